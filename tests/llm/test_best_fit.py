import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skeinery.llm import best_fit, byte_tokens, queries
from skeinery.llm.byte_tokens import PieceIds, slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
IDS = PieceIds(PATH)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB'strevmld.,!()1 é\n\t\x0b\x1c\x85\xa0²ª_ÉĀ§<|"), st.characters(codec="utf-8")), max_size=40))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(IDS([text])[0], "<u4").tolist() == plain(text)


def test_special_tokens_mark_and_long_texts():
    text = "a <|endoftext|> b. C's"
    assert np.frombuffer(IDS([text])[0], "<u4").tolist() == plain(text)
    long = "some words, and  double blanks \n" * 70_000
    assert len(list(slices(long))) > 1 and "".join(slices(long)) == long
    assert np.frombuffer(IDS([long])[0], "<u4").tolist() == plain(long)
    assert list(slices("x" * 3_000_000)) == ["x" * 3_000_000]  # nowhere to cut


def test_words_in_use_stay_in_memory_and_few_strings_are_encoded(monkeypatch):
    monkeypatch.setattr(byte_tokens, "REMEMBERED", 400)
    ids, strings = PieceIds(PATH), []
    encode = ids.encode
    monkeypatch.setattr(ids, "encode", lambda texts: strings.extend(texts) or encode(texts))
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    common = " ".join("common" + letters(i) for i in range(100, 150))
    for k in range(40):
        rare = [f"{letters(1000 * (k + 1) + i)}{end}" for i, end in enumerate(["", ".", ",\nNext", "é", ".)", "'s"] * 8)]
        text = f"{common} {' '.join(rare)}\nLine{letters(k)} {rare[0]} end"
        assert np.frombuffer(ids([text])[0], "<u4").tolist() == plain(text)
    assert sum(" commonbbb " in f"{x} " for x in strings) == 1
    assert len(strings) < 40 * 12


def used(groups, window):
    out = Counter()
    for pattern, n in groups.items():
        assert best_fit.filled(pattern) <= window and n >= 0
        for a, m in pattern:
            out[a] += m * n
    return +out


HISTOGRAM = st.dictionaries(st.integers(1, 63), st.integers(1, 50), min_size=1, max_size=40)


@settings(max_examples=80, deadline=None)
@given(HISTOGRAM, st.integers(0, 9))
def test_every_step_uses_each_piece_once(counts, seed):
    r = np.random.default_rng(seed)
    a, b = best_fit.best_fit(counts, 64), best_fit.best_fit(counts, 64, None, best_fit.shuffled(counts, r, 0.5))
    child = best_fit.crossover(a, b, counts, 64, r)
    for groups in (a, b, child, best_fit.mutate(child, 64, r)):
        assert used(groups, 64) == Counter(counts)
        assert best_fit.fitness(groups)[0] >= best_fit.lower_bound(counts, 64)


def test_groups_fit_as_single_pieces_would():
    """Best fit on groups against best fit of one piece after another."""
    r = np.random.default_rng(3)
    for _ in range(30):
        counts = {int(a): int(r.integers(1, 9)) for a in r.integers(1, 64, 12)}
        rooms: list[int] = []
        for a in sorted(counts, reverse=True):
            for _ in range(counts[a]):
                fits = [x for x in rooms if x >= a]
                rooms.remove(min(fits)) if fits else None
                rooms.append((min(fits) if fits else 64) - a)
        got = Counter()
        for pattern, n in best_fit.best_fit(counts, 64).items():
            got[64 - best_fit.filled(pattern)] += n
        assert got == Counter(rooms)


def optimum(pieces, window):
    """Fewest bins, by search."""
    pieces = sorted(pieces, reverse=True)
    best = [len(pieces)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for room in sorted({x for x in rooms if x >= pieces[i]}):
            j = rooms.index(room)
            put(i + 1, [*rooms[:j], room - pieces[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, window - pieces[i]])

    put(0, [])
    return best[0]


def test_evolution_beats_best_fit_and_meets_small_optima():
    r = np.random.default_rng(7)
    better = 0
    for seed in range(40):
        pieces = r.integers(8, 40, 12).tolist()
        counts = dict(Counter(pieces))
        bound = best_fit.lower_bound(counts, 64)
        first = best_fit.fitness(best_fit.best_fit(counts, 64))[0]
        got = best_fit.fitness(best_fit.evolve([], counts, 64, bound, seed, 8, 60)[0])[0]
        assert bound <= optimum(pieces, 64) == got
        better += got < first
    assert better


def test_elites_migrate_and_the_plan_is_whole(spark):
    r = np.random.default_rng(1)
    counts = {int(a): int(r.integers(1, 30)) for a in r.integers(20, 250, 60)}
    groups = best_fit.plan(spark, counts, 256, islands=3, rounds=2, population=4, children=6)
    assert used(groups, 256) == Counter(counts)
    alone = best_fit.fitness(best_fit.best_fit(counts, 256))
    assert best_fit.fitness(groups) <= alone
    assert best_fit.plan(spark, {}, 256) == {}


def check(pieces, docs, window=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert 1 <= r.length <= window
    ids = {i: plain(t) + [2] for i, t in docs}
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids[i]) // window) and all(r.length == window for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_sequence)


def test_registered_query(spark, sf):
    got = queries.op11_best_fit_packing(spark, sf)
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = check(got.collect(), docs)
    rests = Counter((len(plain(t)) + 1) % 1024 for _, t in docs)
    full = sum((len(plain(t)) + 1) // 1024 for _, t in docs)
    del rests[0]
    assert n - full <= 1.02 * best_fit.lower_bound(rests, 1024) + 1


def test_defined_cases(spark):
    base = [(1, None), (2, ""), (3, "word " * 63 + "x"), (4, "one two three " * 900), (5, "same"), (6, "same"), (7, "same")]
    exact = next("a" + " b" * n for n in range(1000, 1050) if len(plain("a" + " b" * n)) == 1023)
    base.append((8, exact))
    docs = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in base], "doc_id long, text string, rest string, piece int, task int").repartition(3)
    got = best_fit.pack(docs, PATH, rounds=1, islands=2)
    check(got.collect(), base)
    whole = {tuple(r.ids) for r in best_fit.sequences(got, docs, PATH).collect()}
    assert sum(map(len, whole)) == sum(len(plain(t)) + 1 for _, t in base) and all(len(x) <= 1024 for x in whole)
    repeated = spark.createDataFrame([(1, "twice"), (1, "twice"), (None, "none")], "doc_id long, text string")
    assert best_fit.pack(repeated, PATH, rounds=1, islands=2).count() == 3
    assert best_fit.pack(docs.limit(0), PATH).count() == 0


def test_ranks_need_no_task_to_see_a_whole_length(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "'the same text everywhere' AS text").repartition(5)
    got = best_fit.pack(docs, PATH, window=16, rounds=1, islands=2)
    n = len(plain("the same text everywhere")) + 1
    rows = got.collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 600 == len(rows)
    assert len({r.sequence_id for r in rows}) == -(-600 // (16 // n))


def test_a_bound_for_large_pieces():
    assert best_fit.lower_bound({40: 10}, 64) == 10
    assert best_fit.lower_bound({33: 4, 31: 4}, 64) == 4
    with pytest.raises(StopIteration):
        next(iter(best_fit.placed({})[0]))
