import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skeinery.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
IDS = packing.WordIds(PATH)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB'st.,!()1 é\n\t\x1c\x85́ Σσßİ<|"), st.characters(codec="utf-8")), max_size=40))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(IDS([text])[0], "<u4").tolist() == plain(text)


def test_special_tokens_marks():
    text = "a <|endoftext|> b. C's"
    assert np.frombuffer(IDS([text])[0], "<u4").tolist() == plain(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 50), max_size=40))
def test_a_plan_uses_every_tail_once(counts):
    used = Counter()
    for pattern, n in packing.plan(counts, 64):
        assert sum(a * m for a, m in pattern) <= 64 and n > 0
        for a, m in pattern:
            used[a] += m * n
    assert used == Counter(counts)


def test_least_squares_meet_a_histogram():
    counts = {10: 100, 54: 80, 20: 30, 22: 30, 2: 20}
    combos = packing.combinations_filling(counts, 64)
    x = packing.solve_nnls(combos, counts, sweeps=500)
    assert (x >= 0).all() and (10, 54) in combos and (20, 22, 22) in combos
    # Of a least-squares solution under x >= 0: no column still points along the error, and those in use are at right angles to it.
    left = Counter({a: float(n) for a, n in counts.items()})
    for c, v in zip(combos, x):
        for a in c:
            left[a] -= v
    for c, v in zip(combos, x):
        slope = sum(left[a] for a in c)
        assert slope < 0.5 and (v == 0 or abs(slope) < 0.5)


def check(pieces, docs, window=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    padding = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    want = Counter(d for d, _ in docs)
    assert {d: sum(r.start == 0 for r in rs) for d, rs in by_doc.items()} == want
    for d, text in {d: t for d, t in docs if want[d] == 1}.items():
        ids, at = [*plain(text), 1], 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    return padding


def test_pieces_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pieces = packing.pack(docs, PATH).collect()
    padding = check(pieces, [tuple(r) for r in docs.collect()])
    assert padding < 0.02 * sum(r.length for r in pieces)


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 90)) for i in range(60)], "doc_id long, text string")
    pieces = packing.pack(docs, PATH, window=64)
    got = {r.sequence_id: r.ids for r in packing.sequences(pieces, docs, PATH, window=64, pad_id=0).collect()}
    assert sum(x != 0 for ids in got.values() for x in ids) == sum(r.length for r in pieces.collect())
    assert all(len(x) == 64 or len(x) & (len(x) - 1) == 0 for x in got.values())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (5, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(packing.pack(docs, PATH).collect(), rows)
    assert packing.pack(docs.filter("false"), PATH).count() == 0
    many = spark.createDataFrame([(i, "same text") for i in range(3000)], "doc_id long, text string")
    check(packing.pack(many, PATH, window=64).collect(), [(i, "same text") for i in range(3000)], 64)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs, texts = packing.WordIds(path), Tokenizer.from_file(path), ["Hello, World  the\nquick", "", "ab c."]
    assert not ours.by_words and packing.WordIds(PATH).by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in ours(texts)] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_frequent_words_outlast_what_is_forgotten(monkeypatch):
    """Words that every batch has are encoded once, however often the memory is full."""
    monkeypatch.setattr(packing, "REMEMBERED", 400)
    ids, given = packing.WordIds(PATH), Counter()
    letters = ids.learn_letters

    def counted(words, tokenizer):
        given.update(words)
        letters(words, tokenizer)

    monkeypatch.setattr(ids, "learn_letters", counted)
    often = ["alpha", "Beta,", "gamma.", "über"]
    for batch in range(30):
        names = ["".join(chr(97 + int(d)) for d in str(1000 * batch + i)) + "q" for i in range(1, 120)]
        texts = [" ".join([*often, *names]), "don't stop... B. X,y"]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids(texts)] == [plain(t) for t in texts]
    assert [given[w] for w in ("alpha", "beta", "gamma", "über")] == [1, 1, 1, 1]
    assert len(ids.known) + len(ids.older) < 1000


def test_lower_case_letters_reach_the_model_as_they_are():
    assert IDS.bare is not IDS.tokenizer
    words = ["the", "s", "re", "don", "startoftext", "x" * 300, *("".join(p) for p in zip("qzjxk", "aeiou", "zzzzz"))]
    assert [i for w in words for i in IDS.bare.encode(w).ids] == [i for w in words for i in plain(w)]
    kind = {"normalizer": {"normalizers": [{"type": "Replace", "pattern": {"String": "a"}, "content": "b"}]}}
    assert not packing._leaves_letters(kind) and not packing._leaves_letters({})
