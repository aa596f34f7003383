import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from skeinery.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs, min_chars=6, min_count=5, ratio=5, every=199):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= ratio * n[w] else None for w, v in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=1, max_size=7), max_size=60), st.integers(0, 2))
def test_merged_tries_find_all_pairs_once(words, depth):
    words = sorted(w for w in words if len(w) >= depth)
    for begin in {w[:depth] for w in words}:
        own = [w for w in words if w[:depth] == begin]
        got = [tuple(sorted(p)) for p in spelling.merged(own, depth)]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if one_edit(own[i], own[j])}


def test_long_words_and_texts_in_slices():
    deep = "ab" * 5000
    assert len(list(spelling.merged(sorted([deep, deep[:-1], deep[:5000] + deep[5001:], deep + "x"]), 3))) == 3
    text = ("Étude, Fo" + "o" * 999 + " ") * 3000 + "B" * 2_500_000 + "É中ß"
    got = [run for part in spelling.runs(text) for run in part]
    assert b"".join(got) == b"".join(r.encode().lower() for r in RUN.findall(text)) and len(got) == len(RUN.findall(text))


def test_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert rows(queries.op13_spelling_variants(spark, sf)) == want
    assert sum(1 for w in want if w[1]) > 3


def test_groups_that_are_split_lose_no_pair(spark):
    """Tries of at most five words, a hot beginning and a hot end, and words of one letter repeated."""
    words = {f"comput{x}{y}" for x in "abcde" for y in ("", "r", "rs", "é")} | {f"{x}{y}ations" for x in "abcd" for y in ("", "m", "mm")} | {"a" * k for k in range(6, 14)}
    words |= {"aaaaab", "aaaaba", "baaaaa", "computing", "cmputing", "xcomputing"}
    docs = [(k, " ".join(w for i, w in enumerate(sorted(words)) for _ in range(1 + 4 * (i % 3 == 0)))) for k in range(5)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    for most in (5, 20_000):
        assert rows(spelling.group_variants(table, most=most)) == want
    want = brute(docs, min_chars=3, min_count=6, ratio=2, every=7)
    assert rows(spelling.group_variants(table, min_chars=3, min_count=6, ratio=2, every=7, most=5)) == want


def test_chains_of_forms(spark):
    counts = {"colours": 5, "colour": 25, "colou": 700, "colouur": 5, "colouurs": 5, "colors": 26}
    docs = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = rows(spelling.group_variants(spark.createDataFrame(docs, "doc_id long, text string"), every=10**9))
    assert got == brute(docs, every=10**9)
    assert ("colouurs", None, "colouurs", 5, 2, None) in got and any(w == "colouur" and r != "colouur" for w, _, r, *_ in got)


def test_defined_cases(spark):
    schema = "doc_id long, text string, word string, n long, form string, group string"
    docs = [(1, None), (2, ""), (None, "Zebras zebras"), (3, "zebras ZEBRAS ÉTUDES études"), (3, "zebras ZEBRAS ÉTUDES études"), (4, "zebra4zebra × a÷b " + "zebras " * 3)]
    table = spark.createDataFrame([(*d, "w", 1, "f", "g") for d in docs], schema)
    assert rows(spelling.group_variants(table)) == brute(docs)
    assert spelling.group_variants(table.limit(0)).count() == 0
    assert spelling.group_variants(table, min_count=10**6).count() == 0
