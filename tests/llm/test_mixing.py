import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skeinery.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_are_shared_out(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    got = mixing.shared_targets(sizes, weights, 1.5, 2.0)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))
    free = [g / w for g, w, s in zip(got, weights, sizes) if g < 2 * s - 1e-9]
    assert all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes))
    assert all(x == pytest.approx(free[0]) for x in free)
    assert all(2 * s <= free[0] * w + 1e-6 for g, w, s in zip(got, weights, sizes) if free and g >= 2 * s - 1e-9)


def check(rows, texts):
    by_source = defaultdict(list)
    for r in rows:
        assert r[0] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert 0 <= r.copies <= 2
        by_source[r.source].append(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[0] for r in by_source[s]) for s in names]
    want = mixing.shared_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for s, size, t in zip(names, sizes, want):
        own = by_source[s]
        assert {r.source_size for r in own} == {size} and own[0].target == pytest.approx(t)
        assert abs(sum(r.copies * r[0] for r in own) - t) <= 2 * max(r[0] for r in own) + 1e-6
    return by_source


def test_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs.select("doc_id", "source", "text")).select("size", "doc_id", "source", "source_size", "target", "copies").collect()
    assert len(got) == docs.count()
    by_source = check(got, {r.doc_id: r.text for r in docs.collect()})
    again = mixing.mix(docs.select("doc_id", "source", "text").repartition(7)).select("doc_id", "copies").collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for own in by_source.values() for r in own}
    mixed = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for own in by_source.values() for r in own if r.copies})
    assert mixing.mixed(docs).columns == docs.columns


def test_odd_rows(spark):
    rows = [(i, "word " * (i % 7), ("b", "a", None, "é")[i % 4], "x") for i in range(200)] + [(900, None, "b", None), (901, "", "only", "x"), (None, "a b", "a", "x"), (5, "w", "b", "x"), (5, "w", "b", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "size", "_size", "source_size", "target", "copies"]
    got = got.collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies * r[4]
    for r in got:
        assert abs(taken[r.source] - r.target) <= 14
    assert not mixing.mix(docs.filter("false")).count() and not mixing.mixed(docs.filter("false")).count()


def test_a_hot_source_of_copies(spark):
    docs = spark.createDataFrame([(i, "a b c", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, salts=8).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += 3 * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 3 for s, t in target.items())
