import math

import numpy as np
import pytest

from skeinery.llm import neighbours as nn
from skeinery.llm import queries


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % 50 == 0:
            c = [(-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), i) for i, b in ok if i != q]
            out[q] = [(i, -s) for s, i in sorted(c)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_chi_square_quantile():
    assert nn.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)
    assert nn.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-6)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = found(nn.nearest(table, lambda i: i % 50 == 0, cell_rows=300))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, pairs in got.items():
        assert pairs == sorted(pairs, key=lambda x: (-x[1], x[0]))


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(i, [2.0, 0.0]) for i in range(10, 400) if i != 50] + [(50, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(nn.nearest(table, lambda i: i % 50 == 0, cell_rows=60, max_cells=3))
    assert [i for i, _ in got[0]] == [10, 11, 12, 13, 14] and all(s == 1.0 for _, s in got[0])
    assert [i for i, _ in got[100]] == [0, 10, 11, 12, 13]
    few = spark.createDataFrame(rows[:2] + [(7, [1.0, 1.0])], table.schema)
    assert [i for i, _ in found(nn.nearest(few, lambda i: i % 50 == 0))[0]] == [7]
    assert nn.nearest(table.filter("false"), lambda i: i % 50 == 0).count() == 0


def test_the_most_frequent_width_is_taken(spark):
    rng = np.random.default_rng(8)
    rows = [(900, [1.0, 2.0]), *((i, rng.standard_normal(4).tolist()) for i in range(60)), (901, [1.0, 2.0, 3.0])]
    got = found(nn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), lambda i: i % 50 == 0))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in brute(rows[1:-1]).items()}
    even = rows[:1] + rows[1:2] + [(50, [2.0, 1.0]), (2, [0.0, 1.0, 1.0, 0.0])]
    assert {q: [i for i, _ in x] for q, x in found(nn.nearest(spark.createDataFrame(even, "vec_id long, embedding array<double>"), lambda i: i >= 50)).items()} == {50: [900], 900: [50]}


def test_huge_tiny_and_repeated_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(6) * s).tolist()) for i in range(120) for s in [[1e200, 1e-200, 1.0][i % 3]]]
    rows += [(50, rows[50][1])] * 9 + [(7, rows[50][1])] * 3
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nn.nearest(table, lambda i: i % 50 == 0, cell_rows=40))
    assert [i for i, _ in got[50]][:3] == [7, 7, 7] and all(s == s and s <= 1 + 1e-12 for x in got.values() for _, s in x)
    plain = [(i, list(np.array(v) / np.abs(v).max())) for i, v in rows]
    want = brute(plain)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    with pytest.raises(ValueError):
        nn.nearest(table.withColumnRenamed("vec_id", "rank"), lambda i: i > 0, id_column="rank")


def test_cells_split_all_points():
    points = np.random.default_rng(1).standard_normal((5000, 4))
    cells = nn.Cells(points, 16)
    own = cells.of(points)
    assert len(cells.low) == 16 and np.bincount(own, minlength=16).min() > 200
    for c in range(16):
        assert ((points[own == c] >= cells.low[c]) & (points[own == c] <= cells.high[c])).all()
    assert all(own[i] in cells.within(points[i], 0.0) for i in range(0, 5000, 100)) and len(cells.within(points[0], np.inf)) == 16
    assert (nn.Cells(np.zeros((50, 4)), 8).of(np.ones((3, 4))) == 0).all() and (nn.Cells(np.zeros((0, 4)), 8).of(points) == 0).all()


def test_cells_of_equal_points_stay_whole_while_others_split():
    points = np.concatenate([np.zeros((500, 3)), np.random.default_rng(2).standard_normal((300, 3)) + 9])
    cells = nn.Cells(points, 8)
    own = cells.of(points)
    assert len(cells.low) == 8 and np.bincount(own, minlength=8).max() == 500


def exact(rows, k=5):
    """By the definition, with the operator's own measure: parallel vectors differ in its last bits."""
    ids, v = np.array([i for i, _ in rows]), nn.scaled(np.array([v for _, v in rows]))
    n, out = nn.lengths(v), {}
    for i, q, norm in zip(ids.tolist(), v, n.tolist()):
        if i % 50 == 0:
            c = nn.cosine(v, n, q, norm)
            out[i] = sorted(((j, s) for j, s in zip(ids.tolist(), c.tolist()) if j != i), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_parallel_vectors(spark):
    rng = np.random.default_rng(3)
    line = rng.standard_normal(8)
    rows = [(i, (line * (0.37 + i)).tolist()) for i in range(200)] + [(i, rng.standard_normal(8).tolist()) for i in range(200, 400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(nn.nearest(table, lambda i: i % 50 == 0, cell_rows=100)), exact(rows)
    assert {q: got[q] for q in (0, 50, 100, 150)} == {q: want[q] for q in (0, 50, 100, 150)} and got.keys() == want.keys()


def test_queries_are_dealt_into_bounded_parts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(600)] + [(50, rng.standard_normal(6).tolist()) for _ in range(80)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole, parts = (sorted(map(tuple, nn.nearest(table, lambda i: i % 50 == 0, cell_rows=150, query_rows=n).collect())) for n in (4096, 4))
    assert whole == parts and sum(1 for x in whole if x[0] == 50) == 81 * 5


def test_the_registered_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got, want = found(queries.op8_nearest_neighbours(spark, sf)), brute([(r.vec_id, r.embedding) for r in table.collect()])
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))
    score = {(q, i): s for q, x in want.items() for i, s in x}
    assert all(abs(score[q, i] - s) < 1e-9 for q, x in got.items() for i, s in x if (q, i) in score)
