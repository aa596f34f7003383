import hashlib
import math

import numpy as np
import pytest

from skeinery.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Whole numbers of Python alone."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(1024 * x) for x in np.array(v, np.float32).tolist()] for _, v, _ in kept]
    width = len(whole[0]) // parts
    cut = [[w[p * width : (p + 1) * width] for w in whole] for p in range(parts)]
    books = [own[:entries] for own in cut]

    def assign(p):
        gaps = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in books[p]] for x in cut[p]]
        return [(g.index(min(g)), min(g)) for g in gaps]

    for _ in range(rounds):
        for p in range(parts):
            codes = [k for k, _ in assign(p)]
            new = []
            for k, old in enumerate(books[p]):
                own = [x for x, c in zip(cut[p], codes) if c == k]
                new.append([sum(col) // len(own) for col in zip(*own)] if own else old)
            books[p] = new
    coded = [assign(p) for p in range(parts)]
    errors = [sum(coded[p][n][1] for p in range(parts)) for n in range(len(kept))]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{coded[p][n][0]:02x}" for p in range(parts)), errors[n], total[label], digest) for n, (i, _, label) in enumerate(kept))


def coded(df, **options):
    got, books = vector_codes.compress(df, **options)
    return sorted((str(r.id), "".join(f"{c:02x}" for c in r.codes), r.error, r.label_error, vector_codes.digest(books)) for r in vector_codes.with_label_error(got).collect())


def random_rows(n, dims, seed=0):
    r = np.random.default_rng(seed)
    return [(int(i), r.normal(size=dims).astype(np.float32).tolist(), int(i) % 3 or None) for i in r.permutation(n)]


def test_registered_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op12_vector_codes(spark, sf)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == brute(rows)


def test_many_tasks_and_blocks_agree(spark, monkeypatch):
    rows = random_rows(400, 8)
    want = brute(rows, entries=16)
    df = spark.createDataFrame(rows, SCHEMA)
    assert coded(df.repartition(7), entries=16) == want
    assert coded(df.coalesce(1), entries=16) == want


def test_ties_repeats_nulls_and_clashing_columns(spark):
    rows = [(i, [float(i % 2)] * 8, None) for i in range(6)] + [(3, [0.5] * 8, 1), (3, [-0.5] * 8, 1), (None, [0.25] * 8, 1)]
    rows += [(90, None, 1), (91, [1.0] * 7 + [None], 1), (92, [float("nan")] * 8, 1), (93, [float("inf")] * 8, None)]
    df = spark.createDataFrame([(*r, "x", 0, 1) for r in rows], SCHEMA + ", error string, codes int, id int")
    assert coded(df) == brute(rows)
    assert coded(df, entries=3) == brute(rows, entries=3)
    assert coded(df.limit(0)) == []
    assert coded(spark.createDataFrame([*rows, (94, [1.0] * 4, 1), (95, [], 1)], SCHEMA)) == brute(rows)


def test_large_components(spark):
    rows = [(i, [x * (i + 1) for x in (200_000.0, -3.5, 0.001, -200_000.0)], 1) for i in range(1)] + [(5, [-262_143.0, 1e-30, 7.25, 100.0], 1)]
    assert coded(spark.createDataFrame(rows, SCHEMA), entries=1, rounds=2) == brute(rows, entries=1, rounds=2)
    with pytest.raises(Exception, match="too large"):
        coded(spark.createDataFrame([(1, [1e9] * 4, 1)], SCHEMA))
    with pytest.raises(ValueError, match="divide"):
        coded(spark.createDataFrame([(1, [1.0] * 6, 1)], SCHEMA))


def test_narrow_numbers_give_the_same_distances():
    r = np.random.default_rng(2)
    columns, book = r.integers(-2000, 2000, (16, 700)).astype(np.int32), r.integers(-2000, 2000, (20, 16))
    index, error = vector_codes.nearest(columns, book)
    gaps = ((columns.T[:, None, :].astype(np.int64) - book[None]) ** 2).sum(axis=2)
    assert (index == gaps.argmin(axis=1)).all() and (error == gaps.min(axis=1)).all()
    wide, _ = vector_codes.nearest(columns * 40_000, book * 40_000)
    assert (wide == index).all()


def test_decoding_is_near(spark):
    df = spark.createDataFrame(random_rows(200, 8, 5), SCHEMA)
    got, books = vector_codes.compress(df, entries=200)
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    for r in vector_codes.decode(got, books).collect():
        gap = np.array(r.vector) - np.array(vectors[r.id])
        assert (gap * gap).sum() <= 2 * r.error / 1024**2 + 1e-4
