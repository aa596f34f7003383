import string
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from skeinery.llm import line_dedup, queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, kept_text string"


def brute(rows, min_chars, min_docs):
    low = -(2**63)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(low if d is None else d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= min_docs and max(h) != (low if d is None else d) for x in lines]
        out.append((d, len(lines), sum(gone), t if not any(gone) else "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def ours(docs, *args, **kw):
    got = line_dedup.dedup_lines(docs, *args, **kw)
    kept, n, dropped = got.columns[-3:]
    return sorted(((r.doc_id, r[n], r[dropped], r[kept]) for r in got.collect()), key=repr)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.execute(queries.ORACLE_SQL["op4_line_dedup"]).df()[["doc_id", "n_lines", "n_dropped", "kept_sha256"]].values.tolist()))
    got = queries.op4_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want and sum(r.n_dropped for r in got) > 0


def test_odd_rows(spark):
    rows = [(i, f"  SAME line É\t\nown {i}\nsame LINE É\n\nshort\n" + "x" * i, "clash") for i in range(12)]
    rows += [(None, "same line É\nnull", "c"), (None, "same line É", "c"), (3, "same line É\nother text", "c"), (3, "same line É\nother text", "c"), (90, None, None), (91, "", None), (92, "\n\n", None), (93, "own 1\nown 1", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for least, many in ((6, 3), (1, 2), (100, 1)):
        assert ours(docs, least, many, batches=3) == brute(rows, least, many)
    assert ours(docs.filter("false")) == []
    assert line_dedup.dedup_lines(docs).columns == ["doc_id", "text", "kept_text", "_kept_text", "n_lines", "n_dropped"]


def test_a_very_long_text(spark):
    long = "\n".join(f"line number {i} of a long text" for i in range(30_000))
    rows = [(i, long) for i in range(5)]
    got = ours(spark.createDataFrame(rows, "doc_id long, text string"), 10, 5)
    assert [(r[0], r[2]) for r in got] == [(0, 30_000), (1, 30_000), (2, 30_000), (3, 30_000), (4, 0)] and got[0][3] == "" and got[4][3] == long


def test_runs_are_levelled_and_compacted(spark):
    runs = line_dedup.LineRuns(spark)
    docs = spark.createDataFrame([(i, f"common line\nline {i % 4}\nown {i}") for i in range(28)], "doc_id long, text string")
    lines = line_dedup.hashed_lines(docs, 1).persist()
    for b in range(7):
        runs.add(lines.filter(F.col("doc") % 7 == b))
    assert [len(x) for x in runs.levels] == [1, 1, 1] and [len(x) for x in runs.additions] == [0, 1, 1]
    # The anti-joins keep a line in the one run that saw it first: without them rows repeat, and so do those of the totals.
    rows = [(r.h1, r.h2) for r in runs.read().collect()]
    assert len(rows) == len(set(rows)) == 33
    totals = runs.totals().collect()
    assert len(totals) == 33 and sorted(r.n for r in totals)[-5:] == [7, 7, 7, 7, 28] and max(r.keeper for r in totals) == 27
    with line_dedup.in_written_order(spark):
        plan = runs.totals()._jdf.queryExecution().sparkPlan().toString() + runs.totals()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    lines.unpersist()
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("skeinery_")]
