"""Commands, the guard on opening, a chunker of one's own, candidates of ``holders``, and what queries leave behind."""

import json

import pytest
from pyspark.sql import functions as F

from skeinery import __main__ as commands
from skeinery.config import Settings, load
from skeinery.operators import evaluate
from skeinery.operators.embed import HashedEmbedder
from skeinery.operators.retrieve import build_postings
from skeinery.plans import queries as core
from skeinery.plans.search import HybridEngine
from skeinery.sources.index import IndexMissing, VersionedIndex

FILES = "file_path string, file_name string, text string"


def test_commands(spark, tmp_path, capsys):
    folder = tmp_path / "code"
    folder.mkdir()
    (folder / "Login.cs").write_text("namespace A { public class Login { public bool Check(string password) { return password != null; } } }")
    (folder / "Mail.cs").write_text("namespace A { public class Mail { public void Deliver() { } } }")

    def said(*words):
        args = commands.parser().parse_args(["--root", str(tmp_path / "index"), "--name", "c", *words])
        return commands.run(spark, args, Settings())

    with pytest.raises(IndexMissing):
        said("query", "password")
    built = said("build", str(folder))
    assert built["changed"] and not said("build", str(folder))["changed"]
    assert said("build", str(folder), "--full")["version"] != built["version"]
    found = said("query", "check password", "--top-k", "1")
    assert found["sources"] == ["Login.cs"]
    json.dumps(found)
    assert "check password" in said("ask", "check password")["answer"]
    assert said("ask", "check password", "--model", "builtins:len")["answer"] > 100


def test_empty_index_is_refused(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path), "none", HashedEmbedder())
    index.build(spark.createDataFrame([], FILES))
    with pytest.raises(IndexMissing):
        HybridEngine.over(index)


def test_own_chunker_and_totals(spark, tmp_path):
    def whole(files):
        kept = files.select("file_path", "file_name", F.sha2("text", 256).alias("file_hash"), F.lit(0).alias("chunk_no"), "text")
        return kept.withColumn("node_id", F.col("file_path"))

    index = VersionedIndex(spark, str(tmp_path), "own", HashedEmbedder(), chunker=whole)
    index.build(spark.createDataFrame([("a", "a", "One two two."), ("b", "b", "..."), ("c", "c", None)], FILES))
    assert {r.node_id for r in index.chunks().collect()} == {"a", "b", "c"}
    want, got = build_postings(index.chunks()), index.postings()
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows(got.totals) == rows(want.totals) == [(1.0, 3)]
    assert rows(got.frequencies) == rows(want.frequencies) and rows(got.postings) == rows(want.postings)


def test_holders_is_contains(spark):
    files = [("f1", "a b c d e f g h"), ("f2", "xa b c d e fy"), ("f3", "b  c d"), ("f4", None), ("f5", ""), ("f6", "a b c d e f g h a b c d e f"), ("f7", "a b c\nd e f g")]
    items = [(1, "a b c d e f"), (2, "b c"), (3, "a b c d e f g h"), (4, ""), (5, None), (6, "b  c"), (7, " c d e f g "), (8, "a b c d e  f"), (9, "b c d e f g h a")]
    got = evaluate.holders(spark.createDataFrame(files, "file_name string, text string"), spark.createDataFrame(items, "query_id long, query string"))
    want = sorted((i, f) for i, q in items for f, t in files if q is not None and t is not None and q in t)
    assert sorted((r.query_id, r.file_name) for r in got.collect()) == want


def test_queries_cache_nothing(spark, sf):
    spark.catalog.clearCache()
    core.QUERIES["bm25_topk"](spark, sf).count()
    core.QUERIES["hybrid_search"](spark, sf).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_environment_prefix():
    assert load(env={"ALPHA": "0.1", "TOP_K": "3", "PORT": "81"}) == load(env={"PORT": "81"})
    assert load(env={"SKEINERY_ALPHA": "0.1"}).alpha == 0.1


def test_holders_scans_once(spark, monkeypatch):
    files = spark.createDataFrame([(f"f{i}", f"text {i} of many words, number {i % 7} é") for i in range(50)] + [("n", None)], "file_name string, text string")
    items = [(1, "number 3"), (2, "é"), (3, "text 4"), (4, "none"), (5, ""), (6, "text 4"), (7, None)]
    asked = spark.createDataFrame(items, "query_id long, query string")
    want = sorted((i, q, r.file_name) for i, q in items for r in files.collect() if q is not None and r.text is not None and q in r.text)
    got = evaluate.holders(files, asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(evaluate, "AUTOMATON_BYTES", 5)
    assert sorted(map(tuple, evaluate.holders(files, asked).collect())) == want
