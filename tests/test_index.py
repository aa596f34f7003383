import os

import pytest
from pyspark.sql import functions as F

from skeinery.config import Settings, load
from skeinery.operators import cache, catalog, manifest
from skeinery.operators.embed import HashedEmbedder
from skeinery.plans.search import Cached, HybridEngine, documents
from skeinery.sources import files
from skeinery.sources.index import IndexMissing, VersionedIndex
from skeinery.streaming import ingest

FILES = "file_path string, file_name string, text string"


def rows(*pairs):
    return [(p, p.split("/")[-1], t) for p, t in pairs]


def test_settings():
    assert load(env={}).suffixes == ("implementation",)
    got = load(env={"QUERY_VARIANT_SUFFIXES": "a, ,b c", "rerank_candidates": "7"}, top_k=3)
    assert got.suffixes == ("a", "b c") and got.rerank_candidates == 7 and got.top_k == 3


def test_diff(spark):
    m = lambda *x: spark.createDataFrame(list(x), "file_path string, file_hash string")
    got = {r.file_path: r.status for r in manifest.diff(m(("a", "1"), ("b", "1"), ("c", None), ("d", "1")), m(("a", "1"), ("b", "2"), ("c", "3"), ("e", "1"))).collect()}
    assert got == {"b": "changed", "c": "changed", "d": "deleted", "e": "new"}
    assert {r.status for r in manifest.diff(m(), m(("a", "1"))).collect()} == {"new"}


def test_catalog(spark):
    names = ["demo-20260101-000000", "demo-20260102-000000", "demo-eval-20260101-000000", "demo"]
    collections = spark.createDataFrame([(n,) for n in names], "name string")
    aliases = spark.createDataFrame([("live", names[1])], "alias string, target string")
    assert {r.name for r in catalog.swept(collections, aliases, "demo", names[1]).collect()} == {names[0], "demo"}
    taken = aliases.unionByName(spark.createDataFrame([("demo", names[0])], aliases.schema))
    assert {r.name for r in catalog.swept(collections, taken, "demo", names[1]).collect()} == {names[0]}
    asked = spark.createDataFrame([("live",), ("demo",), ("none",)], "name string")
    assert {r.name: r.active for r in catalog.resolve_active(collections, aliases, asked).collect()} == {"live": names[1], "demo": "demo", "none": None}


def test_cache(spark):
    embedder = HashedEmbedder()
    empty = spark.createDataFrame([], cache.SCHEMA)
    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    out, after = cache.get_many(texts, empty, embedder, now=1)
    assert out.count() == 3 and after.count() == 2 and not cache.lookup(texts, empty, embedder.name).filter("hit").count()
    after = spark.createDataFrame(after.collect(), cache.SCHEMA)
    _, later = cache.get_many(spark.createDataFrame([("ccc",), ("a",)], "text string"), after, embedder, now=2, max_size=2)
    kept = {r.text_hash for r in later.collect()}
    assert kept == {r.h for r in spark.createDataFrame([("a",), ("ccc",)], "t string").select(F.sha2("t", 256).alias("h")).collect()}
    other = cache.lookup(texts, after, "another").filter("hit")
    assert other.count() == 0


@pytest.fixture
def index(spark, tmp_path):
    return VersionedIndex(spark, str(tmp_path / "index"), "demo", HashedEmbedder())


def test_build_search_update(spark, index):
    first = spark.createDataFrame(rows(("a/login.txt", "User login checks the password. " * 3), ("b/mail.txt", "Mail delivery queue."), ("c/gone.txt", "Old words.")), FILES)
    with pytest.raises(IndexMissing):
        index.chunks()
    version = index.build(first)
    assert index.current() == version and index.versions() == [version]
    with pytest.raises(FileExistsError):
        index.build(first)
    assert index.update(first) is None
    second = spark.createDataFrame(rows(("a/login.txt", "User login checks the password. " * 3), ("b/mail.txt", "Mail delivery by pigeon."), ("d/new.txt", "Fresh words.")), FILES)
    newer = index.update(second)
    assert index.versions() == [newer] != [version]
    got = {r.file_path: r.text for r in index.chunks().collect()}
    assert set(got) == {"a/login.txt", "b/mail.txt", "d/new.txt"} and "pigeon" in got["b/mail.txt"]
    full = VersionedIndex(spark, index.root + "2", "demo", HashedEmbedder())
    full.build(second)
    key = lambda i: sorted((r.node_id, r.text) for r in i.chunks().collect())
    assert key(full) == key(index)

    engine = HybridEngine(index.chunks(), index.postings(), index.embedder, Settings())
    asked = spark.createDataFrame([(1, "login password"), (2, "pigeon mail")], "query_id long, query string")
    best = {r.query_id: r.file for r in engine.search(asked).filter("rank = 1").collect()}
    assert best == {1: "login.txt", 2: "mail.txt"}
    docs = {r.query_id: r for r in documents(engine.search(asked), asked).collect()}
    assert docs[1].answer.startswith("Top 3 ") and docs[1].sources == sorted(docs[1].sources) and [c["rank"] for c in docs[1].context] == [1, 2, 3]
    flipped = HybridEngine(index.chunks(), index.postings(), index.embedder, Settings(), cross_encoder=lambda qs, ts: [9.0 if "Fresh" in t else -9.0 for t in ts])
    assert {r.file for r in flipped.search(asked).filter("rank = 1").collect()} == {"new.txt"}

    calls = []
    cached = Cached(lambda: (index.current(), calls.append(1) or engine), size=2)
    for q in ("q1", "q2", "q1", "q3"):
        cached.query(q)
    assert {k[1] for k in cached.kept} == {"q1", "q3"}


def test_failed_build_leaves_nothing(spark, index, monkeypatch):
    good = spark.createDataFrame(rows(("a.txt", "Words.")), FILES)
    version = index.build(good)
    bad = good.withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        index.build(bad, overwrite=True)
    assert index.current() == version and index.versions() == [version]


def test_file_scan(spark, tmp_path):
    for name in ("a.cs", "src/b c+d.cs", "src/bin/no.cs", "build/no.cs", "x/build/yes.sln", "no.txt", ".git/no.cs"):
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text of {name}\nline 2")
    got = {r.file_path: (r.file_name, r.text) for r in files.load(spark, str(tmp_path / "repo")).collect()}
    assert set(got) == {"a.cs", "src/b c+d.cs", "x/build/yes.sln"}
    assert got["src/b c+d.cs"] == ("b c+d.cs", "text of src/b c+d.cs\nline 2")


def test_stream(spark, index, tmp_path):
    where = str(tmp_path / "in")
    spark.createDataFrame(rows(("a.txt", "One."), ("b.txt", "Two.")), FILES).coalesce(1).write.parquet(where)
    ingest.run(index, ingest.read_files(spark, where), str(tmp_path / "cp")).awaitTermination()
    first = index.current()
    spark.createDataFrame(rows(("a.txt", "Three.")), FILES).coalesce(1).write.mode("append").parquet(where)
    ingest.run(index, ingest.read_files(spark, where), str(tmp_path / "cp")).awaitTermination()
    assert index.current() != first and {r.file_path: r.text for r in index.chunks().collect()} == {"a.txt": "Three.", "b.txt": "Two."}


def test_no_unsafe_loading():
    import skeinery

    root = os.path.dirname(skeinery.__file__)
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".py"):
                source = open(os.path.join(folder, n), encoding="utf-8").read()
                assert not any(x in source for x in ("pickle.load", "torch.load", "marshal.load", "yaml.load("))
