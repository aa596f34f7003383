"""Segments, tombstones and merges; two writers and a reader; the table of embedded texts; blocks of postings; tiles of vectors."""

import os
import random
import re
import time

import numpy as np
import pytest

from skeinery.config import Settings
from skeinery.operators import retrieve
from skeinery.operators.embed import HashedEmbedder, with_embedding
from skeinery.operators.retrieve import build_postings
from skeinery.plans import queries as core
from skeinery.plans.search import HybridEngine
from skeinery.sources.index import IndexBusy, VersionedIndex
from skeinery.sources.vectors import VectorTable

FILES = "file_path string, file_name string, text string"
WORDS = "login mail queue token index vector search chunk file path node score rank query model cache bucket merge".split()


def files(spark, texts):
    return spark.createDataFrame([(p, p.split("/")[-1], t) for p, t in texts.items()], FILES)


def some_text(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, weights=range(1, len(WORDS) + 1), k=n)) + f". Only{seed} here."


class Noted(HashedEmbedder):
    """Writes down which texts it is asked for."""

    def __init__(self, folder, name="noted"):
        super().__init__(64)
        self.folder, self.name = str(folder), name

    def embed(self, texts):
        os.makedirs(self.folder, exist_ok=True)
        with open(os.path.join(self.folder, f"{os.getpid()}-{time.monotonic_ns()}"), "w") as out:
            out.write("\n".join(texts))
        return super().embed(texts)

    def asked(self):
        out = []
        for n in sorted(os.listdir(self.folder)) if os.path.isdir(self.folder) else []:
            with open(os.path.join(self.folder, n)) as f:
                out += f.read().split("\n")
            os.remove(os.path.join(self.folder, n))
        return [t for t in out if t]


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def same(a, b):
    assert rows(a.chunks()) == rows(b.chunks())
    p, q = a.postings(), b.postings()
    assert rows(p.postings) == rows(q.postings) and rows(p.frequencies) == rows(q.frequencies) and rows(p.totals) == rows(q.totals)


def test_updates_read_like_a_full_build(spark, tmp_path):
    r = random.Random(5)
    texts = {f"d{i % 7}/f{i}.txt": some_text(i) for i in range(60)}
    index = VersionedIndex(spark, str(tmp_path / "a"), "x", HashedEmbedder())
    index.build(files(spark, texts))
    counts = []
    for step in range(3):
        for path in r.sample(sorted(texts), 4):
            texts[path] = some_text(1000 + 10 * step + len(texts))
        for path in r.sample(sorted(texts), 3):
            del texts[path]
        texts[f"new/{step}.txt"] = some_text(2000 + step)
        if step == 2:
            texts["d0/f0.txt"] = some_text(0)  # back again, perhaps after a deletion
        assert index.update(files(spark, texts)) == index.current()
        counts.append(len(index.segments()))
    full = VersionedIndex(spark, str(tmp_path / "b"), "x", HashedEmbedder())
    full.build(files(spark, texts))
    assert max(counts) > 1 and min(counts) < 5
    same(index, full)
    asked = spark.createDataFrame([(i, some_text(i, 5)) for i in range(6)], "query_id long, query string")
    found = [rows(HybridEngine.over(i, Settings(bm25_k=5)).search(asked)) for i in (index, full)]
    assert found[0] == found[1]
    assert len(os.listdir(tmp_path / "a" / "segments-x")) >= len(index.segments())


def test_an_update_writes_and_embeds_what_changed(spark, tmp_path):
    texts = {f"f{i:03}.txt": some_text(i, 3000) for i in range(200)}
    embedder = Noted(tmp_path / "noted")
    index = VersionedIndex(spark, str(tmp_path / "i"), "x", embedder)
    index.build(files(spark, texts))
    assert len(embedder.asked()) >= 200
    whole = index.store.size("segments-x")
    texts["f007.txt"] = some_text(7000, 3000)
    texts["f008.txt"] = some_text(8000, 3000)
    index.update(files(spark, texts))
    again = embedder.asked()
    assert again and all("Only7000" in t or "Only8000" in t or "Only" not in t for t in again) and len(again) < 20
    assert index.store.size("segments-x") - whole < 0.04 * whole
    assert len(index.segments()) == 2


def test_merges(spark, tmp_path):
    texts = {f"f{i}.txt": some_text(i) for i in range(12)}
    index = VersionedIndex(spark, str(tmp_path), "x", HashedEmbedder())
    index.build(files(spark, texts))
    for i in range(5):
        texts[f"f{i}.txt"] = some_text(100 + i)
        index.update(files(spark, texts))
    assert len(index.segments()) <= 3
    full = VersionedIndex(spark, str(tmp_path / "full"), "x", HashedEmbedder())
    full.build(files(spark, texts))
    same(index, full)


def test_delete_with_a_pushed_filter(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = {f"f{i:03}.txt": some_text(i) for i in range(100)}
        index = VersionedIndex(spark, str(tmp_path), "x", HashedEmbedder())
        index.build(files(spark, texts))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for paths, pushed in ((["f050.txt"], "EqualTo(file_path,f050.txt)"), (["f050.txt", "f051.txt"], "In(file_path, [f050.txt,f051.txt])")):
        got = index.chunks(paths=paths)
        assert {r.file_path for r in got.collect()} == set(paths)
        plan = got._jdf.queryExecution().executedPlan()
        assert pushed in plan.toString()
        leaf = plan.collectLeaves().apply(0)
        assert leaf.metrics().apply("numOutputRows").value() < 60  # of 100: other files' row groups aren't read
    assert index.delete(["f050.txt", "none"]) == index.current() and index.delete(["f050.txt"]) is None
    assert index.chunks().select("file_path").distinct().count() == 99 and not index.chunks(paths=["f050.txt"]).count()
    del texts["f050.txt"]
    full = VersionedIndex(spark, str(tmp_path / "full"), "x", HashedEmbedder())
    full.build(files(spark, texts))
    same(index, full)


def test_two_writers_and_a_reader(spark, tmp_path):
    first, second = (VersionedIndex(spark, str(tmp_path), "x", HashedEmbedder()) for _ in range(2))
    old = first.build(files(spark, {"a": "One two.", "b": "Three four."}))
    with first.reading() as pinned:
        lazy = pinned.chunks()
        with first.lease():
            with pytest.raises(IndexBusy):
                second.update(files(spark, {"a": "Else."}))
        new = second.update(files(spark, {"a": "Five six.", "b": "Seven."}))
        assert new != old and set(first.versions()) == {old, new}
        assert {r.text for r in lazy.collect()} == {"One two.", "Three four."} and pinned.current() == old
    newest = second.update(files(spark, {"a": "Eight.", "b": "Seven."}))
    assert first.versions() == [newest]
    # A lease that has expired is taken over, and who lost it can't move the pointer.
    with pytest.raises(IndexBusy):
        with first.lease(seconds=-1) as lost:
            second.update(files(spark, {"a": "Nine.", "b": "Seven."}))
            first.promote(newest, newest, lost)
    assert {r.text for r in second.chunks().collect()} == {"Nine.", "Seven."}
    # A mark that has expired keeps nothing.
    with first.reading(seconds=-1):
        last = second.update(files(spark, {"a": "Ten.", "b": "Seven."}))
        assert first.versions() == [last]


def test_a_second_build_embeds_nothing(spark, tmp_path):
    now = iter(range(1, 100))
    table = VectorTable(spark, str(tmp_path / "v"), max_size=30, clock=lambda: next(now))
    texts = {f"f{i}.txt": some_text(i) for i in range(20)}
    one, two = Noted(tmp_path / "one", "org/one:a=1"), Noted(tmp_path / "two", "two")
    index = VersionedIndex(spark, str(tmp_path / "i"), "x", one, vectors=table)
    index.build(files(spark, texts))
    assert len(one.asked()) == 20
    index.build(files(spark, texts), overwrite=True)
    assert one.asked() == [] and table.vectors().count() == 20
    plain = VersionedIndex(spark, str(tmp_path / "j"), "x", HashedEmbedder())
    plain.build(files(spark, texts))
    same(index, plain)
    other = VersionedIndex(spark, str(tmp_path / "k"), "x", two, vectors=table)
    other.build(files(spark, {p: t for p, t in list(texts.items())[:15]}))
    assert len(two.asked()) == 15
    got = {m: n for m, n in table.vectors().groupBy("model_name").count().collect()}
    assert got == {"org/one:a=1": 15, "two": 15}  # 35 over a cap of 30: the oldest five of the first model went
    other.build(files(spark, {p: t for p, t in list(texts.items())[:15]}), overwrite=True)
    assert two.asked() == []
    index.build(files(spark, texts), overwrite=True)
    assert len(one.asked()) == 5 and table.vectors().count() == 30


def test_repeated_and_null_texts_are_embedded_once(spark, tmp_path):
    embedder = Noted(tmp_path / "n")
    table = VectorTable(spark, str(tmp_path / "v"))
    got = table.embedded(spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, "")], "id long, text string"), embedder)
    assert got.columns == ["id", "text", "embedding"] and got.count() == 4
    assert embedder.asked() == ["same"] and table.vectors().count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_bm25_gives_the_same_rows(spark, seed, monkeypatch):
    monkeypatch.setattr(retrieve, "FIRST_BLOCKS", 3)
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    nodes = spark.createDataFrame([(f"n{i}", " ".join(r.choices(vocabulary, weights, k=r.randint(0, 30)))) for i in range(500)], "node_id string, text string")
    asked = spark.createDataFrame([(i, 0, " ".join(r.choices(vocabulary, k=r.randint(1, 6)))) for i in range(40)] + [(90, 0, "none"), (91, 1, "")], "query_id long, variant_no int, variant string")
    flat = build_postings(nodes)
    blocks = retrieve.Blocks(retrieve.in_blocks(flat.postings, flat.frequencies, size=8), flat.frequencies, flat.totals)
    assert blocks.blocks.agg({"n": "max"}).first()[0] < 40  # w0 is in most nodes
    for k in (2, 600):
        assert rows(retrieve.bm25(blocks, asked, k)) == rows(retrieve.bm25(flat, asked, k))
    assert rows(blocks.flat().postings) == rows(flat.postings)


def test_frequent_terms_are_mostly_skipped(spark):
    r = random.Random(0)
    texts = [(f"n{i}", "common " * r.randint(1, 3) + "filler " * r.randint(0, 40) + (f"rare{i % 300}" if i % 3 else "")) for i in range(3000)]
    flat = build_postings(spark.createDataFrame(texts, "node_id string, text string"))
    blocks = retrieve.Blocks(retrieve.in_blocks(flat.postings, flat.frequencies, size=16), flat.frequencies, flat.totals)
    asked = spark.createDataFrame([(i, 0, f"common filler rare{i}") for i in range(1, 30) if i % 3], "query_id long, variant_no int, variant string")
    _, planned = retrieve.bm25_plan(blocks, asked, 3)
    read = {b: n for b, n in planned.groupBy("read").agg({"n": "sum"}).collect()}
    assert read[True] < 0.05 * read[False]
    assert rows(retrieve.bm25(blocks, asked, 3)) == rows(retrieve.bm25(flat, asked, 3))


def test_hits_meet_in_tiles(spark, monkeypatch):
    r = random.Random(3)
    texts = [(f"n{i % 150}", None if i == 7 else " ".join(r.choices("abcdefghij", range(1, 11), k=r.randint(0, 12)))) for i in range(200)]  # 50 nodes have two texts
    asked = [(i, i % 2, " ".join(r.choices("abcdefghijkl", k=3))) for i in range(30)]
    dl, tf = {}, {}
    for node, text in texts:
        words = (text or "").split()
        for w in words:
            tf[w, node, len(words)] = tf.get((w, node, len(words)), 0) + 1
    df = {w: sum(x[0] == w for x in tf) for w, _, _ in tf}
    mean, want = sum(len((t or "").split()) for _, t in texts) / 200, set()
    for q, v, text in asked:
        scores = {}
        for w in set(text.split()) & set(df):
            idf = np.log(1 + (200 - df[w] + 0.5) / (df[w] + 0.5))
            for (t, node, n), f in tf.items():
                if t == w:
                    scores[node] = scores.get(node, 0) + idf * f / (f + 1.5 * (0.25 + 0.75 * n / mean))
        best = sorted((-round(s, 9), node) for node, s in scores.items())[:4]
        want |= {(q, v, node, rank + 1) for rank, (_, node) in enumerate(best)}
    flat = build_postings(spark.createDataFrame(texts, "node_id string, text string"))
    blocks = retrieve.Blocks(retrieve.in_blocks(flat.postings, flat.frequencies, size=8), flat.frequencies, flat.totals)
    queries = spark.createDataFrame(asked, "query_id long, variant_no int, variant string")
    for sizes in ((1024, 4096), (7, 40)):
        monkeypatch.setattr(retrieve, "ASKED_BLOCK", sizes[0])
        monkeypatch.setattr(retrieve, "NODE_BLOCK", sizes[1])
        for index in (flat, blocks):
            got = retrieve.bm25(index, queries, 4)
            assert {(x.query_id, x.variant_no, x.node_id, x["rank"]) for x in got.collect()} == want
    # Nothing is grouped by query and node: such rows are the product of both.
    plan = retrieve.bm25(flat, queries, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and not re.search(r"Aggregate \[query_id#\d+L?, variant_no#\d+, node_id#", plan)


def test_a_text_is_cut_into_terms_once(spark):
    plan = build_postings(spark.createDataFrame([("n", "a b a")], "node_id string, text string")).postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Repartition" in plan


def test_tiles_of_vectors(spark):
    r = np.random.default_rng(4)
    data, queries = r.normal(size=(300, 8)).round(1), r.normal(size=(50, 8)).round(1)
    data[5], data[6], queries[3] = data[4], 0, 0  # ties and zero vectors
    vectors = spark.createDataFrame([(f"n{i:03}", v.tolist()) for i, v in enumerate(data)], "node_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(queries)], "query_id long, variant_no int, embedding array<float>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cosines = np.round(unit(queries.astype(np.float32).astype(float)) @ unit(data.astype(np.float32).astype(float)).T, 9) + 0.0
    want = {(q, rank + 1, f"n{i:03}") for q, row in enumerate(cosines) for rank, i in enumerate(sorted(range(300), key=lambda i: (-row[i], i))[:7])}
    for blocks in ((2048, 8192), (7, 40), (1000, 1)):
        got = {(x.query_id, x.rank, x.node_id) for x in retrieve.knn(vectors, asked, 7, *blocks).collect()}
        assert got == want
    assert retrieve.knn(vectors, asked.limit(0), 7).count() == 0 and retrieve.knn(vectors.limit(0), asked, 7).count() == 0


def test_texts_are_embedded_once(spark, sf, tmp_path):
    plan = core.QUERIES["hashed_embedding"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    embedder = Noted(tmp_path / "n")
    chunks = core.nodes(spark, sf)
    asked = core.asked(spark, sf).limit(2)
    HybridEngine(chunks, build_postings(chunks), embedder, Settings(rerank_candidates=3)).search(asked).collect()
    lines = sum(sum(1 for x in (r.text or "").split("\n") if x) for r in chunks.select("text").collect())
    assert lines <= len(embedder.asked()) < 1.2 * lines  # all once for the vectors, and the few candidates again
    assert with_embedding(chunks, embedder).select("node_id").count() == chunks.count() and embedder.asked() == []


def test_streamed_batches_keep_other_files(spark, tmp_path):
    from skeinery.streaming import ingest

    index = VersionedIndex(spark, str(tmp_path), "x", HashedEmbedder())
    ingest.upsert(index, files(spark, {"a": "One.", "b": "Two."}))
    twice = files(spark, {"a": "Three."}).unionByName(files(spark, {"a": "Four."}))
    ingest.upsert(index, twice)
    kept = {r.file_path: r.text for r in index.chunks().collect()}
    assert kept["b"] == "Two." and kept["a"] in ("Three.", "Four.")
    ingest.upsert(index, twice.orderBy("text"))
    assert {r.file_path: r.text for r in index.chunks().collect()} == kept
