import importlib

import corpus_pipeline as P
from skeinery.llm import mixing, packing, queries, simhash
from skeinery.llm._common import materialise

from .test_line_dedup import brute as lines_brute
from .test_packing import PATH, check
from .test_similar import kept_by_brute_force


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before = docs.collect()
        docs = materialise(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        kept[name] = (before, docs.collect())
    before, after = kept["toxicity"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) > 0.8 * len(before)
    before, after = kept["line_dedup"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted((d, t) for d, _, _, t in lines_brute([(r.doc_id, r.text) for r in before], 40, 5))
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = kept["simhash_near_dedup"]
    assert sorted(r.doc_id for r in after) == kept_by_brute_force([(r.doc_id, r.text) for r in before])
    before, after = kept["mixing"]
    again = mixing.mixed(spark.createDataFrame(before, docs.schema))
    assert sorted(map(tuple, after)) == sorted(map(tuple, again.collect())) and {r.doc_id for r in after} <= {r.doc_id for r in before}
    pieces = P.STAGES[-1][1](spark, docs, sf).collect()
    check(pieces, [(r.doc_id, r.text) for r in docs.collect()])


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op") and x[2].isdigit()} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and PATH and packing and simhash
