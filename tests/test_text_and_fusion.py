import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skeinery.functions import text as T
from skeinery.functions import vectors as V
from skeinery.operators import fuse


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_expand_and_suffixes(spark):
    row = one(spark, a=T.expand_query(F.lit("q"), ["x", "y z"]), b=T.expand_query(F.lit("q"), []), c=T.parse_suffixes(F.lit(" a b,, c ,")))
    assert row.a == ["q", "q x", "q y z"] and row.b == ["q"] and row.c == ["a b", "c"]


@pytest.mark.parametrize(
    "question, mode",
    [("Where is login?", "locate"), ("How does it run", "flow"), ("show me", "flow"), ("a bug in x", "debug"), ("the classes", "explain"), ("how located", "locate")],
)
def test_modes(spark, question, mode):
    assert one(spark, m=T.detect_mode(F.lit(question))).m == mode


def test_mode_fallback_and_instructions(spark):
    row = one(spark, a=T.mode_fallback(F.lit("flow"), F.lit(2)), b=T.mode_fallback(F.lit("debug"), F.lit(0)), c=T.mode_fallback(F.lit("flow"), F.lit(3)), d=T.instruction(F.lit("no")))
    assert (row.a, row.b, row.c, row.d) == ("locate", "debug", "flow", "")


def test_names_and_sections(spark):
    row = one(
        spark,
        a=T.qualify(F.lit("n"), F.lit("c")),
        b=T.qualify(F.lit(""), F.lit("c")),
        c=T.namespace_prefix(F.lit(None).cast("string")),
        d=T.section(F.lit(1), F.lit("f"), F.lit("p"), F.lit(0.5), F.lit("t")),
        e=T.is_code_file(F.lit(None).cast("string")),
        f=T.is_code_file(F.lit("X.cshtml.cs")),
    )
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("n.c", "c", "", "[1] f (p) score=0.5\nt", False, True)


def test_cosine(spark):
    array = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    row = one(spark, same=V.cosine(array(1, 2), array(2, 4)), right=V.cosine(array(1, 0), array(0, 1)), zero=V.cosine(array(0, 0), array(0, 1)))
    assert row.same == pytest.approx(1) and row.right == 0 and row.zero == 0


def lists(spark, rows, weights):
    ranked = spark.createDataFrame([(0, n, r, x) for n, own in enumerate(rows) for r, x in enumerate(own, 1)], "query_id long, list_no int, rank int, node_id string")
    return ranked, spark.createDataFrame([(0, n, float(w)) for n, w in enumerate(weights)], "query_id long, list_no int, weight double")


def fused(spark, rows, weights):
    return {r.node_id: r.rrf for r in fuse.rrf(*lists(spark, rows, weights)).collect()}


def test_rrf(spark):
    assert fused(spark, [["a"], ["a"], ["a"]], [1.5, 1, 1]) == {"a": 1.0}
    got = fused(spark, [["A", "B", "C"], ["B", "D", "A"]], [1, 1])
    assert sorted(got, key=got.get, reverse=True) == ["B", "A", "D", "C"]
    assert got["A"] == pytest.approx((1 / 61 + 1 / 63) / (2 / 61))
    got = fused(spark, [["a"], ["b"]], [2, 1])
    assert got["a"] == pytest.approx(2 / 3) and got["b"] == pytest.approx(1 / 3)
    assert fused(spark, [["a"], []], [1, 1])["a"] == pytest.approx(0.5)  # an empty list stays in the denominator
    assert fused(spark, [["a", "a"]], [1])["a"] == pytest.approx(1 + 61 / 62)


def test_cut_keeps_first_seen_order(spark):
    got = fuse.cut(fuse.rrf(*lists(spark, [["x", "y"], ["z"], ["y", "x"]], [1, 1, 1])), 2).orderBy("cand_rank").collect()
    assert [r.node_id for r in got] == ["x", "y"]


def test_blends(spark):
    n = F.lit(None).cast("double")
    row = one(
        spark, a=fuse.blend_cosine(F.lit(0.5), F.lit(1.0), 1), b=fuse.blend_cosine(F.lit(0.5), F.lit(1.0), 0), c=fuse.blend_cosine(F.lit(0.5), n), d=fuse.blend_cross_encoder(F.lit(0.0), n, 1), e=fuse.blend_cross_encoder(F.lit(9.0), F.lit(0.25), 0)
    )
    assert row == Row(a=0.5, b=1.0, c=pytest.approx(0.35), d=0.5, e=0.25)


def test_top_k_breaks_ties_by_candidate_rank(spark):
    rows = spark.createDataFrame([(0, "a", 0.5, 2), (0, "b", 0.5, 1), (0, "c", 0.9, 3)], "query_id long, node_id string, score double, cand_rank int")
    assert [r.node_id for r in fuse.top_k(rows, 2).orderBy("rank").collect()] == ["c", "b"]
