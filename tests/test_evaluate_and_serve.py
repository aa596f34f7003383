import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from skeinery.operators import answer, evaluate
from skeinery.serving import http


def golden(spark, *rows):
    return spark.createDataFrame([(i, f"q{i}", list(r)) for i, r in enumerate(rows)], evaluate.GOLDEN)


def found(spark, *rows):
    return spark.createDataFrame([(i, r, f) for i, own in enumerate(rows) for r, f in enumerate(own, 1)], "query_id long, rank int, file string")


def test_metrics(spark):
    got = evaluate.metrics(found(spark, ["x", "a"], ["x", "y", "z", "b"], []), golden(spark, ["a"], ["b", "c"], ["d"]), k=3).orderBy("query_id").collect()
    assert [(r.recall, r.mrr) for r in got] == [(1.0, 0.5), (0.0, 0.25), (0.0, 0.0)]
    assert got[0].ndcg == pytest.approx(0.63092975) and got[1].ndcg == 0
    assert evaluate.metrics(found(spark, ["a", "b"]), golden(spark, ["b", "a"]), 2).first().ndcg == 1
    with pytest.raises(Exception, match="must not be empty"):
        evaluate.metrics(found(spark, ["a"]), golden(spark, []), 3).collect()


def test_summary_and_ranked_files(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (0, 2, None), (0, 3, "a"), (0, 4, ""), (0, 5, "b")], "query_id long, rank int, file string")
    assert [(r["rank"], r.file) for r in evaluate.ranked_files(rows).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    empty = evaluate.summary(evaluate.metrics(found(spark, ["a"]), golden(spark, ["a"]).filter("false"), 3)).first()
    assert empty.recall is None and empty.n_queries == 0


def test_evaluate_and_report(spark, tmp_path):
    search = lambda queries, k: found(spark, ["a"], ["x"])
    per_query, means = evaluate.evaluate(golden(spark, ["a"], ["b"]), 5, search)
    assert means.first().recall == 0.5 and means.first().mrr == 0.5
    out = io.StringIO()
    evaluate.report(per_query, means, 5, str(tmp_path / "r.json"), out)
    assert "MEAN (2 queries)" in out.getvalue()
    assert json.load(open(tmp_path / "r.json"))["summary"] == {"recall@5": 0.5, "mrr": 0.5, "ndcg@5": 0.5}


def test_golden_file(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"query": "q", "relevant_files": ["a", "b"]}\n\n{"query": "r", "relevant_files": ["c"]}\n')
    assert [(r.query, r.relevant_files) for r in evaluate.load_golden(spark, str(path)).orderBy("query_id").collect()] == [("q", ["a", "b"]), ("r", ["c"])]
    path.write_text('{"query": "q", "relevant_files": ["a"]}\n\n{"query": "", "relevant_files": ["c"]}\n')
    with pytest.raises(ValueError, match=r"g\.jsonl:3"):
        evaluate.load_golden(spark, str(path))


CONTEXT = "query_id long, rank int, file string, path string, score double, text string"


def test_budget(spark):
    rows = spark.createDataFrame([(0, r, "f", "p", 0.5, "w " * n) for r, n in ((1, 3), (2, 9), (3, 1))], CONTEXT)
    kept = lambda n: [r["rank"] for r in answer.with_budget(rows, n).orderBy("rank").collect()]
    assert kept(0) == [1] and kept(8) == [1] and kept(100) == [1, 2, 3] and kept(16) == [1]


def test_ask(spark):
    one = spark.createDataFrame([(0, 1, "f.cs", "a/f.cs", 0.5, "class F { }")], CONTEXT)
    prompts = []
    assert answer.ask("how does it work", lambda q, k: one, lambda p: prompts.append(p) or "fine", spark) == "fine"
    assert len(prompts) == 1 and "class F" in prompts[0] and "Say where" in prompts[0]  # flow with one context is locate
    assert answer.ask("x", lambda q, k: one.filter("false"), lambda p: "fine", spark) == answer.NOTHING

    def broken(prompt):
        raise RuntimeError("down")

    assert answer.ask("x", lambda q, k: one, broken, spark).startswith("LLM error: down\n\nContext was:\n[1] f.cs")


@pytest.fixture
def url():
    def query(q):
        if q == "boom":
            raise RuntimeError("went wrong")
        return {"answer": q, "sources": [], "context": []}

    server = http.server(query, port=0, max_bytes=200)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def post(url, body):
    try:
        with urllib.request.urlopen(urllib.request.Request(url + "/search", body)) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_service(url):
    assert json.load(urllib.request.urlopen(url + "/health")) == {"status": "ok"}
    assert post(url, b'{"query": "x"}') == (200, {"answer": "x", "sources": [], "context": []})
    assert post(url, b'{"query": " "}')[0] == 200
    for body in (b"{}", b"no json", b'{"query": ["x"]}', b'{"query": ""}', b"[1]"):
        assert post(url, body)[0] == 400
    assert post(url, b'{"query": "boom"}') == (500, {"error": "went wrong"})
    assert post(url, b" " * 300)[0] == 413


def test_client_never_raises(url):
    assert http.search_code("x", url)["answer"] == "x"
    assert "500" in http.search_code("boom", url)["error"]
    assert "hint" in http.search_code("x", "http://127.0.0.1:9", timeout=2)
    tool = http.tools(url)["search_codebase"]
    assert tool["call"]("x")["answer"] == "x" and tool["input_schema"]["required"] == ["query"]
