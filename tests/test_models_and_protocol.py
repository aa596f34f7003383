"""Models over tables, the tool protocol, the evaluation command, and cuts between lines."""

import io
import json
import os
import subprocess
import sys
import textwrap

from hypothesis import given, settings
from hypothesis import strategies as st

from skeinery import __main__ as commands
from skeinery.config import Settings
from skeinery.operators import chunk, models
from skeinery.operators.retrieve import build_postings
from skeinery.operators.embed import HashedEmbedder
from skeinery.plans.search import HybridEngine
from skeinery.serving import protocol

MODEL = """
import os
FOLDER = {folder!r}
def shout():
    open(os.path.join(FOLDER, f"load-{{os.getpid()}}-{{os.urandom(4).hex()}}"), "w").close()
    def call(inputs):
        if any("bad" in x for x in inputs):
            raise ValueError("a bad one")
        return [x.upper() for x in inputs]
    return call
def overlap():
    return lambda pairs: [len(set(q.split()) & set(t.split())) for q, t in pairs]
"""


def registered(tmp_path, monkeypatch, spark):
    folder = tmp_path / "models"
    folder.mkdir()
    name = f"own_models_{os.getpid()}_{abs(hash(str(tmp_path)))}"
    (folder / f"{name}.py").write_text(MODEL.format(folder=str(folder)))
    spark.sparkContext.addPyFile(str(folder / f"{name}.py"))
    monkeypatch.syspath_prepend(str(folder))
    return folder, name


def test_prompts_in_answers_out(spark, tmp_path, monkeypatch):
    folder, name = registered(tmp_path, monkeypatch, spark)
    rows = [(i, None if i % 10 == 3 else "bad" if i == 7 else "word " * (i % 40) + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(6)
    got = {r.id: r for r in models.complete(df, f"{name}:shout", token_budget=50).collect()}
    for i, p in rows:
        assert (got[i].answer, got[i].error) == ((None, None) if p is None else (None, "a bad one") if p == "bad" else (p.upper(), None))
    workers = [n.split("-")[1] for n in os.listdir(folder) if n.startswith("load-")]
    assert workers and len(workers) == len(set(workers))  # one load a worker, however many partitions and batches


def test_token_batches():
    got = models.token_batches([5, 1, 1, 100, 2], 10)
    assert sorted(i for b in got for i in b) == [0, 1, 2, 3, 4] and [3] in got
    assert all(len(b) * max([5, 1, 1, 100, 2][i] for i in b) <= 10 or len(b) == 1 for b in got)
    assert models.token_batches([], 10) == []


def test_questions_and_cross_encoder(spark, tmp_path, monkeypatch):
    _, name = registered(tmp_path, monkeypatch, spark)
    chunks = spark.createDataFrame([("n1", "Login.cs", "a/Login.cs", "login checks the password"), ("n2", "Mail.cs", "a/Mail.cs", "bad mail queue")], "node_id string, file_name string, file_path string, text string")
    engine = HybridEngine(chunks, build_postings(chunks), HashedEmbedder(), Settings(rerank_candidates=1))
    asked = spark.createDataFrame([(1, "login password", None), (2, "mail queue", "locate")], "query_id long, query string, mode string")
    got = {r.query_id: r for r in models.ask_all(asked, engine.search, f"{name}:shout").collect()}
    assert "LOGIN CHECKS THE PASSWORD" in got[1].answer and got[1].n_contexts == 1
    assert got[2].answer.startswith("LLM error: a bad one\n\nContext was:\n") and got[2].mode == "locate"
    empty = HybridEngine(chunks.limit(0), build_postings(chunks.limit(0)), HashedEmbedder(), Settings())
    assert {r.answer for r in models.ask_all(asked, empty.search, f"{name}:shout").collect()} == {"No relevant code found."}
    pairs = spark.createDataFrame([("a b", "b c"), ("a", None)], "query string, text string")
    assert sorted(r.logit for r in models.logits(pairs, f"{name}:overlap").collect()) == [0.0, 1.0]


def said(*requests):
    out = io.StringIO()
    offer = lambda url: {"find": {"description": "d", "input_schema": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}, "call": call}}

    def call(query):
        if query == "raise":
            raise RuntimeError("inside")
        return {"error": "down"} if query == "down" else {"answer": query}

    protocol.serve([r if isinstance(r, str) else json.dumps(r) for r in requests], out, offer=offer)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def request(method, number=1, **params):
    return {"jsonrpc": "2.0", "id": number, "method": method, "params": params}


def test_protocol():
    got = said(request("initialize"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, request("tools/list", "x"), request("ping", 3), "")
    assert [g["id"] for g in got] == [1, "x", 3]
    assert got[0]["result"]["capabilities"] == {"tools": {}} and got[1]["result"]["tools"][0]["name"] == "find" and got[2]["result"] == {}
    call = lambda query: said(request("tools/call", name="find", arguments={"query": query}))[0]
    assert call("q")["result"] == {"content": [{"type": "text", "text": '{"answer": "q"}'}], "isError": False}
    assert call("down")["result"]["isError"] is True
    assert call("raise")["error"] == {"code": protocol.INTERNAL, "message": "RuntimeError: inside"}


def test_protocol_errors():
    codes = [
        ("no json", protocol.PARSE),
        ("[1]", protocol.REQUEST),
        ({"id": 1, "method": "ping"}, protocol.REQUEST),
        (request("none"), protocol.METHOD),
        ({"jsonrpc": "2.0", "id": 1, "method": "ping", "params": [1]}, protocol.PARAMS),
        (request("tools/call", name="none"), protocol.PARAMS),
        (request("tools/call", name=["find"]), protocol.PARAMS),
        (request("tools/call", name="find"), protocol.PARAMS),
        (request("tools/call", name="find", arguments={"query": 1}), protocol.PARAMS),
        (request("tools/call", name="find", arguments={"query": "q", "more": 1}), protocol.PARAMS),
    ]
    assert [g["error"]["code"] for g in said(*[r for r, _ in codes])] == [c for _, c in codes]


def test_protocol_in_a_process():
    lines = "\n".join(json.dumps(r) for r in (request("initialize"), request("tools/call", 2, name="search_codebase", arguments={"query": "x"})))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "skeinery", "serve-tools", "--url", "http://127.0.0.1:9"], input=lines, capture_output=True, text=True, cwd=root, timeout=60)
    got = [json.loads(x) for x in done.stdout.splitlines()]
    assert [g["id"] for g in got] == [1, 2] and got[1]["result"]["isError"] and done.returncode == 0


def test_evaluate_command(spark, tmp_path):
    folder = tmp_path / "code"
    folder.mkdir()
    (folder / "Login.cs").write_text("namespace A { public class Login { public bool Check(string password) { return password != null; } } }")
    (folder / "Mail.cs").write_text("namespace A { public class Mail { public void Deliver() { } } }")
    golden = tmp_path / "golden.jsonl"
    golden.write_text('{"query": "check password login", "relevant_files": ["Login.cs"]}\n\n{"query": "deliver mail", "relevant_files": ["Mail.cs", "None.cs"]}\n')
    run = lambda *words: commands.run(spark, commands.parser().parse_args(["--root", str(tmp_path / "i"), "--name", "c", *words]), Settings())
    run("build", str(folder))
    got = run("evaluate", "--golden", str(golden), "--k", "3", "--out", str(tmp_path / "report.json"))
    assert got["recall@3"] == 0.75 and got["mrr"] == 1.0 and got["queries"] == 2
    report = json.loads((tmp_path / "report.json").read_text())
    assert [r["query"] for r in report["per_query"]] == ["check password login", "deliver mail"] and report["summary"]["recall@3"] == 0.75


def folded(text, budget):
    """Line by line."""
    lines = text.split("\n")
    kept = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    out, now = [], ""
    for line in kept:
        if now and len(now) + len(line) > budget:
            out.append(now)
            now = line
        else:
            now += line
    return [*out, now] if now.strip(" \t\n\x0b\f\r") else out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t\r", max_size=60), st.integers(1, 12))
def test_pieces_are_a_fold_over_lines(text, budget):
    assert chunk.pieces_of(text, budget) == folded(text, budget)


def test_a_long_text_is_cut_in_linear_time():
    text = textwrap.fill("word " * 100, 80) * 40_000  # 20 MB
    got = chunk.pieces_of(text, 80)
    assert len(text) > 19_000_000 and "".join(got) == text and len(got) > 200_000
