import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinery.operators import chunk
from skeinery.operators.chunk_code import brackets, chunk_code, masked

SMALL = "using System;\nnamespace App.Auth\n{\n    // a { comment\n    [Obsolete(\"}\")]\n    public class Login { string s = \"{\"; void Run() { } }\n}\n"


def members(n, size=300):
    return "\n".join(f"    /* no {{ */\n    public int Method{i}(int x) {{ var s = @\"\"\"}}\"; return x + {i}; // {'y' * size}\n    }}" for i in range(n))


def test_small_class_is_one_chunk():
    [(text, meta)] = chunk_code(SMALL)
    assert text.startswith("// namespace App.Auth\n[Obsolete") and text.endswith("}") and meta == {"namespace": "App.Auth", "type_name": "Login"}


def test_large_class_keeps_its_signature():
    got = chunk_code("namespace A;\npublic sealed class Big<T> : Base where T : new()\n{\n" + members(12) + "\n}\n")
    assert len(got) > 1
    for text, meta in got:
        assert text.startswith("// namespace A\npublic sealed class Big<T> : Base where T : new()\n{\n") and text.endswith("\n}") and len(text) <= 3400
        assert meta["type_name"] == "Big"
    assert ", ".join(m["members"] for _, m in got) == ", ".join(f"Method{i}" for i in range(12))


def test_kinds_and_file_scope():
    got = chunk_code("namespace A.B;\ninterface IX { void M(); }\nenum E { A, B }\npublic record R(int X);\npublic delegate void D<T>(T x);\nrecord struct S { }\n")
    assert [m["type_name"] for _, m in got] == ["IX", "E", "R", "D", "S"] and {m["namespace"] for _, m in got} == {"A.B"}


def test_nested_namespaces_and_types():
    big = "class Inner {\n" + members(12) + "\n}"
    got = chunk_code("namespace A { namespace B { class Outer { int x = 3; " + big + " int Y { get; set; } = 4; } } }")
    assert [(m["namespace"], m["type_name"]) for _, m in got if m["type_name"] == "Inner"][0] == ("A.B.Outer", "Inner")
    outer = [m["members"] for _, m in got if m["type_name"] == "Outer"]
    assert outer == ["x", "Y"]


def test_oversized_member_is_cut_at_lines():
    body = "\n".join(f"        var x{i} = {i}; // some words here" for i in range(400))
    got = chunk_code("class C\n{\n    void Long()\n    {\n" + body + "\n    }\n}\n")
    assert len(got) > 3 and all(t.startswith("class C\n{\n") and len(t) <= 3200 for t, _ in got) and {m["members"] for _, m in got} == {"Long"}


def test_unreadable_source():
    assert chunk_code("class C { void M( { }") is None
    assert chunk_code('class C { string s = "open; }') is None
    assert chunk_code("Console.WriteLine(1);") is None
    assert chunk_code("") is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='class C{}()[];"\'/*\n=@$# xn', max_size=80))
def test_any_source_is_handled(source):
    got = chunk_code(source)
    assert got is None or all(t for t, _ in got)
    if (m := masked(source)) is not None:
        assert len(m[0]) == len(source)
        brackets(m[0])


def pieces(text, budget):
    out, piece = [], ""
    for line in [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]]:
        if piece and len(piece) + len(line) > budget:
            out.append(piece)
            piece = ""
        piece += line
    return out + [piece] * bool(piece.strip())


def test_line_pieces(spark):
    texts = ["", None, "a\nbb\n\nccc\n", "x" * 50 + "\ny", "\n\n\n", "aaaa\n   ", "one"]
    got = {}
    for r in chunk.line_pieces(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 10).orderBy("piece_no").collect():
        got.setdefault(r.id, []).append(r.piece)
    assert got == {i: p for i, t in enumerate(texts) if (p := pieces(t or "", 10))}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=200), st.integers(1, 12))
def test_sentence_windows(text, size):
    assert "".join(chunk.sentences(text)) == text
    got = chunk.sentence_windows(text, size, overlap=size // 3)
    assert all(len(w.split()) <= size for w in got)
    words = text.split()
    assert set(words) == {w for x in got for w in x.split()}


def test_routing(spark):
    files = spark.createDataFrame([("a/x.cs", "x.cs", SMALL), ("a/y.cs", "y.cs", "no types here."), ("z.sln", "z.sln", "One. Two."), ("n", None, None)], "file_path string, file_name string, text string")
    got = {(r.file_path, r.type_name): r for r in chunk.chunks(files).collect()}
    assert set(got) == {("a/x.cs", "Login"), ("a/y.cs", None), ("z.sln", None)}
    assert len({r.node_id for r in got.values()}) == 3 and got["z.sln", None].text == "One. Two."


def test_workers_hold_bounded_batches(spark):
    from pyspark.sql import functions as F

    texts = spark.range(3000, numPartitions=1).select(F.concat("id", F.lit(".txt")).alias("file_path"), F.repeat(F.lit("One two. "), 20).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert chunk.line_pieces(texts, 50).count() == chunk.chunks(texts.withColumn("file_name", F.col("file_path"))).count() == 3000
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(x.n for x in sizes) <= chunk.BATCH_ROWS
