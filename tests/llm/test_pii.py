import re

from hypothesis import given, settings
from hypothesis import strategies as st

from skeinery.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.-+ ()5é\n%", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_real_forms():
    text = "é x a.b@c.example.com, 1.2.3.4 300.1.1.1 or 4111 1111 1111 1111, +1 (632) 555-4827; 4111111111111112"
    assert [(k, text[s:e]) for k, s, e in pii.base_spans(text)] == [
        (0, "a.b@c.example.com"),
        (1, "1.2.3.4"),
        (2, "4111 1111 1111 1111"),
        (3, "+1 (632) 555-4827"),
    ]


def test_patterns_are_linear():
    assert pii.base_spans("1" * 300_000) == []
    assert pii.base_spans("a" * 300_000 + "@") == []


def test_field_finds_held_out_forms_and_leaves_other_numbers():
    model = pii.trained()
    right = wrong = missed = 0
    for text, pieces in pii.examples(300, seed=99):
        words, at, gold = [], 0, set()
        for t, p in pieces:
            s, e = pii.trimmed(text, at, at + len(p))
            if t >= 0:
                gold.add((t, s, e))
            for x in p.split(" "):
                words.append((at, at + len(x)))
                at += len(x) + 1
        got = set(model.best(text, words))
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


def test_added_spans_touch_no_base_span():
    text = "call (632) 555-4827 or jane [at] mail [dot] com, not 2020-01-02, but +1 (632) 555-4827"
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, pii.trained())
    assert [(k, text[s:e]) for k, s, e in added] == [(3, "(632) 555-4827"), (0, "jane [at] mail [dot] com")]


def test_query_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.co a@b.co", "x"), (3, "a@b.co a@b.co", "x"), (None, "5" * 70_000, "x")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    assert [len(r[3]) for r in got] == [0, 0, 2, 2, 0] and got[0].asDict()["base"] == "x"
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spelled_marks_in_any_case_are_offered():
    for text in ("jane [at] mail [dot] com", "jane [At] mail [Dot] com", "jane (aT) mail (dOT) com"):
        assert [list(r) for r in pii.regions(text)] == [list(r) for r in pii.regions("jane [at] mail [dot] com")] != []


def test_a_long_region_takes_little_memory():
    """One region of 40,000 numbers: what the field keeps is bytes for each word, and the patterns keep nothing."""
    import tracemalloc

    text = " ".join(str(7919 * i % 100003) for i in range(40_000))
    model = pii.trained()
    pii._features.cache_clear()
    pii.added_spans(text[:3000], [], model)
    tracemalloc.start()
    words = next(iter(pii.regions(text)))
    assert len(words) == 40_000 and len(words.at) * 8 <= 16 * 40_000
    part = pii.Words(words[i] for i in range(3000))
    model.best(text, part)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 90 << 20
    assert pii.base_spans("1 " * 3_000_000) == []


def test_the_registered_query(spark, sf):
    import hashlib

    from skeinery.llm import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_pii(spark, sf).collect():
        found = [(pii.KINDS[k], a, b) for k, a, b in plain(texts[r.doc_id])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in found) for kind in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert {(k, int(s), int(e)) for k, s, e in spans} >= set(found)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))
