import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinery.llm import graph, simhash

UPPER = {i: i + 32 for i in range(65, 91)}


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBÉé \t\n\x0b\x0c\r\x1c\x85", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def components(fps):
    """{fp: smallest fp reachable} by brute force; fps signed."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(set(fps))
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in own}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_connect_all_that_are_near(spark):
    r = random.Random(4)
    fps = [signed(r.getrandbits(64)) for _ in range(60)]
    for _ in range(500):
        f = r.choice(fps) & (2**64 - 1)
        for _ in range(r.randint(1, 3)):
            f ^= 1 << r.randrange(64)
        fps.append(signed(f))
    fps += [0, -1, -(2**63), 2**63 - 1]
    links = simhash.links(spark.createDataFrame([(f,) for f in set(fps)], "fp long"))
    assert all(((x.u ^ x.v) & (2**64 - 1)).bit_count() <= 2 for x in links.collect())
    got = {x.node: x.root for x in graph.connected_components(links).collect()}
    want = components(fps)
    assert {f: got.get(f, f) for f in want} == want


def test_every_six_positions_have_one_list():
    free = [f for own in simhash._free_positions() for f in own]
    assert len(free) == len(set(free)) == 28 and all(f.bit_count() == 2 for f in free)


def test_long_lists_are_whole_and_not_paired_out(spark, monkeypatch):
    """3,000 fingerprints share six bytes (every pair reaches the tally), and half of them differ from the rest in a seventh."""
    r = random.Random(5)
    low = r.sample(range(1 << 16), 1500)
    fps = [signed(0xABCDEF0123450000 | x) for x in low] + [signed(0xABCDEF0123450000 ^ (0xFF << 40) | x) for x in low]
    rows, write = {}, simhash.materialise

    def counted(df, tag, keep=False):
        got = write(df, tag, keep)
        rows[tag] = got.count()
        return got

    monkeypatch.setattr(simhash, "materialise", counted)
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(8))
    found = links.collect()
    assert len(found) <= 65 * len(fps) and rows["four-bytes"] <= 6 * len(fps) and rows["six-bytes"] <= 28 * len(fps)
    got = {x.node: x.root for x in graph.connected_components(spark.createDataFrame([(x.u, x.v) for x in found], "u long, v long")).collect()}
    want = components(fps)
    assert {f: got.get(f, f) for f in want} == want


def test_a_very_long_text_and_clashing_names(spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(1, long, 5, 6, 7), (2, long + " more", 5, 6, 7), (3, "short text of its own", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root long, first long, component_id long")
    got = {x.doc_id: (x.component_id, x.fp) for x in simhash.near_duplicates(docs).collect()}
    assert {d: f for d, (_, f) in got.items()} == {r[0]: signed(plain(r[1])) for r in rows}
    assert {d: c for d, (c, _) in got.items()} == {1: 1, 2: 1, 3: 3}
    assert [x.doc_id for x in simhash.representatives(docs).orderBy("doc_id").collect()] == [1, 3]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {x.node: x.root for x in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: signed(plain(t)) for d, t in texts.items()}
    roots, first = components(fps.values()), {}
    for d in sorted(fps):
        first.setdefault(roots[fps[d]], d)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp, r.component_id) for r in got} == {d: (f, first[roots[f]]) for d, f in fps.items()} and len(got) == len(fps)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values()))


def test_odd_rows(spark):
    rows = [(3, None, "x"), (1, "", "x"), (2, " \n", "x"), (7, "one two", "x"), (7, "one two", "x"), (7, "quite another text of words", "x"), (None, "nobody has an id here", "x"), (None, "nor here, in other words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(3, 1), (1, 1), (2, 1), (7, 7), (7, 7), (7, 7), (None, None), (None, None)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in simhash.representatives(docs).collect()), key=repr)
    assert kept == sorted([(1, ""), (7, "one two"), (7, "quite another text of words"), (None, "nobody has an id here"), (None, "nor here, in other words")], key=repr)
    assert simhash.near_duplicates(docs.filter("false")).count() == 0
