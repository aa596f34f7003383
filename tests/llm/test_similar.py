import random
import threading

import pytest

import corpus_pipeline as P
from skeinery.llm import similar
from skeinery.llm._common import materialise, scratch_scope
from skeinery.llm.graph import connected_components


def cut(text, words=5):
    import re

    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1)) or frozenset([tuple(found)] if found else [])


def kept_by_brute_force(rows):
    """Smallest doc_id of each component of the documents at 0.8 or more."""
    sets = {d: cut(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(sets)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted({find(d) for d in own})


def planted():
    """Copies of texts with words changed far apart, above and below 0.8, a chain, and texts with half of their words in common."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for n, changed in ((100, 1), (100, 3), (500, 5), (500, 10), (500, 20), (2000, 40)):
        for _ in range(6):
            text = [word() for _ in range(n)]
            copy = list(text)
            for i in range(changed):
                copy[(2 * i + 1) * n // (2 * changed)] = word()
            rows += [text, copy]
    link = [word() for _ in range(300)]
    for i in range(30):
        link = list(link)
        link[10 * i] = word()
        rows.append(link)
    common = [word() for _ in range(60)]
    rows += [common + [word() for _ in range(60)] for _ in range(40)]
    r.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)] + [(900, None), (901, " \n"), (902, "two words"), (903, "Two  words")]


def test_the_stage_drops_copies_at_most_a_fifth_apart(spark, sf):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_brute_force(rows)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf) if name == "simhash_near_dedup" else docs
    assert sorted(x.doc_id for x in docs.collect()) == want and len(want) < len(rows) - 50


@pytest.mark.parametrize("most", [2, 16])
def test_components(spark, most):
    rows = planted()
    got = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()
    assert len(got) == len(rows) and sorted({x.component_id for x in got}) == kept_by_brute_force(rows)


def test_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {x.component_id for x in similar.near_duplicates(docs).collect()}
    assert sorted(got) == kept_by_brute_force([(x.doc_id, x.text) for x in docs.collect()])
    assert similar.near_duplicates(docs.filter("false")).count() == 0
    repeated = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "g h", "z"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, node string")
    assert sorted((str(x.doc_id), str(x.component_id)) for x in similar.near_duplicates(repeated).collect()) == [("1", "1"), ("1", "1"), ("2", "2"), ("3", "2"), ("None", "None")]


def short_texts():
    """Pairs of few words with the last one changed, some of them linked, in a small vocabulary."""
    r = random.Random(9)
    rows = []
    for n in range(1, 40):
        for _ in range(3):
            text = [f"w{r.randrange(50)}" for _ in range(n)]
            rows += [text, [*text[:-1], "other"], ["other", *text]]
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def test_short_texts(spark):
    rows = short_texts()
    got = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=3).collect()
    assert sorted({x.component_id for x in got}) == kept_by_brute_force(rows)


def template(n, changes, seed, base=200):
    """Texts of one template with some of its words changed, each in its own places."""
    r = random.Random(seed)
    words = [f"t{i}" for i in range(base)]
    rows = []
    for _ in range(n):
        own = list(words)
        for at in r.sample(range(base), r.choice(changes)):
            own[at] = f"w{r.randrange(10**9)}"
        rows.append(own)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def test_a_template_and_a_passage_that_many_share(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    r = random.Random(3)
    rows = template(150, range(1, 16), 1)
    rows += [(1000 + i, " ".join([f"a{r.randrange(10**9)}" for _ in range(r.randrange(5, 90))]) + " " + passage + (" end" if i % 7 else "")) for i in range(150)]
    rows += [(2000 + i, "one text that a third of all rows are " * 3) for i in range(150)]
    got = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=4).collect()
    want = kept_by_brute_force(rows)
    assert sorted({x.component_id for x in got}) == want and 100 < len(want) < len(rows) - 170


def test_work_on_a_template_grows_with_its_texts(spark, monkeypatch):
    """Candidates of texts just below 0.8: as many times more as there are texts."""
    seen = []
    write = similar.materialise

    def counted(df, tag, keep=False):
        out = write(df, tag, keep)
        if tag in ("tallied", "led", "pairs-apart"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(similar, "materialise", counted)
    total = []
    for n in (100, 400):
        seen.clear()
        got = similar.near_duplicates(spark.createDataFrame(template(n, range(9, 17), 2), "doc_id long, text string"))
        assert got.select("component_id").distinct().count() == n
        total.append(sum(seen))
    assert total[0] < 100 and total[1] < 400  # of 4,950 and 79,800 pairs


def test_scopes_of_two_threads_are_apart(spark):
    """A query's end doesn't delete what another thread's query has written."""
    ready, done = threading.Event(), threading.Event()
    got = []

    def other():
        with scratch_scope(spark):
            table = materialise(spark.range(5), "thread")
            ready.set()
            done.wait(60)
            got.append(table.count())

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    with scratch_scope(spark):
        materialise(spark.range(3), "thread")
    done.set()
    thread.join()
    assert got == [5]


def test_partial_components_join_only_what_is_connected(spark):
    """A chain and a star: after one round a component may have several roots, but no root is in two components."""
    chain, star = [(i, i + 1) for i in range(40)], [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame(chain + star, "u long, v long")
    got = {x.node: x.root for x in connected_components(edges, rounds=1, partial=True).collect()}
    assert sorted(got) == [*range(41), *range(100, 130)]
    assert all((node < 100) == (root < 100) for node, root in got.items()) and {got[x] for x in range(100, 130)} == {100}
    assert len({x.root for x in connected_components(edges).collect()}) == 2


def long_copies():
    r = random.Random(6)
    rows = []
    for _ in range(5):
        text = [f"w{r.randrange(10**6)}" for _ in range(3000)]
        rows += [" ".join(text), " ".join([*text[:-1], "other"])]
    return list(enumerate(rows))


def test_the_stage_links_by_fingerprints(spark, sf, monkeypatch):
    """Texts in few bits meet and are linked without the index of shingles; those that fingerprints join wrongly are not."""
    rows = [*long_copies(), (50, "a b c d e"), (51, "A b  c d e f"), (52, "")]
    tallied, near = similar._tallied, []
    monkeypatch.setattr(similar, "_tallied", lambda lists, similarity: tallied(lists, similarity).filter("false"))
    by_fingerprint = similar.by_fingerprint

    def seen(distinct):
        got = by_fingerprint(distinct)
        nodes = {r.node: r.fp for r in distinct.collect()}
        near.extend((nodes[p.u], nodes[p.v]) for p in got.collect())
        return got

    monkeypatch.setattr(similar, "by_fingerprint", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(x.doc_id for x in dict(P.STAGES)["simhash_near_dedup"](spark, docs, sf).collect())
    assert kept == [0, 2, 4, 6, 8, 50, 51, 52] and len(near) >= 5
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in near)

    monkeypatch.setattr(similar.simhash, "majority", lambda hashes: 7)  # all meet: what isn't similar is refuted
    monkeypatch.setattr(similar, "_tallied", tallied)
    rows = planted()
    got = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted({x.component_id for x in got}) == kept_by_brute_force(rows)


def test_long_lists_file_no_whole_texts_again(spark, monkeypatch):
    """Texts that share a passage: no table has a row for each of their shingles."""
    rows, write = {}, similar.materialise

    def counted(df, tag, keep=False):
        out = write(df, tag, keep)
        rows[tag] = out.count()
        return out

    monkeypatch.setattr(similar, "materialise", counted)
    passage = " ".join(f"p{i}" for i in range(80))
    texts = [(i, " ".join(f"a{i}x{j}" for j in range(200)) + " " + passage) for i in range(60)]
    got = similar.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert got.select("component_id").distinct().count() == 60
    assert rows["postings-again"] and max(rows.values()) <= 60 * similar.indexed(276, 0.8)[0]


def test_shared_passages_are_indexed_last(spark, monkeypatch):
    """Texts that are half passages which many share, but have enough of their own: no list of theirs is long, and their copies are linked."""
    rows, write = {}, similar.materialise

    def counted(df, tag, keep=False):
        out = write(df, tag, keep)
        rows[tag] = out.count()
        return out

    monkeypatch.setattr(similar, "materialise", counted)
    monkeypatch.setattr(similar, "FEWEST", 0, raising=False)
    r = random.Random(8)
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(4)]
    texts = []
    for i in range(300):
        a, b = r.sample(passages, 2)
        own = [f"a{i}x{j}" for j in range(200)]
        texts.append((i, " ".join([*a, *own, *b])))
        if i % 10 == 0:
            texts.append((1000 + i, " ".join([*a, *own[:-1], "other", *b])))
    got = similar.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted({x.component_id for x in got}) == list(range(300))
    assert rows["long"] == 0


@pytest.mark.parametrize("marks", [[], range(64), range(0, 64, 3)])
def test_any_marks_give_the_same_rows(spark, monkeypatch, marks):
    """Marks only order the index: none, all and arbitrary ones lose no link."""
    table = similar.np.packbits(similar.np.isin(similar.np.arange(64), list(marks)), bitorder="little")
    monkeypatch.setattr(similar, "frequent_marks", lambda docs, words: table)
    rows = planted()
    got = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=3).collect()
    assert sorted({x.component_id for x in got}) == kept_by_brute_force(rows)


def test_marks_are_of_shingles_that_two_sampled_texts_share(spark, monkeypatch):
    monkeypatch.setattr(similar, "FEWEST", 0)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x b c d e f"), (3, "a b c d e f"), (4, "k l m n o p"), (5, None)], "doc_id long, text string")
    marks = similar.np.flatnonzero(similar.np.unpackbits(similar.frequent_marks(docs, 5, sampled=1), bitorder="little"))
    assert marks.tolist() == [int(similar.shingle_set("b c d e f")[0]) % similar.MARKS]
    assert not similar.frequent_marks(docs.filter("false"), 5).any()


def test_whole_texts_are_dealt_once_for_the_rows_that_stay(spark):
    """The window takes its rows from the join, with no shuffle between; null ids and repeated rows stay apart."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s t u v"), (0, "g h i j k l"), (None, "g h i j k l")], "doc_id long, text string")
        got = similar.simhash.representatives(docs, similar.near_duplicates)
        plan = str(got._jdf.queryExecution().executedPlan().toString())
        assert sorted(got.collect(), key=str) == sorted([(1, "a b c d e f"), (None, "q r s t u v"), (0, "g h i j k l")], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "Exchange" not in plan[plan.index("Window") : plan.index("SortMergeJoin")]


def test_shuffles_go_with_the_job(spark):
    """What a written table was shuffled for isn't left on the disk."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {str(files.apply(i).getName()) for i in range(files.size()) if str(files.apply(i).getName()).startswith("shuffle")}

    before = shuffles()
    with scratch_scope(spark):
        assert materialise(spark.range(1000).groupBy("id").count(), "shuffled").schema
        assert not shuffles() - before
