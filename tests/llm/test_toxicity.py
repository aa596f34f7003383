import numpy as np
import pytest

from skeinery.llm import toxicity as T


def corpus(n, seed):
    r = np.random.default_rng(seed)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "ra", "si", "tu", "we"]
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(r.choice(syllables, r.integers(1, 4))) for _ in range(r.integers(3, 150))]
        bad = r.random() < 0.3
        if bad:
            words.insert(int(r.integers(0, len(words))), ["zgrum" + r.choice(syllables), "vile"][int(r.integers(0, 2))])
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def net():
    return T.fit(*corpus(700, 1))


def test_gradients_are_those_of_finite_differences():
    net = T.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(2)
    x, ids = r.standard_normal((7, T.EMBED)), r.integers(0, 7, (T.WINDOW, 5))
    mask = (np.arange(T.WINDOW)[:, None] < [T.WINDOW, 3, 1, 20, 9]).astype(np.float64)[:, :, None]
    truth, weight = np.array([1, 0, 1, 1, 0]), np.array([1.0, 2, 1, 1, 3])

    def loss():
        z = net.logits(net.gates(x), ids, mask)
        return float((weight * (np.logaddexp(0, z) - truth * z)).sum() / weight.sum())

    g, d_x = net.gradients(x, ids, mask, truth, weight)
    for values, gradient in [(x, d_x), *((net.p[k], g[k]) for k in g)]:
        flat = values.reshape(-1)
        for i in r.choice(len(flat), min(4, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert gradient.reshape(-1)[i] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_held_out_accuracy(net):
    texts, labels = corpus(300, 9)
    got = T.Scorer(net)(texts) >= 0.5
    y = np.array(labels) == 1
    assert (got & y).sum() >= 0.95 * y.sum() and (got & ~y).sum() <= 0.03 * (~y).sum()


def test_long_texts_are_scored_whole(net):
    words = [w for w in " ".join(corpus(400, 5)[0]).split() if not w.startswith("zgrum") and w != "vile"] * 12
    assert len(words) > 2 * T.AT_ONCE
    low, high = T.Scorer(net)([" ".join(words), " ".join(words[:-5] + ["zgrumba"] + words[-5:])])
    assert low < 0.5 <= high


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        spans = T.windows_of(n)
        assert {i for s, m in spans for i in range(s, s + m)} == set(range(n))
        assert all(a + T.WINDOW > b for (a, _), (b, _) in zip(spans, spans[1:]))


def test_scores_do_not_hang_on_the_batch(net):
    texts, _ = corpus(60, 3)
    alone = [T.Scorer(net)([t])[0] for t in texts]
    assert T.Scorer(net)(texts) == pytest.approx(alone, abs=2e-6)


def test_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "some words", "x"), (4, "some words", "x"), (None, "words", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(4, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    got = T.score_toxicity(docs, labels)
    assert got.columns[-1] == "_score"
    scores = [r["_score"] for r in got.collect()]
    assert len(scores) == 6 and scores[:3] == [0, 0, 0] and all(0 <= s < 0.5 for s in scores)
    assert T.score_toxicity(docs.filter("false"), labels).count() == 0


def test_held_out_rows_do_not_teach(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.training_sample(docs, labels) == T.training_sample(docs, flipped)
    texts, toxic = T.training_sample(docs, labels, max_texts=5)
    assert sum(toxic) <= 5 and len(toxic) <= 20


def test_decorated_words_are_the_words():
    for w in ("zgrum", "Zgrum***", "###zgrum&&&", "zgrum,$$$"):
        assert [x.tolist() for x in T.features([w])] == [x.tolist() for x in T.features(["zgrum"])]
    assert len(T.features(["***"])[0]) == 1


def test_held_out_documents(spark):
    """Label noise is in these tables: of 97 held-out toxic texts 11 have no word in common with what marks the others."""
    from skeinery.llm import queries

    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()}
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, sf).collect()}
    judged = [(r.predicted, truth[d]) for d, r in got.items() if r.held_out and d in truth]
    found, toxic = sum(p and t for p, t in judged), sum(t for _, t in judged)
    false = sum(p and not t for p, t in judged)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert found >= 0.8 * toxic and false <= 0.012 * (len(judged) - toxic), (found, toxic, false, len(judged))


def test_ties_and_repeated_rows_teach_alike(spark):
    texts, labels = corpus(60, 4)
    rows = [(i % 40, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 5
    marks = spark.createDataFrame([(i, labels[i]) for i in range(40)] + [(3, labels[3])] * 2, "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = T.training_sample(docs, marks), T.training_sample(docs.repartition(7), marks.repartition(3))
    assert one == other and len(one[0]) == len({i for i in range(40) if not __import__("zlib").crc32(str(i).encode()) % 5 == 0})
