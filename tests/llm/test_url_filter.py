import re
from collections import Counter, defaultdict
from math import log, sqrt

import pytest

from pyspark.sql import functions as F

from skeinery.llm import url_filter as U

LOWER = {i: i + 32 for i in range(65, 91)}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, kind) for kind, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def symbols(host, path):
    return re.sub(r"[^a-z0./_-]", "~", re.sub("[0-9]", "0", (host + path).translate(LOWER)))


def model(rows, order):
    """The score of a text by the seeds among ``rows``."""
    counts = {k: [defaultdict(Counter) for _ in range(order + 1)] for k in ("allow", "block")}
    for _, h, p, _, kind in rows:
        if kind:
            text = "^" * order + symbols(h, p)
            for i in range(order, len(text)):
                for k in range(order + 1):
                    counts[kind][k][text[i - k : i]][text[i]] += 1

    def probability(kind, gram):
        out = 1 / 32
        for k in range(order + 1):
            seen = counts[kind][k].get(gram[order - k : order])
            if seen:
                out = (seen[gram[order]] + len(seen) * out) / (sum(seen.values()) + len(seen))
        return out

    def score(text):
        padded = "^" * order + text
        grams = [padded[i : i + order + 1] for i in range(len(text))]
        return sum(round(1e6 * (log(probability("allow", g)) - log(probability("block", g)))) for g in grams) / len(grams) / 1e6 if grams else 0.0

    return score


def brute(urls, fold, order=4):
    rows = [(u, *parts(u), *rule_of(*parts(u))) for u in urls]
    score = model(rows, order)
    scores = [score(symbols(h, p)) for _, h, p, _, _ in rows]
    own = {"allow": [], "block": []}
    for x in (0, 1):
        other = model([r for r in rows if fold[symbols(r[1], r[2])] != x], order)
        for _, h, p, _, kind in rows:
            if kind and fold[symbols(h, p)] == x:
                own[kind].append(other(symbols(h, p)))
    if own["allow"] and own["block"]:
        mean = {k: sum(x) / len(x) for k, x in own.items()}
        sd = {k: sqrt(max(0, sum(v * v for v in x) / len(x) - mean[k] ** 2)) for k, x in own.items()}
        both = sd["allow"] + sd["block"]
        limit = (mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / both if both else sum(mean.values()) / 2
    else:
        limit = 0.0
    return [(u, h, p, r, v or ("allow" if s >= round(limit, 6) else "block"), s) for (u, h, p, r, v), s in zip(rows, scores)]


def check(spark, urls):
    got = U.judge(spark.createDataFrame([(u, "x") for u in urls], "url string, host string")).collect()
    assert all(r.asDict()["host"] == "x" for r in got)
    key = lambda x: repr(x[:5])
    mine = sorted(((r.url, r["_host"], r.path, r.rule, r.verdict, r.score) for r in got), key=key)
    texts = [(x,) for x in {symbols(*parts(u)) for u in urls}]
    folds = spark.createDataFrame(texts, "text string").select("text", F.pmod(F.xxhash64(F.lit("second"), "text"), F.lit(2)).alias("fold")).collect()
    want = sorted(brute(urls, {r.text: r.fold for r in folds}), key=key)
    assert [x[:4] for x in mine] == [x[:4] for x in want]
    for a, b in zip(mine, want):
        assert a[5] == pytest.approx(b[5], abs=3e-6) and (a[4] == b[4] or abs(b[5]) < 1e-4)


def test_pages(spark, sf):
    check(spark, [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()])


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "a://", "http://NET", "http://NET/", "x://A.Example.NET/en/é?q#f", "x://badexample.net/en/", "http://a.org/fr/x", "x://fr.org", "http://ü.org/fr/", "x://b.net?x/", "x://b.net#/", "x://y.net/a://b", "x://q.net/\n", "x://long.net/" + "ab1/" * 5000] * 2
    check(spark, urls)


def test_no_seeds_and_no_rows(spark):
    got = U.judge(spark.createDataFrame([("http://a.com/",), (None,)], "url string")).collect()
    assert [(r.score, r.verdict) for r in got] == [(0.0, "allow")] * 2
    assert U.judge(spark.createDataFrame([], "url string")).count() == 0


def test_plans_stay_small(spark, sf, monkeypatch):
    """All models and orders go through the same few joins: the driver holds their plans."""
    exchanges, write = [], U.materialise

    def counted(df, tag, keep=False):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return write(df, tag, keep)

    monkeypatch.setattr(U, "materialise", counted)
    U.judge(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"))
    assert 0 < sum(exchanges) <= 30
