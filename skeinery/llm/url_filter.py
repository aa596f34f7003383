"""URL filters: rules, and a ratio of two character language models for what the rules leave open.

Both models are variable-order Markov models over the characters of host and path, one of accepted and one of
rejected URLs, smoothed by interpolation down to the uniform distribution (Witten-Bell: the weight of the longer
context is its count against the number of different characters that followed it). A URL's score is the mean over its
characters of the difference of the two log-likelihoods, so length doesn't count. The threshold is calibrated on the
seeds in two folds, each scored by models of the other: the value between the two classes' mean scores at equal distance
in standard deviations.

Seeds are the URLs that the rules decide. Alphabet: a-z, all digits as one class, . - / _ and one class for the rest
(32 symbols that a model predicts, and the mark before the start), so there are at most 33 ** order contexts and a model has a
size of its own, not the corpus'. Seeds are counted over all pages: every distinct URL once for each time it occurs.

Everything is DataFrame functions. Grams are pre-aggregated before each shuffle; the log ratio is computed once for
each distinct gram; grams meet their ratio in a join salted by page, with the bounded table repeated for each salt, so
a gram that every URL has is spread; a URL goes with its grams as two hashes, so its length is paid for once.

Defined cases: a null url or one without :// has empty host and path, is decided by no rule and scores 0 like any
empty one; without seeds of both kinds every score is 0; a score of exactly the threshold is allowed; repeated rows are
judged alike; a URL of any length is scored whole; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinery.llm._common import materialise, spare

#: (verdict, host, path): fixed values, the rules of the default recipe.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
SALTS = 16
START = "^"
#: What a model predicts one of: letters, a digit, . / _ - and the rest.
SYMBOLS = 26 + 1 + 4 + 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; its fields are null where none does."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = None
    for kind, h, p in by_length:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if rule is None:
        rule = verdict = F.lit(None).cast("string")
    return F.struct(rule.alias("rule"), verdict.alias("verdict"))


def symbols(host: Column, path: Column) -> Column:
    """Host and path in the models' alphabet."""
    whole = F.translate(F.concat(host, path), _UPPER + "0123456789", _LOWER + "0" * 10)
    return F.regexp_replace(whole, r"[^a-z0./_-]", "~")


def grams(text: Column, order: int = ORDER) -> Column:
    """The gram that ends at each character: it and up to ``order`` before it, with marks before the start."""
    padded = F.concat(F.lit(START * order), text)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(order + 1))))


#: The models: of the seeds of either fold, and of all.
FOLDS = {"m0": (0,), "m1": (1,), "m": (0, 1)}


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, m0, m1, m) for each gram of ``counts``: log P(last | rest) of the accepted less the rejected model, learnt from either fold and from both.

    ``counts`` has (gram, fold, good, bad), full grams. All orders are one table of suffixes, whose length is the order,
    and so are the models; both are bounded by the alphabet.
    """
    kinds = [(m, k) for m in FOLDS for k in ("good", "bad")]
    suffixes = F.transform(F.sequence(F.lit(0), F.lit(order)), lambda k: F.substring("gram", F.lit(order + 1) - k, k + 1))
    own = F.expr("substring(seen, 1, length(seen) - 1)")
    seen = counts.filter("good > 0 or bad > 0").select("fold", "good", "bad", F.explode(suffixes).alias("seen"))
    seen = seen.groupBy("seen").agg(*[F.sum(F.when(F.col("fold").isin(*FOLDS[m]), F.col(k)).otherwise(0)).alias(f"{m}_{k}") for m, k in kinds])
    seen = materialise(seen, "url-suffixes")
    totals = [f(c).alias(f"{m}_{k}_{name}") for m, k in kinds for c in [F.col(f"{m}_{k}")] for name, f in (("n", F.sum), ("kinds", lambda c: F.count_if(c > 0)))]
    around = materialise(seen.groupBy(own.alias("context")).agg(*totals), "url-contexts")
    each = counts.select("gram").distinct().select("gram", F.explode(suffixes).alias("seen")).withColumn("context", own)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    numbers = [F.struct(number(f"{m}_{k}").alias("own"), number(f"{m}_{k}_n").alias("n"), number(f"{m}_{k}_kinds").alias("kinds")).alias(f"{m}_{k}") for m, k in kinds]
    joined = each.join(seen, "seen", "left").join(around, "context", "left").select("gram", F.struct(F.length("seen").alias("at"), *numbers).alias("level"))
    levels = joined.groupBy("gram").agg(F.array_sort(F.collect_list("level")).alias("levels"))  # one of each order
    log = lambda c: F.log(F.aggregate("levels", F.lit(1.0 / SYMBOLS), lambda p, x: _interpolated(x[c]["own"], x[c]["n"], x[c]["kinds"], p)))
    return levels.select("gram", *[(log(f"{m}_good") - log(f"{m}_bad")).alias(m) for m in FOLDS])


def _interpolated(n: Column, total: Column, kinds: Column, shorter: Column) -> Column:
    return F.when(total > 0, (n + kinds * shorter) / (total + kinds)).otherwise(shorter)


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, salts: int = SALTS, url: str = "url") -> DataFrame:
    """``pages`` (url, ...) with host, path, rule, score and verdict."""
    plain = list(pages.columns)
    host, path, rule, score, verdict, text, fits = (spare(plain, c) for c in ("host", "path", "rule", "score", "verdict", "_text", "_fits"))
    rows = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    rows = rows.withColumn(fits, matching_rule(F.col(host), F.col(path), rules)).withColumn(text, symbols(F.col(host), F.col(path)))
    # Texts that occur more than once (digits are one class) are scored once.
    of_rules = [F.count_if(F.col(f"{fits}.verdict") == v).alias(c) for v, c in (("allow", "good"), ("block", "bad"))]
    kinds = rows.groupBy(F.col(text).alias("text")).agg(*of_rules)
    kinds = kinds.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    kinds = materialise(kinds.withColumn("fold", F.pmod("t2", F.lit(2)).cast("int")), "url-texts")
    ending = kinds.select("t1", "t2", "fold", "good", "bad", F.explode(grams(F.col("text"), order)).alias("gram"))
    counts = ending.groupBy("gram", "fold").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ratios = materialise(log_ratios(materialise(counts, "url-grams"), order), "url-ratios")
    salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    tallied = ending.groupBy("t1", "t2", "fold", "gram").agg(F.count("*").alias("n")).withColumn("salt", F.pmod("t1", F.lit(salts)))
    # Sums of rounded values: the same in any order.
    total = lambda ratio: F.sum(F.round(ratio * 1e6).cast("long") * F.col("n")) / F.sum("n") / 1e6
    other = F.when(F.col("fold") == 0, F.col("m1")).otherwise(F.col("m0"))
    means = tallied.join(salted, ["gram", "salt"]).groupBy("t1", "t2").agg(total(F.col("m")).alias("whole"), total(other).alias("mean"))
    judged = materialise(kinds.join(means, ["t1", "t2"], "left").select("text", "good", "bad", "mean", F.coalesce("whole", F.lit(0.0)).alias("whole")), "url-scores")
    limit = threshold(judged.filter("mean is not null and (good > 0 or bad > 0)"))
    scored = judged.select("text", F.col("whole").alias("mean"))
    joined = rows.join(scored.select(F.col("text").alias(text), F.col("mean").alias(score)), text, "left")
    by_model = F.when(F.coalesce(score, F.lit(0.0)) >= F.lit(limit), "allow").otherwise("block")
    return joined.select(
        *[F.col(f"`{c}`") for c in plain], host, path, F.col(f"{fits}.rule").alias(rule), F.col(score), F.coalesce(F.col(f"{fits}.verdict"), by_model).alias(verdict)
    )


def threshold(scored: DataFrame) -> float:
    """Between the seeds' mean scores, as many standard deviations from either; 0 without both kinds."""
    sums = [F.sum(f"{k}") for k in ("good", "bad")] + [F.sum(F.col(k) * F.col("mean") ** p) for k in ("good", "bad") for p in (1, 2)]
    n_good, n_bad, g1, g2, b1, b2 = scored.agg(*(s.alias(str(i)) for i, s in enumerate(sums))).first()
    if not n_good or not n_bad:
        return 0.0
    g, b = g1 / n_good, b1 / n_bad
    sd_g, sd_b = math.sqrt(max(0, g2 / n_good - g * g)), math.sqrt(max(0, b2 / n_bad - b * b))
    return round((g * sd_b + b * sd_g) / (sd_g + sd_b) if sd_g + sd_b > 0 else (g + b) / 2, 6)
