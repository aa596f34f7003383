"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.llm import best_fit, line_dedup, media, mixing, neighbours, packing, pii, simhash, spelling, toxicity, url_filter, vector_codes, warc
from skeinery.llm._common import materialise, table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0)
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return got.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return got.select("page_id", "host", "path", "rule", "verdict", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    got = warc.read_archives(manifest, with_data=False).filter("last")
    return got.select("page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0, k=5)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)
    return got.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(media.encode_png(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "media")
    got = media.decode_png(stored).select("doc_id", "n_bytes", "media", "image.*")
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=2)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    got = vector_codes.with_label_error(coded)
    return got.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spelling.group_variants(table(spark, sf_dir, "documents"), min_chars=6, min_count=5, ratio=5, every=199)
    return got.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_pii,
        op3_toxicity,
        op4_line_dedup,
        op5_url_filter,
        op6_warc,
        op7_packing,
        op8_nearest_neighbours,
        op9_simhash_near_dedup,
        op10_media_columns,
        op11_best_fit_packing,
        op12_vector_codes,
        op13_spelling_variants,
    )
}

#: Code points that C's isspace takes, as DuckDB's trim wants them.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS whole, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id <> r.keeper, false) AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Equal payloads are those with equal bytes; the digest's 160 bits are cut into fives.
_WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), firsts AS (
  SELECT html, min(page_id) AS first FROM payloads GROUP BY html
), bits AS (
  SELECT p.*, f.first, array_to_string(list_transform(string_split(sha1(p.html), ''), lambda c:
    ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS bits
  FROM payloads p JOIN firsts f ON p.html = f.html
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INT) * (16 >> j))) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""



def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Squared distances through inner products of doubles, which are exact below 2^53."""
    steps = [
        """vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id) AS nth
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""pieces AS MATERIALIZED (SELECT vec_id, label, nth, p, v[(p - 1) * len(v) // {parts} + 1 : p * len(v) // {parts}] AS x FROM vectors, range(1, {parts + 1}) t(p))""",
        f"books0 AS MATERIALIZED (SELECT p, nth - 1 AS entry, x AS c FROM pieces WHERE nth <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"""codes{k} AS MATERIALIZED (SELECT vec_id, label, p, x, min(gap) AS gap, arg_min(entry, (gap, entry)) AS entry FROM (
  SELECT vec_id, label, nth, b.p, x, entry, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS gap FROM pieces a JOIN books{k} b ON a.p = b.p)
  GROUP BY vec_id, label, nth, p, x)""")
        if k < rounds:
            steps.append(f"""means{k} AS (SELECT p, entry, list(m ORDER BY i) AS c FROM (SELECT p, entry, i, floor(sum(x[i]) / count(*)) AS m FROM codes{k}, range(1, len(x) + 1) t(i) GROUP BY p, entry, i) GROUP BY p, entry)""")
            steps.append(f"books{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN means{k} m USING (p, entry))")
    steps.append(f"""coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', entry::INT)), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error FROM codes{rounds} GROUP BY vec_id)""")
    steps.append("labels_ AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded GROUP BY label)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM books{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256 FROM coded c JOIN labels_ l ON c.label IS NOT DISTINCT FROM l.label, digest"


#: CRC-32 over a list of bytes, by its table of 256 remainders; the bytes of a word are one or two for each code point.
_SPELLING = r"""
WITH RECURSIVE remainders(i, step, r) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM remainders WHERE step < 8
), lookup AS (SELECT list(r ORDER BY i) AS tbl FROM remainders WHERE step = 8
), found AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + (ord(c) >> 6))::BIGINT, (128 + (ord(c) & 63))::BIGINT] END))),
    lambda r, b: xor(r >> 8, tbl[xor(r & 255, b) + 1])), 4294967295::BIGINT) AS h FROM found, lookup
), words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), gone AS MATERIALIZED (
  SELECT word, n, pos, word[: pos - 1] || word[pos + 1 :] AS rest FROM words, range(1, length(word) + 1) t(pos)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word
), near AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS best, max(other_n) AS best_n FROM pairs GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)
), chain(word, last) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL
)
SELECT word, form, last AS root, n, n_near, form_n FROM forms JOIN chain USING (word) WHERE last IN (SELECT word FROM forms WHERE form IS NULL)
"""

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": _LINE_DEDUP, "op6_warc": _WARC, "op12_vector_codes": _vector_codes(), "op13_spelling_variants": _SPELLING}
