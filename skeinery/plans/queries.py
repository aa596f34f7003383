"""A registered query for every operator, over the driver's tables, with its SQL where SQL can express it.

Roles: ``documents`` are the files (one chunk each, named by source and id), ``benchmark`` items are the queries,
``conversations`` the questions. Manifest, catalog and cache states are derived from whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinery.config import Settings
from skeinery.functions import text as T
from skeinery.functions import vectors as V
from skeinery.operators import answer, cache, catalog, chunk, evaluate, fuse, manifest, retrieve
from skeinery.operators.embed import HashedEmbedder, with_embedding
from skeinery.plans.search import HybridEngine, documents
from skeinery.sources import files, scratch

SUFFIX = "implementation"
S = Settings(bm25_k=6)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, d, "documents").select("doc_id", path.alias("node_id"), path.alias("file_path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "text")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def keyword_index(spark: SparkSession, d: str) -> retrieve.Postings:
    """What a stored index would have; nothing is cached, so that no table outlives its query in the caller's session."""
    return retrieve.build_postings(nodes(spark, d))


def engine(spark: SparkSession, d: str) -> HybridEngine:
    embedder = HashedEmbedder()
    return HybridEngine(nodes(spark, d), keyword_index(spark, d), embedder, S, settle=scratch.written)


# SQL building blocks: the same definitions, for DuckDB.
NODES = "nodes AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS node_id, doc_id || '.txt' AS file_name, text FROM documents)"
ASKED = f"""asked AS (
  SELECT item_id AS query_id, 0 AS variant_no, text AS variant, text AS query FROM benchmark
  UNION ALL SELECT item_id, 1, text || ' {SUFFIX}', text FROM benchmark)"""
TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
POSTINGS = f"""words AS (SELECT node_id, {TERMS.format("text")} AS terms FROM nodes),
postings AS (SELECT term, node_id, dl, count(*) AS tf FROM (SELECT node_id, len(terms) AS dl, unnest(terms) AS term FROM words) GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM words),
stats AS (SELECT term, count(*) AS df, any_value(n_docs) AS n_docs, any_value(avgdl) AS avgdl,
          ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, totals GROUP BY term)"""
BM25 = f"""wanted AS (SELECT DISTINCT query_id, variant_no, unnest({TERMS.format("variant")}) AS term FROM asked),
keyword_scores AS (
  SELECT query_id, variant_no, node_id, round(sum(idf * tf / (tf + {S.bm25_k1}::DOUBLE * (1 - {S.bm25_b}::DOUBLE + {S.bm25_b}::DOUBLE * dl / avgdl))), 9) AS score
  FROM wanted JOIN stats USING (term) JOIN postings USING (term) GROUP BY ALL),
keywords AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, node_id) AS rank FROM keyword_scores
             QUALIFY row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, node_id) <= {S.bm25_k})"""


def sparse(name: str, source: str, key: str, text: str) -> str:
    """CTEs {name}_parts(key, bucket, v) and {name}_norms(key, norm) with the hashed embedding's float components."""
    return f"""{name}_sums AS (
  SELECT {key}, bucket, sum(sign)::DOUBLE AS v FROM (
    SELECT {key}, ('0x' || substr(md5(term), 1, 8))::UBIGINT % 64 AS bucket, CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END AS sign
    FROM (SELECT {key}, unnest({TERMS.format(text)}) AS term FROM {source})) GROUP BY ALL),
{name}_parts AS (SELECT s.*  EXCLUDE (v), (v / n)::FLOAT::DOUBLE AS v FROM {name}_sums s JOIN (SELECT {key}, sqrt(sum(v * v)) AS n FROM {name}_sums GROUP BY ALL HAVING sum(v * v) > 0) USING ({key})),
{name}_norms AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name}_parts GROUP BY ALL)"""


KNN = f"""{sparse("node", "nodes", "node_id", "text")},
{sparse("asked", "asked", "query_id, variant_no", "variant")},
dots AS (SELECT query_id, variant_no, node_id, sum(a.v * n.v) AS dot FROM asked_parts a JOIN node_parts n USING (bucket) GROUP BY ALL),
cosines AS (
  SELECT a.query_id, a.variant_no, n.node_id, coalesce(round(dot / (an.norm * nn.norm), 9), 0) + 0.0 AS score
  FROM asked a CROSS JOIN nodes n LEFT JOIN dots USING (query_id, variant_no, node_id)
  LEFT JOIN asked_norms an USING (query_id, variant_no) LEFT JOIN node_norms nn USING (node_id)),
wide AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, node_id) AS rank FROM cosines
         QUALIFY row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, node_id) <= {S.wide_k})"""
FUSED = f"""ranked AS (
  SELECT query_id, variant_no * 3 AS list_no, rank, node_id FROM wide WHERE rank <= {S.narrow_k}
  UNION ALL SELECT query_id, variant_no * 3 + 1, rank, node_id FROM keywords
  UNION ALL SELECT query_id, variant_no * 3 + 2, rank, node_id FROM wide),
lists AS (SELECT query_id, variant_no * 3 + r AS list_no, CASE WHEN variant = query THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM asked, range(3) t(r)),
best AS (SELECT query_id, sum(weight / 61) AS best FROM lists GROUP BY query_id),
fused AS (SELECT query_id, node_id, round(sum(weight / (60 + rank)) / any_value(best), 9) AS rrf, min(list_no * 1000 + rank) AS first
          FROM ranked JOIN lists USING (query_id, list_no) JOIN best USING (query_id) GROUP BY query_id, node_id),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, node_id) AS cand_rank FROM fused
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, node_id) <= {S.rerank_candidates})"""
SEARCH = f"""scored AS (
  SELECT c.*, 0.7::DOUBLE * k.score + (1 - 0.7::DOUBLE) * c.rrf AS final FROM cut c JOIN cosines k ON k.query_id = c.query_id AND k.variant_no = 0 AND k.node_id = c.node_id),
results AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, cand_rank) AS rank, file_name AS file, node_id AS path,
         substr(text, 1, 800) AS text, round(final, 3) AS score, node_id FROM scored JOIN nodes USING (node_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, cand_rank) <= {S.top_k})"""


def with_(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then


# -- projections and scalar functions


@query(with_(ASKED, then="SELECT query_id, variant_no, variant FROM asked"))
def query_expand(spark, d):
    return retrieve.variants(asked(spark, d), [SUFFIX]).select("query_id", "variant_no", "variant")


@query("SELECT doc_id, coalesce(list_aggregate(list_filter(list_transform(string_split(text, ','), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''), 'string_agg', '|'), '') AS suffixes FROM documents")
def suffix_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.parse_suffixes(F.col("text")), "|").alias("suffixes"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("file_hash"))


@query("SELECT DISTINCT source, CASE WHEN source = '' THEN '' ELSE '// namespace ' || source || chr(10) END AS prefix, CASE WHEN source = '' OR lang = '' THEN source || lang ELSE source || '.' || lang END AS qualified FROM documents")
def qualified_names(spark, d):
    return table(spark, d, "documents").select("source", T.namespace_prefix(F.col("source")).alias("prefix"), T.qualify(F.col("source"), F.col("lang")).alias("qualified")).distinct()


_MODE = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN '{mode}'" for mode, words in T.MODES) + " ELSE 'explain' END"


@query(f"SELECT conv_id, turn, {_MODE} AS mode FROM conversations")
def detect_mode(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.detect_mode(F.col("text")).alias("mode"))


@query(f"SELECT conv_id, turn, CASE WHEN turn < 3 AND {_MODE} IN ('explain', 'flow') THEN 'locate' ELSE {_MODE} END AS mode FROM conversations")
def mode_fallback(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.mode_fallback(T.detect_mode(F.col("text")), F.col("turn")).alias("mode"))


_PATHS = ("src/", "src/bin/", "obj/", "a/node_modules/b/", ".git/", "x/build/", "build/", "t/TestResults/")
_ENDS = (".cs", ".csproj", ".txt", ".sln", ".snk", ".slnx")
_PATH_SQL = f"list_extract([{', '.join(map(repr, _PATHS))}], (doc_id % {len(_PATHS)})::INT + 1) || doc_id || list_extract([{', '.join(map(repr, _ENDS))}], (doc_id % {len(_ENDS)})::INT + 1)"


@query(rf"""SELECT file_path FROM (SELECT {_PATH_SQL} AS file_path FROM documents)
WHERE regexp_matches(file_path, '\.(cs|csproj|sln|slnx)$')
  AND NOT regexp_matches(file_path, '(^|/)(bin|obj|node_modules|TestResults|PackageRoot)/') AND NOT regexp_matches(file_path, '^(\.git|\.vs|\.run|build|dist|packages)/')""")
def path_filter(spark, d):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    paths = table(spark, d, "documents").select(F.concat(pick(_PATHS), F.col("doc_id").cast("string"), pick(_ENDS)).alias("file_path"))
    return paths.filter(files.is_wanted(F.col("file_path")))


# -- keyword index


@query(with_(NODES, POSTINGS, then="SELECT node_id, term, tf FROM postings"))
def tokenize_terms(spark, d):
    return retrieve.build_postings(nodes(spark, d)).postings.select("node_id", "term", "tf")


@query(with_(NODES, POSTINGS, then="SELECT term, df, n_docs, round(avgdl, 6) AS avgdl, round(idf, 9) AS idf FROM stats"))
def bm25_stats(spark, d):
    got = retrieve.bm25_stats(retrieve.build_postings(nodes(spark, d)))
    return got.select("term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 9).alias("idf"))


@query(with_(NODES, ASKED, POSTINGS, BM25, then="SELECT query_id, variant_no, node_id, rank::INT AS rank, round(score, 6) AS score FROM keywords"))
def bm25_topk(spark, d):
    got = retrieve.bm25(keyword_index(spark, d), retrieve.variants(asked(spark, d), [SUFFIX]), S.bm25_k, settle=scratch.written)
    return got.select("query_id", "variant_no", "node_id", "rank", F.round("score", 6).alias("score"))


@query(ORACLE_SQL["bm25_topk"])
def bm25_blocks(spark, d):
    """The same rows from written blocks, most of which aren't read."""
    flat = keyword_index(spark, d)
    postings = scratch.written(flat.postings, "postings")
    frequencies = scratch.written(retrieve.term_frequencies(postings), "frequencies")
    blocks = scratch.written(retrieve.in_blocks(postings, frequencies, settle=scratch.written), "blocks")
    totals = scratch.written(flat.totals, "totals")
    got = retrieve.bm25(retrieve.Blocks(blocks, frequencies, totals), retrieve.variants(asked(spark, d), [SUFFIX]), S.bm25_k, settle=scratch.written)
    return got.select("query_id", "variant_no", "node_id", "rank", F.round("score", 6).alias("score"))


# -- vectors


@query(with_(NODES, sparse("node", "nodes", "node_id", "text"), then="SELECT node_id, bucket::INT AS component, round(v, 6) AS value FROM node_parts WHERE v <> 0"))
def hashed_embedding(spark, d):
    rows = with_embedding(nodes(spark, d), HashedEmbedder()).select("node_id", F.posexplode("embedding").alias("component", "value"))
    return rows.filter("value <> 0").select("node_id", "component", F.round(F.col("value").cast("double"), 6).alias("value"))


_CENTRES = "centres AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i)"


@query(with_(_CENTRES, then="""SELECT vec_id, e.label, round(sum(e.embedding[i]::DOUBLE * c.v) / (sqrt(sum(e.embedding[i]::DOUBLE ** 2)) * sqrt(sum(c.v * c.v))), 6) AS cosine
FROM embeddings e JOIN centres c ON e.label = c.label GROUP BY vec_id, e.label"""))
def cosine_pairs(spark, d):
    """Every vector against its label's mean."""
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    centres = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("centre"))
    return e.join(centres, "label").select("vec_id", "label", F.round(V.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


def _knn(spark, d, k):
    e = engine(spark, d)
    got = retrieve.knn(e.vectors(), with_embedding(retrieve.variants(asked(spark, d), [SUFFIX]), e.embedder, text="variant"), k)
    return got.select("query_id", "variant_no", "node_id", "rank", F.round("score", 6).alias("score"))


@query(with_(NODES, ASKED, KNN, then="SELECT query_id, variant_no, node_id, rank::INT AS rank, round(score, 6) AS score FROM wide"))
def knn_wide(spark, d):
    return _knn(spark, d, S.wide_k)


@query(with_(NODES, ASKED, KNN, then=f"SELECT query_id, variant_no, node_id, rank::INT AS rank, round(score, 6) AS score FROM wide WHERE rank <= {S.narrow_k}"))
def knn_narrow(spark, d):
    return _knn(spark, d, S.narrow_k)


# -- fusion

_TURNS = "ranked AS (SELECT conv_id % 97 AS query_id, conv_id AS list_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank, role || length(text) % 20 AS node_id FROM conversations)"


def _turns(spark, d):
    """Conversations as ranked lists: a list is a conversation, nodes are roles with a length."""
    c = table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return c.select((F.col("conv_id") % 97).alias("query_id"), F.col("conv_id").alias("list_no"), F.row_number().over(order).alias("rank"), F.concat("role", (F.length("text") % 20).cast("string")).alias("node_id"))


def _rrf_sql(weight: str, more: str = "") -> str:
    return with_(
        _TURNS,
        f"lists AS (SELECT DISTINCT query_id, list_no, {weight}::DOUBLE AS weight FROM ranked {more})",
        "best AS (SELECT query_id, sum(weight / 61) AS best FROM lists GROUP BY query_id)",
        then="""SELECT query_id, node_id, round(round(sum(weight / (60 + rank)) / any_value(best), 9), 6) AS rrf
FROM ranked JOIN lists USING (query_id, list_no) JOIN best USING (query_id) GROUP BY query_id, node_id""",
    )


def _rrf(spark, d, weight, empty=False):
    ranked = _turns(spark, d)
    lists = ranked.select("query_id", "list_no").distinct().withColumn("weight", weight)
    if empty:
        lists = lists.unionByName(ranked.select("query_id").distinct().select("query_id", F.lit(-1).cast("long").alias("list_no"), F.lit(1.0).alias("weight")))
    return fuse.rrf(ranked, lists).select("query_id", "node_id", F.round("rrf", 6).alias("rrf"))


@query(_rrf_sql("1"))
def rrf_unweighted(spark, d):
    return _rrf(spark, d, F.lit(1.0))


@query(_rrf_sql("CASE WHEN list_no % 2 = 0 THEN 1.5 ELSE 1 END"))
def rrf_weighted(spark, d):
    return _rrf(spark, d, F.when(F.col("list_no") % 2 == 0, 1.5).otherwise(1.0))


@query(_rrf_sql("1", "UNION SELECT DISTINCT query_id, -1, 1::DOUBLE FROM ranked"))
def rrf_empty_list(spark, d):
    return _rrf(spark, d, F.lit(1.0), empty=True)


@query(with_(NODES, ASKED, POSTINGS, BM25, KNN, FUSED, then="SELECT query_id, node_id, cand_rank::INT AS cand_rank, round(rrf, 6) AS rrf FROM cut"))
def candidate_cut(spark, d):
    return engine(spark, d).candidates(asked(spark, d)).select("query_id", "node_id", "cand_rank", F.round("rrf", 6).alias("rrf"))


@query("SELECT doc_id, round(0.7::DOUBLE * (n_chars % 1000 / 1000.0::DOUBLE) + (1 - 0.7::DOUBLE) * coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id % 101 / 101.0::DOUBLE END, 0), 6) AS score FROM documents")
def blend_cosine(spark, d):
    rrf = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 101 / F.lit(101.0))
    return table(spark, d, "documents").select("doc_id", F.round(fuse.blend_cosine(F.col("n_chars") % 1000 / F.lit(1000.0), rrf), 6).alias("score"))


@query("SELECT doc_id, round(0.85::DOUBLE / (1 + exp(-(n_chars % 21 - 10)::DOUBLE)) + (1 - 0.85::DOUBLE) * coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id % 101 / 101.0::DOUBLE END, 0), 6) AS score FROM documents")
def blend_cross_encoder(spark, d):
    rrf = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 101 / F.lit(101.0))
    return table(spark, d, "documents").select("doc_id", F.round(fuse.blend_cross_encoder(F.col("n_chars") % 21 - 10, rrf), 6).alias("score"))


# -- search

_ALL = (NODES, ASKED, POSTINGS, BM25, KNN, FUSED, SEARCH)


@query(with_(*_ALL, then="SELECT * REPLACE (rank::INT AS rank) FROM results"))
def hybrid_search(spark, d):
    return engine(spark, d).search(asked(spark, d))


@query(with_(*_ALL, then="""SELECT item_id AS query_id, 'Top ' || count(rank) || ' relevant code snippets retrieved. See context for details.' AS answer,
coalesce(string_agg(DISTINCT file, '|' ORDER BY file), '') AS sources, count(rank) AS n FROM benchmark LEFT JOIN results ON item_id = query_id GROUP BY item_id"""))
def result_documents(spark, d):
    got = documents(engine(spark, d).search(asked(spark, d)), asked(spark, d))
    return got.select("query_id", "answer", F.array_join("sources", "|").alias("sources"), F.size("context").cast("long").alias("n"))


@query(with_(*_ALL, then="SELECT query_id, string_agg(DISTINCT file, '|' ORDER BY file) AS sources FROM results GROUP BY query_id"))
def result_sources(spark, d):
    got = engine(spark, d).search(asked(spark, d)).groupBy("query_id").agg(F.array_sort(F.collect_set("file")).alias("sources"))
    return got.select("query_id", F.array_join("sources", "|").alias("sources"))


# -- incremental indexing

_OLD = """old AS (SELECT doc_id::VARCHAR AS file_path, CASE doc_id % 10 WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE sha256(text) END AS file_hash FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT doc_id::VARCHAR AS file_path, sha256(text) AS file_hash FROM documents WHERE doc_id % 10 <> 3)"""
_DIFF = """changes AS (SELECT file_path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' ELSE 'changed' END AS status
FROM old o FULL JOIN new n USING (file_path) WHERE o.file_path IS NULL OR n.file_path IS NULL OR o.file_hash IS DISTINCT FROM n.file_hash)"""


def _manifests(spark, d):
    """Old and new states of all documents: a tenth each is new, edited, stored without a hash, or gone."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), (F.col("doc_id") % 10).alias("m"), F.sha2("text", 256).alias("file_hash"))
    old = docs.filter("m <> 0").select("file_path", F.when(F.col("m") == 1, "x").when(F.col("m") == 2, F.lit(None)).otherwise(F.col("file_hash")).alias("file_hash"))
    return old, docs.filter("m <> 3").select("file_path", "file_hash")


@query("SELECT source AS file_path, max(sha256(text)) AS file_hash FROM documents WHERE source IS NOT NULL GROUP BY source")
def manifest_hashes(spark, d):
    return manifest.manifest(table(spark, d, "documents").select(F.col("source").alias("file_path"), F.sha2("text", 256).alias("file_hash")))


@query(with_(_OLD, _DIFF, then="SELECT * FROM changes"))
def diff_files(spark, d):
    return manifest.diff(*_manifests(spark, d))


@query(with_(_OLD, _DIFF, then="SELECT file_path, file_hash FROM old ANTI JOIN (SELECT file_path FROM changes WHERE status <> 'new') USING (file_path) UNION ALL SELECT file_path, file_hash FROM new SEMI JOIN (SELECT file_path FROM changes WHERE status <> 'deleted') USING (file_path)"))
def incremental_apply(spark, d):
    old, new = _manifests(spark, d)
    return manifest.apply(old, manifest.diff(old, new), new)


@query(with_(_OLD, _DIFF, then="SELECT file_path, file_hash FROM old ANTI JOIN (SELECT file_path FROM changes WHERE status <> 'new') USING (file_path)"))
def delete_files(spark, d):
    old, new = _manifests(spark, d)
    return manifest.delete_files(old, manifest.to_delete(manifest.diff(old, new)))


# -- catalog

_COLLECTIONS = "collections AS (SELECT DISTINCT source || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '-20260613-' || lpad((doc_id % 7)::VARCHAR, 6, '0') ELSE '-eval-20260613-000000' END AS name FROM documents), aliases AS (SELECT DISTINCT 'live-' || source AS alias, source || '-20260613-000001' AS target FROM documents)"


def _catalog(spark, d):
    docs = table(spark, d, "documents")
    m, seconds = F.col("doc_id") % 3, F.lpad((F.col("doc_id") % 7).cast("string"), 6, "0")
    name = F.concat("source", F.when(m == 0, "").when(m == 1, F.concat(F.lit("-20260613-"), seconds)).otherwise("-eval-20260613-000000"))
    return docs.select(name.alias("name")).distinct(), docs.select(F.concat(F.lit("live-"), "source").alias("alias"), F.concat("source", F.lit("-20260613-000001")).alias("target")).distinct()


@query(with_(_COLLECTIONS, "wanted AS (SELECT DISTINCT unnest([source, 'live-' || source, 'no-' || source]) AS name FROM documents)", then="SELECT name, coalesce(target, c) AS active FROM wanted LEFT JOIN aliases ON alias = name LEFT JOIN (SELECT name AS c FROM collections) ON c = name"))
def resolve_active(spark, d):
    collections, aliases = _catalog(spark, d)
    wanted = table(spark, d, "documents").select(F.explode(F.array("source", F.concat(F.lit("live-"), "source"), F.concat(F.lit("no-"), "source"))).alias("name")).distinct()
    return catalog.resolve_active(collections, aliases, wanted)


@query(with_(_COLLECTIONS, then=r"SELECT name FROM collections WHERE (name <> 'src1-20260613-000001' AND regexp_matches(name, '^src1-\d{8}-\d{6}$')) OR (name = 'src1' AND NOT EXISTS (SELECT 1 FROM aliases WHERE alias = 'src1'))"))
def promote_sweep(spark, d):
    return catalog.swept(*_catalog(spark, d), "src1", "src1-20260613-000001")


# -- chunks


@query("""WITH RECURSIVE lines AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (
    SELECT doc_id, pos, CASE WHEN pos < total THEN part || chr(10) ELSE part END AS line FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos, len(string_split(text, chr(10))) AS total FROM documents)) WHERE line <> ''
), fold AS (
  SELECT doc_id, n, 0 AS piece_no, length(line) AS size FROM lines WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n, CASE WHEN f.size + length(l.line) > 800 THEN f.piece_no + 1 ELSE f.piece_no END,
         CASE WHEN f.size + length(l.line) > 800 THEN length(l.line) ELSE f.size + length(l.line) END
  FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.n = f.n + 1
), pieces AS (SELECT doc_id, piece_no, string_agg(line, '' ORDER BY n) AS piece, max(n) = (SELECT max(n) FROM lines x WHERE x.doc_id = fold.doc_id) AS is_last FROM fold JOIN lines USING (doc_id, n) GROUP BY doc_id, piece_no)
SELECT doc_id, piece_no, length(piece) AS n, sha256(piece) AS hash FROM pieces WHERE NOT is_last OR regexp_replace(piece, '\\s+', '', 'g') <> ''""")
def chunk_lines(spark, d):
    got = chunk.line_pieces(table(spark, d, "documents").select("doc_id", "text"), 800)
    return got.select("doc_id", "piece_no", F.length("piece").cast("long").alias("n"), F.sha2("piece", 256).alias("hash"))


@query()
def chunk_files(spark, d):
    return chunk.chunks(nodes(spark, d).select("file_path", "file_name", "text"))


@query()
def chunk_code(spark, d):
    """Documents written as C# types with a method for each line, then chunked as code."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.format_string('    /// <summary>%d</summary>\n    public string Line%d() { return @"%s"; }', i, i, F.replace(x, F.lit('"'), F.lit('""'))))
    code = F.format_string("using System;\nnamespace App.%s\n{\n  public class Doc%d\n  {\n%s\n  }\n}\n", F.col("source"), F.col("doc_id"), F.array_join(lines, "\n\n"))
    docs = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".cs")).alias("file_path"), code.alias("text"))
    return chunk.chunks(docs.withColumn("file_name", F.col("file_path")))


# -- embedding cache


def _cache(spark, d):
    """A cache state: two models, the documents not divisible by 3, last used by id."""
    docs = table(spark, d, "documents").filter("doc_id % 3 <> 0")
    vector = F.array(F.col("n_chars").cast("float"))
    rows = docs.select(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("model_name"), F.sha2("text", 256).alias("text_hash"), vector.alias("vector"), "doc_id")
    return rows.groupBy("model_name", "text_hash").agg(F.min("vector").alias("vector"), F.max("doc_id").alias("last_used"))


_CACHE = "cache AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS model_name, sha256(text) AS text_hash, min(n_chars)::DOUBLE AS value, max(doc_id) AS last_used FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL)"


@query(with_(_CACHE, then="SELECT d.doc_id, c.value, c.text_hash IS NOT NULL AS hit FROM documents d LEFT JOIN cache c ON c.model_name = 'a' AND c.text_hash = sha256(d.text)"))
def cache_lookup(spark, d):
    got = cache.lookup(table(spark, d, "documents").select("doc_id", "text"), _cache(spark, d), "a")
    return got.select("doc_id", F.get("vector", F.lit(0)).cast("double").alias("value"), "hit")


@query(with_(_CACHE, then="SELECT model_name, text_hash, last_used FROM cache ORDER BY last_used DESC, model_name, text_hash LIMIT 300"))
def cache_evict(spark, d):
    return cache.evict(_cache(spark, d), 300).select("model_name", "text_hash", "last_used")


# -- evaluation


@query("""SELECT conv_id AS query_id, file, row_number() OVER (PARTITION BY conv_id ORDER BY first, file)::INT AS rank FROM
(SELECT conv_id, role || length(text) % 3 AS file, min(turn) AS first FROM conversations GROUP BY ALL)""")
def ranked_files(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat("role", (F.length("text") % 3).cast("string")).alias("file"))
    return evaluate.ranked_files(rows)


def _golden(spark, d):
    """Items that some document holds word for word, with those documents' names."""
    hits = evaluate.holders(nodes(spark, d).select("file_name", "text"), asked(spark, d))
    return hits.groupBy("query_id").agg(F.first("query").alias("query"), F.collect_set("file_name").alias("relevant_files"))


def _evaluated(spark, d):
    golden = scratch.written(_golden(spark, d), "golden")
    one = golden.select("query_id", F.lit(0).alias("variant_no"), F.col("query").alias("variant"))
    found = retrieve.bm25(keyword_index(spark, d), one, 5, settle=scratch.written)
    return evaluate.metrics(found.select("query_id", "rank", F.element_at(F.split("node_id", "/"), -1).alias("file")), golden, 5)


_EVALUATED = with_(
    NODES,
    "golden AS (SELECT item_id AS query_id, b.text AS query, n.file_name AS file FROM benchmark b JOIN nodes n ON contains(n.text, b.text) GROUP BY ALL)",
    "asked AS (SELECT DISTINCT query_id, 0 AS variant_no, query AS variant, query FROM golden)",
    POSTINGS,
    BM25.replace(f"<= {S.bm25_k}", "<= 5"),
    "found AS (SELECT query_id, rank, split_part(node_id, '/', 2) AS file FROM keywords)",
    "hits AS (SELECT g.query_id, f.rank FROM golden g JOIN found f USING (query_id, file))",
    "sizes AS (SELECT query_id, count(*) AS n FROM golden GROUP BY query_id)",
    """evaluated AS (SELECT s.query_id, round(count(h.rank) / any_value(n), 9) AS recall, round(coalesce(1.0 / min(h.rank), 0), 9) AS mrr,
 round(coalesce(sum(1 / log2(h.rank + 1.0)), 0) / list_sum(list_transform(range(1, least(any_value(n), 5) + 1), lambda i: 1 / log2(i + 1.0))), 9) AS ndcg
 FROM sizes s LEFT JOIN hits h USING (query_id) GROUP BY s.query_id)""",
    then="{}",
)


@query(_EVALUATED.replace("{}", "SELECT query_id, round(recall, 6) AS recall FROM evaluated"))
def recall_at_k(spark, d):
    return _evaluated(spark, d).select("query_id", F.round("recall", 6).alias("recall"))


@query(_EVALUATED.replace("{}", "SELECT query_id, round(mrr, 6) AS mrr FROM evaluated"))
def mrr(spark, d):
    return _evaluated(spark, d).select("query_id", F.round("mrr", 6).alias("mrr"))


@query(_EVALUATED.replace("{}", "SELECT query_id, round(ndcg, 6) AS ndcg FROM evaluated"))
def ndcg_at_k(spark, d):
    return _evaluated(spark, d).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(_EVALUATED.replace("{}", "SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM evaluated"))
def eval_summary(spark, d):
    return evaluate.summary(_evaluated(spark, d))


# -- answers


@query(r"""WITH parts AS (
  SELECT source AS query_id, doc_id AS rank, len(list_filter(regexp_split_to_array('[' || doc_id || '] ' || doc_id || '.txt (' || source || ') score=0.5' || chr(10) || text, '\s+'), lambda x: x <> '')) AS n FROM documents
), running AS (SELECT query_id, rank, sum(n) OVER (PARTITION BY query_id ORDER BY rank) AS running_tokens, min(rank) OVER (PARTITION BY query_id) AS first FROM parts)
SELECT query_id, rank, running_tokens::BIGINT AS running_tokens FROM running WHERE rank = first OR running_tokens <= 4000""")
def context_budget(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.col("source").alias("path"), F.lit(0.5).alias("score"), "text")
    return answer.with_budget(rows, S.max_context_tokens).select("query_id", "rank", "running_tokens")


@query()
def answer_prompts(spark, d):
    asked_ = asked(spark, d).withColumn("mode", F.lit(None).cast("string"))
    return answer.prompts(asked_, engine(spark, d).search(asked(spark, d), S.ask_top_k), S.max_context_tokens)
