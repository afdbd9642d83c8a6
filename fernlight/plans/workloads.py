"""Queries over the driver's tables, each an operator or a composition of them, with the same result in SQL.

Documents stand in for one-chunk Markdown files: path lang/source/id.md, title the first five words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import staged
from ..functions.vectors import cosine
from ..operators import catalog, filters, fusion, keyword
from ..sources import embeddings, markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY = "thesea retionand on er with ation the"
TIERS = {"en/": 1.5, "en/src1": 1.3, "de/": 0.8, "fr/": 0.5}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.select(
        "doc_id", path.alias("path"), "lang", "source", F.col("text").alias("body"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("title"), F.concat_ws("-", "lang", "source", F.col("doc_id").cast("string")).alias("slug")
    )


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tok(x: str) -> str:
    cleaned = rf"list_transform(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}.]+'), lambda t: regexp_replace(t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))"
    return rf"list_filter({cleaned}, lambda t: t <> '' AND t NOT IN ({_STOPS}) AND NOT regexp_full_match(t, '\p{{Han}}'))"


CHUNKS = """chunks AS (
  SELECT doc_id, lang || '/' || source || '/' || doc_id || '.md' AS path, lang, source, text AS body,
    array_to_string(string_split(text, ' ')[1:5], ' ') AS title, lang || '-' || source || '-' || doc_id AS slug
  FROM documents
)"""
TOKENS = f"""{CHUNKS}, tok AS (
  SELECT *, {_tok("title")} AS tt, {_tok("regexp_replace(slug, '[./_-]+', ' ', 'g')")} AS st, {_tok("body")} AS bt FROM chunks
), idx AS (
  SELECT *, 4 * len(tt) + 3 * len(st) + len(bt) AS length FROM tok
)"""
_WANTED = T.query_terms(QUERY)


def _count_of(term: str) -> str:
    return "(" + " + ".join(f"{w} * len(list_filter({c}, lambda t: t = '{term}'))" for w, c in ((4, "tt"), (3, "st"), (1, "bt"))) + ")"


def _keyword_sql(source: str = "idx") -> str:
    tf = ", ".join(f"{_count_of(t)} AS tf{i}" for i, t in enumerate(_WANTED))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(_WANTED)))
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(length, 1) / mean_length)) ELSE 0 END" for i in range(len(_WANTED)))
    folded, hyphened = QUERY, "-".join(QUERY.split())
    boost = f"CASE WHEN contains(lower(title), '{folded}') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(slug), '{hyphened}') OR contains(regexp_replace(lower(slug), '[./_-]+', ' ', 'g'), '{folded}') THEN 2.5 ELSE 0 END"
    return f"""tf AS (SELECT *, {tf} FROM {source}), st AS (SELECT count(*) AS n, avg(greatest(length, 1)) AS mean_length, {df} FROM tf),
kw AS (SELECT * FROM (SELECT tf.*, {part} + {boost} AS keyword_score FROM tf, st) WHERE keyword_score > 0)"""


KEYWORD = f"WITH {TOKENS}, {_keyword_sql()}"
VECTOR = """q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
vs AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], qv) AS vector_score FROM embeddings, q)"""


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.index(chunks(spark, sf))


#: The inverted indexes of an application: rows without bodies, and postings.
_INDEXES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def build_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Splits all texts once and writes the index to the shared folder; later queries of the application read it."""
    own = staged(indexed(spark, sf).drop("body"), "indexed")
    rows = staged(own.drop("title", "slug", *keyword.FIELD_TERMS), "rows")
    inverted = staged(keyword.by_term(staged(keyword.postings(own, "doc_id"), "postings")), "postings")
    _INDEXES[spark.sparkContext.applicationId, sf] = rows, inverted
    return rows, inverted


def index_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _INDEXES.get((spark.sparkContext.applicationId, sf)) or build_index(spark, sf)


def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.score(*index_of(spark, sf), _WANTED, QUERY, "doc_id")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector that stands for the query's embedding: one row."""
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


# Text


@query(r"""SELECT doc_id, greatest(1, ceil(len(regexp_extract_all(text, '[A-Za-z0-9_./+-]+')) + len(regexp_extract_all(text, '\p{Han}')) / 1.6 + length(regexp_replace(text, '\p{Han}', '', 'g')) / 8.0))::BIGINT AS tokens FROM documents""")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_terms, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)")
def stopword_terms(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(r"SELECT doc_id, CASE WHEN length(f) > 260 THEN f[1:257] || '...' ELSE f END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'ation', ''))) / 5 + (length(text) - length(replace(text, 'the', ''))) / 3)::BIGINT AS n FROM documents")
def token_occurrences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.occurrences(F.col("text"), ["ation", "the"]).alias("n"))


@query(rf"""WITH {CHUNKS} SELECT doc_id, CASE WHEN path LIKE 'en/src1%' THEN 1.3 WHEN path LIKE 'en/%' THEN 1.5 WHEN path LIKE 'de/%' THEN 0.8 WHEN path LIKE 'fr/%' THEN 0.5 ELSE 1.0 END::DOUBLE AS tier FROM chunks""")
def tier_boost(spark, sf):
    return chunks(spark, sf).select("doc_id", T.tier(F.col("path"), TIERS).alias("tier"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), s AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM p),
b AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS slug FROM s),
h AS (SELECT *, trim(regexp_replace(regexp_replace(slug, '[-_]+', ' ', 'g'), '\s+', ' ', 'g')) AS flat, regexp_replace(lower(trim(path)), '[^\p{L}\p{N}\s-]', '', 'g') AS kept FROM b)
SELECT page_id, slug, regexp_replace(path, '(?i)\.md$', '') AS concept_id, upper(flat[1:1]) || flat[2:] AS human,
  regexp_replace(regexp_replace(regexp_replace(kept, '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS anchor FROM h""")
def slug_anchor_humanize(spark, sf):
    path = F.regexp_replace("url", "^https?://", "")
    slug = T.slug_of(path)
    return table(spark, sf, "pages").select("page_id", slug.alias("slug"), T.concept_id(path).alias("concept_id"), T.humanize(slug).alias("human"), T.anchor_of(path).alias("anchor"))


@query("SELECT page_id, sha256(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS sha FROM pages")
def strip_comments(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(T.strip_comments(F.col("html")), 256).alias("sha"))


@query(rf"WITH {CHUNKS} SELECT doc_id, h AS content_hash, sha256(doc_id::VARCHAR || ':document:0:' || h) AS chunk_uid FROM (SELECT doc_id, sha256(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS h FROM chunks)")
def content_hash_chunks(spark, sf):
    h = F.sha2(F.regexp_replace("body", "\\r\\n?", "\n"), 256)
    return chunks(spark, sf).select("doc_id", h.alias("content_hash"), catalog.chunk_uid(F.col("doc_id").cast("string"), F.lit("document"), F.lit(0), h).alias("chunk_uid"))


# Keyword search


@query(f"WITH {TOKENS} SELECT doc_id, length::BIGINT AS length FROM idx")
def bm25_doc_stats(spark, sf):
    return indexed(spark, sf).select("doc_id", "length")


@query(f"WITH {TOKENS} SELECT doc_id, length::BIGINT AS length FROM idx")
def keyword_index(spark, sf):
    return build_index(spark, sf)[0].select("doc_id", "length")


@query(f"WITH {TOKENS} SELECT doc_id, term, sum(w)::BIGINT AS tf FROM (SELECT doc_id, unnest(tt) AS term, 4 AS w FROM tok UNION ALL SELECT doc_id, unnest(st), 3 FROM tok UNION ALL SELECT doc_id, unnest(bt), 1 FROM tok) GROUP BY doc_id, term")
def inverted_index(spark, sf):
    return index_of(spark, sf)[1].select("doc_id", "term", "tf")


@query(f"WITH {TOKENS}, w AS (SELECT unnest({list(_WANTED)!r}) AS term) SELECT term, count(*) FILTER (WHERE list_contains(list_concat(tt, st, bt), term)) AS df FROM idx, w GROUP BY term")
def doc_frequency(spark, sf):
    wanted = spark.createDataFrame([(t,) for t in _WANTED], "term string")
    df = index_of(spark, sf)[1].where(F.col("term").isin(_WANTED)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return wanted.join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


@query(f"WITH {TOKENS} SELECT doc_id, {', '.join(f'{_count_of(t)}::BIGINT AS tf_{i}' for i, t in enumerate(_WANTED))} FROM idx")
def field_weighted_tf(spark, sf):
    rows = keyword.counted(indexed(spark, sf), _WANTED)
    return rows.select("doc_id", *(F.col("tf")[i].cast("long").alias(f"tf_{i}") for i in range(len(_WANTED))))


@query(rf"""WITH {CHUNKS} SELECT doc_id, (CASE WHEN contains(lower(title), 'the') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(slug), 'the') OR contains(regexp_replace(lower(slug), '[./_-]+', ' ', 'g'), 'the') THEN 2.5 ELSE 0 END)::DOUBLE AS boost FROM chunks""")
def exact_metadata_boost(spark, sf):
    return chunks(spark, sf).select("doc_id", keyword.boost("the", F.lower("title"), F.lower("slug")).alias("boost"))


@query(KEYWORD + " SELECT doc_id, path, round(keyword_score, 6) AS score FROM kw ORDER BY round(keyword_score, 9) DESC, doc_id LIMIT 10")
def keyword_topk(spark, sf):
    hits = keyword_hits(spark, sf)
    return hits.orderBy(F.round("keyword_score", 9).desc(), "doc_id").limit(10).select("doc_id", "path", F.round("keyword_score", 6).alias("score"))


@query(f"WITH {TOKENS}, good AS (SELECT idx.* FROM idx JOIN labels USING (doc_id) WHERE quality = 1), {_keyword_sql('good')} SELECT doc_id, path, round(keyword_score, 6) AS score FROM kw ORDER BY round(keyword_score, 9) DESC, doc_id LIMIT 10")
def keyword_topk_filtered(spark, sf):
    rows, inverted = index_of(spark, sf)
    good = rows.join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")
    return keyword.score(good, inverted, _WANTED, QUERY, "doc_id").orderBy(F.round("keyword_score", 9).desc(), "doc_id").limit(10).select("doc_id", "path", F.round("keyword_score", 6).alias("score"))


@query(KEYWORD.replace("+ CASE WHEN contains(lower(title)", "+ 0 * CASE WHEN contains(lower(title)").replace("+ CASE WHEN contains(lower(slug)", "+ 0 * CASE WHEN contains(lower(slug)") + " SELECT doc_id, round(keyword_score, 6) AS score FROM kw")
def keyword_postings(spark, sf):
    return keyword.score(*index_of(spark, sf), _WANTED, "", "doc_id").select("doc_id", F.round("keyword_score", 6).alias("score"))


# Vectors, fusion, pooling


@query(f"WITH {VECTOR} SELECT doc_id AS vec_id, round(vector_score, 6) AS score FROM vs WHERE vector_score > 0")
def cosine_scan(spark, sf):
    return fusion.vector_scan(table(spark, sf, "embeddings"), query_vector(spark, sf)).select("vec_id", F.round("vector_score", 6).alias("score"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query(f"WITH {VECTOR} SELECT doc_id AS vec_id, round(vector_score, 6) AS score FROM vs ORDER BY round(vector_score, 9) DESC, doc_id LIMIT 50")
def vector_top50(spark, sf):
    return fusion.vector_top(table(spark, sf, "embeddings"), query_vector(spark, sf), "vec_id").select("vec_id", F.round("vector_score", 6).alias("score"))


def _fused(spark, sf, weights=(1.0, 1.0)):
    kw = keyword_hits(spark, sf)
    vec = fusion.vector_scan(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), query_vector(spark, sf))
    return fusion.fuse(kw, vec, "doc_id", weights=weights)


def _fused_sql(weights=(1.0, 1.0)) -> str:
    return f"""{KEYWORD}, {VECTOR}, kr AS (SELECT doc_id, keyword_score, row_number() OVER (ORDER BY round(keyword_score, 9) DESC, doc_id) AS keyword_rank FROM kw),
vr AS (SELECT doc_id, vector_score, row_number() OVER (ORDER BY round(vector_score, 9) DESC, doc_id) AS vector_rank FROM vs WHERE vector_score > 0),
fused AS (SELECT coalesce(kr.doc_id, vr.doc_id) AS doc_id, keyword_score, vector_score, keyword_rank, vector_rank,
  coalesce({weights[0]} / (60.0::DOUBLE + keyword_rank), 0) + coalesce({weights[1]} / (60.0::DOUBLE + vector_rank), 0) AS rrf FROM kr FULL JOIN vr ON kr.doc_id = vr.doc_id)"""


@query(_fused_sql() + " SELECT doc_id, keyword_rank, vector_rank, round(rrf, 6) AS score FROM fused")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("doc_id", "keyword_rank", "vector_rank", F.round("rrf", 6).alias("score"))


@query(_fused_sql((1.0, 3.0)) + " SELECT doc_id, keyword_rank, vector_rank, round(rrf, 6) AS score FROM fused")
def weighted_rrf(spark, sf):
    return _fused(spark, sf, (1.0, 3.0)).select("doc_id", "keyword_rank", "vector_rank", F.round("rrf", 6).alias("score"))


@query(_fused_sql() + f", own AS (SELECT c.doc_id, c.source, rrf * CASE WHEN path LIKE 'en/src1%' THEN 1.3 WHEN path LIKE 'en/%' THEN 1.5 WHEN path LIKE 'de/%' THEN 0.8 WHEN path LIKE 'fr/%' THEN 0.5 ELSE 1.0 END AS score FROM fused JOIN chunks c USING (doc_id)) SELECT source, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) AS n FROM own) WHERE n = 1 ORDER BY round(score, 9) DESC, doc_id LIMIT 10".replace("'", "'"))
def pool_by_document(spark, sf):
    own = _fused(spark, sf).join(index_of(spark, sf)[0].select("doc_id", "path", "source"), "doc_id").withColumn("score", F.col("rrf") * T.tier(F.col("path"), TIERS))
    return fusion.pool(own, "source", 10, "score", "doc_id").select("source", "doc_id", F.round("score", 6).alias("score"))


@query(_fused_sql() + """ SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND coalesce(keyword_score, 0) > 0 THEN 'title_match' WHEN coalesce(keyword_score, 0) >= 3 THEN 'keyword_exact'
  WHEN coalesce(vector_score, 0) > 0.78 THEN 'high_vector_match' WHEN coalesce(vector_score, 0) > 0 THEN 'vector_match' ELSE 'keyword_match' END AS evidence FROM fused""")
def evidence_class(spark, sf):
    return _fused(spark, sf).select("doc_id", fusion.evidence(F.col("keyword_score"), F.col("vector_score"), F.col("doc_id") % 3).alias("evidence"))


@query(KEYWORD + """, top AS (SELECT doc_id, keyword_score AS score FROM kw ORDER BY round(keyword_score, 9) DESC, doc_id LIMIT 40), n AS (SELECT doc_id, score / (SELECT max(score) FROM top) AS s FROM top)
SELECT doc_id, round(s, 6) AS normalized_score FROM n WHERE s >= 0.6 ORDER BY round(s, 9) DESC, doc_id LIMIT 10""")
def normalized_threshold(spark, sf):
    hits = keyword_hits(spark, sf).withColumnRenamed("keyword_score", "score")
    return fusion.threshold(hits, 10, 0.6, F.round("score", 9).desc(), F.col("doc_id")).select("doc_id", F.round("normalized_score", 6).alias("normalized_score"))


# Facets and conditions: events' props are open JSON, documents' labels may be absent

_FACETS_SQL = "e AS (SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k, json_extract_string(props, '$.k') AS ks FROM events)"


def _facets(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("props").alias("facets"))


def _metadata(name: str, op: str, value, sql: str, key: str = "k"):
    def run(spark, sf):
        rows = _facets(spark, sf)
        return rows.where(filters.condition(key, op, value, rows.columns)).select("event_id")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_FACETS_SQL} SELECT event_id FROM e WHERE {sql}"


@query(f"WITH {_FACETS_SQL} SELECT event_id FROM e WHERE ks = '7'")
def facet_filter(spark, sf):
    return _facets(spark, sf).where(filters.exact({"k": "7"})).select("event_id")


_metadata("metadata_is", "is", 5, "k = 5")
_metadata("metadata_is_text", "=", "5", "k = 5")
_metadata("metadata_is_not", "≠", 5, "k IS DISTINCT FROM 5")
_metadata("metadata_in", "in", [1, "2", 3], "k IN (1, 2, 3)")
_metadata("metadata_not_in", "not in", [1, "2", 3], "k IS NULL OR k NOT IN (1, 2, 3)")
_metadata("metadata_gt", ">", 50, "k > 50")
_metadata("metadata_lt", "<", "10", "k < 10")
_metadata("metadata_ge", "≥", 50, "k >= 50")
_metadata("metadata_le", "<=", 10, "k <= 10")

def _labelled(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.to_json(F.struct("lang", "source", "quality", F.array("lang", "source").alias("tags"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")), "yyyy-MM-dd").alias("day"))).alias("facets"))


_DOC_FACETS_SQL = "d AS (SELECT doc_id, lang, source, quality, strftime(DATE '2024-01-01' + (doc_id % 200)::INTEGER, '%Y-%m-%d') AS day FROM documents LEFT JOIN labels USING (doc_id))"


def _documents_where(name: str, key: str, op: str, value, sql: str):
    def run(spark, sf):
        rows = _labelled(spark, sf)
        return rows.where(filters.condition(key, op, value, rows.columns)).select("doc_id")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_DOC_FACETS_SQL} SELECT doc_id FROM d WHERE {sql}"


_documents_where("metadata_contains", "source", "contains", "c1", "contains(source, 'c1')")
_documents_where("metadata_contains_item", "tags", "contains", "fr", "lang = 'fr' OR source = 'fr'")
_documents_where("metadata_not_contains", "source", "not contains", "c1", "NOT contains(source, 'c1')")
_documents_where("metadata_start_with", "source", "start with", "src1", "source LIKE 'src1%'")
_documents_where("metadata_end_with", "source", "end with", "9", "source LIKE '%9'")
_documents_where("metadata_before", "day", "before", "2024-04-01", "day < '2024-04-01'")
_documents_where("metadata_after", "day", "after", "2024-04-01", "day > '2024-04-01'")
_documents_where("metadata_absent_number", "quality", ">", -1, "quality > -1")


def _sparse(spark, sf):
    """A facet that is absent, null, empty in three ways, false, zero or filled, by turns."""
    kinds = ("{}", '{"x": null}', '{"x": ""}', '{"x": []}', '{"x": {}}', '{"x": false}', '{"x": 0}', '{"x": "v"}', '{"x": [null]}', '{"x": {"y": 1}}')
    return table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % len(kinds) + 1).cast("int")).alias("facets"))


def _sparse_where(name: str, op: str, value, sql: str):
    def run(spark, sf):
        rows = _sparse(spark, sf)
        return rows.where(filters.condition("x", op, value, rows.columns)).select("doc_id")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id FROM documents WHERE {sql}"


_sparse_where("metadata_empty", "empty", None, "doc_id % 10 < 5")
_sparse_where("metadata_not_empty", "not empty", None, "doc_id % 10 >= 5")
_sparse_where("metadata_missing", "is", "undefined", "doc_id % 10 = 0")


@query(f"WITH {_DOC_FACETS_SQL} SELECT doc_id FROM d WHERE lang = 'de' OR quality = 0")
def metadata_tree(spark, sf):
    rows = _labelled(spark, sf)
    tree = {"logical_operator": "or", "conditions": [{"name": "lang", "comparison_operator": "is", "value": "de"}, {"name": "quality", "comparison_operator": "=", "value": 0}]}
    return rows.where(filters.conditions(tree, rows.columns)).select("doc_id")


# Catalogue: two revisions of the documents, links between them, a queue

_BEFORE = "b AS (SELECT 'd/' || doc_id || '.md' AS path, md5(text) AS content_hash, md5(lang) AS frontmatter_hash, doc_id::VARCHAR AS doc_id, 'active' AS status, '1' AS last_synced_at FROM documents WHERE doc_id % 7 <> 0)"
_NOW = "n AS (SELECT 'd/' || doc_id || '.md' AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash, md5(lang) AS frontmatter_hash, 'new' AS doc_id, 'active' AS status, '2' AS last_synced_at FROM documents WHERE doc_id % 11 <> 0)"


def _revisions(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    rest = lambda at: (F.md5("lang").alias("frontmatter_hash"),)
    before = d.where("doc_id % 7 <> 0").select(path, F.md5("text").alias("content_hash"), *rest(1), F.col("doc_id").cast("string").alias("doc_id"), F.lit("active").alias("status"), F.lit("1").alias("last_synced_at"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = d.where("doc_id % 11 <> 0").select(path, F.md5(text).alias("content_hash"), *rest(2), F.lit("new").alias("doc_id"), F.lit("active").alias("status"), F.lit("2").alias("last_synced_at"))
    return before, now


@query(f"WITH {_BEFORE}, {_NOW} SELECT coalesce(n.path, b.path) AS path, CASE WHEN n.path IS NULL THEN 'missing' WHEN b.path IS NULL THEN 'new' WHEN n.content_hash = b.content_hash AND n.frontmatter_hash = b.frontmatter_hash THEN 'unchanged' ELSE 'changed' END AS action FROM n FULL JOIN b ON n.path = b.path")
def sync_plan(spark, sf):
    return catalog.changes(*_revisions(spark, sf))


@query(f"WITH {_BEFORE}, {_NOW} SELECT coalesce(n.path, b.path) AS path, coalesce(n.content_hash, b.content_hash) AS content_hash, coalesce(n.frontmatter_hash, b.frontmatter_hash) AS frontmatter_hash, coalesce(b.doc_id, n.doc_id) AS doc_id, 'active' AS status, coalesce(n.last_synced_at, b.last_synced_at) AS last_synced_at FROM n FULL JOIN b ON n.path = b.path")
def upsert_snapshot(spark, sf):
    return catalog.upsert(*_revisions(spark, sf))


@query(f"WITH {_BEFORE}, {_NOW} SELECT b.path, b.doc_id, CASE WHEN n.path IS NULL THEN 'deleted' ELSE b.status END AS status, CASE WHEN n.path IS NULL THEN '3' ELSE b.last_synced_at END AS last_synced_at FROM b LEFT JOIN n ON n.path = b.path")
def tombstone(spark, sf):
    before, now = _revisions(spark, sf)
    return catalog.tombstone(before, before.join(now, "path", "left_anti"), "3").select("path", "doc_id", "status", "last_synced_at")


_LINKS = """docs AS (SELECT doc_id::VARCHAR AS doc_id, lang || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 50 = 0 THEN 'same' ELSE 'doc-' || doc_id END AS slug, CASE WHEN doc_id % 13 = 0 THEN 'deleted' ELSE 'active' END AS status FROM documents),
links AS (
  SELECT doc_id::VARCHAR AS src_doc_id, 'wikilink' AS kind, 'doc-' || ((doc_id * 7) % 1200) AS normalized_target FROM documents
  UNION ALL SELECT doc_id::VARCHAR, 'wikilink', 'same' FROM documents WHERE doc_id % 9 = 0
  UNION ALL SELECT doc_id::VARCHAR, 'wikilink', lang || '/' || (doc_id + 1) FROM documents
  UNION ALL SELECT doc_id::VARCHAR, 'mdlink_relative', lang || '/' || (doc_id + 2) || '.md' FROM documents
  UNION ALL SELECT doc_id::VARCHAR, 'wikilink', '' FROM documents WHERE doc_id % 17 = 0
  UNION ALL SELECT doc_id::VARCHAR, 'external', 'https://example.org/' || doc_id FROM documents
), active AS (SELECT * FROM docs WHERE status = 'active'), slugs AS (SELECT slug, count(*) AS same, min(doc_id) AS doc_id FROM active GROUP BY slug),
resolved AS (
  SELECT l.*, CASE WHEN kind = 'external' THEN NULL ELSE coalesce(p.doc_id, m.doc_id, CASE WHEN same = 1 THEN s.doc_id END) END AS resolved_doc_id,
    kind = 'wikilink' AND p.doc_id IS NULL AND m.doc_id IS NULL AND coalesce(same > 1, false) AS ambiguous
  FROM links l LEFT JOIN active p ON p.path = l.normalized_target AND l.normalized_target <> ''
    LEFT JOIN active m ON l.kind = 'wikilink' AND l.normalized_target <> '' AND m.path = l.normalized_target || '.md'
    LEFT JOIN slugs s ON l.kind = 'wikilink' AND l.normalized_target <> '' AND s.slug = regexp_replace(regexp_extract(l.normalized_target, '([^/]*)$', 1), '(?i)\\.md$', '')
)"""


def _link_tables(spark, sf):
    d = table(spark, sf, "documents")
    own = F.col("doc_id").cast("string")
    path = lambda shift, end: F.concat("lang", F.lit("/"), (F.col("doc_id") + shift).cast("string"), F.lit(end))
    docs = d.select(own.alias("doc_id"), path(0, ".md").alias("path"), F.when(F.col("doc_id") % 50 == 0, "same").otherwise(F.concat(F.lit("doc-"), own)).alias("slug"), F.when(F.col("doc_id") % 13 == 0, "deleted").otherwise("active").alias("status"))
    kinds = [
        (d, "wikilink", F.concat(F.lit("doc-"), (F.col("doc_id") * 7 % 1200).cast("string"))),
        (d.where("doc_id % 9 = 0"), "wikilink", F.lit("same")),
        (d, "wikilink", path(1, "")),
        (d, "mdlink_relative", path(2, ".md")),
        (d.where("doc_id % 17 = 0"), "wikilink", F.lit("")),
        (d, "external", F.concat(F.lit("https://example.org/"), own)),
    ]
    links = None
    for rows, kind, target in kinds:
        part = rows.select(own.alias("src_doc_id"), F.lit(kind).alias("kind"), target.alias("normalized_target"))
        links = part if links is None else links.unionByName(part)
    return docs, links


def _resolved(spark, sf):
    docs, links = _link_tables(spark, sf)
    return docs, catalog.resolve_links(links, docs)


@query(f"WITH {_LINKS} SELECT * FROM resolved")
def link_resolution(spark, sf):
    return _resolved(spark, sf)[1]


_ENDS = "SELECT r.src_doc_id, s.path AS src_path, r.kind, r.normalized_target, r.resolved_doc_id, t.path AS resolved_path FROM resolved r JOIN docs s ON s.doc_id = r.src_doc_id LEFT JOIN docs t ON t.doc_id = r.resolved_doc_id"
_LINK_COLUMNS = ("src_doc_id", "src_path", "kind", "normalized_target", "resolved_doc_id", "resolved_path")


@query(f"WITH {_LINKS} {_ENDS} WHERE r.src_doc_id = '18'")
def outgoing_links(spark, sf):
    docs, links = _resolved(spark, sf)
    return catalog.outgoing(links, docs, "18").select(*_LINK_COLUMNS)


@query(f"WITH {_LINKS} {_ENDS} WHERE r.resolved_doc_id = '19'")
def incoming_links(spark, sf):
    docs, links = _resolved(spark, sf)
    return catalog.incoming(links, docs, "19").select(*_LINK_COLUMNS)


@query(f"WITH {_LINKS} {_ENDS} WHERE r.kind <> 'external' AND r.resolved_doc_id IS NULL")
def broken_links(spark, sf):
    docs, links = _resolved(spark, sf)
    return catalog.broken(links, docs).select(*_LINK_COLUMNS)


@query(f"WITH {_LINKS} SELECT doc_id, path FROM docs WHERE status = 'active' AND (slug = 'same' OR path IN ('same', 'same.md'))")
def resolve_slug(spark, sf):
    return catalog.resolve(_link_tables(spark, sf)[0], "same").select("doc_id", "path")


@query(f"WITH {_LINKS} SELECT doc_id, path, slug FROM docs WHERE status = 'active'")
def active_documents(spark, sf):
    return _link_tables(spark, sf)[0].where("status = 'active'").orderBy("path").select("doc_id", "path", "slug")


_QUEUE = """ch AS (SELECT doc_id::VARCHAR AS chunk_uid, doc_id::VARCHAR AS doc_id, md5(text) AS content_hash, text AS body, 1::BIGINT AS token_est, CASE WHEN doc_id % 4 = 0 THEN [1.0::DOUBLE] END AS embedding FROM documents),
queue AS (SELECT doc_id::VARCHAR AS chunk_uid, lpad(((doc_id * 37) % 1000)::VARCHAR, 4, '0') AS enqueued_at, (doc_id % 3)::INTEGER AS attempts,
  CASE WHEN doc_id % 3 = 1 THEN 'HTTP 429' WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN 'the maximum context length is 8' END AS last_error, CASE WHEN doc_id % 3 = 1 THEN true WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN false END AS retryable FROM documents WHERE doc_id % 5 < 2)"""


def _queue_tables(spark, sf):
    d = table(spark, sf, "documents")
    own, n = F.col("doc_id").cast("string"), F.col("doc_id")
    ch = d.select(own.alias("chunk_uid"), own.alias("doc_id"), F.md5("text").alias("content_hash"), F.col("text").alias("body"), F.lit(1).cast("long").alias("token_est"), F.when(n % 4 == 0, F.array(F.lit(1.0))).alias("embedding"))
    late, long = n % 3 == 1, (n % 3 == 2) & (n % 2 == 0)
    queue = d.where("doc_id % 5 < 2").select(
        own.alias("chunk_uid"), F.lpad((n * 37 % 1000).cast("string"), 4, "0").alias("enqueued_at"), (n % 3).cast("int").alias("attempts"),
        F.when(late, "HTTP 429").when(long, "the maximum context length is 8").alias("last_error"), F.when(late, True).when(long, False).alias("retryable"),
    )
    return ch, queue


@query(f"WITH {_QUEUE} SELECT chunk_uid, enqueued_at, attempts FROM queue WHERE retryable IS DISTINCT FROM false ORDER BY enqueued_at, attempts, chunk_uid LIMIT 64")
def queue_poll(spark, sf):
    ch, queue = _queue_tables(spark, sf)
    return catalog.poll(queue, ch, 64).select("chunk_uid", "enqueued_at", "attempts")


@query(f"WITH {_LINKS}, {_QUEUE} SELECT chunk_uid, path, attempts, last_error, retryable FROM queue JOIN ch USING (chunk_uid) JOIN docs USING (doc_id) WHERE last_error IS NOT NULL ORDER BY retryable DESC NULLS LAST, attempts DESC, path, chunk_uid LIMIT 50")
def failed_list(spark, sf):
    ch, queue = _queue_tables(spark, sf)
    return catalog.failed(queue, ch, _link_tables(spark, sf)[0], 50).select("chunk_uid", "path", "attempts", "last_error", "retryable")


@query(f"WITH {_LINKS}, {_QUEUE} SELECT chunk_uid FROM ch JOIN docs USING (doc_id) WHERE status = 'active' AND embedding IS NULL AND chunk_uid NOT IN (SELECT chunk_uid FROM queue)")
def enqueue_missing(spark, sf):
    ch, queue = _queue_tables(spark, sf)
    return catalog.missing(ch, _link_tables(spark, sf)[0], queue)


@query(f"WITH {_QUEUE} SELECT chunk_uid, enqueued_at, CASE WHEN again THEN 0 ELSE attempts END AS attempts, CASE WHEN again THEN NULL ELSE last_error END AS last_error, CASE WHEN again THEN NULL ELSE retryable END AS retryable FROM (SELECT *, coalesce(retryable, false) OR coalesce(last_error LIKE '%maximum context length%', false) AS again FROM queue)")
def retry_failed(spark, sf):
    return catalog.retry(_queue_tables(spark, sf)[1])


@query(f"WITH {_QUEUE}, errors AS (SELECT chunk_uid FROM queue WHERE chunk_uid LIKE '%1') SELECT q.chunk_uid, CASE WHEN e.chunk_uid IS NULL THEN attempts ELSE attempts + 1 END AS attempts, CASE WHEN e.chunk_uid IS NULL THEN last_error ELSE repeat('x', 2000) END AS last_error, CASE WHEN e.chunk_uid IS NULL THEN retryable ELSE true END AS retryable FROM queue q LEFT JOIN errors e USING (chunk_uid)")
def mark_failure(spark, sf):
    queue = _queue_tables(spark, sf)[1]
    errors = queue.where("chunk_uid LIKE '%1'").select("chunk_uid", F.repeat(F.lit("x"), 2500).alias("error"), F.lit(True).alias("may_retry"))
    return catalog.fail(queue, errors).select("chunk_uid", "attempts", "last_error", "retryable")


_CACHE = "cache AS (SELECT DISTINCT 'p' AS provider, 'm' AS model, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS dimensions, md5(text) AS content_hash, [7.0::DOUBLE] AS vector FROM documents WHERE doc_id % 6 = 0)"


@query(f"WITH {_QUEUE}, {_CACHE} SELECT chunk_uid, coalesce(ch.embedding, c.vector)[1] AS first FROM ch LEFT JOIN cache c ON c.content_hash = ch.content_hash AND dimensions = 1")
def cache_lookup(spark, sf):
    ch, _ = _queue_tables(spark, sf)
    cache = table(spark, sf, "documents").where("doc_id % 6 = 0").select(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("dimensions"), F.md5("text").alias("content_hash"), F.array(F.lit(7.0)).alias("vector")).distinct()
    return catalog.from_cache(ch, cache, "p", "m", 1).select("chunk_uid", F.col("embedding")[0].alias("first"))


@query(f"""WITH {_LINKS}, {_QUEUE} SELECT (SELECT count(*) FROM docs WHERE status = 'active') AS documents_active, (SELECT count(*) FROM docs WHERE status = 'deleted') AS documents_deleted, (SELECT count(*) FROM ch) AS chunks,
  (SELECT count(embedding) FROM ch) AS embedded_chunks, (SELECT count(*) FROM resolved) AS links, (SELECT count(*) FROM resolved WHERE kind <> 'external' AND resolved_doc_id IS NULL) AS broken_links,
  (SELECT count(*) FROM resolved WHERE ambiguous) AS ambiguous_links, (SELECT count(*) FROM queue WHERE last_error IS NULL) AS queued_embeddings, (SELECT count(last_error) FROM queue) AS failed_embeddings, 'hybrid' AS retrieval_mode""")
def catalog_stats(spark, sf):
    docs, links = _resolved(spark, sf)
    ch, queue = _queue_tables(spark, sf)
    return catalog.statistics(docs, ch, links, queue)


# Markdown: documents become files with front matter, headings, a fence and links, by the same text in both engines

_SETTINGS = {"cjk_char_per_token": 1.6, "target_tokens": 60, "max_tokens": 120, "tier_boost": TIERS, "exclude_flags": ["hidden"]}
_MD_SQL = """md AS (SELECT doc_id, lang || '/' || doc_id || '.md' AS path, '---' || chr(10) || 'title: T' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'rank: ' || (doc_id % 5) || chr(10) || 'tags: [a, ' || source || ', a]' || chr(10) || '---' || chr(10) AS front,
  '# Head ' || doc_id || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || '## Links' || chr(10) || '[[doc-' || ((doc_id * 7) % 1200) || '#part|name]] and [x](../' || source || '/' || (doc_id + 1) || '.md#a) and ![i](no.md) and ^[' || lang || '/' || (doc_id + 2) || '.md] and [e](https://example.org/' || doc_id || ')' || chr(10) || '```' || chr(10) || '[[fenced]]' || chr(10) || '```' || chr(10) AS body FROM documents)"""


def _markdown(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    n, nl = F.col("doc_id"), F.lit("\n")
    s = lambda c: c.cast("string")
    front = F.concat(F.lit("---\ntitle: T"), s(n), F.lit("\nlang: "), "lang", F.lit("\nrank: "), s(n % 5), F.lit("\ntags: [a, "), "source", F.lit(", a]\n---\n"))
    links = F.concat(
        F.lit("[[doc-"), s(n * 7 % 1200), F.lit("#part|name]] and [x](../"), "source", F.lit("/"), s(n + 1), F.lit(".md#a) and ![i](no.md) and ^["), "lang", F.lit("/"), s(n + 2), F.lit(".md] and [e](https://example.org/"), s(n), F.lit(")\n")
    )
    body = F.concat(F.lit("# Head "), s(n), nl, F.replace("text", nl, F.lit("\n\n")), F.lit("\n## Links\n"), links, F.lit("```\n[[fenced]]\n```\n"))
    return d.select("doc_id", F.concat("lang", F.lit("/"), s(n), F.lit(".md")).alias("path"), F.concat(front, body).alias("text"))


def _parsed(spark, sf) -> DataFrame:
    return markdown.parse_texts(_markdown(spark, sf), _SETTINGS)


@query(f"WITH {_MD_SQL} SELECT path, 'T' || doc_id AS title, sha256(front || body) AS content_hash, (doc_id % 5)::VARCHAR AS rank, array_to_string(list_distinct_keep, ',') AS tags FROM (SELECT md.*, ['a', source] AS list_distinct_keep FROM md JOIN documents USING (doc_id))")
def frontmatter_split(spark, sf):
    return _parsed(spark, sf).select("path", "title", "content_hash", F.get_json_object("facets", "$.rank").alias("rank"), F.array_join("tags", ",").alias("tags"))


_LINK_SQL = {
    "wikilinks": ("wikilink", "SELECT path, 'doc-' || ((doc_id * 7) % 1200) || '#part|name' AS raw_target, 'doc-' || ((doc_id * 7) % 1200) AS normalized_target, 'part' AS anchor, 'name' AS alias FROM md"),
    "mdlinks": ("mdlink_relative", "SELECT path, '../' || source || '/' || (doc_id + 1) || '.md#a' AS raw_target, source || '/' || (doc_id + 1) || '.md' AS normalized_target, 'a' AS anchor, 'x' AS alias FROM md JOIN documents USING (doc_id)"),
    "footnotes": ("footnote_source", "SELECT path, lang || '/' || (doc_id + 2) || '.md' AS raw_target, lang || '/' || (doc_id + 2) || '.md' AS normalized_target, NULL::VARCHAR AS anchor, NULL::VARCHAR AS alias FROM md JOIN documents USING (doc_id)"),
    "external_links": ("external", "SELECT path, 'https://example.org/' || doc_id AS raw_target, 'https://example.org/' || doc_id AS normalized_target, NULL::VARCHAR AS anchor, 'e' AS alias FROM md"),
}


def _links_of(name: str, kind: str, sql: str):
    def run(spark, sf):
        rows = _parsed(spark, sf).select("path", F.explode("links").alias("l")).where(F.col("l.kind") == kind)
        return rows.select("path", "l.raw_target", "l.normalized_target", "l.anchor", "l.alias")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_MD_SQL} {sql}"


for _name, (_kind, _sql) in _LINK_SQL.items():
    _links_of(_name, _kind, _sql)




def _tokens_sql(x: str) -> str:
    return rf"greatest(1, ceil(len(regexp_extract_all({x}, '[A-Za-z0-9_./+-]+')) + len(regexp_extract_all({x}, '\p{{Han}}')) / 1.6 + length(regexp_replace({x}, '\p{{Han}}', '', 'g')) / 8.0))::BIGINT"


_TARGET, _MOST = _SETTINGS["target_tokens"], _SETTINGS["max_tokens"]
#: Of texts (id, t): parts (id, part, p), by walking through each text's blocks one after another.
_SPLIT_SQL = rf"""blocks AS (SELECT id, unnest(regexp_split_to_array(t, '\n\n+')) AS b, generate_subscripts(regexp_split_to_array(t, '\n\n+'), 1) AS i FROM texts WHERE {_tokens_sql("t")} > {_MOST}),
steps AS (
  SELECT id, i, 0 AS part, b AS held FROM blocks WHERE i = 1
  UNION ALL SELECT id, i, CASE WHEN fits THEN part ELSE part + 1 END, CASE WHEN fits THEN joined ELSE b END FROM (
    SELECT *, held = '' OR {_tokens_sql("joined")} <= {_TARGET} AS fits FROM (
      SELECT b.id, b.i, s.part, s.held, b.b, CASE WHEN s.held = '' THEN b.b ELSE s.held || chr(10) || chr(10) || b.b END AS joined FROM steps AS s JOIN blocks AS b ON b.id = s.id AND b.i = s.i + 1))
), parts AS (
  SELECT id, part, arg_max(held, i) AS p FROM steps GROUP BY id, part HAVING trim(arg_max(held, i), ' ' || chr(9) || chr(10)) <> '' OR part < (SELECT max(m.part) FROM steps AS m WHERE m.id = steps.id)
  UNION ALL SELECT id, 0, t FROM texts WHERE {_tokens_sql("t")} <= {_MOST}
)"""


@query(f"""WITH RECURSIVE texts AS (SELECT doc_id AS id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents), {_SPLIT_SQL}
SELECT id AS doc_id, part, {_tokens_sql("p")} AS tokens, sha256(p) AS part_sha FROM parts""")
def oversize_split(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return markdown.split_texts(texts, _SETTINGS, "doc_id").select("doc_id", "part", "tokens", F.sha2("text", 256).alias("part_sha"))


@query(rf"""WITH RECURSIVE {_MD_SQL}, secs AS (
  SELECT md.path, 1 AS sec, 'Head ' || doc_id AS heading, 'head-' || doc_id AS anchor, string_split(body, chr(10) || '## Links' || chr(10))[1] AS t FROM md
  UNION ALL SELECT path, 2, 'Head ' || doc_id || ' > Links', 'links', '## Links' || chr(10) || string_split(body, chr(10) || '## Links' || chr(10))[2] FROM md
), texts AS (SELECT path || ' ' || sec AS id, path, sec, heading, anchor, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM secs), {_SPLIT_SQL},
rows AS (
  SELECT path, 0 AS sec, 0 AS part, 'Document Summary' AS heading, 'summary' AS anchor, 'T' || md.doc_id || ' a ' || source AS p FROM md JOIN documents AS d ON d.doc_id = md.doc_id
  UNION ALL SELECT path, sec, part, heading, anchor, p FROM parts JOIN texts USING (id) WHERE trim(p, ' ' || chr(9) || chr(10)) <> ''
)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY sec, part) - 1)::INTEGER AS seq, heading AS heading_path, anchor, {_tokens_sql("p")} AS token_est, sha256(p) AS content_hash FROM rows""")
def markdown_chunks(spark, sf):
    rows = _parsed(spark, sf).select("path", F.explode("chunks").alias("c"))
    return rows.select("path", "c.seq", F.array_join("c.heading_path", " > ").alias("heading_path"), "c.anchor", "c.token_est", "c.content_hash")


@query(rf"""WITH {_MD_SQL}, l AS (SELECT path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM md),
f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS fences FROM l)
SELECT path, count(*) FILTER (WHERE NOT fence AND fences % 2 = 0 AND regexp_matches(line, '^#{{1,6}}\s+\S')) AS headings FROM f GROUP BY path""")
def sections(spark, sf):
    heads = F.size(F.array_distinct(F.transform(F.filter("chunks", lambda c: c["seq"] > 0), lambda c: F.array_join(c["heading_path"], ">"))))
    return _parsed(spark, sf).select("path", heads.cast("long").alias("headings"))


@query(f"WITH {_MD_SQL} SELECT path, 'Head ' || doc_id AS heading FROM md")
def first_heading(spark, sf):
    return _markdown(spark, sf).select("path", T.first_heading(F.col("text")).alias("heading"))


@query(f"WITH {CHUNKS} SELECT path AS chunk_uid, md5(body) AS content_hash, 32 AS dimensions, NULL::VARCHAR AS error FROM chunks")
def embed_batches(spark, sf):
    pending = chunks(spark, sf).select(F.col("path").alias("chunk_uid"), F.md5("body").alias("content_hash"), "body", T.estimate_tokens(F.col("body")).cast("long").alias("token_est"))
    settings = {"provider": "local", "dimensions": 32, "batch_size": 16, "max_batch_tokens": 3000, "max_input_tokens": 800}
    return embeddings.embed(pending, settings).select("chunk_uid", "content_hash", F.size("vector").alias("dimensions"), "error")
