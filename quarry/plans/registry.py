"""All queries of the engine by name, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.chunkers import registry as chunkers
from quarry.functions import text as T
from quarry.operators import decide, evaluate, scoring, stats, tools
from quarry.operators import index as ix
from quarry.operators import vectors as V
from quarry.plans import corpus, fixtures
from quarry.plans import oracle as O
from quarry.session import cut
from quarry.streaming import calls as streams

K = 5
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def blended(spark: SparkSession, d: str) -> DataFrame:
    return cut(scoring.search(corpus.index(spark, d), corpus.queries(spark, d), "hybrid+blend", K))


# Text


@query(
    f"WITH RECURSIVE {O.CHUNKS}, c_idents AS (SELECT chunk_id, unnest({O.IDENT.format('content')}) AS ident FROM chunks), {O.folded('c_idents')} "
    f"SELECT DISTINCT ident, array_to_string(toks, ' ') AS tokens FROM tokens_of"
)
def tokenize_idents(spark: SparkSession, d: str) -> DataFrame:
    words = corpus.files(spark, d).select(F.explode(T.idents(F.col("content"))).alias("ident")).distinct()
    return words.select("ident", F.array_join(T.ident_tokens(F.col("ident")), " ").alias("tokens"))


@query(f"WITH w AS (SELECT DISTINCT lower(unnest({O.IDENT.format('text')})) AS word FROM documents) SELECT word, {O.stem_sql('word')} AS stem FROM w")
def stem_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = corpus.files(spark, d).select(F.explode(T.idents(F.col("content"))).alias("ident")).select(F.lower("ident").alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query(O.SPOKEN + " SELECT query_id, term FROM qterms")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return scoring.terms_of(corpus.spoken(spark, d))


# Index


@query(O.INDEX + " SELECT chunk_id, term, tf FROM postings")
def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return corpus.index(spark, d).postings.select("chunk_id", "term", "tf")


@query(O.INDEX + " SELECT chunk_id, dlen FROM docs")
def doc_length(spark: SparkSession, d: str) -> DataFrame:
    return corpus.index(spark, d).docs


@query(O.INDEX + " SELECT term, df FROM terms")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return corpus.index(spark, d).terms.select("term", "df")


@query(O.INDEX + " SELECT n_chunks, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.index(spark, d).corpus.select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query(O.INDEX + " SELECT term, round(idf, 6) AS idf FROM terms")
def idf(spark: SparkSession, d: str) -> DataFrame:
    return corpus.index(spark, d).terms.select("term", F.round("idf", 6).alias("idf"))


@query(
    O.INDEX + ", norms AS (SELECT chunk_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM postings JOIN terms USING (term) GROUP BY 1) SELECT chunk_id, "
    "term, round(CASE WHEN norm > 0 THEN tf * idf / norm ELSE 0 END, 6) AS w FROM postings JOIN terms USING (term) JOIN norms USING (chunk_id)"
)
def tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    index = corpus.index(spark, d)
    return ix.weights(index.postings, index.terms).select("chunk_id", "term", F.round("w", 6).alias("w"))


# Retrieval


@query(O.INDEX + O.QTERMS + O.BM25 + O.SHOW.replace("SELECT", " SELECT", 1) + O.top("bm25", 10))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(scoring.search(corpus.index(spark, d), corpus.queries(spark, d), "fts", 10))


@query(O.INDEX + O.QTERMS + O.COSINE + " " + O.SHOW + O.top("cosine", 10))
def tfidf_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(scoring.search(corpus.index(spark, d), corpus.queries(spark, d), "vec", 10))


@query(O.INDEX + O.QTERMS + O.BM25 + O.COSINE + O.RRF + " " + O.SHOW + O.top("fused", 10))
def rrf_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(scoring.search(corpus.index(spark, d), corpus.queries(spark, d), "hybrid", 10))


@query(O.FULL + " SELECT query_id, chunk_id, round(relevance, 6) AS relevance FROM relevance")
def heuristic_score(spark: SparkSession, d: str) -> DataFrame:
    index, queries = corpus.index(spark, d), corpus.queries(spark, d)
    return scoring.heuristic_scores(index, queries, cut(scoring.hybrid(index, queries, scoring.POOL))).select("query_id", "chunk_id",
        F.round("relevance", 6).alias("relevance"))


@query(O.FULL + " " + O.SHOW + O.reranked(1.0, K))
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(scoring.search(corpus.index(spark, d), corpus.queries(spark, d), "hybrid+rerank", K))


@query(O.FULL + " " + O.SHOW + O.reranked(0.5, K))
def blend_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(blended(spark, d))


@query(O.FULL + O.HITS + " " + O.SHOW + "kept")
def filter_relevant(spark: SparkSession, d: str) -> DataFrame:
    return shown(decide.filter_relevant(blended(spark, d)))


@query(O.FULL + O.HITS + O.GATE + " SELECT query_id, round(noul, 6) AS noul, noul < 0.5 AS need_more FROM gate")
def noul_gate(spark: SparkSession, d: str) -> DataFrame:
    return decide.noul(decide.filter_relevant(blended(spark, d))).select("query_id", F.round("noul", 6).alias("noul"), "need_more")


@query(
    O.FULL + O.HITS + O.GATE + ", a AS (SELECT query_id, count(*) AS n_raw FROM hits GROUP BY 1), b AS (SELECT query_id, count(*) AS n_hits FROM kept GROUP BY 1) "
    "SELECT query_id, n_hits, (n_raw = 5 OR n_hits < n_raw) AS more_available, round(noul, 6) AS noul, noul < 0.5 AS need_more FROM a JOIN "
    "b USING (query_id) JOIN gate USING (query_id)"
)
def search_payload(spark: SparkSession, d: str) -> DataFrame:
    hits = blended(spark, d)
    kept = decide.filter_relevant(hits)
    return decide.payload(hits, kept, decide.noul(kept), K).withColumn("noul", F.round("noul", 6))


# Chunks


@query(
    "WITH f AS (SELECT source || '/doc_' || doc_id || '.txt' AS file_path, " + O.LINES.format("coalesce(text, '')") + " AS l FROM documents), "
    "s AS (SELECT file_path, l, unnest(range(1, 2 + CAST(greatest(0, ceil((len(l) - 60) / 50.0)) AS BIGINT) * 50, 50)) AS a FROM f) "
    "SELECT file_path, CAST(a AS INTEGER) AS start_line, CAST(least(len(l), a + 59) AS INTEGER) AS end_line, array_to_string(l[a:least(len(l), "
    "a + 59)], chr(10)) AS content FROM s"
)
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.window_chunks(corpus.files(spark, d))


_HEADED = O.changed_lines(f"CASE WHEN {O.SHORT} THEN repeat('#', length(x) % 7) || ' ' || x ELSE x END")
_HEADING = r"^(#{1,6})[\t\n\f\r ]+(.+)$"


@query(O.boundaries(_HEADED, "file_path", "'# ' || file_path || chr(10) || text", _HEADING, rf"trim(regexp_extract(line, '{_HEADING}', 2))",
    rf"'h' || length(regexp_extract(line, '{_HEADING}', 1))"))
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.markdown_chunks(corpus.headed(spark, d))


@query(O.boundaries(O.changed_lines(f"CASE WHEN {O.SHORT} THEN '[' || translate(x, '[]', '()') || ']' ELSE x END"), "file_path", "text",
    r"^\[\[*([^\]]+)\]\]?", r"trim(regexp_extract(line, '^\[\[*([^\]]+)\]\]?', 1))", "'section'"))
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.section_chunks(corpus.sectioned(spark, d))


@query(O.boundaries("pages", "'page_' || page_id || '.html'", "html", r"(?i)<(?:h[1-6]|section|article|script|style|div)(?:[\t\n\f\r ]|>|/)",
    "'block@' || start_line", "'block'"))
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return chunkers.html_blocks(pages.select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"),
        F.coalesce("html", F.lit("")).alias("content")))


@query(f"WITH {O.PROGRAMS} SELECT * EXCLUDE (content) FROM chunks")
def chunk_code_files(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk_files(corpus.programs(spark, d)).drop("content", "hash")


@query(O.CODE_INDEX + O.QTERMS + O.BM25 + " " + O.SHOW + O.top("bm25", 10))
def code_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """From files to chunks to an index to hits."""
    index = ix.build(chunkers.chunk_files(corpus.programs(spark, d)), cut)
    return shown(scoring.search(index, corpus.queries(spark, d), "fts", 10))


# Vectors

_VEC = "(SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label, q.label AS query_label, list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"
_NEAR = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {_VEC} QUALIFY rank <= 10)"


def asked_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    return vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    return V.exact_topk(*asked_vectors(spark, d), 10)


@query()
def vector_ann_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors, asked = asked_vectors(spark, d)
    return shown(V.Lists(vectors).search(asked, 10))


@query("SELECT count(*) AS n, true AS enough FROM " + _NEAR)
def vector_ann_recall(spark: SparkSession, d: str) -> DataFrame:
    vectors, asked = asked_vectors(spark, d)
    return V.recall(V.Lists(vectors).search(asked, 10), V.exact_topk(vectors, asked, 10)).select("n", (F.col("recall") >= 0.9).alias("enough"))


@query(O.SHOW + _NEAR)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(nearest(spark, d))


@query(f"SELECT query_id, round(avg(CASE WHEN label = query_label THEN 1.0::DOUBLE ELSE 0 END), 6) AS same_label FROM {_NEAR} GROUP BY 1")
def vector_label_precision(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("chunk_id"), "label")
    asked = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    hits = nearest(spark, d).join(own, "chunk_id").join(asked, "query_id")
    return hits.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("same_label"))


# Tools


@query(
    "SELECT source || '/doc_' || doc_id || '.txt' AS file_path, 1 AS start_line, CAST(len(" + O.LINES.format("coalesce(text, '')") + ") AS INTEGER) AS end_line, 'doc_' || doc_id AS symbol_name, 'file' AS kind, 'text' AS language, 'doc_' || doc_id AS signature FROM "
    "documents WHERE lower('doc_' || doc_id) = 'doc_7'"
)
def find_symbol(spark: SparkSession, d: str) -> DataFrame:
    return tools.find_symbol(corpus.chunks(spark, d), "DOC_7")


_REFS = (
    "WITH l AS (SELECT doc_id, source || '/doc_' || doc_id || '.txt' AS file_path, unnest(" + O.LINES.format("coalesce(text, '')") + ") AS line, unnest(range(1, 1 + len(" + O.LINES.format("coalesce(text, '')") + "))) AS no FROM documents), "
    "b AS (SELECT *, string_split(regexp_replace(line, '`[^`]*`|\"(?:\\\\.|[^\"\\\\])*\"|''(?:\\\\.|[^''\\\\])*''', '', 'g'), CASE WHEN "
    "doc_id % 2 = 0 THEN '#' ELSE '//' END)[1] AS bare FROM l), r AS ("
    "SELECT file_path, CAST(no AS INTEGER) AS line, trim(line) AS text FROM b WHERE regexp_matches(bare, '(^|[^A-Za-z0-9_])NAME($|[^A-Za-z0-9_])'))"
)


@query(_REFS.replace("NAME", "token") + " SELECT * FROM r")
def all_references(spark: SparkSession, d: str) -> DataFrame:
    return tools.all_references(corpus.files(spark, d), "token")


@query(_REFS.replace("NAME", "the") + " SELECT *, (SELECT count(*) FROM r) > 50 AS truncated FROM r ORDER BY file_path, line LIMIT 50")
def find_references(spark: SparkSession, d: str) -> DataFrame:
    return tools.find_references(corpus.files(spark, d), "the")


@query(
    "SELECT source || '/doc_' || doc_id || '.txt' AS file_path, CASE WHEN len(l) >= 2 THEN array_to_string(l[2:least(4, len(l))], chr(10)) "
    "END AS span FROM (SELECT *, " + O.LINES.format("coalesce(text, '')") + " AS l FROM documents)"
)
def read_span(spark: SparkSession, d: str) -> DataFrame:
    return tools.read_span(corpus.files(spark, d), F.lit(2), F.lit(4))


@query("SELECT source || '/doc_' || doc_id || '.txt' AS file_path, sha256(coalesce(text, '')) AS hash FROM documents")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    return tools.manifest(corpus.files(spark, d))


# Incremental: labelled documents were indexed before, and those of quality 0 have changed since; pages were indexed and are gone.

_BEFORE = (
    "before AS (SELECT source || '/doc_' || doc_id || '.txt' AS file_path, CASE WHEN quality = 0 THEN sha256('old:' || coalesce(text, '')) "
    "ELSE sha256(coalesce(text, '')) END AS hash FROM documents JOIN labels USING (doc_id) "
    "UNION ALL SELECT 'pages/' || page_id || '.html', sha256(coalesce(html, '')) FROM pages), "
    "now AS (SELECT source || '/doc_' || doc_id || '.txt' AS file_path, sha256(coalesce(text, '')) AS hash FROM documents)"
)


def manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = corpus.files(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    old = files.join(labels, "doc_id").withColumn("content", F.when(F.col("quality") == 0, F.concat(F.lit("old:"), "content")).otherwise(F.col("content")))
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"),
        F.lit(".html")).alias("file_path"), F.coalesce("html", F.lit("")).alias("content"))
    return tools.manifest(files), tools.manifest(old).unionByName(tools.manifest(pages))


@query(
    f"WITH {_BEFORE} SELECT coalesce(n.file_path, b.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN 'remove' WHEN n.hash = b.hash "
    f"THEN 'keep' ELSE 'reindex' END AS action FROM now n FULL JOIN before b ON n.file_path = b.file_path"
)
def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    return tools.plan_update(*manifests(spark, d))


@query(
    f"WITH {_BEFORE} SELECT count(*) FILTER (WHERE n.file_path IS NOT NULL) AS files, count(*) FILTER (WHERE n.hash = b.hash) AS kept, count(*) "
    f"FILTER (WHERE n.file_path IS NOT NULL AND n.hash IS DISTINCT FROM b.hash) AS reindexed, count(*) FILTER (WHERE n.file_path IS NULL) "
    f"AS removed FROM now n FULL JOIN before b ON n.file_path = b.file_path"
)
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    plan = tools.plan_update(*manifests(spark, d))
    is_ = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(F.count_if(F.col("action") != "remove").alias("files"), is_("keep").alias("kept"), is_("reindex").alias("reindexed"),
        is_("remove").alias("removed"))


@query(f"WITH {_BEFORE} SELECT file_path, hash FROM before WHERE file_path NOT IN (SELECT file_path FROM now)")
def removed_files(spark: SparkSession, d: str) -> DataFrame:
    return tools.removed(*manifests(spark, d))


@query(f"WITH {_BEFORE} SELECT file_path, hash FROM now")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    now, before = manifests(spark, d)
    changed = now.join(before, ["file_path", "hash"], "left_anti")
    return tools.upsert(before, changed, tools.removed(now, before), "file_path").select("file_path", "hash")


@query(
    f"WITH {_BEFORE}, toxic AS (SELECT source || '/doc_' || doc_id || '.txt' AS file_path FROM documents JOIN labels USING (doc_id) WHERE "
    f"toxic = 1) SELECT n.file_path, n.hash FROM now n LEFT JOIN before b ON n.file_path = b.file_path WHERE b.file_path IS NULL OR b.hash "
    f"<> n.hash OR n.file_path IN (SELECT file_path FROM toxic)"
)
def embed_need(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents were never embedded."""
    now, before = manifests(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id")
    toxic = corpus.files(spark, d).join(labels, "doc_id", "left_semi").select("file_path", F.lit(False).alias("has_vector"))
    known = before.join(toxic, "file_path", "left").select(F.col("file_path").alias("chunk_id"), "hash", F.coalesce("has_vector", F.lit(True)).alias("has_vector"))
    return tools.need_embedding(now.withColumnRenamed("file_path", "chunk_id"), known).withColumnRenamed("chunk_id", "file_path")


_ASKED = "SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN ' ' || upper(source) || ' ' WHEN 2 THEN '/srv/' || source || '/' ELSE source || '-unknown' END AS asked FROM documents WHERE source IS NOT NULL UNION SELECT '' UNION SELECT '  '"


@query(
    f"WITH asked AS ({_ASKED}), p AS (SELECT source AS name, '/srv/' || source AS path, row_number() OVER (ORDER BY source) AS pos FROM "
    f"(SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)), "
    "w AS (SELECT asked, CASE WHEN trim(asked) = '' THEN 'nobody' ELSE trim(asked) END AS wanted FROM asked), "
    "m AS (SELECT asked, name, path, pos, CASE WHEN wanted = name THEN 0 WHEN lower(wanted) = lower(name) THEN 1 WHEN rtrim(wanted, '/') "
    "= path THEN 2 WHEN trim(asked) = '' AND pos = 1 THEN 3 END AS prio FROM w, p) "
    "SELECT asked, arg_min(name, (prio, pos)) AS name, arg_min(path, (prio, pos)) AS path FROM m WHERE prio IS NOT NULL GROUP BY asked"
)
def project_resolve(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").where("source IS NOT NULL").select("doc_id", "source")
    names = docs.select("source").distinct().select(F.col("source").alias("name"), F.concat(F.lit("/srv/"), "source").alias("path"))
    projects = names.withColumn("pos", F.row_number().over(W.orderBy("name")))  # a row per source
    way = F.pmod("doc_id", F.lit(4))
    spelled = F.when(way == 0, F.col("source")).when(way == 1, F.concat(F.lit(" "), F.upper("source"), F.lit(" "))).when(way == 2,
        F.concat(F.lit("/srv/"), "source", F.lit("/"))).otherwise(F.concat("source", F.lit("-unknown")))
    asked = docs.select(spelled.alias("asked")).union(spark.createDataFrame([("",), ("  ",)], "asked string")).distinct()
    return tools.resolve_projects(projects, asked, "nobody")


# Evaluation and statistics


def first_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First ranks of the questions, and what is relevant to them."""
    relevant = cut(corpus.relevant(spark, d))
    return stats.first_hits(blended(spark, d), relevant), relevant


def metrics() -> list:
    return [F.round(c, 6).alias(n) for c, n in zip(stats.recall_mrr(), ("recall_1", "recall_3", "recall_5", "mrr"), strict=True)]


@query(O.FULL + O.HITS + O.RELEVANT + f" SELECT count(*) AS n, {O.METRICS} FROM first")
def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return first_hits(spark, d)[0].agg(F.count("*").alias("n"), *metrics())


@query(
    O.FULL + O.HITS + O.RELEVANT + ", langs AS (SELECT query_id, min(lang) AS lang, CASE WHEN regexp_matches(any_value(text), '[^\\x00-\\x7F]') THEN 'accented' ELSE 'plain' END AS question_lang FROM relevant JOIN benchmark ON item_id = query_id GROUP BY 1) "
    f"SELECT lang, question_lang, count(*) AS n, {O.METRICS} FROM first JOIN langs USING (query_id) GROUP BY GROUPING SETS ((), (lang), (question_lang))"
)
def eval_slices(spark: SparkSession, d: str) -> DataFrame:
    """By the language of the documents, and by the letters of the question."""
    letters = F.when(F.octet_length("query") > F.length("query"), "accented").otherwise("plain")
    asked = corpus.queries(spark, d).select("query_id", letters.alias("question_lang"))
    first, relevant = first_hits(spark, d)
    langs = relevant.groupBy("query_id").agg(F.min("lang").alias("lang")).join(asked, "query_id")
    return first.join(langs, "query_id").groupingSets([[], ["lang"], ["question_lang"]], "lang", "question_lang").agg(F.count("*").alias("n"), *metrics())


def bench_rows(spark: SparkSession, d: str) -> DataFrame:
    index = corpus.index(spark, d)
    return evaluate.token_bench(index, corpus.queries(spark, d), corpus.files(spark, d), K).withColumn("ratio", F.round("ratio", 6))


@query(O.BENCH + " SELECT query_id, baseline, rag, ratio, need_more FROM bench")
def token_bench(spark: SparkSession, d: str) -> DataFrame:
    return bench_rows(spark, d)


@query(O.BENCH + " SELECT count(*) AS n, round(avg(ratio), 4) AS mean_ratio, round(median(ratio), 4) AS median_ratio FROM bench")
def token_bench_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mean_median(bench_rows(spark, d)).select("n", F.round("mean_ratio", 4).alias("mean_ratio"), F.round("median_ratio", 4).alias("median_ratio"))


@query(O.BENCH + " SELECT query_id, baseline AS tokens FROM base")
def grep_cost(spark: SparkSession, d: str) -> DataFrame:
    return stats.grep_cost(corpus.queries(spark, d), corpus.files(spark, d))


_CALLS = "(SELECT event_id, ts, event_type AS tool, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS response_bytes FROM events)"
_CALL_STATS = "count(*) AS calls, CAST(sum(response_bytes) AS BIGINT) AS total_bytes, round(avg(response_bytes), 6) AS avg_bytes, round(avg(latency_ms), 6) AS avg_latency, round(sum(response_bytes) / 4.0::DOUBLE, 6) AS tokens"


def rounded_calls(spark: SparkSession, d: str) -> DataFrame:
    found = stats.call_stats(corpus.calls(spark, d))
    return found.select("tool", "calls", "total_bytes", *(F.round(c, 6).alias(c) for c in ("avg_bytes", "avg_latency", "tokens")))


@query(f"SELECT {_CALL_STATS} FROM {_CALLS}")
def call_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded_calls(spark, d).where("tool IS NULL").drop("tool")


@query(f"SELECT tool, {_CALL_STATS} FROM {_CALLS} GROUP BY ROLLUP (tool)")
def call_stats_by_tool(spark: SparkSession, d: str) -> DataFrame:
    return rounded_calls(spark, d)


def _last(n: int, way: str) -> str:
    return (
        f"SELECT CAST(row_number() OVER (ORDER BY ts {way}, event_id {way}) AS INTEGER) AS place, event_id, tool, latency_ms, response_bytes "
        f"FROM (SELECT * FROM {_CALLS} ORDER BY ts DESC, event_id DESC LIMIT {n})"
    )


@query(_last(10, "DESC"))
def recent_calls(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.last_calls(corpus.calls(spark, d), 10).select("place", "event_id", "tool", "latency_ms", "response_bytes")


@query(_last(200, "ASC"))
def call_series(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.last_calls(corpus.calls(spark, d), 200, newest_first=False).select("place", "event_id", "tool", "latency_ms", "response_bytes")


@query(
    "WITH c AS (SELECT CASE WHEN trim(coalesce(source, '')) = '' THEN 'other' ELSE source END AS v, count(*) AS n FROM documents GROUP "
    "BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS place FROM c) SELECT CASE WHEN place <= 8 THEN v ELSE 'прочее' END "
    "AS name, CAST(sum(n) AS BIGINT) AS count FROM r GROUP BY 1"
)
def top_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_counts(corpus.files(spark, d), "source", 8)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_call_windows(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # The file source wants a folder or a pattern.
    stream = streams.windowed_calls(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))
    return streams.drain(stream, "calls").withColumn("total", F.round("total", 4))
