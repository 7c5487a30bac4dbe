"""Queries for retrieval, fusion, routing, catalogs, evaluation, evidence and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.functions import text, vectors
from sparkquarry.operators import calibration, evaluation, index, prototypes, retrieval, routing
from sparkquarry.sources import relation, scratch
from sparkquarry.streaming import traces

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items are the stated query set."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _body_hits(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    return retrieval.bm25_top_k(relation.dealt(load(spark, sf_dir, "documents")), _questions(spark, sf_dir), top)


def _title_hits(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    """The first line of a document stands for its title."""
    docs = relation.dealt(load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title")))
    return retrieval.bm25_top_k(docs, _questions(spark, sf_dir), top, fields={"title": 1.0})


def _bm25(name: str, text: str) -> str:
    return f"""
{name}_w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM documents),
{name}_s AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM {name}_w),
{name}_p AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM {name}_w) GROUP BY doc_id, term),
{name}_q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_r AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 6) AS score
  FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_d USING (term) CROSS JOIN {name}_s GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_r) WHERE rank <= 20)"""


_BODY = "WITH " + _bm25("body", "text")
_BOTH = _BODY + "," + _bm25("title", "split_part(text, chr(10), 1)")


@query(_BODY + " SELECT query_id, doc_id, score, rank FROM body")
def bm25_search(spark, sf_dir):
    return _body_hits(spark, sf_dir)


_RRF = _BOTH + """, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS left_rank, b.rank AS right_rank,
  round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 12) AS score FROM title a FULL OUTER JOIN body b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(left_rank, right_rank), doc_id) AS rank FROM f) WHERE rank <= 10)
"""


@query(_RRF + "SELECT query_id, doc_id, coalesce(left_rank, 0) AS title_rank, coalesce(right_rank, 0) AS body_rank, score, rank FROM fused")
def title_body_search(spark, sf_dir):
    """Title and body rankings fused by reciprocal rank."""
    fused = retrieval.rrf(_title_hits(spark, sf_dir), _body_hits(spark, sf_dir), "doc_id", 10)
    nth = lambda c: F.coalesce(c, F.lit(0))
    return fused.select("query_id", "doc_id", nth("left_rank").alias("title_rank"), nth("right_rank").alias("body_rank"), "score", "rank")


_FIELDS = {"title": "split_part(coalesce(text, ''), chr(10), 1)", "section_path": "source", "content": "text"}
_HYBRID = "WITH " + ",".join(_bm25(f"{name}_f", text) for name, text in _FIELDS.items()) + f""",
weighted AS ({" UNION ALL ".join(f"SELECT query_id, doc_id, {retrieval.FIELD_WEIGHTS[name]}::DOUBLE * sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))) AS part FROM {name}_f_q JOIN {name}_f_p USING (term) JOIN {name}_f_d USING (term) CROSS JOIN {name}_f_s GROUP BY query_id, doc_id" for name in _FIELDS)}),
words AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM weighted GROUP BY ALL) QUALIFY rank <= 200),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN benchmark ON item_id = q.vec_id CROSS JOIN embeddings v) QUALIFY rank <= 200),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS l, b.rank AS r, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 12) AS score
  FROM near a FULL OUTER JOIN words b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)
SELECT query_id, doc_id, coalesce(l, 0) AS vector_rank, coalesce(r, 0) AS bm25_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(l, r), doc_id) AS rank FROM f QUALIFY rank <= 10"""


@query(_HYBRID)
def hybrid_search(spark, sf_dir):
    """The flagship: nearest vectors and field-weighted BM25 fused; the vector of an item's id stands for its question's, that of a document's id for the document's."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"), F.col("source").alias("section_path"), F.col("text").alias("content"))
    docs = relation.dealt(docs)
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")).join(rows, "doc_id").select(F.col("doc_id").alias("query_id"), "embedding")
    fused = retrieval.hybrid_top_k(docs, rows, _questions(spark, sf_dir), asked, 10)
    nth = lambda c: F.coalesce(c, F.lit(0))
    return fused.select("query_id", "doc_id", nth("vector_rank").alias("vector_rank"), nth("bm25_rank").alias("bm25_rank"), "score", "rank")


_GROUP = _BODY + """, g AS (SELECT query_id, source, min_by(doc_id, rank) AS doc_id, min(rank) AS best_rank, count(*) AS hits, list_sort(list(rank)) AS ranks FROM body JOIN documents USING (doc_id) GROUP BY query_id, source),
s AS (SELECT *, round({}, 12) AS score FROM g)
SELECT query_id, source, doc_id, best_rank, hits, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, source) AS rank FROM s"""
_FIRST = "(1.0::DOUBLE / (60 + ranks[1]))"


@query(_GROUP.format(f"{_FIRST} * (1 + 0.05::DOUBLE * len(list_filter(ranks[2:3], lambda r: 1.0::DOUBLE / (60 + r) >= 0.8::DOUBLE * {_FIRST})))"))
def grouped_search_adaptive(spark, sf_dir):
    return _grouped(spark, sf_dir, "adaptive_sum_3")


@query(_GROUP.format("list_sum(list_transform(ranks[1:3], lambda r: 1.0::DOUBLE / (60 + r)))"))
def grouped_search_capped(spark, sf_dir):
    return _grouped(spark, sf_dir, "capped_sum_3")


@query(_GROUP.format(_FIRST))
def grouped_search_max(spark, sf_dir):
    return _grouped(spark, sf_dir, "max")


def _grouped(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    hits = _body_hits(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return retrieval.group_hits(hits, "doc_id", "source", how)


@query(_BODY + """, h AS (SELECT query_id, doc_id, rank, source, sha256(text) AS content_hash FROM body JOIN documents USING (doc_id))
SELECT query_id, content_hash, min_by(doc_id, rank) AS doc_id, min(rank) AS rank, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM h GROUP BY query_id, content_hash""")
def deduplicated_search(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    hits = _body_hits(spark, sf_dir).join(docs, "doc_id").select("query_id", "content_hash", "doc_id", "rank", "source")
    return retrieval.dedupe_hits(hits, ["query_id", "content_hash"], ["rank"], "source").select("query_id", "content_hash", "doc_id", "rank", F.array_join("sources", ",").alias("sources"))


@query(_BOTH + """, c AS (SELECT b.query_id, source AS namespace, doc_id AS key, b.score AS local_score, coalesce(t.score, 0) AS cross_score FROM body b JOIN documents USING (doc_id) LEFT JOIN title t USING (query_id, doc_id)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY local_score DESC, key) AS local_rank FROM c) WHERE local_rank <= 8),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, local_rank, namespace, key) AS cross_rank FROM l),
s AS (SELECT *, round(1.0::DOUBLE / (60 + local_rank) + 1.0::DOUBLE / (60 + cross_rank), 12) AS score FROM x)
SELECT query_id, namespace, key, local_rank, cross_rank, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cross_rank, local_rank, namespace, key) AS rank FROM s) WHERE rank <= 5""")
def namespace_fusion(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("namespace"))
    title = _title_hits(spark, sf_dir).select("query_id", "doc_id", F.col("score").alias("cross"))
    hits = _body_hits(spark, sf_dir).join(docs, "doc_id").join(title, ["query_id", "doc_id"], "left")
    hits = hits.select("query_id", "namespace", F.col("doc_id").alias("key"), F.col("score").alias("local_score"), F.coalesce("cross", F.lit(0.0)).alias("cross_score"))
    return retrieval.namespace_fusion(hits).select("query_id", "namespace", "key", "local_rank", "cross_rank", "score", "rank")


_COS = "list_cosine_similarity(CAST({}.embedding AS DOUBLE[]), CAST({}.embedding AS DOUBLE[]))"
_KNN = f"""WITH k AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS.format("q", "v")}, 6) AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k) WHERE rank <= 10)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return retrieval.vector_top_k(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query(_KNN + " SELECT query_id, vec_id, score, rank FROM knn")
def vector_search(spark, sf_dir):
    return _neighbours(spark, sf_dir)


_JUDGED = _KNN + """, j AS (SELECT q.vec_id AS query_id, v.vec_id, 1 + v.vec_id % 3 AS grade FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0),
m AS (SELECT j.*, rank, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, vec_id) AS ideal FROM j LEFT JOIN knn USING (query_id, vec_id)),
a AS (SELECT query_id, count(*) AS judged, coalesce(sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg, sum((2.0::DOUBLE ** grade - 1) / log2(ideal + 1)) FILTER (ideal <= 10) AS ideal,
  count(*) FILTER (rank <= 10) AS found, min(rank) FILTER (rank <= 10) AS first_rank, count(*) FILTER (rank <= 5) AS near FROM m GROUP BY query_id),
g AS (SELECT query_id, judged, first_rank, dcg / ideal AS ndcg, found / judged AS recall, coalesce(1.0::DOUBLE / first_rank, 0) AS mrr, near / 5 AS precision FROM a),
e AS (SELECT *, 100 * (0.55::DOUBLE * ndcg + 0.2::DOUBLE * recall + 0.15::DOUBLE * mrr + 0.1::DOUBLE * precision) AS composite FROM g)
"""
_GRADED = ["ndcg", "recall", "mrr", "precision", "composite"]


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    judged = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(rows.select("vec_id", "label"), "label")
    return evaluation.graded_metrics(_neighbours(spark, sf_dir), judged.select("query_id", "vec_id", (1 + F.col("vec_id") % 3).alias("grade")), "vec_id")


@query(_JUDGED + "SELECT query_id, judged, first_rank, " + ", ".join(f"round({c}, 6) AS {c}" for c in _GRADED) + " FROM e")
def graded_metrics(spark, sf_dir):
    return _graded(spark, sf_dir).select("query_id", "judged", "first_rank", *[F.round(c, 6).alias(c) for c in _GRADED])


@query(_JUDGED + "SELECT count(*) AS cases, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _GRADED) + " FROM e")
def graded_average(spark, sf_dir):
    return evaluation.macro_average(_graded(spark, sf_dir)).select("cases", *[F.round(c, 6).alias(c) for c in _GRADED])


_CARDS = """WITH p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i),
c AS (SELECT 'label-' || label AS namespace, list(x ORDER BY i) AS v FROM p GROUP BY label),
r AS (SELECT vec_id AS query_id, namespace, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), v) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS score FROM embeddings CROSS JOIN c),
o AS (SELECT *, row_number() OVER w AS rank, round(score - lead(score) OVER w, 6) AS gap FROM r WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, namespace)),
h AS (SELECT query_id, gap AS margin, score >= 0.65 AND (gap IS NULL OR gap >= 0.05) AS confident FROM o WHERE rank = 1),
routes AS (SELECT query_id, namespace, label, score, rank, margin, confident, CASE WHEN confident THEN 1 ELSE 3 END AS fanout FROM o JOIN h USING (query_id))
"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is routed to the centroids of the labels, a catalog of at most a few cards."""
    rows = load(spark, sf_dir, "embeddings")
    cards = vectors.mean_by(rows.withColumn("namespace", F.concat(F.lit("label-"), F.col("label").cast("string"))), "namespace", "embedding").withColumnRenamed("embedding", "vector")
    return routing.semantic_route(rows.select(F.col("vec_id").alias("query_id"), vectors.unit(F.col("embedding")).alias("vector")), cards)


@query(_CARDS + "SELECT query_id, namespace, score, rank, confident, fanout FROM routes WHERE rank <= 3")
def semantic_routes(spark, sf_dir):
    return _routes(spark, sf_dir).where("rank <= 3").select("query_id", "namespace", "score", "rank", "confident", "fanout")


@query(_CARDS + """, e AS (SELECT vec_id AS query_id, 'label-' || label AS namespace FROM embeddings), m AS (SELECT e.query_id, rank FROM e LEFT JOIN (SELECT * FROM routes WHERE rank <= 3) USING (query_id, namespace)),
t AS (SELECT query_id, fanout, confident FROM routes WHERE rank = 1)
SELECT count(*) AS cases, round(count(rank) / count(*), 6) AS route_recall_at_3, count(rank) AS complete_cases, count(*) FILTER (confident AND coalesce(rank, 0) <> 1) AS wrong_confident_singles,
  round(avg(fanout), 6) AS average_fanout, max(fanout) AS max_fanout FROM m JOIN t USING (query_id)""")
def routing_metrics(spark, sf_dir):
    expected = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("namespace"))
    out = evaluation.routing_metrics(_routes(spark, sf_dir), expected)
    return out.withColumn("route_recall_at_3", F.round("route_recall_at_3", 6)).withColumn("average_fanout", F.round("average_fanout", 6))


@query(_CARDS + """, s(score_floor) AS (VALUES (0.2::DOUBLE), (0.4), (0.6), (0.65), (0.8)), g(margin_floor) AS (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2)),
heads AS (SELECT score, coalesce(margin, 1) AS margin, namespace = 'label-' || label AS correct FROM routes WHERE rank = 1)
SELECT score_floor, margin_floor, count(*) FILTER (score >= score_floor AND margin >= margin_floor AND correct) AS correct, count(*) FILTER (score >= score_floor AND margin >= margin_floor AND NOT correct) AS wrong,
  CAST(sum(CASE WHEN score >= score_floor AND margin >= margin_floor THEN 1 ELSE 3 END) AS BIGINT) AS fanout FROM heads CROSS JOIN s CROSS JOIN g GROUP BY ALL""")
def routing_threshold_grid(spark, sf_dir):
    labels = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("own"))
    cases = _routes(spark, sf_dir).where("rank = 1").join(labels, "query_id").select("score", F.coalesce("margin", F.lit(1.0)).alias("margin"), (F.col("namespace") == F.col("own")).alias("correct"))
    floors = lambda *xs: spark.createDataFrame([(float(x),) for x in xs], "value double")
    return evaluation.threshold_grid(cases, floors(0.2, 0.4, 0.6, 0.65, 0.8), floors(0, 0.05, 0.1, 0.2))


@query(_CARDS + """, heads AS (SELECT round(score, 2) AS score, round(margin, 2) AS margin, namespace = 'label-' || label AS correct FROM routes WHERE rank = 1),
s AS (SELECT DISTINCT unnest([score, nextafter(score, 'inf'::DOUBLE)]) AS score_floor FROM heads), g AS (SELECT DISTINCT unnest([margin, nextafter(margin, 'inf'::DOUBLE)]) AS margin_floor FROM heads WHERE margin IS NOT NULL),
f AS (SELECT score_floor, margin_floor, count(*) AS cases, count(*) FILTER (score >= score_floor AND margin >= margin_floor AND correct) AS correct, count(*) FILTER (score >= score_floor AND margin >= margin_floor AND NOT correct) AS wrong,
  sum(CASE WHEN score >= score_floor AND margin >= margin_floor THEN 1 ELSE 3 END) / count(*) AS average_fanout FROM heads CROSS JOIN s CROSS JOIN g GROUP BY score_floor, margin_floor)
SELECT score_floor, margin_floor, cases, correct, wrong, round(average_fanout, 9) AS average_fanout FROM f WHERE wrong = 0 ORDER BY correct DESC, average_fanout, score_floor DESC, margin_floor DESC LIMIT 1""")
def routing_floors(spark, sf_dir):
    """The floors of confident routing over every breakpoint of the vectors' routes; scores are rounded, which makes ties."""
    labels = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("own"))
    heads = _routes(spark, sf_dir).where("rank = 1").join(labels, "query_id")
    cases = heads.select(F.round("score", 2).alias("score"), F.round("margin", 2).alias("margin"), (F.col("namespace") == F.col("own")).alias("correct"), F.lit(calibration.MAX_FANOUT).alias("ranked"))
    return calibration.choose_floors(cases).withColumn("average_fanout", F.round("average_fanout", 9))


@query("""
WITH d AS (SELECT DISTINCT source AS namespace, trim(regexp_replace(lower(regexp_extract(text, '^(\\S+\\s+\\S+)', 1)), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM documents),
p AS (SELECT DISTINCT namespace, phrase, len(string_split(phrase, ' ')) AS n FROM d WHERE phrase <> ''),
q AS (SELECT item_id AS query_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM benchmark),
m AS (SELECT query_id, namespace, count(*) AS matches, CAST(sum(n) AS BIGINT) AS words FROM q JOIN p ON contains(t, ' ' || phrase || ' ') GROUP BY ALL)
SELECT query_id, namespace, matches, words, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, words DESC, namespace) AS rank FROM m""".replace("\\\\", "\\"))
def lexical_routes(spark, sf_dir):
    """Descriptors of a source are the first two words of its documents."""
    cards = load(spark, sf_dir, "documents").select(F.col("source").alias("namespace"), F.regexp_extract("text", r"^(\S+\s+\S+)", 1).alias("descriptor"))
    return routing.lexical_route(_questions(spark, sf_dir), cards)


_NAMED = """
WITH c AS (SELECT DISTINCT label, 'label-' || label AS namespace FROM embeddings),
phrases AS (SELECT item_id, trim(regexp_replace(lower(regexp_extract(text, '^(\\S+\\s+\\S+)', 1)), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM benchmark),
d AS (SELECT DISTINCT namespace, phrase, len(string_split(phrase, ' ')) AS n FROM (SELECT namespace, 'label ' || label AS phrase FROM c UNION ALL SELECT 'label-' || item_id % 10 AS namespace, phrase FROM phrases WHERE item_id % 5 = 0 UNION ALL SELECT 'label-' || (item_id // 5) % 10 AS namespace, phrase FROM phrases WHERE item_id % 10 = 0) WHERE phrase <> '' AND namespace IN (SELECT namespace FROM c)),
q AS (SELECT item_id AS query_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM benchmark),
named AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, words DESC, namespace) AS rank FROM (SELECT query_id, namespace, count(*) AS matches, CAST(sum(n) AS BIGINT) AS words FROM q JOIN d ON contains(t, ' ' || phrase || ' ') GROUP BY ALL))
""".replace("\\\\", "\\")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each label of the vectors: its aliases are the first words of some benchmark items, its vector the centroid."""
    rows = load(spark, sf_dir, "embeddings").withColumn("namespace", F.concat(F.lit("label-"), F.col("label").cast("string")))
    centroids = vectors.mean_by(rows, "namespace", "embedding").withColumnRenamed("embedding", "vector")
    first = load(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", r"^(\S+\s+\S+)", 1).alias("alias"))
    one = first.where("item_id % 5 = 0").select((F.col("item_id") % 10).alias("label"), "alias")
    two = first.where("item_id % 10 = 0").select((F.floor(F.col("item_id") / 5) % 10).alias("label"), "alias")
    aliases = one.unionByName(two).groupBy(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("namespace")).agg(F.collect_set("alias").alias("aliases"))
    return centroids.withColumn("title", F.regexp_replace("namespace", "label-", "Label ")).join(aliases, "namespace", "left")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return _questions(spark, sf_dir).join(rows, "query_id").select("query_id", "query", vectors.unit(F.col("embedding")).alias("vector"))


@query(_NAMED + "SELECT query_id, namespace, matches, words, rank FROM named")
def named_routes(spark, sf_dir):
    return routing.named_route(_questions(spark, sf_dir), _cards(spark, sf_dir))


_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"
_BANK = _NAMED + f""", u AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings),
centroid AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
base AS (SELECT 'label-' || label AS namespace, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM centroid),
asked AS (SELECT vec_id AS query_id, v FROM u JOIN benchmark ON item_id = vec_id)"""
_SELECT = """, counts AS (SELECT query_id, count(*) AS named FROM named GROUP BY ALL),
own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, namespace) AS route_rank FROM (
  SELECT query_id, namespace, rank AS place, CAST(NULL AS DOUBLE) AS score, true AS by_name FROM named WHERE rank <= 3
  UNION ALL SELECT query_id, namespace, rank + 3, score, false FROM near n WHERE NOT EXISTS (SELECT 1 FROM named m WHERE m.query_id = n.query_id AND m.namespace = n.namespace)) JOIN counts USING (query_id) WHERE named = 1 OR by_name),
lead AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin FROM ranked GROUP BY query_id),
rest AS (SELECT query_id, namespace, rank AS route_rank, score, {sure} AS sure, count(*) OVER (PARTITION BY query_id) AS n FROM ranked JOIN lead USING (query_id) WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM counts))
SELECT query_id, CASE WHEN named <= 3 THEN namespace END AS namespace, route_rank, CASE WHEN named <= 3 THEN score END AS score,
  CASE WHEN named > 3 THEN 'too_many_named' WHEN named = 1 THEN 'unique_title_or_alias' ELSE 'multiple_named_corpora' END AS reason, named <= 3 AS confident, CAST(CASE WHEN named > 3 THEN 0 ELSE named END AS INTEGER) AS fanout
FROM own WHERE route_rank <= 3 AND (named <= 3 OR route_rank = 1)
UNION ALL SELECT query_id, namespace, route_rank, score, CASE WHEN sure THEN 'high_confidence' ELSE 'ambiguous' END, sure, CAST(CASE WHEN sure THEN 1 ELSE n END AS INTEGER) FROM rest"""


@query(_BANK + """, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, namespace) AS rank FROM (SELECT query_id, namespace, round(list_dot_product(a.v, b.v), 6) AS score FROM asked a CROSS JOIN base b) QUALIFY rank <= 12), ranked AS (SELECT * FROM near)"""
       + _SELECT.format(sure="coalesce(top >= 0.65::DOUBLE AND coalesce(margin >= 0.05::DOUBLE, true), false)"))
def hybrid_routes(spark, sf_dir):
    return routing.hybrid_route(_asked(spark, sf_dir), _cards(spark, sf_dir))


@query(_BANK + """, bank AS (SELECT * FROM base UNION ALL SELECT 'label-' || label, v FROM u),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, namespace) AS rank FROM (SELECT query_id, namespace, round(max(list_dot_product(a.v, b.v)), 6) AS score FROM asked a CROSS JOIN bank b GROUP BY ALL) QUALIFY rank <= 12),
w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS words FROM benchmark),
p AS (SELECT 'label-' || item_id % 10 AS namespace, item_id // 10 AS ordinal, words FROM w),
met AS (SELECT query_id, n.namespace, rank AS shortlist_rank, ordinal, round(len(list_intersect(w.words, p.words)) / len(list_distinct(list_concat(w.words, p.words))), 6) AS s FROM near n JOIN p USING (namespace) JOIN w ON w.item_id = query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shortlist_rank, namespace) AS rank FROM (SELECT query_id, namespace, shortlist_rank, max(s) AS score FROM met GROUP BY ALL))"""
       + _SELECT.format(sure="coalesce(top >= 0.3::DOUBLE AND margin >= 0.1::DOUBLE, false)"))
def prototype_routes(spark, sf_dir):
    """Every label has its centroid and its vectors in the bank, and the benchmark items as passages; scores are shares of common words."""
    rows = load(spark, sf_dir, "embeddings").select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("namespace"), "vec_id", vectors.unit(F.col("embedding")).alias("vector"))
    cards = scratch.written(_cards(spark, sf_dir))  # a row a label, for the bank and the names
    bank = cards.select("namespace", "vector").unionByName(rows.select("namespace", "vector"))
    items = load(spark, sf_dir, "benchmark")
    passages = items.select(F.concat(F.lit("label-"), (F.col("item_id") % 10).cast("string")).alias("namespace"), F.floor(F.col("item_id") / 10).alias("ordinal"), F.col("text").alias("passage"))
    common = lambda q, p: prototypes.overlap(text.lexical_tokens(q), text.lexical_tokens(p))
    return routing.prototype_route(_asked(spark, sf_dir), cards, bank, passages, common, 0.3, 0.1)


@query("""
WITH live AS (SELECT DISTINCT source AS namespace FROM documents), cards AS (SELECT 'src' || n_nationkey AS namespace, n_nationkey % 7 <> 0 AS enabled, CASE WHEN n_nationkey % 5 = 0 THEN 'small' ELSE 'base' END AS model FROM nation WHERE n_nationkey % 3 <> 1)
SELECT coalesce(l.namespace, c.namespace) AS namespace, CASE WHEN c.namespace IS NULL THEN 'missing' WHEN l.namespace IS NULL THEN 'stale' WHEN NOT enabled THEN 'disabled' WHEN model <> 'base' THEN 'incompatible' ELSE 'eligible' END AS status
FROM live l FULL OUTER JOIN cards c ON l.namespace = c.namespace""")
def catalog_status(spark, sf_dir):
    live = load(spark, sf_dir, "documents").select(F.col("source").alias("namespace"))
    key = F.col("n_nationkey")
    cards = load(spark, sf_dir, "nation").where(key % 3 != 1).select(
        F.concat(F.lit("src"), key.cast("string")).alias("namespace"), (key % 7 != 0).alias("enabled"), F.when(key % 5 == 0, "small").otherwise("base").alias("model"), F.lit("float32").alias("precision"), F.lit(384).alias("dims")
    )
    return routing.classify_catalog(live, cards, "base", "float32", 384)


@query("""
WITH s AS (SELECT c_custkey AS k, 'rev-' || c_nationkey AS rev, c_mktsegment AS title FROM customer WHERE c_custkey % 4 <> 3), n AS (SELECT o_custkey AS k, CASE WHEN min(o_orderkey) % 3 = 0 THEN NULL ELSE 'rev-' || min(o_orderkey) % 25 END AS expected, min(o_orderpriority) AS title FROM orders GROUP BY 1)
SELECT 'card-' || coalesce(s.k, n.k) AS namespace, CASE WHEN n.k IS NULL THEN s.title WHEN s.k IS NULL THEN CASE WHEN expected IS NULL THEN n.title END WHEN expected = rev THEN n.title ELSE s.title END AS title,
  CASE WHEN n.k IS NULL THEN 'kept' WHEN s.k IS NULL THEN CASE WHEN expected IS NULL THEN 'created' ELSE 'conflict' END WHEN expected = rev THEN 'updated' ELSE 'conflict' END AS outcome FROM s FULL OUTER JOIN n ON s.k = n.k""")
def card_updates(spark, sf_dir):
    name = lambda c: F.concat(F.lit("card-"), F.col(c).cast("string"))
    stored = load(spark, sf_dir, "customer").where("c_custkey % 4 <> 3").select(name("c_custkey").alias("namespace"), F.concat(F.lit("rev-"), F.col("c_nationkey").cast("string")).alias("card_revision"), F.col("c_mktsegment").alias("title"))
    new = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("low"), F.min("o_orderpriority").alias("title"))
    new = new.select(name("o_custkey").alias("namespace"), F.when(F.col("low") % 3 != 0, F.concat(F.lit("rev-"), (F.col("low") % 25).cast("string"))).alias("expected_revision"), "title")
    return routing.compare_and_set(stored, new, ["title"])


@query("SELECT source, CASE WHEN min(lang) = max(lang) THEN min(lang) END AS value, min(lang) IS NULL OR min(lang) = max(lang) AS consistent FROM documents GROUP BY source")
def consistent_metadata(spark, sf_dir):
    return routing.consistent(load(spark, sf_dir, "documents"), "source", "lang")


_SEEN = "WITH o AS (SELECT quality = 1 AS useful, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE (n_chars % 1000) / 10.0::DOUBLE + quality * 40 END AS score, lang FROM labels JOIN documents USING (doc_id))"
_CURVE = _SEEN + """, p AS (SELECT score AS threshold, count(*) FILTER (useful) AS p, count(*) FILTER (NOT useful) AS n FROM o WHERE score IS NOT NULL GROUP BY score),
k AS (SELECT threshold, CAST(sum(p) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp FROM p),
curve AS (SELECT threshold, tp, fp, tp + fp AS accepted, fp / (tp + fp) AS risk, tp / (SELECT count(*) FROM o WHERE useful) AS recall FROM k)
"""


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return both.select((F.col("quality") == 1).alias("useful"), F.when(F.col("doc_id") % 9 != 0, (F.col("n_chars") % 1000) / F.lit(10.0) + F.col("quality") * 40).alias("score"), "lang")


@query(_CURVE + "SELECT * FROM curve")
def evidence_curve(spark, sf_dir):
    return evaluation.risk_curve(_observations(spark, sf_dir))


@query(_CURVE + "SELECT * FROM curve WHERE fp * 100 <= accepted * 5 ORDER BY tp DESC, risk, threshold DESC LIMIT 1")
def evidence_threshold(spark, sf_dir):
    return evaluation.select_threshold(_observations(spark, sf_dir))


@query("""
WITH o AS (SELECT quality = 1 AS useful, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE (n_chars % 1000) / 100.0::DOUBLE + quality * 40 END AS score, CASE WHEN doc_id % 2 = 0 THEN 'calibration' ELSE 'gate' END AS split FROM labels JOIN documents USING (doc_id)),
p AS (SELECT score AS threshold, count(*) FILTER (useful) AS p, count(*) FILTER (NOT useful) AS n FROM o WHERE score IS NOT NULL AND split = 'calibration' GROUP BY score),
k AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS fp FROM p),
c AS (SELECT threshold FROM k WHERE fp * 100 <= (tp + fp) * 5 ORDER BY tp DESC, fp / (tp + fp), threshold DESC LIMIT 1),
g AS (SELECT threshold, count(*) FILTER (a AND useful) AS tp, count(*) FILTER (a AND NOT useful) AS fp, count(*) FILTER (NOT a AND NOT useful) AS tn, count(*) FILTER (NOT a AND useful) AS fn
  FROM (SELECT threshold, useful, coalesce(score >= threshold, false) AS a FROM o CROSS JOIN c WHERE split = 'gate') GROUP BY threshold),
r AS (SELECT *, fp / nullif(fp + tp, 0) AS risk, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS abstention FROM g)
SELECT threshold, tp, fp, tn, fn, round(risk, 9) AS risk, round(recall, 9) AS recall, round(abstention, 9) AS abstention, coalesce(risk <= 0.05::DOUBLE, false) AND coalesce(recall >= 0.95::DOUBLE, false) AND coalesce(abstention >= 0.9::DOUBLE, false) AS passed FROM r""")
def evidence_certification(spark, sf_dir):
    """Even documents calibrate, odd ones certify."""
    both = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    score = F.when(F.col("doc_id") % 9 != 0, (F.col("n_chars") % 1000) / F.lit(100.0) + F.col("quality") * 40)
    out = evaluation.certify(both.select((F.col("quality") == 1).alias("useful"), score.alias("score"), F.when(F.col("doc_id") % 2 == 0, "calibration").otherwise("gate").alias("split")))
    return out.select("threshold", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("risk", "recall", "abstention")], "passed")


@query("""
WITH k AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 50 = 0),
j AS (SELECT q.query_id, v.vec_id AS key, 'g' || v.vec_id % 7 AS "group", 1 + (v.vec_id % 7) % 3 AS grade FROM k q JOIN embeddings v ON v.label = q.label),
w AS (SELECT query_id, "group", max(grade) AS grade FROM j GROUP BY ALL),
b AS (SELECT query_id, vec_id AS key, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 10),
h AS (SELECT 'before' AS side, * FROM b UNION ALL SELECT 'after', query_id, key, 11 - rank FROM b),
m AS (SELECT side, query_id, "group", min(rank) AS rank FROM h JOIN j USING (query_id, key) GROUP BY ALL),
n AS (SELECT s.side, w.query_id, w.grade, m.rank, row_number() OVER (PARTITION BY s.side, w.query_id ORDER BY w.grade DESC, w."group") AS ideal FROM w CROSS JOIN (VALUES ('before'), ('after')) AS s(side) LEFT JOIN m ON m.side = s.side AND m.query_id = w.query_id AND m."group" = w."group"),
d AS (SELECT side, query_id, coalesce(sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1)) FILTER (rank <= 5), 0) / sum((2.0::DOUBLE ** grade - 1) / log2(ideal + 1)) FILTER (ideal <= 5) AS ndcg FROM n GROUP BY ALL)
SELECT count(*) FILTER (side = 'before') AS cases, round(avg(ndcg) FILTER (side = 'before'), 9) AS ndcg_before, round(avg(ndcg) FILTER (side = 'after'), 9) AS ndcg_after, round(avg(ndcg) FILTER (side = 'after') - avg(ndcg) FILTER (side = 'before'), 9) AS improvement FROM d""")
def rerank_gain(spark, sf_dir):
    """Neighbours of some vectors, before and after their order is turned round; seven groups of the own label's vectors are the judgments."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label")
    asked = rows.where("key % 50 = 0").select(F.col("key").alias("query_id"), "label")
    nth = F.col("key") % 7
    groups = asked.join(rows, "label").select("query_id", "key", F.concat(F.lit("g"), nth.cast("string")).alias("group"), (1 + nth % 3).alias("grade"))
    before = _neighbours(spark, sf_dir).select("query_id", F.col("vec_id").alias("key"), "rank")
    out = evaluation.rerank_gain(before, before.withColumn("rank", 11 - F.col("rank")), groups)
    return out.select("cases", *[F.round(c, 9).alias(c) for c in ("ndcg_before", "ndcg_after", "improvement")])


@query(_CARDS + """, e AS (SELECT vec_id AS query_id, 'label-' || label AS namespace FROM embeddings)
SELECT namespace, count(*) AS cases, count(rank) AS found, round(count(rank) / count(*), 9) AS recall FROM e LEFT JOIN (SELECT query_id, namespace, rank FROM routes WHERE rank <= 2) USING (query_id, namespace) GROUP BY namespace""")
def recall_by_namespace(spark, sf_dir):
    expected = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("namespace"))
    out = evaluation.recall_by_namespace(_routes(spark, sf_dir), expected, 2)
    return out.withColumn("recall", F.round("recall", 9))


@query(_SEEN + """, c AS (SELECT lang, count(*) FILTER (coalesce(score >= 60, false) AND useful) AS tp, count(*) FILTER (coalesce(score >= 60, false) AND NOT useful) AS fp,
  count(*) FILTER (NOT coalesce(score >= 60, false) AND NOT useful) AS tn, count(*) FILTER (NOT coalesce(score >= 60, false) AND useful) AS fn FROM o GROUP BY GROUPING SETS ((lang), ())),
r AS (SELECT *, fp / nullif(fp + tp, 0) AS risk, tp / nullif(tp + fn, 0) AS recall FROM c)
SELECT lang, tp, fp, tn, fn, round(risk, 9) AS risk, round(recall, 9) AS recall, round(risk - (SELECT risk FROM r WHERE lang IS NULL), 9) AS excess_risk, round((SELECT recall FROM r WHERE lang IS NULL) - recall, 9) AS recall_shortfall FROM r""")
def evidence_by_language(spark, sf_dir):
    out = evaluation.metrics_by_kind(_observations(spark, sf_dir), 60.0, "lang")
    return out.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("risk", "recall", "excess_risk", "recall_shortfall")])


@query(_BODY + """, e AS (SELECT item_id AS query_id, regexp_extract(text, '^(\\S+\\s+\\S+\\s+\\S+)', 1) AS phrase FROM benchmark),
m AS (SELECT query_id, min(rank) AS rank FROM body JOIN documents USING (doc_id) JOIN e USING (query_id) WHERE contains(lower(text), lower(phrase)) GROUP BY query_id)
SELECT e.query_id, rank IS NOT NULL AS passed, coalesce(rank, 0) AS rank FROM e LEFT JOIN m USING (query_id)""".replace("\\\\", "\\"))
def first_match(spark, sf_dir):
    hits = _body_hits(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    phrases = _questions(spark, sf_dir).select("query_id", F.regexp_extract("query", r"^(\S+\s+\S+\s+\S+)", 1).alias("phrase"))
    return evaluation.first_match(hits, phrases, "text").withColumn("rank", F.coalesce("rank", F.lit(0)))


_SPANS = "WITH s AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, event_id, event_type AS name, ts, value, event_type = 'error' AS bad FROM events)"


@query(_SPANS + " SELECT trace_id, count(*) AS spans, count(*) FILTER (bad) AS errors, min(ts) AS started_at, max(ts) AS ended_at, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS duration_us, CASE WHEN count(*) FILTER (bad) > 0 THEN 'error' ELSE 'ok' END AS status FROM s GROUP BY trace_id")
def trace_runs(spark, sf_dir):
    return traces.runs(traces.spans(load(spark, sf_dir, "events")))


@query(_SPANS + " SELECT name, count(*) AS spans, min(value) AS min_ms, max(value) AS max_ms, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total_us FROM s GROUP BY name")
def stage_latency(spark, sf_dir):
    return traces.stage_latency(traces.spans(load(spark, sf_dir, "events")))


@query(_SPANS + """, r AS (SELECT trace_id, count(*) AS spans, min(ts) AS started_at, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS us, count(*) FILTER (bad) = 0 AS ok FROM s GROUP BY trace_id)
SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS retrievals, round(sum(us) / count(*) / 1000, 1) AS average_ms, count(*) FILTER (ok) AS successful, count(*) FILTER (spans = 1) AS incomplete FROM r GROUP BY day""")
def daily_volume(spark, sf_dir):
    return traces.daily_volume(traces.runs(traces.spans(load(spark, sf_dir, "events")))).withColumn("day", F.col("day").cast("string"))


@query(_SPANS + " SELECT name AS stage, count(*) AS calls, round(sum(CAST(round(value * 1000) AS BIGINT)) / count(*) / 1000, 1) AS average_ms, round(quantile_cont(round(value, 1), 0.95), 1) AS p95_ms FROM s GROUP BY name")
def stage_percentiles(spark, sf_dir):
    return traces.stage_percentiles(traces.spans(load(spark, sf_dir, "events")))


@query(_SPANS + """, r AS (SELECT count(*) AS spans, count(*) FILTER (bad) AS errors FROM s GROUP BY trace_id)
SELECT spans > 2 AS widened, CASE WHEN errors > 0 THEN 'error' ELSE 'none' END AS fallback_reason, errors AS failure_count, count(*) AS retrievals FROM r GROUP BY ALL""")
def widening_matrix(spark, sf_dir):
    run = traces.runs(traces.spans(load(spark, sf_dir, "events")))
    run = run.select((F.col("spans") > 2).alias("widened"), F.when(F.col("errors") > 0, "error").otherwise("none").alias("fallback_reason"), F.col("errors").alias("failure_count"))
    return traces.outcome_matrix(run, "widened", "fallback_reason", "failure_count")


@query("""
WITH e AS (SELECT CASE WHEN event_id % 41 = 0 THEN ' ' ELSE event_type || '-' || user_id END AS trace_id, CASE event_id % 37 WHEN 3 THEN 'broken' WHEN 5 THEN '[1]' WHEN 7 THEN '{"ms": -1}' ELSE '{"ms": ' || event_id || '}' END AS payload FROM events)
SELECT trace_id, 'id missing' AS reason FROM e WHERE trim(trace_id) = '' UNION ALL SELECT trace_id, 'no object' FROM e WHERE payload IN ('broken', '[1]') UNION ALL SELECT trace_id, 'negative duration' FROM e WHERE payload = '{"ms": -1}'""")
def envelope_violations(spark, sf_dir):
    """Events as envelopes, some spoilt by rule."""
    key, part = F.col("event_id"), F.col("event_id") % 37
    body = F.when(part == 3, "broken").when(part == 5, "[1]").when(part == 7, '{"ms": -1}').otherwise(F.concat(F.lit('{"ms": '), key.cast("string"), F.lit("}")))
    name = F.when(key % 41 == 0, " ").otherwise(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")))
    return traces.envelope_violations(load(spark, sf_dir, "events").select(name.alias("trace_id"), body.alias("payload")))


@query("""
WITH t AS (SELECT user_id AS trace_id, event_id AS span_id, CASE WHEN event_id % 97 <> 0 THEN event_id - event_id % 97 END AS p, ts AS started_at, ts + INTERVAL 1 HOUR AS ended_at FROM events),
l AS (SELECT c.trace_id, r.span_id AS parent, c.started_at < r.started_at OR c.ended_at > r.ended_at AS outside FROM t c LEFT JOIN t r ON r.trace_id = c.trace_id AND r.span_id = c.p WHERE c.p IS NOT NULL)
SELECT trace_id, 'not one root' AS reason FROM t GROUP BY trace_id HAVING count(*) FILTER (p IS NULL) <> 1
UNION SELECT trace_id, CASE WHEN parent IS NULL THEN 'parent missing' WHEN outside THEN 'outside its parent' END AS reason FROM l WHERE parent IS NULL OR outside""")
def trace_graph_violations(spark, sf_dir):
    hour = F.col("ts") + F.expr("INTERVAL 1 HOUR")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.when(F.col("event_id") % 97 != 0, F.col("event_id") - F.col("event_id") % 97).alias("parent_span_id"), F.col("ts").alias("started_at"), hour.alias("ended_at"))
    return traces.graph_violations(rows)


@query("""
WITH b AS (SELECT event_type || '-' || user_id AS trace_id, CASE WHEN event_id % 50 = 7 THEN 'broken' ELSE props END AS payload FROM events), s AS (SELECT event_type || '-' || user_id AS trace_id, sha256(min(props)) AS stored FROM events WHERE event_id % 2 = 0 GROUP BY 1),
h AS (SELECT trace_id, payload, sha256(payload) AS content_hash, payload <> 'broken' AS ok FROM b), f AS (SELECT trace_id, min(content_hash) AS first FROM h WHERE ok GROUP BY 1)
SELECT trace_id, content_hash, CASE WHEN NOT ok THEN 'rejected' WHEN content_hash <> coalesce(stored, first) THEN 'conflict' WHEN stored IS NOT NULL THEN 'replayed' ELSE 'committed' END AS outcome FROM h LEFT JOIN f USING (trace_id) LEFT JOIN s USING (trace_id)""")
def trace_outcomes(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    name = F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string")).alias("trace_id")
    stored = events.where("event_id % 2 = 0").groupBy(name).agg(F.sha2(F.min("props"), 256).alias("content_hash"))
    batch = events.select(name, F.when(F.col("event_id") % 50 == 7, "broken").otherwise(F.col("props")).alias("payload"))
    return traces.classify(batch, stored).select("trace_id", "content_hash", "outcome")


@query(_BODY + """, h AS (SELECT query_id, doc_id AS key, source AS namespace, rank FROM body JOIN documents USING (doc_id)),
m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, namespace ORDER BY rank, key) = 1 THEN 1 ELSE 0 END AS first FROM h),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, rank, key) AS slot FROM m) WHERE slot <= 8)
SELECT query_id, key, namespace, row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS rank FROM s""")
def namespace_coverage(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("namespace"))
    hits = _body_hits(spark, sf_dir).join(docs, "doc_id").select("query_id", F.col("doc_id").alias("key"), "namespace", "rank")
    return index.cover_namespaces(hits, 8)


@query("""
WITH h AS (SELECT user_id AS query_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS rank, 'https://docs.example/' || event_type || '/' || event_id % 10 AS url, event_type AS section FROM events WHERE value > 60),
j AS (SELECT user_id AS query_id, event_id AS judgment_id, 'docs.example/' || event_type AS url, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE '' END AS section, 1 + event_id % 3 AS grade FROM events WHERE value < 1)
SELECT query_id, judgment_id, max(grade) AS grade, min(rank) AS rank FROM h JOIN j USING (query_id) WHERE (contains(lower(h.url), lower(j.url)) OR contains(lower(j.url), lower(h.url))) AND (j.section = '' OR contains(lower(h.section), lower(j.section))) GROUP BY ALL""")
def credited_judgments(spark, sf_dir):
    from pyspark.sql import Window

    events, kind = load(spark, sf_dir, "events"), F.col("event_type")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    hits = events.where("value > 60").select(F.col("user_id").alias("query_id"), nth.alias("rank"), F.concat(F.lit("https://docs.example/"), kind, F.lit("/"), (F.col("event_id") % 10).cast("string")).alias("url"), F.lit("").alias("path"), kind.alias("section"))
    judged = events.where("value < 1").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("judgment_id"), F.concat(F.lit("docs.example/"), kind).alias("url"), F.lit("").alias("path"),
        F.when(F.col("event_id") % 2 == 0, F.upper(kind)).otherwise("").alias("section"), (1 + F.col("event_id") % 3).alias("grade"),
    )
    return index.credited(index.match_judgments(hits, judged))


@query("""SELECT coalesce(reason, 'eligible') AS reason, count(*) AS cards FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'disabled' WHEN c_nationkey % 5 = 0 THEN 'region' WHEN c_mktsegment = 'BUILDING' THEN 'model' WHEN c_acctbal < 0 THEN 'precision' END AS reason FROM customer) GROUP BY 1""")
def card_eligibility(spark, sf_dir):
    key = F.col("c_custkey")
    cards = load(spark, sf_dir, "customer").select(
        key.cast("string").alias("namespace"), (key % 7 != 0).alias("enabled"), F.when(F.col("c_nationkey") % 5 == 0, "west").otherwise("east").alias("region"),
        F.when(F.col("c_mktsegment") == "BUILDING", "small").otherwise("base").alias("model"), F.when(F.col("c_acctbal") < 0, "float16").otherwise("float32").alias("precision"), F.lit(384).alias("dims"),
    )
    return index.ineligible(cards, "east", "base", "float32", 384).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("cards"))


@query("SELECT o_custkey AS customer, 'left' AS side FROM (SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 EXCEPT SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) UNION ALL SELECT o_custkey, 'right' FROM (SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 EXCEPT SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)")
def unequal_keys(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    left, right = (orders.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("customer")) for x in "FO")
    return index.same_keys(left, right, "customer")


@query("SELECT key, CAST(sum(value) AS BIGINT) AS value FROM (SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events WHERE value > 10 GROUP BY 1) GROUP BY key")
def combined_counters(spark, sf_dir):
    events, orders = load(spark, sf_dir, "events"), load(spark, sf_dir, "orders")
    count = lambda df, c: df.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("value"))
    return index.combined_counters(count(events, "event_type"), count(orders, "o_orderstatus"), count(events.where("value > 10"), "event_type"))


@query("""
WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark),
b AS (SELECT * FROM body)
SELECT query_id, doc_id, round(len(list_intersect(w, list_distinct(list_filter(string_split_regex(lower('Title: ' || source || chr(10) || substr(text, 1, 8192)), '[^a-z0-9]+'), lambda x: x <> '')))) / len(w), 9) AS cross_score
FROM b JOIN documents USING (doc_id) JOIN q USING (query_id)""".replace("WITH q AS", _BODY + ", q AS", 1))
def cross_scores(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", index.rerank_passage(F.col("source"), F.lit(""), F.lit(""), F.col("text")).alias("passage"))
    hits = _body_hits(spark, sf_dir).join(docs, "doc_id").join(_questions(spark, sf_dir), "query_id")
    return hits.select("query_id", "doc_id", F.round(index.overlap_score(F.col("query"), F.col("passage")), 9).alias("cross_score"))


@query("SELECT 'ts-' || doc_id AS id, source AS namespace, sha256(text) AS chunk_hash, substr(text, 1, 240) AS preview, 'duck://docs/' || doc_id AS url, 'en,' || coalesce(lang, '') AS tags FROM documents WHERE lang > 'en' UNION ALL SELECT 'ts-' || doc_id, source, sha256(text), substr(text, 1, 240), 'duck://docs/' || doc_id, array_to_string(list_sort(list_distinct(['en', lang])), ',') FROM documents WHERE lang <= 'en'")
def index_rows(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("content", F.col("text")).withColumn("tags", F.array(F.lit("en"), F.col("lang"), F.lit("en")))
    key = F.col("doc_id").cast("string")
    return index.chunk_record(docs).select(F.concat(F.lit("ts-"), key).alias("id"), F.col("source").alias("namespace"), "chunk_hash", "preview", index.document_url("duck", "docs", key).alias("url"), F.array_join("tags", ",").alias("tags"))


@query()
def embedded_documents(spark, sf_dir):
    """Every document's hashed vector, and whether it is a valid unit vector."""
    docs = load(spark, sf_dir, "documents").select("doc_id", index.embed(F.col("text")).alias("vector"))
    return docs.select("doc_id", "vector", vectors.is_unit(F.col("vector"), index.DIMENSIONS).alias("valid"))


_ROLES = _BODY + """, h AS (SELECT query_id, doc_id AS key, CASE (query_id + doc_id) % 13 WHEN 0 THEN 'docs' WHEN 1 THEN 'tests' ELSE 'source' END AS role, doc_id % 4 AS strength, rank FROM body WHERE rank > 0),
"""


@query(_ROLES + """p AS (SELECT query_id, max(rank = 1 AND role = 'source') AS source, max(rank <= 5 AND role <> 'source') AS has, arg_min(rank, (-strength * 100 + rank)) FILTER (rank BETWEEN 6 AND 20 AND role <> 'source' AND strength > 0) AS f FROM h GROUP BY query_id),
m AS (SELECT query_id, f FROM p WHERE source AND NOT has AND f IS NOT NULL)
SELECT query_id, key, role, CAST(CASE WHEN rank = f THEN 5 WHEN rank >= 5 AND rank < f THEN rank + 1 ELSE rank END AS BIGINT) AS rank FROM h LEFT JOIN m USING (query_id)""")
def companion_placement(spark, sf_dir):
    code = (F.col("query_id") + F.col("doc_id")) % 13
    hits = _body_hits(spark, sf_dir).select("query_id", F.col("doc_id").alias("key"), F.when(code == 0, "docs").when(code == 1, "tests").otherwise("source").alias("role"), (F.col("doc_id") % 4).alias("strength"), "rank")
    return retrieval.place_companion(hits).select("query_id", "key", "role", F.col("rank").cast("long").alias("rank"))


@query(_BODY + """, g AS (SELECT query_id, source, min_by(doc_id, rank) AS doc_id, min(rank) AS best_rank, count(*) AS hits, max(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) AS factor FROM body JOIN documents USING (doc_id) GROUP BY query_id, source),
s AS (SELECT *, round(1.0::DOUBLE / (60 + best_rank) * factor, 12) AS score FROM g)
SELECT query_id, source, doc_id, best_rank, hits, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, source) AS rank FROM s""")
def grouped_search_weighted(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("lang") == "en", 1.0).otherwise(0.7).alias("factor"))
    return retrieval.group_hits(_body_hits(spark, sf_dir).join(docs, "doc_id"), "doc_id", "source", "max", "factor")


@query(ORACLE["routing_metrics"].join(["SELECT gate, value, threshold, coalesce(CASE WHEN gate = 'route_recall_at_3' THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM (SELECT * FROM (", """)) CROSS JOIN LATERAL (VALUES ('route_recall_at_3', CAST(route_recall_at_3 AS DOUBLE), 0.95::DOUBLE), ('average_fanout', CAST(average_fanout AS DOUBLE), 2.0::DOUBLE),
  ('max_fanout', CAST(max_fanout AS DOUBLE), 3.0::DOUBLE), ('wrong_confident_singles', CAST(wrong_confident_singles AS DOUBLE), 0.0::DOUBLE)) AS v(gate, value, threshold)"""]))
def release_gates(spark, sf_dir):
    return evaluation.gates(routing_metrics(spark, sf_dir), evaluation.ROUTING_GATES)
