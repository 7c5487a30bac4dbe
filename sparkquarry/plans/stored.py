"""Queries over tables that the library keeps itself, the inverted index and the store that plans are applied to, and over judged hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.functions import markdown
from sparkquarry.operators import apply, judged, text_index, vector_index
from sparkquarry.plans import search
from sparkquarry.sources import relation, scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _indexed(spark: SparkSession, sf_dir: str, docs: DataFrame, fields: list[str], top: int) -> DataFrame:
    """Documents indexed in two additions, then searched for every benchmark item."""
    docs = relation.dealt(docs)
    with scratch.folder(spark) as root:
        for part in (0, 1):
            text_index.add_documents(spark, root, docs.where(F.pmod("doc_id", F.lit(2)) == part), fields, buckets=32)
        return scratch.written(text_index.bm25_search(text_index.Reader(spark, root), search._questions(spark, sf_dir), top))


@query(search._BODY + " SELECT query_id, doc_id, score, rank FROM body")
def indexed_search(spark, sf_dir):
    """The rows of bm25_search from a stored index."""
    return _indexed(spark, sf_dir, search.load(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], 20)


@query(search._HYBRID.split("\nnear AS")[0].rstrip(",") + " SELECT query_id, doc_id, score, rank FROM words WHERE rank <= 20")
def indexed_field_search(spark, sf_dir):
    """Title, section and content with their weights from a stored index."""
    docs = search.load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"), F.col("source").alias("section_path"), F.col("text").alias("content"))
    return _indexed(spark, sf_dir, docs, ["title", "section_path", "content"], 20)


@query(search._KNN + " SELECT query_id, vec_id, score, rank FROM knn")
def indexed_vector_search(spark, sf_dir):
    """The rows of vector_search from a stored index of cells."""
    rows = search.load(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    with scratch.folder(spark) as root:
        vector_index.build(spark, root, rows, cells=32)
        return scratch.written(vector_index.search(vector_index.Reader(spark, root), asked, 10))


@query("""
WITH d AS (SELECT doc_id, 'doc-' || doc_id AS row_id, sha256(text) AS old_hash, CASE WHEN doc_id % 3 = 0 THEN sha256(text || ' v2') ELSE sha256(text) END AS new_hash, doc_id % 5 <> 0 AS first, doc_id % 7 <> 0 AS second FROM documents)
SELECT row_id, CASE WHEN second THEN new_hash ELSE old_hash END AS content_hash, CASE WHEN second THEN 'active' ELSE 'retained_stale' END AS status,
  CASE WHEN NOT second OR (first AND new_hash = old_hash) THEN 'plan-1' ELSE 'plan-2' END AS plan_id, 'second card' AS card FROM d WHERE first OR second""")
def applied_index(spark, sf_dir):
    """Index, ledger and card after two plans over the documents: some leave, some are new, every third is changed."""
    docs = search.load(spark, sf_dir, "documents")
    row_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("row_id")

    def plan(rows: DataFrame, text) -> tuple[DataFrame, DataFrame]:
        wanted = rows.select(row_id, F.concat(F.lit("https://documents/"), "doc_id").alias("canonical_url"), F.sha2("text", 256).alias("page_hash"), F.sha2(text, 256).alias("embedding_text_hash"))
        return wanted, wanted.select(F.col("row_id").alias("id"), F.col("embedding_text_hash").alias("content_hash"))

    def card(title: str, expected: str | None) -> DataFrame:
        return spark.createDataFrame([("documents", expected, title)], "namespace string, expected_revision string, title string")

    later = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    with scratch.folder(spark) as root:
        apply.apply_plan(spark, root, *plan(docs.where("doc_id % 5 <> 0"), F.col("text")), "plan-1", card=card("first card", None), buckets=16)
        revision = apply.Applied(spark, root).table("cards").first()["card_revision"]
        apply.apply_plan(spark, root, *plan(docs.where("doc_id % 7 <> 0"), later), "plan-2", card=card("second card", revision), expected=1)
        now = apply.Applied(spark, root)
        both = now.table("index").withColumnRenamed("id", "row_id").join(now.table("ledger").select("row_id", "status", "plan_id"), "row_id", "full_outer")
        cards = F.broadcast(now.table("cards").select(F.col("title").alias("card")))  # one card
        return scratch.written(both.crossJoin(cards).select("row_id", "content_hash", "status", "plan_id", "card"))


@query()
def page_markdown(spark, sf_dir):
    """Title, main content as Markdown and its hash of every page."""
    made = relation.dealt(search.load(spark, sf_dir, "pages")).select("page_id", "url", markdown.page_content(F.col("html")).alias("page"))
    return made.select("page_id", F.coalesce(F.nullif("page.title", F.lit("")), "url").alias("title"), "page.markdown", F.sha2("page.markdown", 256).alias("source_hash"))


_JUDGED = """
WITH RECURSIVE h AS (SELECT user_id AS query_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS rank, 'src/' || event_type || '/' || event_id % 4 || '.py' AS file, event_type AS section FROM events WHERE value > 60 QUALIFY rank <= 10),
r AS (SELECT user_id AS query_id, event_id % 4 AS grade, CASE WHEN event_id % 3 = 0 THEN 'src/' || event_type || '/' || event_id % 5 || '.py' ELSE '' END AS file, CASE WHEN event_id % 3 > 0 THEN 'host.example/o/r/blob/main/src/' || event_type ELSE '' END AS url,
  CASE WHEN event_id % 3 = 2 THEN upper(event_type) ELSE '' END AS section FROM events WHERE value < 4),
j AS (SELECT query_id, CASE WHEN file <> '' THEN 'repo_path:' || file ELSE 'url:' || url END AS key, CAST(max(grade) AS BIGINT) AS grade, arg_min(section, (-grade, section)) AS section, any_value(file) AS file, any_value(url) AS url FROM r WHERE grade > 0 GROUP BY 1, 2),
m AS (SELECT query_id, rank, key, grade FROM h JOIN j USING (query_id) WHERE CASE WHEN j.file <> '' THEN j.file = h.file ELSE contains('host.example/o/r/blob/main/' || h.file, j.url) END AND (j.section = '' OR lower(j.section) = h.section)),
g AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS rank, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS BIGINT) AS grade, CAST([] AS VARCHAR[]) AS used FROM m
  UNION ALL
  SELECT g.query_id, g.rank + 1, arg_min(m.key, (-m.grade, m.key)), CAST(-min(-m.grade) AS BIGINT), list_concat(any_value(g.used), coalesce([arg_min(m.key, (-m.grade, m.key))], []))
  FROM g LEFT JOIN m ON m.query_id = g.query_id AND m.rank = g.rank + 1 AND NOT list_contains(g.used, m.key) WHERE g.rank < 10 GROUP BY g.query_id, g.rank),
a AS (SELECT query_id, rank, key, grade FROM g WHERE key IS NOT NULL)
"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A user's events as hits and as judgments by path or URL, some with a section; rivals for one hit and one judgment for several hits."""
    events, kind, number = search.load(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    query_id, none = F.col("user_id").alias("query_id"), F.lit(None).cast("string")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    file = lambda n: F.concat(F.lit("src/"), kind, F.lit("/"), (number % n).cast("string"), F.lit(".py"))
    hits = events.where("value > 60").select(query_id, nth.alias("rank"), F.concat(F.lit("https://Host.example/o/r/blob/main/"), file(4)).alias("url"), none.alias("path"), none.alias("repo_path"), kind.alias("section_path"))
    judgments = events.where("value < 4").select(
        query_id, F.when(number % 3 > 0, F.concat(F.lit("host.example/o/r/blob/main/src/"), kind, F.lit("/"))).alias("url"), F.when(number % 3 == 0, F.concat(F.lit("/"), file(5))).alias("repo_path"),
        F.when(number % 3 == 2, F.concat(F.upper(kind), F.lit(" "))).alias("section_path"), (number % 4).alias("grade"),
    )
    return hits.where("rank <= 10"), judgments


@query(_JUDGED + "SELECT query_id, rank, key, grade FROM a")
def judged_assignment(spark, sf_dir):
    """Every hit with the judgment that it takes."""
    hits, judgments = _judged(spark, sf_dir)
    return judged.assigned(judged.matches(hits, judged.distinct_judgments(judgments)))


@query(_JUDGED + """, i AS (SELECT query_id, count(*) AS judged, list_sort(list(grade), 'DESC')[1:10] AS grades FROM j GROUP BY 1),
w AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, count(*) AS found, count(*) FILTER (rank <= 5) AS near FROM a GROUP BY 1),
s AS (SELECT query_id, judged, first_rank, coalesce(dcg / list_sum(list_transform(grades, lambda g, n: (pow(2, g) - 1) / log2(n + 1))), 0) AS ndcg, coalesce(found / judged, 0) AS recall, coalesce(1.0::DOUBLE / first_rank, 0) AS mrr, coalesce(near / shown, 0) AS precision
  FROM i LEFT JOIN w USING (query_id) LEFT JOIN (SELECT query_id, min(rank) AS first_rank FROM m GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS shown FROM h WHERE rank <= 5 GROUP BY 1) USING (query_id))
SELECT query_id, judged, coalesce(first_rank, 0) AS first_rank, round(ndcg, 9) AS ndcg, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(precision, 9) AS precision,
  round(100 * (0.55::DOUBLE * ndcg + 0.20::DOUBLE * recall + 0.15::DOUBLE * mrr + 0.10::DOUBLE * precision), 6) AS composite FROM s""")
def judged_metrics(spark, sf_dir):
    out = judged.judged_metrics(*_judged(spark, sf_dir)).withColumn("first_rank", F.coalesce("first_rank", F.lit(0)))
    return out.withColumns({c: F.round(c, 6 if c == "composite" else 9) for c in ("ndcg", "recall", "mrr", "precision", "composite")})
