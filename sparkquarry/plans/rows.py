"""Queries over rows that go in and out of an index: pages of files, URL forms, deltas, evidence, hits, banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.functions import text as tx
from sparkquarry.functions import urls
from sparkquarry.operators import manifest, repository, rows
from sparkquarry.operators import search as search_ops
from sparkquarry.plans import corpus, search
from sparkquarry.sources import artifacts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
load = corpus.load


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 3 WHEN 0 THEN 'src/pkg/doc-' || doc_id || '.py' WHEN 1 THEN 'docs/doc-' || doc_id || '.md' ELSE 'notes/doc-' || doc_id || '.txt' END AS path FROM documents),
l AS (SELECT *, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS lines, CASE WHEN contains(text, '```') THEN '~~~~' ELSE '```' END AS fence FROM d),
m AS (SELECT *, 'Search metadata:' || chr(10) || 'Path tokens: ' || CASE doc_id % 3 WHEN 0 THEN 'src pkg doc ' WHEN 1 THEN 'docs doc ' ELSE 'notes doc ' END || doc_id || chr(10) || 'File stem: doc-' || doc_id AS meta, CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' ELSE 'text' END AS language FROM l),
h AS (SELECT *, 'Repository file: `' || path || '`' || chr(10) || 'Language: `' || language || '`' AS told FROM m)
SELECT path, language, sha256('# File metadata: ' || path || chr(10) || chr(10) || told || chr(10) || chr(10) || meta) AS card_sha,
  sha256(CASE doc_id % 3 WHEN 1 THEN text WHEN 2 THEN '# ' || path || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g')
    ELSE array_to_string(list_concat(['# ' || path || chr(10) || chr(10) || told || chr(10) || chr(10) || meta],
      list_transform(range(1, len(lines) + 1, 80), lambda i: chr(10) || '## Lines ' || i || '-' || least(i + 79, len(lines)) || chr(10) || chr(10) || fence || 'python' || chr(10) || array_to_string(lines[i:i + 79], chr(10)) || chr(10) || fence)), chr(10)) END) AS page_sha FROM h""")
def repository_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a repository: a third code, a third Markdown, a third plain text."""
    key = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("src/pkg/doc-"), key, F.lit(".py"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("docs/doc-"), key, F.lit(".md"))).otherwise(F.concat(F.lit("notes/doc-"), key, F.lit(".txt")))
    made = repository.as_pages(load(spark, sf_dir, "documents").select(name.alias("path"), "text"))
    return made.select("path", "language", tx.sha256(F.col("card")).alias("card_sha"), tx.sha256(F.col("page")).alias("page_sha"))


@query(r"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^www\.', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS source FROM u)
SELECT page_id, regexp_replace(regexp_replace(host || '/' || regexp_replace(path, '^/+|/+$', '', 'g'), '/{2,}', '/', 'g'), '/+$', '') AS eval_url, lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')) AS page_key, source AS source_id, 'site-' || source || '-v1' AS namespace,
  lpad(CAST(page_id AS VARCHAR), 5, '0') || '-' || CASE WHEN source = '' THEN 'page' ELSE source END || '-' || substr(sha256(url), 1, 12) || '.md' AS file, contains(host, 'example.org') AND host LIKE '%.example.org' AS known FROM s""")
def page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    known = urls.with_scheme_and_host(F.regexp_replace(url, r"[?#].*$", "")) & F.endswith(urls.host(url), F.lit(".example.org"))
    return load(spark, sf_dir, "pages").select(
        "page_id", urls.eval_url(url).alias("eval_url"), urls.page_key(url).alias("page_key"), urls.source_id(url).alias("source_id"), urls.namespace_name(url).alias("namespace"), rows.page_file(url, urls.source_id(url), F.col("page_id")).alias("file"), known.alias("known")
    )


@query("SELECT url AS canonical_url, sha256(html) AS page_hash, 'host=' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || ';n=' || page_id AS metadata FROM pages")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a crawl time among their metadata, which must go."""
    url = F.col("url")
    meta = F.create_map(F.lit("host"), urls.host(url), F.lit("crawl_timestamp"), F.current_timestamp().cast("string"), F.lit("n"), F.col("page_id").cast("string"))
    made = rows.page_records(load(spark, sf_dir, "pages").select(url.alias("canonical_url"), url.alias("title"), tx.sha256(F.col("html")).alias("page_hash"), meta.alias("metadata")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return made.select("canonical_url", "page_hash", shown.alias("metadata"))


_DELTA = corpus._SIDES + """, y AS (SELECT row_id, action AS category FROM x WHERE action <> 'unchanged'),
z AS (SELECT row_id, CASE WHEN status = 'active' AND CAST(substr(row_id, 5) AS BIGINT) % 6 = 1 THEN 'deleted' ELSE status END AS status FROM l)
"""


@query(corpus._SIDES + """SELECT row_id, CASE WHEN action IN ('stale', 'retained_stale') THEN 'stale' ELSE 'upsert' END AS kind, action AS category, CASE action WHEN 'stale' THEN 'absent from the plan' WHEN 'retained_stale' THEN 'kept by an earlier plan' END AS reason FROM x WHERE action <> 'unchanged'""")
def delta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.delta_rows(manifest.diff(*corpus._sides(spark, sf_dir))).select("row_id", "kind", "category", "reason")


@query(_DELTA + """SELECT row_id, category || ' but ' || coalesce(status, 'absent') AS reason FROM y LEFT JOIN z USING (row_id) WHERE NOT list_contains(CASE category WHEN 'new' THEN ['absent', 'deleted'] WHEN 'changed' THEN ['active', 'absent', 'deleted'] WHEN 'stale' THEN ['active'] ELSE ['retained_stale'] END, coalesce(status, 'absent'))""")
def delta_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta against a ledger of which some rows were deleted since."""
    wanted, ledger = corpus._sides(spark, sf_dir)
    later = ledger.select("row_id", F.when((F.col("status") == "active") & (F.substring("row_id", 5, 20).cast("long") % 6 == 1), "deleted").otherwise(F.col("status")).alias("status"))
    return rows.delta_violations(rows.delta_rows(manifest.diff(wanted, ledger)), later)


@query(corpus._SIDES + """, u AS (SELECT m.row_id, m.embedding_text_hash AS h FROM m JOIN x USING (row_id) WHERE action IN ('new', 'changed', 'reactivate_retained_stale')), o AS (SELECT row_id, embedding_text_hash AS h FROM l WHERE status = 'active'),
p AS (SELECT 'doc-' || doc_id AS row_id, sha256(text) AS h FROM d)
SELECT p.row_id, CASE WHEN coalesce(u.h, o.h) IS NULL THEN 'no such row' ELSE 'another content' END AS reason FROM p LEFT JOIN u ON u.row_id = p.row_id LEFT JOIN o ON o.row_id = p.row_id WHERE coalesce(u.h, o.h) IS NULL OR coalesce(u.h, o.h) <> p.h""")
def prototype_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a prototype, against the rows put in and those that are active."""
    wanted, ledger = corpus._sides(spark, sf_dir)
    changed = rows.delta_rows(manifest.diff(wanted, ledger)).where("kind = 'upsert'").select("row_id")
    own = lambda df, *more: df.select("row_id", F.col("embedding_text_hash").alias("content_hash"), *more)
    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("row_id"), tx.sha256(tx.text_or_empty(F.col("text"))).alias("content_hash"))
    return rows.prototype_violations(docs, own(wanted).join(changed, "row_id", "left_semi"), own(ledger, "status"))


@query("""
WITH s AS (SELECT doc_id // 10 AS query_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS rank, CASE WHEN doc_id % 47 <> 0 THEN (n_chars % 100) / 100.0::DOUBLE END AS score FROM documents),
o AS (SELECT query_id, count(*) AS candidates, count(score) = count(*) AS whole, list_reverse_sort(list(score)) AS scores FROM s WHERE rank <= 5 GROUP BY query_id),
v AS (SELECT query_id, candidates, CASE WHEN whole THEN scores[1] END AS top, CASE WHEN whole THEN scores[2] END AS second FROM o)
SELECT query_id, top, second, round(top - second, 9) AS gap, candidates, top IS NULL OR top < 0.7::DOUBLE AS weak, CASE WHEN top IS NULL OR top < 0.7::DOUBLE THEN 'insufficient' ELSE 'supported' END AS decision, true AS enforced FROM v""")
def evidence_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents each are the hits of a question, with scores from their lengths."""


    group = F.floor(F.col("doc_id") / 10)
    hits = load(spark, sf_dir, "documents").select(group.alias("query_id"), F.row_number().over(Window.partitionBy(group).orderBy("doc_id")).alias("rank"), F.when(F.col("doc_id") % 47 != 0, (F.col("n_chars") % 100) / F.lit(100.0)).alias("cross_score"))
    return rows.decide_evidence(rows.observe_evidence(hits), 0.7, "active")


_HITS = search._BODY + """, h AS (SELECT query_id, doc_id, rank, score, source, CASE WHEN doc_id % 2 = 0 THEN 'https://github.com/o/r/blob/main/pkg/' || doc_id || '.py#L1' WHEN doc_id % 3 = 0 THEN 'https://docs.example/' || doc_id || '#top' ELSE ' ' END AS url FROM body JOIN documents USING (doc_id) WHERE rank <= 5)
"""


@query(_HITS + "SELECT query_id, rank, doc_id AS id, source AS title, CASE WHEN trim(url) <> '' THEN url ELSE CAST(doc_id AS VARCHAR) END AS citation, score, CASE WHEN doc_id % 2 = 0 THEN 'pkg/' || doc_id || '.py' WHEN trim(url) <> '' THEN regexp_replace(url, '#.*$', '') ELSE CAST(doc_id AS VARCHAR) END AS group_key FROM h")
def hit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    url = F.when(key % 2 == 0, F.concat(F.lit("https://github.com/o/r/blob/main/pkg/"), key.cast("string"), F.lit(".py#L1"))).when(key % 3 == 0, F.concat(F.lit("https://docs.example/"), key.cast("string"), F.lit("#top"))).otherwise(" ")
    hits = search._body_hits(spark, sf_dir, 5).join(load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title")), "doc_id")
    hits = hits.select("query_id", "rank", key.alias("id"), "title", url.alias("url"), F.lit("").alias("repo_path"), F.lit("").alias("path"), "score")
    keys = hits.select(F.col("query_id").alias("_q"), F.col("rank").alias("_r"), rows.group_key(F.col("repo_path"), F.col("url"), F.col("id"), "page").alias("group_key"))
    made = rows.hit_summary(hits)
    return made.join(keys, (made["query_id"] == keys["_q"]) & (made["rank"] == keys["_r"])).drop("_q", "_r")


@query("""
WITH b AS (SELECT label || '-' || vec_id // 500 AS name, row_number() OVER (PARTITION BY label, vec_id // 500 ORDER BY vec_id) - 1 AS nth, embedding FROM embeddings)
SELECT name, CAST(nth AS INTEGER) AS nth, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM b""")
def vector_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of each label and run of 500 ids flattened into a bank and taken apart again."""
    name = F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("vec_id") / 500).cast("string")).alias("name")
    some = load(spark, sf_dir, "embeddings").select(name, "vec_id", rows.as_float32(F.col("embedding")).alias("embedding"))
    made = rows.bank_vectors(rows.flat_bank(some, "name", "vec_id", "embedding"), "name", 64)
    return made.select("name", "nth", F.round(F.aggregate("vector", F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.round(F.col("vector")[0], 6).alias("first"))


@query(search._BODY + """, g AS (SELECT doc_id, 'n' || doc_id % 3 AS namespace, source AS url, 'g' || doc_id % 5 AS "group" FROM documents), h AS (SELECT query_id, rank, namespace, url FROM body JOIN g USING (doc_id)), k AS (SELECT DISTINCT namespace, url, "group" FROM g)
SELECT query_id, "group", min(rank) AS rank FROM h JOIN k USING (namespace, url) GROUP BY ALL""")
def judged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    part = lambda p, n: F.concat(F.lit(p), (key % n).cast("string"))
    known = load(spark, sf_dir, "documents").select("doc_id", part("n", 3).alias("namespace"), F.col("source").alias("url"), part("g", 5).alias("group"))
    hits = search._body_hits(spark, sf_dir).join(known, "doc_id").select("query_id", "rank", "namespace", "url")
    return rows.judged_groups(hits, known)


@query("SELECT * FROM (" + search.ORACLE["hybrid_routes"].replace("SELECT query_id, CASE WHEN named <= 3 THEN namespace END AS namespace", "SELECT query_id, CASE WHEN named <= 3 THEN namespace END AS namespace", 1).join(["WITH routes AS (", "), "]) + search._BODY.replace("WITH ", "", 1) + """,
hits AS (SELECT query_id, 'label-' || doc_id % 10 AS namespace, doc_id AS key, score AS local_score, (n_chars % 997) / 997.0::DOUBLE AS cross_score FROM body JOIN documents USING (doc_id)),
met AS (SELECT hits.*, route_rank, fanout FROM hits JOIN routes USING (query_id, namespace)),
c AS (SELECT 'narrow' AS side, * FROM met WHERE route_rank <= fanout UNION ALL SELECT 'wide', * FROM met),
lr AS (SELECT *, row_number() OVER (PARTITION BY side, query_id, namespace ORDER BY local_score DESC, key) AS local_rank FROM c QUALIFY local_rank <= 8),
cr AS (SELECT *, row_number() OVER (PARTITION BY side, query_id ORDER BY cross_score DESC, local_rank, namespace, key) AS cross_rank FROM lr),
fu AS (SELECT *, round(1.0::DOUBLE / (60 + local_rank) + 1.0::DOUBLE / (60 + cross_rank), 12) AS score FROM cr),
rk AS (SELECT *, row_number() OVER (PARTITION BY side, query_id ORDER BY score DESC, cross_rank, local_rank, namespace, key) AS rank FROM fu QUALIFY rank <= 5),
ob AS (SELECT query_id, max(cross_score) AS top FROM rk WHERE side = 'narrow' GROUP BY query_id),
weak AS (SELECT DISTINCT query_id FROM routes LEFT JOIN ob USING (query_id) WHERE top IS NULL OR top < 0.6::DOUBLE)
SELECT query_id, namespace, key, local_rank, cross_rank, score, rank, side = 'wide' AS widened FROM rk WHERE (side = 'wide') = (query_id IN (SELECT query_id FROM weak)))""")
def routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked of the labels that hybrid_routes sends them to; documents are dealt to labels by their id."""
    chars = load(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 997) / F.lit(997.0)).alias("cross_score"))
    hits = search._body_hits(spark, sf_dir).join(chars, "doc_id")
    hits = hits.select("query_id", F.concat(F.lit("label-"), (F.col("doc_id") % 10).cast("string")).alias("namespace"), F.col("doc_id").alias("key"), F.col("score").alias("local_score"), "cross_score")
    return search_ops.routed_search(search.hybrid_routes(spark, sf_dir), hits, 0.6)


@query("""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'broken' WHEN doc_id % 17 = 0 THEN '{"id": "' || doc_id % 500 || '", "question": "q", "extra": 1}' WHEN doc_id % 13 = 0 THEN '{"id": "' || doc_id % 500 || '"}' ELSE '{"id": "' || doc_id % 500 || '", "question": "q"}' END AS t FROM documents),
i AS (SELECT doc_id % 500 AS id FROM c WHERE t <> 'broken' GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, 'no object' AS problem FROM c WHERE t = 'broken' UNION ALL SELECT doc_id, 'unknown: extra' FROM c WHERE t LIKE '%extra%' UNION ALL SELECT doc_id, 'missing: question' FROM c WHERE t NOT LIKE '%question%' AND t <> 'broken'
UNION ALL SELECT doc_id, 'repeated id: ' || doc_id % 500 FROM c WHERE t <> 'broken' AND doc_id % 500 IN (SELECT id FROM i)""")
def case_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids as JSON cases, some spoilt by rule, and what strict reading says of them."""
    key = F.col("doc_id")
    head = F.concat(F.lit('{"id": "'), (key % 500).cast("string"), F.lit('"'))
    text = F.when(key % 19 == 0, "broken").when(key % 17 == 0, F.concat(head, F.lit(', "question": "q", "extra": 1}'))).when(key % 13 == 0, F.concat(head, F.lit("}"))).otherwise(F.concat(head, F.lit(', "question": "q"}')))
    made = artifacts.unique(artifacts.checked(load(spark, sf_dir, "documents").select("doc_id", text.alias("element")), artifacts.EVAL_CASE, ["id", "question"]), "id")
    return made.select("doc_id", F.explode("problems").alias("problem"))
