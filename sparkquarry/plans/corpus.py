"""Queries over documents and pages: scans, text and URL functions, chunks, manifests and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.functions import ranking, repo
from sparkquarry.functions import text as tx
from sparkquarry.functions import urls
from sparkquarry.operators import chunking, index, manifest, pages, prototypes
from sparkquarry.sources import relation, sinks

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


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, text AS content, CASE WHEN trim(coalesce(source, '')) = '' THEN CAST(doc_id AS VARCHAR) ELSE source END AS title FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> ''".replace("\\\\", "\\"))
def scan_documents(spark, sf_dir):
    return relation.scan(load(spark, sf_dir, "documents"), "DOC_ID", "Text", "source")


@query("SELECT count(*) AS rows_discovered, count(*) FILTER (doc_id IS NULL) AS null_ids, CAST(0 AS BIGINT) AS blank_ids, count(*) FILTER (trim(coalesce(text, '')) = '') AS skipped_empty, greatest(count(*) - count(*) FILTER (trim(coalesce(text, '')) = '') - 500, 0) AS skipped_limit FROM documents")
def scan_summary(spark, sf_dir):
    return relation.scan_summary(load(spark, sf_dir, "documents"), "doc_id", "text", max_documents=500)


@query("SELECT CAST(user_id AS VARCHAR) AS document_id, count(*) AS copies FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_source_ids(spark, sf_dir):
    return relation.duplicate_ids(load(spark, sf_dir, "events"), "user_id")


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*|[^\s]')) AS INTEGER) AS tokens,
  sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS comparable_sha,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '\.md$', ''), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  sha256(trim(regexp_replace(regexp_replace(text, '[*_`~]', '', 'g'), '\s+', ' ', 'g'))) AS plain_sha
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def text_functions(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("text", tx.text_or_empty(F.col("text")))
    body = F.col("text")
    plain = tx.collapse_spaces(F.regexp_replace(body, "[*_`~]", ""))
    return docs.select("doc_id", tx.token_count(body).alias("tokens"), tx.sha256(tx.comparable(body)).alias("comparable_sha"), tx.slug(F.split(body, "\n")[0]).alias("slug"), tx.sha256(plain).alias("plain_sha"))


@query(r"""
SELECT doc_id, CAST(len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS INTEGER) AS terms,
  sha256('Title: ' || source || chr(10) || chr(10) || text) AS embedding_text_hash
FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)""")
def term_counts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("text", tx.text_or_empty(F.col("text")))
    joined = tx.embedding_text(F.col("source"), F.lit(""), F.col("text"))
    return docs.select("doc_id", F.size(tx.lexical_tokens(F.col("text"))).alias("terms"), manifest.embedding_hash(joined, F.lit("float32")).alias("embedding_text_hash"))


_URL = r"""
SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS base,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS raw_path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query FROM pages"""
_PATHS = f"""
WITH u AS ({_URL}),
p AS (SELECT *, CASE WHEN starts_with(raw_path, '/') THEN raw_path ELSE '/' || raw_path END AS slashed, list_filter(string_split(raw_path, '/'), lambda x: x <> '') AS parts FROM u),
n AS (SELECT *, CASE WHEN length(slashed) > 1 THEN regexp_replace(slashed, '/+$', '') ELSE slashed END AS path,
  CASE WHEN regexp_matches(replace(lower(coalesce(parts[1], '')), '_', '-'), '^[a-z]{{2}}(-[a-z]{{2}}|-[a-z]{{4}}|-[0-9]{{3}})?$')
       AND substr(lower(parts[1]), 1, 2) IN ({", ".join(f"'{c}'" for c in urls.LANGUAGE_CODES)}) THEN replace(lower(parts[1]), '_', '-') END AS prefix FROM p),
t AS (SELECT *, base || path || query AS canonical_url, '/' || array_to_string(CASE WHEN prefix IS NOT NULL THEN parts[2:] ELSE parts END, '/') AS tail FROM n)
"""


@query(_PATHS + "SELECT page_id, host, path, canonical_url, prefix AS language, tail, len(parts) AS depth FROM t")
def page_urls(spark, sf_dir):
    url = F.col("url")
    return load(spark, sf_dir, "pages").select(
        "page_id", urls.host(url).alias("host"), urls.normal_path(urls.path(url)).alias("path"), urls.canonical(url).alias("canonical_url"), urls.language_prefix(url).alias("language"), urls.tail_path(url).alias("tail"), F.size(urls.segments(url)).cast("long").alias("depth")
    )


@query(_PATHS + "SELECT min(page_id) AS page_id, canonical_url FROM t GROUP BY canonical_url")
def unique_pages(spark, sf_dir):
    return pages.merge_unique(load(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "canonical_url")


@query(_PATHS + "SELECT page_id, path FROM t WHERE (starts_with(path, '/en/') OR path = '/en' OR regexp_matches(path, '^/de/.*$')) AND NOT regexp_matches(path, '^.*\\.html$')".replace("\\\\", "\\"))
def path_filter(spark, sf_dir):
    path = urls.normal_path(urls.path(F.col("url")))
    return load(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(urls.allowed(F.col("path"), ["/en/**", "/de/*"], ["*.html"]))


@query(_PATHS + """, e AS (SELECT DISTINCT tail FROM t WHERE prefix IS NULL OR prefix LIKE 'en%'),
d AS (SELECT coalesce(prefix, '') AS prefix, tail, count(*) AS n FROM t GROUP BY ALL)
SELECT prefix, CAST(sum(n) AS BIGINT) AS urls, count(*) FILTER (tail IN (SELECT tail FROM e)) AS tail_overlap FROM d GROUP BY prefix""")
def page_locales(spark, sf_dir):
    return pages.locales(load(spark, sf_dir, "pages"))


@query(_PATHS + """, e AS (SELECT DISTINCT tail FROM t WHERE prefix IS NULL OR prefix LIKE 'en%'),
d AS (SELECT coalesce(prefix, '') AS prefix, tail, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT prefix, CAST(sum(n) AS BIGINT) AS urls, count(*) FILTER (tail IN (SELECT tail FROM e)) AS overlap FROM d GROUP BY prefix),
r AS (SELECT count(*) FILTER (prefix <> '' AND prefix NOT LIKE 'en%') AS foreign_locales, CAST(coalesce(sum(urls) FILTER (prefix <> '' AND prefix NOT LIKE 'en%'), 0) AS BIGINT) AS foreign_urls,
  CAST(coalesce(sum(urls) FILTER (prefix = ''), 0) AS BIGINT) AS unprefixed_urls, count(*) FILTER (prefix LIKE 'en%') AS english_locales, coalesce(max(overlap) FILTER (prefix <> '' AND prefix NOT LIKE 'en%'), 0) AS o FROM g)
SELECT foreign_locales, foreign_urls, unprefixed_urls, english_locales,
  foreign_locales > 0 AND (english_locales > 0 OR unprefixed_urls >= 10) AND foreign_urls >= 20 AND (foreign_locales >= 2 OR o >= 5) AS detected FROM r""")
def page_locale_report(spark, sf_dir):
    return pages.locale_report(load(spark, sf_dir, "pages"))


@query("""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title
FROM pages WHERE regexp_matches(html, '(?is)<title[^>]*>[^<]*[^<\\s][^<]*</title>')""".replace("\\\\", "\\"))
def page_titles(spark, sf_dir):
    html = F.col("html")
    titled = load(spark, sf_dir, "pages").where(html.rlike(r"(?is)<title[^>]*>[^<]*[^<\s][^<]*</title>"))
    return titled.select("page_id", pages.html_title(html, F.col("url")).alias("title"))


_BLOCKS = "p|div|h[1-6]|li|ul|ol|tr|table|section|article|br|pre|blockquote"


@query(rf"""
WITH x AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<noscript\b.*?</noscript>|<head\b.*?</head>|<!--.*?-->', ' ', 'g'), '(?i)</?({_BLOCKS})\b[^>]*>', chr(10), 'g') AS t FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM x)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM u""")
def page_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", pages.html_text(F.col("html")).alias("text"))


@query(_PATHS + """, s AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, parts FROM t)
SELECT page_id, array_to_string(parts[i:], '/') AS suffix FROM s""")
def path_suffixes(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.explode(urls.suffixes(urls.path(F.col("url")))).alias("suffix"))


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(relation.dealt(load(spark, sf_dir, "documents")))


@query("SELECT doc_id FROM documents WHERE false")
def lost_words(spark, sf_dir):
    """Documents of which chunks lose a word or a number: none."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^#{1,6}\s", "").alias("text"))
    return chunking.lost_words(docs, chunking.chunk_documents(docs))


@query("""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), s AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1, 80)) AS first_line FROM l)
SELECT doc_id, first_line, least(first_line + 79, len(lines)) AS last_line, sha256(array_to_string(lines[first_line:first_line + 79], chr(10))) AS content_sha FROM s""")
def line_ranges(spark, sf_dir):
    made = chunking.line_ranges(load(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("doc_id", "first_line", "last_line", tx.sha256(F.col("content")).alias("content_sha"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a chunk of it: url, section (its source), hash."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("section_path"), F.concat(F.lit("corpus://documents/"), F.col("doc_id").cast("string")).alias("canonical_url"), tx.text_or_empty(F.col("text")).alias("text"))
    return docs.select("canonical_url", "section_path", tx.sha256(F.col("text")).alias("page_hash"), F.posexplode(F.split("text", "\n")).alias("line", "content")).withColumn("chunk_hash", tx.sha256(F.col("content")))


_CHUNKS = """
WITH d AS (SELECT 'corpus://documents/' || doc_id AS canonical_url, coalesce(source, '') AS section_path, sha256(coalesce(text, '')) AS page_hash, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT canonical_url, section_path, page_hash, unnest(lines) AS content, generate_subscripts(lines, 1) - 1 AS line FROM d),
c AS (SELECT *, sha256(content) AS chunk_hash FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY canonical_url, section_path, chunk_hash ORDER BY line) - 1 AS duplicate_ordinal FROM c)
"""


@query(_CHUNKS + """
SELECT canonical_url, CAST(line AS INTEGER) AS line, duplicate_ordinal, 'ts_' || substr(sha256('documents' || chr(10) || canonical_url || chr(10) || section_path || chr(10) || chunk_hash
  || CASE WHEN duplicate_ordinal > 0 THEN chr(10) || 'duplicate' || chr(10) || duplicate_ordinal ELSE '' END), 1, 32) AS row_id FROM o""")
def chunk_manifest(spark, sf_dir):
    return manifest.with_row_ids(_chunks(spark, sf_dir), "documents", ["line"]).select("canonical_url", "line", "duplicate_ordinal", "row_id")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A desired manifest of documents, and a ledger derived from them: some absent, changed, retained, deleted, and rows of former documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", tx.text_or_empty(F.col("text")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    url = F.concat(F.lit("corpus://"), F.col("source"))
    row = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    wanted = docs.where("doc_id % 13 <> 0").select(row.alias("row_id"), url.alias("canonical_url"), tx.sha256(F.concat("source", F.lit("-v2"))).alias("page_hash"), tx.sha256(F.col("text")).alias("embedding_text_hash"))
    status = F.when(F.col("doc_id") % 11 == 0, "retained_stale").when(F.col("doc_id") % 17 == 0, "deleted").otherwise("active")
    old = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    page = tx.sha256(F.concat("source", F.when(F.col("doc_id") % 2 == 0, F.lit("-v1")).otherwise(F.lit("-v2"))))
    ledger = docs.where("doc_id % 7 <> 0 AND source <> 'src3'").select(row.alias("row_id"), url.alias("canonical_url"), page.alias("page_hash"), tx.sha256(old).alias("embedding_text_hash"), F.lit("plan-1").alias("plan_id"), status.alias("status"))
    return wanted, ledger


_SIDES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
m AS (SELECT 'doc-' || doc_id AS row_id, 'corpus://' || source AS canonical_url, sha256(source || '-v2') AS page_hash, sha256(text) AS embedding_text_hash FROM d WHERE doc_id % 13 <> 0),
l AS (SELECT 'doc-' || doc_id AS row_id, 'corpus://' || source AS canonical_url, sha256(source || CASE WHEN doc_id % 2 = 0 THEN '-v1' ELSE '-v2' END) AS page_hash,
  sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' old' ELSE text END) AS embedding_text_hash, 'plan-1' AS plan_id,
  CASE WHEN doc_id % 11 = 0 THEN 'retained_stale' WHEN doc_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status FROM d WHERE doc_id % 7 <> 0 AND source <> 'src3'),
s AS (SELECT * FROM l WHERE status <> 'deleted'),
x AS (SELECT coalesce(m.row_id, s.row_id) AS row_id, coalesce(m.canonical_url, s.canonical_url) AS canonical_url, s.status AS previous_status,
  CASE WHEN m.row_id IS NULL THEN CASE WHEN s.status = 'active' THEN 'stale' ELSE 'retained_stale' END
       WHEN s.status = 'active' AND s.embedding_text_hash = m.embedding_text_hash THEN 'unchanged' WHEN s.status = 'active' THEN 'changed' WHEN s.status = 'retained_stale' THEN 'reactivate_retained_stale'
       WHEN m.canonical_url IN (SELECT canonical_url FROM s WHERE status = 'active') THEN 'changed' ELSE 'new' END AS action
  FROM m FULL OUTER JOIN s ON m.row_id = s.row_id)
"""


@query(_SIDES + "SELECT row_id, canonical_url, action, previous_status FROM x")
def manifest_diff(spark, sf_dir):
    return manifest.diff(*_sides(spark, sf_dir))


@query(_SIDES + """
SELECT count(*) FILTER (action = 'unchanged') AS chunks_unchanged, count(*) FILTER (action IN ('new', 'changed', 'reactivate_retained_stale')) AS rows_to_upsert, count(*) FILTER (action = 'new') AS rows_new,
  count(*) FILTER (action = 'changed') AS rows_changed, count(*) FILTER (action = 'reactivate_retained_stale') AS rows_reactivated, count(*) FILTER (action = 'stale') AS stale_rows,
  count(*) FILTER (action = 'retained_stale') AS retained_stale_rows FROM x""")
def manifest_diff_summary(spark, sf_dir):
    return manifest.diff_summary(manifest.diff(*_sides(spark, sf_dir)))


@query(_SIDES + """, p AS (SELECT DISTINCT canonical_url, page_hash FROM m), h AS (SELECT canonical_url, list(DISTINCT page_hash) AS hashes FROM l WHERE status = 'active' GROUP BY 1),
b AS (SELECT p.page_hash, h.hashes FROM p FULL OUTER JOIN h USING (canonical_url))
SELECT count(*) FILTER (page_hash IS NOT NULL AND hashes IS NULL) AS pages_added, count(*) FILTER (page_hash IS NOT NULL AND hashes IS NOT NULL AND NOT list_contains(hashes, page_hash)) AS pages_changed,
  count(*) FILTER (list_contains(hashes, page_hash)) AS pages_unchanged, count(*) FILTER (page_hash IS NULL) AS pages_removed FROM b""")
def page_diff_counts(spark, sf_dir):
    return manifest.page_counts(*_sides(spark, sf_dir))


@query(_SIDES + """
SELECT coalesce(m.row_id, s.row_id) AS row_id, CASE WHEN k THEN s.canonical_url ELSE coalesce(m.canonical_url, s.canonical_url) END AS canonical_url, CASE WHEN k OR m.row_id IS NULL THEN s.page_hash ELSE m.page_hash END AS page_hash,
  coalesce(m.embedding_text_hash, s.embedding_text_hash) AS embedding_text_hash, CASE WHEN k OR m.row_id IS NULL THEN s.plan_id ELSE 'plan-2' END AS plan_id, CASE WHEN m.row_id IS NULL THEN 'retained_stale' ELSE 'active' END AS status
FROM (SELECT *, false AS dummy FROM m) m FULL OUTER JOIN s ON m.row_id = s.row_id
CROSS JOIN LATERAL (SELECT coalesce(s.status = 'active' AND m.embedding_text_hash = s.embedding_text_hash, false) AS k)""")
def next_ledger(spark, sf_dir):
    return manifest.next_ledger(*_sides(spark, sf_dir), "plan-2")


@query(_SIDES + "SELECT DISTINCT s.row_id FROM s WHERE s.row_id NOT IN (SELECT row_id FROM m)")
def stale_row_ids(spark, sf_dir):
    wanted, ledger = _sides(spark, sf_dir)
    return manifest.diff(wanted, ledger).where(F.col("action").isin("stale", "retained_stale")).select("row_id").distinct()


@query(_SIDES + ", u AS (SELECT row_id FROM x WHERE action IN ('new', 'changed', 'reactivate_retained_stale')), g AS (SELECT row_id FROM x WHERE action IN ('stale', 'retained_stale')) SELECT count(*) AS upserts, count(*) FILTER (row_id IN (SELECT row_id FROM g)) AS overlap FROM u")
def delta_disjoint(spark, sf_dir):
    changes = manifest.diff(*_sides(spark, sf_dir))
    upserts = changes.where(F.col("action").isin("new", "changed", "reactivate_retained_stale")).select("row_id")
    stale = changes.where(F.col("action").isin("stale", "retained_stale")).select("row_id", F.lit(1).alias("stale"))
    return upserts.join(stale, "row_id", "left").agg(F.count("*").alias("upserts"), F.count("stale").alias("overlap"))


@query(_SIDES + """, b AS (SELECT nullif(row_id, 'doc-1') AS row_id, CASE WHEN status = 'deleted' THEN 'none' ELSE page_hash END AS page_hash, CASE WHEN status = 'retained_stale' THEN 'gone' ELSE status END AS status FROM l)
SELECT rule, count(*) AS rows FROM (SELECT 'row_id missing' AS rule FROM b WHERE row_id IS NULL UNION ALL SELECT 'page_hash malformed' FROM b WHERE page_hash = 'none' UNION ALL SELECT 'status unknown' FROM b WHERE status = 'gone') GROUP BY rule""")
def ledger_violations(spark, sf_dir):
    """The rules broken by a ledger that was spoilt on purpose."""
    ledger = _sides(spark, sf_dir)[1]
    status = F.col("status")
    spoilt = ledger.withColumn("row_id", F.nullif("row_id", F.lit("doc-1"))).withColumn("page_hash", F.when(status == "deleted", "none").otherwise(F.col("page_hash")))
    return manifest.ledger_violations(spoilt.withColumn("status", F.when(status == "retained_stale", "gone").otherwise(status)))


_LANES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(_SIDES + f""", j AS (SELECT sha256('{{"canonical_url":"' || canonical_url || '","embedding_text_hash":"' || embedding_text_hash || '","page_hash":"' || page_hash || '","plan_id":"' || plan_id || '","row_id":"' || row_id || '","status":"' || status || '"}}') AS h FROM l)
SELECT count(*) AS rows, sha256(concat_ws(',', {_LANES})) AS content_hash FROM j""")
def ledger_hash(spark, sf_dir):
    return manifest.table_hash(_sides(spark, sf_dir)[1], "row_id")


@query("""
WITH b AS (SELECT conv_id, turn // 64 AS block, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY ALL)
SELECT conv_id, CAST(sum(turns) AS BIGINT) AS turns, md5(string_agg(h, chr(10) ORDER BY block)) AS body_md5 FROM b GROUP BY conv_id""")
def ordered_assembly(spark, sf_dir):
    """Transcripts in blocks of 64 turns: only the hash of a block meets those of its conversation's other blocks."""
    line = F.concat("role", F.lit(": "), "text")
    blocks = load(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 64).alias("block")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    hashed = blocks.select("conv_id", "block", "n", F.md5(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("h"))
    whole = hashed.groupBy("conv_id").agg(F.sum("n").alias("turns"), F.array_sort(F.collect_list(F.struct("block", "h"))).alias("blocks"))
    return whole.select("conv_id", "turns", F.md5(F.array_join(F.transform("blocks", lambda x: x["h"]), "\n")).alias("body_md5"))


@query(_PATHS + """, r AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'build/' WHEN 4 THEN 'examples/' ELSE 'pkg/fixtures/' END || trim(path, '/') || CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' WHEN 2 THEN '.md' ELSE '' END AS p FROM t)
SELECT page_id, CASE WHEN regexp_matches(p, '^(pkg)/fixtures/') THEN 'fixture' WHEN starts_with(p, 'tests/') THEN 'tests' WHEN starts_with(p, 'docs/') THEN 'docs' WHEN starts_with(p, 'examples/') THEN 'example'
    WHEN starts_with(p, 'src/') OR regexp_matches(p, '\\.(py|js)$') THEN 'source' ELSE 'other' END AS role,
  CASE WHEN starts_with(p, 'build/') OR regexp_matches(p, '\\.min\\.js$') THEN 'default' ELSE 'none' END AS skip_reason,
  CASE WHEN p LIKE '%.py' THEN 'python' WHEN p LIKE '%.js' THEN 'javascript' WHEN p LIKE '%.md' THEN 'markdown' WHEN p LIKE '%.html' THEN 'html' ELSE 'text' END AS language FROM r""")
def repository_paths(spark, sf_dir):
    """Page paths put under repository folders."""
    n, path = F.col("page_id"), F.regexp_replace(urls.normal_path(urls.path(F.col("url"))), "^/+|/+$", "")
    folder = F.element_at(F.array(*map(F.lit, ("src/", "tests/", "docs/", "build/", "examples/", "pkg/fixtures/"))), (n % 6 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".py", ".min.js", ".md", ""))), (n % 4 + 1).cast("int"))
    paths = load(spark, sf_dir, "pages").select("page_id", F.concat(folder, path, ending).alias("p"))
    return paths.select("page_id", repo.role(F.col("p")).alias("role"), F.coalesce(repo.skip_reason(F.col("p")), F.lit("none")).alias("skip_reason"), repo.language(F.col("p")).alias("language"))


_NAMES = ["v1.2", "v1.10", "latest", "intro", "nightly", "2.0.1"]
_VERSIONED = r"""
WITH p AS (SELECT page_id, 'https://docs.example/' || CASE page_id % 4 WHEN 0 THEN 'api/' WHEN 1 THEN 'guide/' WHEN 2 THEN '' ELSE 'blog/' END || ['v1.2', 'v1.10', 'latest', 'intro', 'nightly', '2.0.1'][page_id // 4 % 6 + 1] || '/p' || page_id AS url FROM pages),
s AS (SELECT page_id, url, split_part(url, '/', 4) AS root, split_part(url, '/', 5) AS version FROM p WHERE page_id % 4 <> 2),
k AS (SELECT *, CASE WHEN version IN ('latest', 'current', 'stable') THEN 'current' WHEN version IN ('nightly', 'main', 'master', 'dev', 'snapshot') THEN 'preview' WHEN regexp_matches(version, '^v?[0-9]+(\.[0-9]+){1,3}([-+].*)?$') THEN 'semver' END AS kind FROM s),
v AS (SELECT '/' || root AS root_path, version, kind, count(*) AS urls FROM k WHERE kind IS NOT NULL GROUP BY ALL)
"""


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put under roots and versions by their number."""
    page = F.col("page_id")
    root = F.element_at(F.array(*map(F.lit, ("api/", "guide/", "", "blog/"))), (page % 4 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.floor(page / 4) % len(_NAMES) + 1).cast("int"))
    return load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://docs.example/"), root, name, F.lit("/p"), page.cast("string")).alias("url"))


@query(_VERSIONED + "SELECT root_path, version, kind, urls FROM v")
def page_versions(spark, sf_dir):
    return pages.versions(_versioned(spark, sf_dir))


@query(_VERSIONED + """, best AS (SELECT root_path, coalesce(arg_max(version, list_transform(string_split(regexp_extract(version, '[0-9.]+'), '.'), lambda x: TRY_CAST(x AS INTEGER))) FILTER (kind = 'semver'), min(version) FILTER (kind = 'current'), min(version) FILTER (kind = 'preview')) AS version, count(*) AS n FROM v GROUP BY root_path)
SELECT page_id, url FROM p WHERE page_id NOT IN (SELECT page_id FROM k JOIN best ON root_path = '/' || root WHERE kind IS NOT NULL AND n > 1 AND k.version <> best.version)""")
def stable_pages(spark, sf_dir):
    """Pages of the latest numbered version of each root, and all that have no version."""
    return pages.apply_version_policy(_versioned(spark, sf_dir), "stable-latest")


@query(ORACLE["page_locale_report"].replace("SELECT foreign_locales, foreign_urls, unprefixed_urls, english_locales,\n  ", "SELECT page_id FROM t CROSS JOIN (SELECT ").replace(" AS detected FROM r", " AS detected FROM r) WHERE NOT (detected AND prefix IS NOT NULL AND prefix NOT LIKE 'en%')"))
def english_pages(spark, sf_dir):
    return pages.apply_language_policy(load(spark, sf_dir, "pages"), "english").select("page_id")


@query("""
WITH d AS (SELECT CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN ' ' ELSE CAST(doc_id % 1000 AS VARCHAR) END AS document_id, CASE WHEN doc_id % 29 = 0 THEN ' ' ELSE text END AS content FROM documents)
SELECT rule, count(*) AS rows FROM (SELECT 'id missing' AS rule FROM d WHERE document_id IS NULL UNION ALL SELECT 'id blank' FROM d WHERE trim(document_id) = '' UNION ALL SELECT 'content blank' FROM d WHERE NOT regexp_matches(coalesce(content, ''), '[^\\s]')
  UNION ALL SELECT 'id repeated' FROM d WHERE document_id IS NOT NULL GROUP BY document_id HAVING count(*) > 1) GROUP BY rule""")
def invalid_rows(spark, sf_dir):
    """Documents with some ids and texts spoilt by rule."""
    key = F.col("doc_id")
    name = F.when(key % 31 != 0, F.when(key % 37 == 0, " ").otherwise((key % 1000).cast("string")))
    return index.invalid_rows(load(spark, sf_dir, "documents").select(name.alias("document_id"), F.when(key % 29 == 0, " ").otherwise(F.col("text")).alias("content")))


@query("SELECT 'document-' || substr(sha256(url), 1, 24) || '.md' AS file, sha256('---' || chr(10) || 'title: ' || to_json(left(html, 40)) || chr(10) || 'url: ' || to_json(url) || chr(10) || '---' || chr(10) || chr(10) || html || chr(10)) AS raw_sha FROM pages")
def markdown_files(spark, sf_dir):
    rows = sinks.as_markdown(load(spark, sf_dir, "pages").select("url", F.left("html", F.lit(40)).alias("title"), F.col("html").alias("content")))
    return rows.select("file", tx.sha256(F.col("raw")).alias("raw_sha"))


@query("""
WITH e AS (SELECT 'c-' || c_custkey AS namespace, c_mktsegment AS title, c_nationkey % 2 = 0 AS enabled, CASE WHEN c_custkey % 3 = 0 THEN 'manual' ELSE 'generated' END AS semantic_origin FROM customer WHERE c_custkey % 5 <> 0),
i AS (SELECT 'c-' || c_custkey AS namespace, 'Customer ' || c_custkey AS title, true AS enabled, 'generated' AS semantic_origin FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(e.namespace, i.namespace) AS namespace, CASE WHEN i.namespace IS NULL OR e.semantic_origin = 'manual' THEN e.title ELSE i.title END AS title, CASE WHEN e.namespace IS NOT NULL THEN e.enabled ELSE i.enabled END AS enabled,
  CASE WHEN i.namespace IS NULL OR e.semantic_origin = 'manual' THEN e.semantic_origin ELSE i.semantic_origin END AS semantic_origin FROM e FULL OUTER JOIN i ON e.namespace = i.namespace""")
def merged_cards(spark, sf_dir):
    rows, key = load(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("c-"), key.cast("string")).alias("namespace")
    existing = rows.where(key % 5 != 0).select(name, F.col("c_mktsegment").alias("title"), (F.col("c_nationkey") % 2 == 0).alias("enabled"), F.when(key % 3 == 0, "manual").otherwise("generated").alias("semantic_origin"))
    incoming = rows.where(key % 7 != 0).select(name, F.concat(F.lit("Customer "), key.cast("string")).alias("title"), F.lit(True).alias("enabled"), F.lit("generated").alias("semantic_origin"))
    return prototypes.merge_cards(existing, incoming, ["title"], ["enabled"])


_PROFILE = r"""
WITH r AS (SELECT page_id, trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS tail FROM pages),
p AS (SELECT page_id, [{folders}][page_id % {n_folders} + 1] || tail || [{endings}][(page_id // {n_folders}) % {n_endings} + 1] AS path, [{asks}][(page_id // 7) % {n_asks} + 1] AS query FROM r),
w AS (SELECT *, lower(path) AS l, list_distinct(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) AS q, list_distinct(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda x: x <> '')) AS pt FROM p),
f AS (SELECT page_id, path, query,
  CASE WHEN regexp_matches('/' || l, '/\.(agents|claude|cursor)/') OR starts_with(l, 'artifacts/') OR starts_with(l, 'autoresearch/') OR (l LIKE '%.json' AND contains(l, '/data/') AND (contains(l, 'eval') OR contains(l, 'fixture') OR contains(l, 'seed') OR contains(l, 'dataset'))) THEN 0.2::DOUBLE
    WHEN (starts_with(l, 'docs_src/') OR starts_with(l, 'examples/') OR contains(l, 'example_scripts/') OR contains(l, '/example/') OR contains(l, '/examples/')) AND NOT list_has_any(q, [{example}]) THEN 0.7::DOUBLE
    WHEN starts_with(l, 'docs/') OR l LIKE '%.md' THEN 0.7::DOUBLE WHEN starts_with(l, 'tests/') THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN starts_with(l, 'doc/') AND NOT list_has_any(q, [{documentation}, {example}]) THEN 0.8::DOUBLE ELSE 1 END
  * CASE WHEN starts_with(l, 'docs/source/') AND NOT list_has_any(q, [{documentation}]) THEN 0.8::DOUBLE ELSE 1 END
  * CASE WHEN starts_with(l, 'docs_src/') AND NOT list_has_any(q, [{example}]) THEN 0.8::DOUBLE ELSE 1 END
  * CASE WHEN contains('/' || l, '/fixtures/') AND NOT list_has_any(q, [{fixture}]) THEN 0.8::DOUBLE ELSE 1 END
  * CASE WHEN list_has_any(pt, [{experiments}]) AND NOT list_has_any(q, [{experiment}]) THEN 0.7::DOUBLE ELSE 1 END
  * CASE WHEN starts_with(l, 'src/') AND list_has_any(q, [{implementation}]) THEN 1.12::DOUBLE ELSE 1 END
  * CASE WHEN ends_with(l, '/__init__.py') AND NOT list_has_any(q, [{public}]) THEN 0.82::DOUBLE ELSE 1 END
  * CASE WHEN l LIKE '%/core.py' AND list_has_any(q, [{runtime}]) THEN 1.2::DOUBLE ELSE 1 END
  * CASE WHEN l LIKE '%/models.py' AND list_has_any(q, [{parameter}]) THEN 1.2::DOUBLE ELSE 1 END
  * CASE WHEN l LIKE '%/utils.py' AND list_has_any(q, [{parameter}]) AND NOT list_has_any(q, [{utility}]) THEN 0.75::DOUBLE ELSE 1 END
  * CASE WHEN l LIKE '%/cli.py' AND NOT list_has_any(q, [{cli}]) THEN 0.9::DOUBLE ELSE 1 END
  * CASE WHEN starts_with(l, 'docs/') AND ((l LIKE '%/core.py' AND list_contains(q, 'core')) OR (l LIKE '%/models.py' AND (list_contains(q, 'models') OR list_contains(q, 'model')))) THEN 1.3::DOUBLE
    WHEN regexp_matches(l, '^(docs|doc|tests|test|examples|example|benchmarks|benchmark)/') OR regexp_matches('/' || l, '/\.(agents|claude|cursor)/|/fixtures/') THEN 1.0::DOUBLE
    WHEN (starts_with(l, 'src/') OR l LIKE '%.py') AND ((l LIKE '%/core.py' AND list_contains(q, 'core')) OR (l LIKE '%/models.py' AND (list_contains(q, 'models') OR list_contains(q, 'model')))) THEN 1.0::DOUBLE + 0.04::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM w)
SELECT page_id, path, query, round(factor, 9) AS factor FROM f"""
_FOLDERS = ["src/", "tests/", "docs/", "docs/source/", "doc/", "examples/", "docs_src/", "pkg/fixtures/", "benchmarks/", ".claude/", "artifacts/", "pkg/data/"]
_ENDINGS = ["/core.py", "/models.py", "/utils.py", "/cli.py", "/__init__.py", ".md", ".json", "/eval.json"]
_ASKS = ["how is the command runtime implemented", "which options and parameters does the model have", "show an example of the tutorial", "where is the documentation", "helper for default fields", "benchmark fixtures of the experiment", "core exports"]


def _sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(_PROFILE.format(
    folders=_sql_list(_FOLDERS), n_folders=len(_FOLDERS), endings=_sql_list(_ENDINGS), n_endings=len(_ENDINGS), asks=_sql_list(_ASKS), n_asks=len(_ASKS), example=_sql_list(ranking.EXAMPLE_INTENT),
    documentation=_sql_list(ranking.DOCUMENTATION_INTENT), fixture=_sql_list(ranking.FIXTURE_INTENT), experiments=_sql_list(ranking.EXPERIMENT_PATHS), experiment=_sql_list(ranking.EXPERIMENT_INTENT),
    implementation=_sql_list(ranking.IMPLEMENTATION_INTENT), public=_sql_list(ranking.PUBLIC_INIT), runtime=_sql_list(ranking.COMMAND_RUNTIME), parameter=_sql_list(ranking.PARAMETER_METADATA),
    utility=_sql_list(ranking.UTILITY_INTENT), cli=_sql_list(ranking.CLI_INTENT),
))
def profile_factors(spark, sf_dir):
    """Page paths put under folders and names that the rules of the code profile speak of, each with a question."""
    tail = F.regexp_replace(urls.path(F.col("url")), "^/+|/+$", "")
    nth = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    page = F.col("page_id")
    rows = load(spark, sf_dir, "pages").select("page_id", F.concat(nth(_FOLDERS, page), tail, nth(_ENDINGS, F.floor(page / len(_FOLDERS)))).alias("path"), nth(_ASKS, F.floor(page / 7)).alias("query"))
    return rows.select("page_id", "path", "query", F.round(ranking.code_profile(F.col("path"), F.lit(""), F.col("query")), 9).alias("factor"))


@query()
def routing_prototypes(spark, sf_dir):
    """Eight diverse passages of every source; a document's lines are its sections."""
    docs = load(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("namespace"), F.col("doc_id").cast("string").alias("url"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    order = F.struct(F.col("url").cast("long").alias("doc"), "line").alias("place")
    return prototypes.select_prototypes(docs.select("namespace", "url", order, prototypes.passage(F.col("namespace"), F.lit(""), F.col("content")).alias("passage")), "place").select("namespace", "ordinal", "url", "passage")
