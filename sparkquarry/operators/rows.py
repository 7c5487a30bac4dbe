"""Rows that go in and out of an index: page records, delta rows and their checks, hits, evidence, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.text import safe_slug, sha256

# Fixed values.
VOLATILE = ["crawl_timestamp"]
STALE_REASONS = {"stale": "absent from the plan", "retained_stale": "kept by an earlier plan"}
UPSERTS, STALES = ["new", "changed", "reactivate_retained_stale"], ["stale", "retained_stale"]
EVIDENCE_HITS = 5


def page_records(pages: DataFrame, volatile: list[str] | None = None) -> DataFrame:
    """pages(canonical_url, title, page_hash, metadata map) without metadata that changes with every crawl."""
    gone = F.array(*map(F.lit, VOLATILE if volatile is None else volatile))
    return pages.select("canonical_url", "title", "page_hash", F.map_filter("metadata", lambda k, _: ~F.array_contains(gone, k)).alias("metadata"))


def delta_rows(diff: DataFrame) -> DataFrame:
    """(row_id, canonical_url, kind, category, reason) of manifest.diff: what is put in or taken out; unchanged rows are neither."""
    reason = F.create_map(*[F.lit(x) for pair in STALE_REASONS.items() for x in pair])
    kind = F.when(F.col("action").isin(UPSERTS), "upsert").when(F.col("action").isin(STALES), "stale")
    return diff.select("row_id", "canonical_url", kind.alias("kind"), F.col("action").alias("category"), F.try_element_at(reason, F.col("action")).alias("reason")).where("kind IS NOT NULL")


def delta_counts(delta: DataFrame) -> DataFrame:
    """(category, rows): what a plan's counts must equal."""
    return delta.groupBy("category").agg(F.count("*").alias("rows"))


def delta_violations(delta: DataFrame, state: DataFrame) -> DataFrame:
    """(row_id, reason) of delta rows(row_id, category) that the ledger state(row_id, status) contradicts, and of rows in both kinds."""
    known = state.select("row_id", F.col("status").alias("_status"))
    met = delta.join(known, "row_id", "left")
    status = F.coalesce("_status", F.lit("absent"))
    wants = {"new": ["absent", "deleted"], "reactivate_retained_stale": ["retained_stale"], "stale": ["active"], "retained_stale": ["retained_stale"], "changed": ["active", "absent", "deleted"]}
    bad = F.lit(False)
    for category, fits in wants.items():
        bad = bad | ((F.col("category") == category) & ~status.isin(fits))
    broken = met.where(bad).select("row_id", F.concat(F.col("category"), F.lit(" but "), status).alias("reason"))
    both = delta.groupBy("row_id").agg(F.count_distinct(F.col("category").isin(UPSERTS)).alias("n")).where("n > 1").select("row_id", F.lit("upsert and stale").alias("reason"))
    return broken.unionByName(both)


def prototype_violations(prototypes: DataFrame, upserts: DataFrame, state: DataFrame) -> DataFrame:
    """(row_id, reason) of prototypes(row_id, content_hash) whose row is neither put in nor active, or has another content hash there."""
    new = upserts.select("row_id", F.col("content_hash").alias("_new"))
    old = state.where("status = 'active'").select("row_id", F.col("content_hash").alias("_old"))
    met = prototypes.join(new, "row_id", "left").join(old, "row_id", "left")
    theirs = F.coalesce("_new", "_old")
    return met.select("row_id", F.when(theirs.isNull(), "no such row").when(theirs != F.col("content_hash"), "another content").alias("reason")).where("reason IS NOT NULL")


def as_hits(rows: DataFrame, attributes: dict[str, str], score: str = "score") -> DataFrame:
    """rows of an index as hits: each attribute of ``attributes`` (name and default), nulls filled, the vector gone."""
    known = set(rows.columns)
    return rows.select("query_id", "id", *[(F.coalesce(F.col(n).cast("string"), F.lit(d)) if n in known else F.lit(d)).alias(n) for n, d in attributes.items()], F.col(score).cast("double").alias("score"))


def citation(hit_url: Column, repo_path: Column, path: Column, key: Column) -> Column:
    """The first of these that isn't blank."""
    some = lambda x: F.nullif(F.trim(F.coalesce(x.cast("string"), F.lit(""))), F.lit(""))
    return F.coalesce(*map(some, (hit_url, repo_path, path, key)), F.lit(""))


def group_key(repo_path: Column, url: Column, key: Column, mode: str) -> Column:
    """What hits are grouped by: a repository's file, in page mode the page, else the chunk itself."""
    some = lambda x: F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit(""))
    hosted = F.nullif(F.regexp_extract(url, r"^https://github\.com/[^/]+/[^/]+/blob/[^/]+/([^#?]+)", 1), F.lit(""))
    page = [F.regexp_replace(some(url), "#.*$", "")] if mode == "page" else []
    return F.coalesce(some(repo_path), hosted, *page, key.cast("string"))


def hit_summary(hits: DataFrame) -> DataFrame:
    """(query_id, rank, id, title, citation, score) of hits(query_id, rank, id, title, url, repo_path, path, score)."""
    return hits.select("query_id", "rank", "id", "title", citation(F.col("url"), F.col("repo_path"), F.col("path"), F.col("id")).alias("citation"), F.round("score", 6).alias("score"))


def page_file(url: Column, title: Column, nth: Column) -> Column:
    """A name that sorts by number: number, slug of the title, 12 digits of the URL's hash."""
    return F.concat(F.lpad(nth.cast("string"), 5, "0"), F.lit("-"), safe_slug(title), F.lit("-"), F.substring(sha256(url), 1, 12), F.lit(".md"))


def observe_evidence(hits: DataFrame) -> DataFrame:
    """(query_id, top, second, gap, candidates) of the cross scores of the first EVIDENCE_HITS hits; null where any of them has no finite score."""
    near = hits.where(F.col("rank") <= EVIDENCE_HITS)
    finite = F.col("cross_score").isNotNull() & ~F.isnan("cross_score") & (F.abs("cross_score") < float("inf"))
    per = near.groupBy("query_id").agg(F.count("*").alias("candidates"), F.bool_and(finite).alias("whole"), F.sort_array(F.collect_list("cross_score"), asc=False).alias("scores"))  # at most EVIDENCE_HITS
    at = lambda i: F.when(F.col("whole"), F.try_element_at("scores", F.lit(i)))
    return per.select("query_id", at(1).alias("top"), at(2).alias("second"), F.round(at(1) - at(2), 9).alias("gap"), "candidates")


def decide_evidence(observed: DataFrame, threshold: float | None, mode: str) -> DataFrame:
    """observed with weak, decision and enforced.

    mode collect: nothing is decided; shadow: decided but not acted on; active: acted on.  Evidence is weak
    without candidates or a whole set of scores, or with the best below the threshold; the threshold itself supports.
    """
    weak = F.col("candidates").isNull() | (F.col("candidates") == 0) | F.col("top").isNull() | (F.col("top") < F.lit(threshold))
    decided = mode in ("shadow", "active") and threshold is not None
    decision = F.when(weak, "insufficient").otherwise("supported") if decided else F.lit("not evaluated")
    return observed.withColumn("weak", weak if decided else F.lit(None).cast("boolean")).withColumn("decision", decision).withColumn("enforced", F.lit(decided and mode == "active"))


def allowed_attributes(attributes: Column, allowed: list[str], limit: int = 256) -> Column:
    """The named keys of a map of texts, values cut to limit characters; null values and other keys go."""
    kept = F.map_filter(attributes, lambda k, v: k.isin(allowed) & v.isNotNull())
    return F.transform_values(kept, lambda _, v: F.substring(v, 1, limit))


def timestamp_of_nanos(x: Column) -> Column:
    """Nanoseconds since 1970 as a timestamp, cut to microseconds."""
    return F.timestamp_micros(F.floor(x / 1000).cast("long"))


def as_float32(vector: Column) -> Column:
    """Numbers as single precision stores them, in double precision."""
    return F.transform(vector, lambda x: x.cast("float").cast("double"))


def flat_bank(vectors: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, n, bank): each key's vectors in order, one after another in one array; a bank is a few vectors of a card."""
    per = vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(vector).alias("v")))).alias("vs"))
    return per.select(key, F.size("vs").alias("n"), F.flatten(F.transform("vs", lambda s: s["v"])).alias("bank"))


def bank_vectors(banks: DataFrame, key: str, size: int) -> DataFrame:
    """(key, nth, vector) of banks(key, n, bank); a bank whose length isn't n times size has none."""
    whole = banks.where((F.size("bank") == F.col("n") * size) & (F.col("n") > 0))
    return whole.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice("bank", i * size + 1, F.lit(size)))).alias("nth", "vector"))


def stable_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names, nulls kept."""
    return sha256(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def uncovered_namespaces(status: DataFrame) -> DataFrame:
    """Namespaces of classify_catalog(namespace, status) that automatic routing can't reach: missing or incompatible ones."""
    return status.where(F.col("status").isin("missing", "incompatible")).select("namespace", "status")


def judged_groups(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, group, rank): the groups of groups(namespace, url, group) that each query's hits(query_id, namespace, url, rank) meet, at their best rank."""
    met = hits.join(groups.select("namespace", "url", "group").distinct(), ["namespace", "url"])
    return met.groupBy("query_id", "group").agg(F.min("rank").alias("rank"))


def distinct_in_order(x: Column) -> Column:
    """Trimmed values without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(x, lambda t: F.trim(t)), lambda v: v != ""))


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows equal in key the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
