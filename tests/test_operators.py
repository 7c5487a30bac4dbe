import json

import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import ranking, text, urls, vectors
from sparkquarry.operators import chunking, evaluation, manifest, pages, retrieval, routing
from sparkquarry.sources import relation
from sparkquarry.streaming import traces


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, text.slug(F.lit(" Getting Started!.md"))) == "getting-started"
    assert one(spark, text.safe_slug(F.lit("--- ---"))) == "page"
    assert one(spark, text.plain_inline(F.lit("a ![pic](u) [link](v)  **b**"))) == "a pic link b"
    assert one(spark, text.sentences(F.lit("One two. Three! four? [5] x"))) == ["One two.", "Three! four?", "[5] x"]
    assert one(spark, text.token_count(F.lit("it's a well-known fact, ok?"))) == 7
    assert one(spark, text.identifier_tokens(F.lit("parseHTTPResponse2 parse"))) == ["parse", "http", "response", "2"]
    assert one(spark, text.title_from_path(F.lit("docs/my_first-page.md"))) == "My First Page"
    assert one(spark, text.file_extension(F.lit("a/b/C.PY"))) == ".py"
    assert one(spark, text.doc_kind(F.array(F.lit("x"), F.lit("customer")))) == "customers"
    assert one(spark, text.doc_kind(F.array().cast("array<string>"))) == "page"
    assert one(spark, text.excerpt(F.lit("word " * 100))).endswith("word...") and len(one(spark, text.excerpt(F.lit("word " * 100)))) <= 320
    assert one(spark, text.embedding_text(F.lit(" "), F.lit("S"), F.lit("c"))) == "Section: S\n\nc"


def test_url_functions(spark):
    assert one(spark, urls.canonical(F.lit("https://A.example/x/?q=1#top"))) == "https://A.example/x?q=1"
    assert one(spark, urls.language_prefix(F.lit("https://a.example/pt_BR/docs"))) == "pt-br"
    assert one(spark, urls.language_prefix(F.lit("https://a.example/xx/docs"))) is None
    assert one(spark, urls.version_key(F.lit("v1.12.3-rc1"))) == [1, 12, 3]
    assert one(spark, urls.matches(F.lit("/docs/a/b"), "docs/**")) is True
    assert one(spark, urls.matches(F.lit("/docsx"), "/docs/**")) is False
    assert one(spark, urls.matches(F.lit("/a/b.html"), "*.html")) is True  # as in a file glob, * crosses slashes
    assert one(spark, urls.suffixes(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [0.0, 2.0])], "k int, v array<float>")
    got = {r.k: r.v for r in vectors.mean_by(df, "k", "v").collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 1.0]
    assert one(spark, vectors.is_unit(F.array(F.lit(0.6), F.lit(0.8)), 2)) is True
    assert one(spark, vectors.is_unit(F.array(F.lit(float("nan")), F.lit(0.8)), 2)) is False


def test_scan_contract(spark):
    df = spark.createDataFrame([(3, "third", None), (1, "first", " First "), (4, "   ", "empty"), (2, "second", "")], "doc_key int, body string, heading string")
    rows = relation.scan(df, "DOC_KEY", "body", "heading", max_documents=2).collect()
    assert [(r.document_id, r.title) for r in rows] == [("1", " First "), ("2", "2")]
    summary = relation.scan_summary(df, "doc_key", "body", max_documents=2).first().asDict()
    assert (summary["rows_discovered"], summary["skipped_empty"], summary["skipped_limit"]) == (4, 1, 1)
    with pytest.raises(ValueError):
        relation.scan(df, "absent", "body")


def test_file_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# A\nhello")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "c.txt").write_bytes(b"one\r\ntwo")
    assert [r.relative_path for r in relation.read_markdown(spark, str(tmp_path)).collect()] == ["docs/a.md"]
    assert {r.text for r in relation.read_repository(spark, str(tmp_path)).collect()} == {"# A\nhello", "one\ntwo"}
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps({"cases": [{"id": "q", "question": "?", "judgments": [{"grade": 3, "url": "u"}]}]}))
    assert relation.read_eval_cases(spark, str(cases)).first()["judgments"][0]["grade"] == 3
    tree = spark.createDataFrame([(f"100644 blob {'a' * 40}      12\tsrc/x.py\0garbage\0",)], "t string")
    assert [r.path for r in relation.tree_entries(tree, "t").collect()] == ["src/x.py", None]
    robots = spark.createDataFrame([("User-agent: *\nSitemap: https://a/s.xml\nsitemap:https://a/t.xml",)], "t string")
    assert {r.sitemap for r in relation.robots_sitemaps(robots, "t").collect()} == {"https://a/s.xml", "https://a/t.xml"}


def test_diff_outcomes(spark):
    schema = "row_id string, canonical_url string, page_hash string, embedding_text_hash string"
    desired = spark.createDataFrame([("same", "u", "p", "h"), ("edit", "u", "p", "h2"), ("back", "v", "p", "h"), ("fresh", "w", "p", "h"), ("more", "u", "p", "h"), ("gone-before", "x", "p", "h")], schema)
    state = spark.createDataFrame(
        [("same", "u", "p", "h", "p1", "active"), ("edit", "u", "p", "h", "p1", "active"), ("back", "v", "p", "h", "p1", "retained_stale"), ("old", "y", "p", "h", "p1", "active"), ("older", "y", "p", "h", "p1", "retained_stale"), ("gone-before", "x", "p", "h", "p1", "deleted")],
        schema + ", plan_id string, status string",
    )
    changes = manifest.diff(desired, state)
    assert {r.row_id: r.action for r in changes.collect()} == {
        "same": "unchanged", "edit": "changed", "back": "reactivate_retained_stale", "fresh": "new", "more": "changed", "gone-before": "new", "old": "stale", "older": "retained_stale",
    }
    ledger = {r.row_id: (r.plan_id, r.status) for r in manifest.next_ledger(desired, state, "p2").collect()}
    assert ledger["same"] == ("p1", "active") and ledger["edit"] == ("p2", "active") and ledger["old"] == ("p1", "retained_stale") and len(ledger) == 8
    assert manifest.next_ledger(desired, state, "p2", delete_stale=True).count() == 6
    again = manifest.next_ledger(desired, manifest.next_ledger(desired, state, "p2"), "p3")
    assert {r.plan_id for r in again.where("status = 'active'").collect()} == {"p1", "p2"}
    assert manifest.table_hash(state, "row_id").first() == manifest.table_hash(state.repartition(3), "row_id").first()


def test_duplicate_chunks_are_numbered(spark):
    df = spark.createDataFrame([(0, "u", "s", "h"), (1, "u", "s", "h"), (2, "u", "s", "i")], "line int, canonical_url string, section_path string, chunk_hash string")
    rows = manifest.with_row_ids(df, "site", ["line"]).orderBy("line").collect()
    assert [r.duplicate_ordinal for r in rows] == [0, 1, 0] and len({r.row_id for r in rows}) == 3


def test_fusion_and_grouping(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    right = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, id string, rank int")
    assert [r.id for r in retrieval.rrf(left, right, "id").orderBy("rank").collect()] == ["b", "a", "c"]
    hits = spark.createDataFrame([(1, "x1", "x", 2), (1, "y1", "y", 1), (1, "x2", "x", 3), (1, "x3", "x", 4)], "query_id int, id string, page string, rank int")
    assert retrieval.group_hits(hits, "id", "page", "max").where("rank = 1").first()["page"] == "y"
    assert retrieval.group_hits(hits, "id", "page", "capped_sum_3").where("rank = 1").first()["id"] == "x1"
    assert retrieval.group_hits(hits, "id", "page", "adaptive_sum_3").where("rank = 1").first()["page"] == "x"


def test_vector_ties_and_sizes(spark):
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0])], "vec_id long, embedding array<float>")
    top = retrieval.vector_top_k(rows, rows.where("vec_id = 2").selectExpr("vec_id AS query_id", "embedding"), 2)
    assert [(r.vec_id, r.score) for r in top.orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]


def test_graded_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, doc_id int, rank int")
    judged = spark.createDataFrame([(1, 11, 3), (1, 11, 1), (1, 99, 2), (1, 12, 0), (2, 5, 1)], "query_id int, doc_id int, grade int")
    got = {r.query_id: r for r in evaluation.graded_metrics(hits, judged).collect()}
    assert got[1].recall == 0.5 and got[1].mrr == 0.5 and got[1].precision == pytest.approx(1 / 3)
    assert got[1].ndcg == pytest.approx((7 / 1.584962500721156) / (7 + 3 / 1.584962500721156))
    assert got[2].ndcg == 0 and got[2].composite == 0


def test_evidence_selection_is_exact(spark):
    rows = [(True, float(100 - i)) for i in range(19)] + [(False, 80.0), (True, 70.0), (False, 60.0), (False, None)]
    observed = spark.createDataFrame(rows, "useful boolean, score double")
    chosen = evaluation.select_threshold(observed).first()
    assert (chosen.threshold, chosen.tp, chosen.fp) == (70.0, 20, 1)


def test_routing(spark):
    cards = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "namespace string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7071, 0.7071])], "query_id int, vector array<double>")
    got = {r.query_id: (r.namespace, r.confident, r.fanout) for r in routing.semantic_route(asked, cards).where("rank = 1").collect()}
    assert got == {1: ("a", True, 1), 2: ("a", False, 3)}
    words = spark.createDataFrame([("a", "Data Frames"), ("b", "frames")], "namespace string, descriptor string")
    route = routing.lexical_route(spark.createDataFrame([(1, "How do data-frames work?")], "query_id int, query string"), words)
    assert [r.namespace for r in route.orderBy("rank").collect()] == ["a", "b"]


def _chunks(text, target=300, overlap=2):
    sections = {}
    for path, section, block in chunking.labelled_blocks(text):
        sections.setdefault((section, path), []).append(block)
    return [(path, content, n) for (_, path), blocks in sections.items() for content, n in chunking.section_chunks(blocks, chunking.Words(), target, overlap)]


def test_chunks_follow_headings_and_fences():
    body = "intro text here\n\n# One [x](y)\n\nalpha. Beta gamma.\n\n```\n# not a heading\n\nx = 1\n```\nTwo\n## **Two**\n\ndelta\n\n[Skip to content](#a)\n\n# Three\n# Four"
    made = _chunks(body)
    assert [(p, c) for p, c, _ in made] == [("", "intro text here"), ("One x", "alpha. Beta gamma.\n\n```\n# not a heading\n\nx = 1\n```"), ("One x > Two", "delta")]
    meta, rest = chunking.front_matter('---\ntitle: \'It\'\'s\'\nname: "a \\"b\\" \\\\ c"\nbare: x: y\n---\nbody')
    assert meta == {"title": "It's", "name": 'a "b" \\ c', "bare": "x: y"} and rest == "body"
    assert _chunks("") == [] and _chunks(" \n\n ") == []


def test_chunks_keep_all_words_within_the_target():
    long = " ".join(f"Word{i} goes on." for i in range(300))
    made = _chunks(long, 40)
    assert all(n == len(chunking._token.findall(c)) <= 40 + chunking.OVERLAP_TOKENS for _, c, n in made)
    assert all(f"Word{i} " in " ".join(c for _, c, _ in made) for i in range(300))
    assert all(b.startswith(" ".join(a.split()[-6:])) for (_, a, _), (_, b, _) in zip(made, made[1:], strict=False))  # two sentences again
    giant = _chunks("x+" * 500 + " end", 10, 0)
    assert len(giant) > 50 and "".join(c for _, c, _ in giant).replace(" ", "") == "x+" * 500 + "end"
    blocks = "\n\n".join(" ".join(["word"] * 30) for _ in range(20))
    assert [n for _, _, n in _chunks(blocks, 100, 0)] == [90] * 6 + [60]


@pytest.mark.parametrize(
    "path,query,factor",
    [
        ("", "anything", 1.0),
        ("artifacts/report.md", "report", 0.2),  # one rule for the kind of file, not two
        ("crates/parser/src/lib.rs", "how does the parser work", 1.35),
        ("web/settings/index.ts", "where are settings kept", 1.5),
        ("src/pkg/_vendor/thing.py", "network retries", 0.8),
        ("src/pkg/_internal/user_errors.py", "user exceptions", 1.04),
        ("docs/retry_policy.md", "retry policy", 0.7 * 1.3),
        ("src/pkg/_click/termui.py", "show a progress prompt", 0.8 * 1.2),
        ("docs/tutorial/first.md", "network", 0.7 * 0.8),
    ],
)
def test_code_profile(spark, path, query, factor):
    assert one(spark, ranking.code_profile(F.lit(path), F.lit(""), F.lit(query))) == pytest.approx(factor)


def test_ranking_signals(spark):
    assert set(one(spark, ranking.signal_tokens(F.lit("parseHTTPErrors ABC-def policies in")))) == {"parse", "http", "errors", "error", "exception", "exceptions", "abc", "def", "policies", "policie", "policy"}
    declared = F.lit("import x\nclass RetryPolicy:\n    def backoff_delay(self): ...")
    assert one(spark, ranking.code_profile(F.lit("src/a/net.py"), declared, F.lit("retry policy delay"))) == pytest.approx(1.04)
    assert one(spark, ranking.companion_strength(F.lit("tests/test_net.py"), F.lit(""), F.lit(""), F.lit(""), F.lit("net"), F.lit("x"))) == 3
    assert one(spark, ranking.companion_strength(F.lit("docs/net.md"), F.lit(""), F.lit(""), F.lit(""), F.lit("net"), F.lit("x"))) == 12
    assert one(spark, ranking.card_group_factor(ranking.card_path_bonus(F.lit("src/net.py"), F.lit("net")), F.lit(0))) == 1.3
    assert one(spark, ranking.card_group_factor(F.lit(None).cast("double"), F.lit(3))) == 0.9


def test_line_ranges_cover(spark):
    files = spark.createDataFrame([("a", "\n".join(map(str, range(200)))), ("b", ""), ("c", None)], "path string, text string")
    ranges = chunking.line_ranges(files, "path", "text")
    assert chunking.uncovered(ranges, "path").count() == 0
    assert [(r.first_line, r.last_line) for r in ranges.where("path = 'a'").orderBy("first_line").collect()] == [(1, 80), (81, 160), (161, 200)]
    assert chunking.uncovered(ranges.where("first_line <> 81"), "path").count() == 1


def test_pages(spark):
    html = "<html><head><title> A &amp; B </title></head><body><nav>menu</nav><h1>H</h1><p>one<b>two</b></p><script>x()</script></body></html>"
    assert one(spark, pages.html_title(F.lit(html), F.lit("u"))) == "A & B"
    assert one(spark, pages.html_text(F.lit(html))).split("\n") == ["H", "onetwo"]
    rows = [(f"https://a.example/docs/{v}/p{i}",) for v in ("1.9", "1.10", "2.0") for i in range(12)]
    family = pages.version_family(spark.createDataFrame(rows, "url string")).first()
    assert (family.root_path, family.versions, family.urls, family.latest) == ("/docs", 3, 36, "2.0")


def test_trace_ingest_is_exactly_once(spark, tmp_path):
    inbox, store, receipts, checkpoint = (str(tmp_path / x) for x in ("inbox", "store", "receipts", "checkpoint"))
    (tmp_path / "inbox").mkdir()

    def put(name, *rows):
        (tmp_path / "inbox" / name).write_text("\n".join(json.dumps({"trace_id": t, "payload": p}) for t, p in rows))

    def drain():
        traces.ingest(spark, inbox, store, receipts, checkpoint).awaitTermination(120)
        seen = spark.read.option("basePath", receipts).parquet(f"{receipts}/batch=*")
        return sorted((r.trace_id, r.outcome) for r in seen.collect()), spark.read.parquet(store).count()

    put("1.json", ("a", '{"n": 1}'), ("b", '{"n": 2}'), ("c", "no json"))
    assert drain() == ([("a", "committed"), ("b", "committed"), ("c", "rejected")], 2)
    put("2.json", ("a", '{"n": 1}'), ("b", '{"n": 3}'), ("d", "{}"))
    outcomes, stored = drain()
    assert stored == 3 and {("a", "replayed"), ("b", "conflict"), ("d", "committed")} <= set(outcomes)
    assert drain()[1] == 3


def test_repository_paths(spark):
    from sparkquarry.functions import repo

    assert one(spark, repo.language(F.lit("a/b.RS"))) == "rust" and one(spark, repo.language(F.lit("Makefile"))) == "text" and one(spark, repo.language(F.lit("x.foo"))) == "foo"
    assert one(spark, repo.skip_reason(F.lit("node_modules/x.js"))) == "default"
    assert one(spark, repo.skip_reason(F.lit("node_modules/x.js"), include=["node_modules/**"])) is None
    assert one(spark, repo.skip_reason(F.lit("src/a.py"), subdir="lib")) == "outside the folder"
    assert [one(spark, repo.role(F.lit(p))) for p in ("src/a.py", "pkg/test_a.py", "docs/x.md", "tests/data/x", "README.md")] == ["source", "tests", "docs", "fixture", "other"]


def test_prototypes_equal_plain_greedy(spark):
    import random

    from sparkquarry.operators import prototypes

    rng = random.Random(6)
    rows = [(ns, f"u{rng.randrange(4)}", i, " ".join(rng.choice("abcdefgh") for _ in range(4))) for i, ns in enumerate("xxxxxxxxxxxxyyyzzzzzz")] + [("x", "u9", 99, None)]
    got = prototypes.select_prototypes(spark.createDataFrame(rows, "namespace string, url string, n int, passage string"), "n", 5).collect()
    for ns in "xyz":
        seen, pool = set(), []
        for _, url, n, p in [r for r in rows if r[0] == ns and r[3]]:
            if p not in seen:
                seen.add(p)
                pool.append((url, n, set(p.split())))
        want = []
        while pool and len(want) < 5:
            rank = lambda c: (any(c[0] == w[0] for w in want), max([len(c[2] & w[2]) / len(c[2] | w[2]) for w in want], default=0.0), c[1])  # noqa: B023, E731
            want.append(min(pool, key=rank))
            pool.remove(want[-1])
        assert [r.n for r in sorted(got, key=lambda r: r.ordinal) if r.namespace == ns] == [w[1] for w in want]


def test_source_chunks_own_every_line(spark):
    from sparkquarry.operators import source_code

    text = "import os\n\n# about f\n@deco\ndef f():\n    def g():\n        return 1\n    return g\n\n\nclass C:\n    x = 1\n\n    def m(self):\n        pass\n"
    files = spark.createDataFrame([("a.py", text), ("bad.py", "def ("), ("n.txt", "\n".join("x" * 3 for _ in range(100))), ("e.py", None)], "path string, text string")
    chunks = source_code.chunk_source(files)
    assert chunking.uncovered(chunks, "path").count() == 0
    got = [(r.first_line, r.last_line, r.symbol) for r in chunks.where("path = 'a.py'").orderBy("first_line").collect()]
    assert got[:4] == [(1, 1, ""), (2, 5, "f"), (6, 7, "f.g"), (8, 8, "f")] and {"C", "C.m"} <= {g[2] for g in got}
    assert "\n".join(r.content for r in chunks.where("path = 'a.py'").orderBy("first_line").collect()) == text


def test_versions_and_upserts(spark, tmp_path):
    from sparkquarry.sources import sinks

    root = str(tmp_path / "ledger")
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, root)
    first = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert sinks.publish(first, root) == 1
    second = sinks.upsert(sinks.read_current(spark, root), spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int"), spark.createDataFrame([("a",)], "id string"))
    assert sinks.publish(second, root, expected=1) == 2
    with pytest.raises(ValueError):
        sinks.publish(first, root, expected=1)
    assert {tuple(r) for r in sinks.read_current(spark, root, first.schema).collect()} == {("b", 3), ("c", 4)}
    with pytest.raises(ValueError):
        sinks.read_current(spark, root, spark.range(1).schema)
    index = str(tmp_path / "index")
    rows = spark.createDataFrame([("x", "1", 1), ("y", "2", 1)], "namespace string, id string, n int")
    sinks.write_index(rows, index)
    sinks.write_index(rows.where("namespace = 'x'").withColumn("n", F.lit(2)), index)
    assert {(r.namespace, r.n) for r in spark.read.parquet(index).collect()} == {("x", 2), ("y", 1)}
    title = 'a "b" \\ c\n: é'
    page = sinks.as_markdown(spark.createDataFrame([("u", title, "text")], "url string, title string, content string")).first()
    values, body = chunking.front_matter(page.raw)
    assert values == {"title": title, "url": "u"} and body.strip() == "text" and page.file.startswith("document-")


def test_strict_artifacts(spark, tmp_path):
    from sparkquarry.sources import artifacts

    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"cases": [{"id": "a", "question": "q", "split": "gate", "role": "named", "expected": ["x"]}, {"id": "b", "question": "r", "split": "calibration"}]}')
    rows = artifacts.read_strict(spark, str(good), artifacts.ROUTING_CASE, ["id", "question", "split"], "id")
    assert {(r.id, r.role) for r in rows.collect()} == {("a", "named"), ("b", None)} and artifacts.gate_cases(rows).count() == 1
    bad.write_text('[{"id": "a", "id": "b", "score_floor": "much", "odd": 1}, 7]')
    with pytest.raises(ValueError) as said:
        artifacts.read_strict(spark, str(bad), "id string, score_floor double", ["id", "mode"])
    assert all(x in str(said.value) for x in ("unknown: odd", "missing: mode", "misfit: score_floor", "no object"))


def test_small_forms(spark):
    from sparkquarry.operators import rows

    assert one(spark, urls.hosted_repository(F.lit("git@github.com:me/some.repo.git"))).asDict() == {"owner": "me", "name": "some.repo"}
    assert one(spark, urls.hosted_repository(F.lit("https://example.org/a/b"))) is None
    assert one(spark, urls.eval_url(F.lit("https://A.example//x%20y/?q#z"))) == "a.example/x y" and one(spark, urls.eval_url(F.lit(" Some/Path/ "))) == "some/path"
    assert one(spark, urls.plain_path(F.lit("\\a\\b%2Fc/"))) == "a/b/c" and one(spark, urls.plain_path(F.lit("100%"))) == "100%"
    assert one(spark, urls.same_host(F.lit("HTTPS://Docs.Example/x"), "docs.example")) is True and one(spark, urls.same_host(F.lit("ftp://docs.example/x"), "docs.example")) is False
    assert one(spark, urls.with_scheme_and_host(F.lit("https://u:p@a.example"))) is False and one(spark, urls.with_scheme_and_host(F.lit("https://a.example/x"))) is True
    assert one(spark, urls.sitemap_seeds(F.lit("https://a.example/docs")))[0] == "https://a.example/robots.txt"
    assert one(spark, rows.allowed_attributes(F.create_map(F.lit("a"), F.lit("x" * 300), F.lit("b"), F.lit("y"), F.lit("c"), F.lit(None).cast("string")), ["a", "c"])) == {"a": "x" * 256}
    assert one(spark, rows.timestamp_of_nanos(F.lit(1_700_000_000_123_456_789))).microsecond == 123456
    assert one(spark, rows.distinct_in_order(F.array(F.lit(" b"), F.lit(""), F.lit("a"), F.lit("b")))) == ["b", "a"]
    assert one(spark, rows.as_float32(F.array(F.lit(0.1)))) == [0.10000000149011612]
    left = spark.createDataFrame([("a", "x"), ("b", "y")], "namespace string, status string")
    assert rows.uncovered_namespaces(left.replace({"x": "missing", "y": "eligible"}, subset="status")).first()["namespace"] == "a"
    before, after = (spark.createDataFrame(r, "k string, v double") for r in ([("a", 1.0), ("b", 0.5), ("c", 0.1)], [("a", 1.0), ("b", 0.4)]))
    assert {r.k for r in evaluation.regressions(before, after, "k", "v").collect()} == {"b", "c"}


def test_evidence_modes(spark):
    from sparkquarry.operators import rows

    seen = rows.observe_evidence(spark.createDataFrame([(1, 1, 0.7), (1, 2, 0.4), (1, 6, 0.9), (2, 1, None), (3, 1, 0.2)], "query_id int, rank int, cross_score double"))
    got = {r.query_id: r for r in rows.decide_evidence(seen, 0.7, "active").collect()}
    assert (got[1].decision, got[1].gap, got[1].candidates) == ("supported", 0.3, 2) and got[2].weak and got[3].decision == "insufficient"
    assert {(r.decision, r.enforced) for r in rows.decide_evidence(seen, 0.7, "shadow").collect()} == {("supported", False), ("insufficient", False)}
    assert {r.decision for r in rows.decide_evidence(seen, None, "collect").collect()} == {"not evaluated"}


def test_pages_of_source_files(spark):
    from sparkquarry.operators import repository

    text = "import os\n\ndef load_rows():\n    pass\n" + "x = 1\n" * 90 + "class Reader:\n    pass\n"
    files = spark.createDataFrame([("src/my_reader.py", text), ("README.md", "# Hi"), ("notes.txt", " plain\n"), ("run.sh", "```"), ("empty.py", None)], "path string, text string")
    got = {r.path: r for r in repository.as_pages(files).collect()}
    code = got["src/my_reader.py"]
    assert code.n_symbols == 2 and "## Lines 1-80\n\nSymbol breadcrumbs: load_rows\n\n```python" in code.page and "## Lines 81-96\n\nSymbol breadcrumbs: Reader" in code.page
    assert "Path tokens: src my reader\nFile stem: my_reader\nSymbols: load_rows, Reader\nSymbol tokens: load rows reader" in code.card and code.card.startswith("# File metadata: src/my_reader.py\n\nRepository file: `src/my_reader.py`")
    assert got["README.md"].page == "# Hi" and got["notes.txt"].page == "# notes.txt\n\nplain" and "~~~~shell\n```\n~~~~" in got["run.sh"].page and "## Lines" not in got["empty.py"].page


def test_of_two_writers_of_a_version_one_is_refused(spark, tmp_path, monkeypatch):
    from sparkquarry.sources import sinks

    root = str(tmp_path / "table")
    df = spark.range(3)
    assert sinks.publish(df, root) == 1
    monkeypatch.setattr(sinks, "_versions", lambda spark, root: [])  # what a writer saw that began before
    with pytest.raises(ValueError):
        sinks.publish(spark.range(5), root)
    monkeypatch.undo()
    assert sinks.read_current(spark, root).count() == 3 and sinks.publish(df, root, expected=1) == 2


def test_risk_curve_in_ranges_equals_one_window(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.random() < 0.4, rng.choice([None, round(rng.random(), 2)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "useful boolean, score double")
    whole, parts = ({r.threshold: (r.tp, r.fp) for r in evaluation.risk_curve(df, n).collect()} for n in (10**6, 7))
    assert whole == parts and whole == {t: tuple(sum(u == want and s is not None and s >= t for u, s in rows) for want in (True, False)) for t in whole}
    points = [r.threshold for r in evaluation.breakpoints(df.limit(3).union(spark.createDataFrame([(True, 0.5)], df.schema)), "score").collect()]
    assert 0.5 in points and any(0 < p - 0.5 < 1e-15 for p in points)


def test_routes_by_name_and_by_certified_margin(spark):
    cards = spark.createDataFrame([("a", "Alpha.com", ["first site"], [1.0, 0.0]), ("b", "Beta", [], [0.0, 1.0]), ("c", "Gamma", None, [0.6, 0.8]), ("d", "Delta", [], [-1.0, 0.0])], "namespace string, title string, aliases array<string>, vector array<double>")
    asked = [(1, "what does alpha do", [0.0, 1.0]), (2, "beta or gamma", [1.0, 0.0]), (3, "no name", [1.0, 0.0]), (4, "alpha beta gamma delta", [1.0, 0.0]), (5, "nothing", [0.7, 0.714])]
    queries = spark.createDataFrame(asked, "query_id long, query string, vector array<double>")
    got = {}
    for r in routing.hybrid_route(queries, cards).orderBy("query_id", "route_rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert [r.namespace for r in got[1]] == ["a", "b", "c"] and got[1][0].fanout == 1 and got[1][0].reason == "unique_title_or_alias"
    assert {r.namespace for r in got[2]} == {"b", "c"} and got[2][0].fanout == 2 and got[2][0].confident
    assert [r.namespace for r in got[3]] == ["a", "c", "b"] and got[3][0].confident and got[3][0].fanout == 1
    assert [(r.namespace, r.reason, r.fanout) for r in got[4]] == [(None, "too_many_named", 0)]
    assert not got[5][0].confident or got[5][0].score >= 0.65
    passages = spark.createDataFrame([("a", 0, "nothing at all"), ("b", 0, "else"), ("b", 1, "nothing"), ("c", 0, "x"), ("d", 0, "x")], "namespace string, ordinal long, passage string")
    same = lambda q, p: F.when(q == p, 1.0).otherwise(0.0)
    for certified, sure in ((True, True), (False, False)):
        rows = routing.prototype_route(queries.where("query_id = 5"), cards, cards, passages, same, 0.5, 0.5, certified).orderBy("route_rank").collect()
        assert [r.namespace for r in rows] == ["b", "c", "a"] and rows[0].confident == sure and rows[0].fanout == (1 if sure else 3)


def test_nearest_namespaces_whichever_side_goes_out(spark, monkeypatch):
    """Namespaces larger than a block of the bank are never collected whole; either side in several blocks gives the rows of all pairs."""
    import random

    rng = random.Random(4)
    vector = lambda n: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(n)]
    asked = [(q, vector(3)) for q in range(40)] + [(90, None), (91, []), (92, vector(5))]
    bank = [(f"n{rng.choice('aaaaaabc')}{i % 5}", vector(3)) for i in range(300)] + [("nz", vector(5)), ("nz", None), ("ny", [])]
    best = {}
    for q, x in asked:
        for name, y in bank:
            if x and y and len(x) == len(y):
                best[q, name] = max(best.get((q, name), -9.0), sum(a * b for a, b in zip(x, y, strict=True)))
    want = {}
    for (q, name), score in sorted(best.items(), key=lambda b: (b[0][0], -b[1], b[0][1])):
        want.setdefault(q, []).append((name, score))
    queries, rows = spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(bank, "namespace string, vector array<double>")
    collected = []
    to_pandas = type(rows).toPandas
    monkeypatch.setattr(type(rows), "toPandas", lambda df: collected.append(out := to_pandas(df)) or out)
    for query_block, bank_block in ((1024, 50), (16, 50), (4, 50)):
        monkeypatch.setattr(routing, "QUERY_BLOCK", query_block, raising=False)
        monkeypatch.setattr(routing, "BANK_BLOCK", bank_block)
        got = {}
        for r in routing.nearest_namespaces(queries, rows, 3).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.namespace, r.score))
        assert got == {q: hits[:3] for q, hits in want.items()}
    assert max(map(len, collected)) <= 80


def test_unit_vectors(spark):
    from sparkquarry.functions import vectors

    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id int, v array<float>")
    assert [r.u for r in rows.select("id", vectors.unit(F.col("v")).alias("u")).orderBy("id").collect()] == [[0.6, 0.8], None, None, None]


def test_field_weights_and_pushed_filters(spark):
    docs = spark.createDataFrame([(1, "alpha", "x", "beta"), (2, "x", "x", "alpha alpha"), (3, None, None, None)], "doc_id long, title string, section_path string, content string")
    asked = spark.createDataFrame([(7, "Alpha"), (8, "absent"), (9, None)], "query_id long, query string")
    top = retrieval.bm25_top_k(docs, asked, 5, fields=retrieval.FIELD_WEIGHTS).collect()
    assert [(r.query_id, r.doc_id) for r in sorted(top, key=lambda r: r.rank)] == [(7, 1), (7, 2)]
    assert retrieval.bm25_top_k(docs.limit(0), asked, 5, fields={"content": 1.0}).count() == 0


def test_judgments_slots_and_rules(spark):
    from sparkquarry.operators import index

    hits = spark.createDataFrame([(1, 1, "https://a.example/x", "pkg/src/m.py", "Intro > Use"), (1, 2, "https://b.example/y", "", "Other")], "query_id int, rank int, url string, path string, section string")
    judged = spark.createDataFrame([(1, "p", "", "src/m.py", "", 3), (1, "u", "b.example/y", "", "nothing", 2), (1, "s", "b.example/y", "", "OTHER", 1)], "query_id int, judgment_id string, url string, path string, section string, grade int")
    assert {(r.judgment_id, r.rank) for r in index.credited(index.match_judgments(hits, judged)).collect()} == {("p", 1), ("s", 2)}
    ranked = spark.createDataFrame([(1, "a", i, i) for i in range(1, 6)] + [(1, "b", 9, 9)], "query_id int, namespace string, key int, rank int")
    assert [(r.key, r.rank) for r in index.cover_namespaces(ranked, 3).orderBy("rank").collect()] == [(1, 1), (2, 2), (9, 3)]
    rows = spark.createDataFrame([(None, "x"), (" ", "x"), ("a", " "), ("a", "x")], "document_id string, content string")
    assert {r.rule: r.rows for r in index.invalid_rows(rows).collect()} == {"id missing": 1, "id blank": 1, "content blank": 1, "id repeated": 1}
    assert one(spark, index.document_url("duck", "s", F.lit("a b/~*é"))) == "duck://s/a%20b%2F~%2A%C3%A9"
    assert one(spark, index.row_key(F.struct(F.lit("").alias("id"), F.lit("u").alias("url"), F.lit("s").alias("section_path"), F.lit("c").alias("content"), F.lit("p").alias("path"), F.lit(1).alias("chunk_index"), F.lit("t").alias("title")))) == "u|s|c"


def test_compatible_fold(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ－Straße_1",), (None,), ("",)], "t string")
    assert [r.x for r in df.select(text.compatible_fold("t").alias("x")).collect()] == ["full strasse 1", None, ""]


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="needs a tokenizer file")
def test_token_budget(spark):
    from sparkquarry.operators import budget

    body = "\n".join("word " * (i % 7 + 1) for i in range(120)) + "\n" + "long " * 200
    files = spark.createDataFrame([("a", body), ("b", ""), ("c", None)], "path string, text string")
    ranges = budget.fit_lines(files, TOKENIZER, 64)
    assert chunking.uncovered(ranges, "path").count() == 0
    rows = [r for r in ranges.where("path = 'a'").orderBy("first_line").collect()]
    assert all(r.tokens <= 64 or r.first_line == r.last_line for r in rows) and rows[-1].tokens > 64
    lines = body.split("\n")
    for r in rows[:-2]:
        longer = spark.createDataFrame([("\n".join(lines[r.first_line - 1 : r.last_line + 1]),)], "t string").select(budget.token_count(F.col("t"), TOKENIZER).alias("n"))
        assert longer.first()["n"] > 64
        break
