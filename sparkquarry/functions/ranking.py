"""Ranking factors of repository paths: token signals of queries, paths and symbols, and the rules of the code profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquarry.functions.repo import DATA_MARKS, SCAFFOLD_ROOTS, agent_folder, holds, is_example, is_fixture, is_source, is_tests, relative, under
from sparkquarry.functions.text import IDENTIFIER, file_stem, lexical_tokens

# Words that tell what a query is after.
EXAMPLE_INTENT = ["demo", "demos", "example", "examples", "sample", "samples", "tutorial", "tutorials"]
DOCUMENTATION_INTENT = ["doc", "docs", "document", "documentation", "documented", "guide", "guides", "readme", "tutorial", "tutorials"]
IMPLEMENTATION_INTENT = ["code", "function", "functions", "implement", "implemented", "implementation", "logic", "source"]
EXPERIMENT_INTENT = ["autoresearch", "benchmark", "benchmarks", "experiment", "experiments", "fixture", "fixtures", "hypothesis", "hypotheses", "research"]
EXPERIMENT_PATHS = ["autoresearch", "benchmark", "benchmarks", "experiment", "experiments", "fixture", "fixtures", "hypothesis", "hypotheses"]
CLI_INTENT = ["cli", "command", "commands", "runner", "script", "scripts"]
COMMAND_RUNTIME = ["callback", "command", "commands", "execute", "execution", "group", "groups", "invocation", "invoke", "lookup", "main", "registration", "runtime", "subcommand"]
PARAMETER_METADATA = ["annotated", "argument", "arguments", "default", "defaults", "field", "fields", "metadata", "model", "models", "option", "options", "parameter", "parameters"]
UTILITY_INTENT = ["helper", "helpers", "util", "utilities", "utility", "utils"]
PUBLIC_INIT = ["api", "entry", "entrypoint", "export", "exports", "init", "initialization", "initialize", "level", "main", "module", "public", "reexport", "reexports", "top"]
TERMINAL_UI = ["app", "appdir", "confirm", "dir", "echo", "get", "launch", "progress", "progressbar", "prompt", "secho", "style", "terminal"]
FIXTURE_INTENT = ["fixture", "fixtures", "snapshot", "snapshots", "test", "testing", "tests"]
# Tokens that say nothing of a path or symbol, and what stands for one another.
STOP_TOKENS = [
    "and", "are", "as", "behavior", "code", "does", "file", "files", "flow", "for", "helper", "helpers", "implement", "implemented", "implements", "in", "including", "into", "is", "local",
    "locally", "logic", "of", "or", "public", "repo", "repository", "source", "such", "system", "the", "to", "using", "validate", "validated", "where", "with",
]
GENERIC_TOKENS = ["app", "apps", "changelog", "doc", "docs", "js", "json", "lib", "md", "py", "readme", "rst", "src", "test", "tests", "ts", "txt", "yaml", "yml"]
ALIASES = {
    "auth": ["authentication"], "authentication": ["auth"], "error": ["exception", "exceptions"], "errors": ["exception", "exceptions"], "exception": ["error", "errors"], "exceptions": ["error", "errors"],
    "utilities": ["util", "utility", "utils"], "utility": ["util", "utilities", "utils"], "utils": ["util", "utilities", "utility"],
}
DECLARATION = r"(?m)^\s*(?:async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def signal_tokens(x: Column) -> Column:
    """Distinct identifier parts of at least three letters with their singulars and aliases, without those that say nothing."""
    parts = F.flatten(F.transform(F.split(x, "[^A-Za-z0-9]+"), lambda t: F.regexp_extract_all(t, F.lit(IDENTIFIER), F.lit(0))))
    plain = F.array_distinct(F.transform(parts, F.lower))
    aliases = F.create_map(*[c for k, v in ALIASES.items() for c in (F.lit(k), _texts(v))])
    shorter = F.transform(F.filter(plain, lambda t: (F.length(t) > 3) & F.endswith(t, F.lit("s"))), lambda t: F.substring(t, 1, F.length(t) - 1))
    singular = F.transform(F.filter(plain, lambda t: (F.length(t) > 3) & F.endswith(t, F.lit("ies"))), lambda t: F.concat(F.substring(t, 1, F.length(t) - 3), F.lit("y")))
    other = F.flatten(F.transform(plain, lambda t: F.coalesce(F.try_element_at(aliases, t), F.array().cast("array<string>"))))
    every = F.array_distinct(F.concat(plain, singular, shorter, other))
    return F.array_except(F.filter(every, lambda t: F.length(t) >= 3), _texts(STOP_TOKENS + GENERIC_TOKENS))


def related(asked: Column, own: Column) -> Column:
    """How many of own's tokens equal one asked for, or share its beginning where both have four letters or more."""
    close = lambda a, b: (F.length(a) >= 4) & (F.length(b) >= 4) & (F.startswith(a, b) | F.startswith(b, a))
    return F.size(F.filter(own, lambda t: F.exists(asked, lambda q: (q == t) | close(q, t))))


def stem_matches(asked: Column, stem: Column) -> Column:
    """Whether a query's tokens have the only token of a file's stem, or two of its tokens."""
    own = signal_tokens(stem)
    return (F.size(own) > 0) & (related(asked, own) >= F.least(F.lit(2), F.size(own)))


def private_folder_missed(path: Column, asked: Column) -> Column:
    """Whether a folder below the package begins with _ and the query says nothing of it (_internal: nor two tokens of the path)."""
    parts = F.split(F.lower(path), "/")
    package = F.when(parts[0].isin("src", "lib"), 1).otherwise(0)
    known = related(asked, signal_tokens(path)) >= 2

    def missed(segment: Column, at: Column) -> Column:
        deep = (at > package) & (at < F.size(parts) - 1) & F.startswith(segment, F.lit("_"))
        return deep & ~((segment == "_internal") & known) & (related(asked, signal_tokens(segment)) == 0)

    return (F.size(parts) >= 3) & F.exists(F.transform(parts, missed), lambda x: x)


def symbol_factor(path: Column, content: Column, asked: Column) -> Column:
    """1.30 for documentation named as asked; for source 0.04 more for its name and for two declared symbols, 0.06 at most."""
    named = stem_matches(asked, file_stem(path))
    declared = related(asked, signal_tokens(F.array_join(F.regexp_extract_all(content, F.lit(DECLARATION), F.lit(1)), " "))) >= 2
    extra = F.least(F.lit(0.06), F.when(named, 0.04).otherwise(0.0) + F.when(declared, 0.04).otherwise(0.0))
    lower = F.lower(path)
    return F.when(F.size(asked) == 0, 1.0).when(F.startswith(lower, F.lit("docs/")) & named, 1.30).when(is_source(path), 1.0 + extra).otherwise(1.0)


def code_profile(path: Column, content: Column, query: Column, agents: list[str] | None = None) -> Column:
    """The factor of a hit's path for a query: one rule for what kind of file it is, then each that applies.  No path: 1."""
    path = relative(path)
    lower, words, asked = F.lower(path), lexical_tokens(query), signal_tokens(query)
    wants = lambda *lists: F.arrays_overlap(words, _texts([w for x in lists for w in x]))
    ends, starts = (lambda x: F.endswith(lower, F.lit(x))), (lambda x: F.startswith(lower, F.lit(x)))
    slashed = F.concat(F.lit("/"), lower)
    parts = F.split(lower, "/")
    data = ends(".json") & F.contains(lower, F.lit("/data/")) & holds(lower, DATA_MARKS)
    kind = (
        F.when(agent_folder(lower, agents) | under(lower, ["artifacts/", "autoresearch/"]) | data, 0.20)
        .when(is_example(lower) & ~wants(EXAMPLE_INTENT), 0.70)
        .when(starts("docs/") | ends(".md"), 0.70)
        .when(starts("tests/"), 1.10)
        .otherwise(1.0)
    )
    crate = (F.size(parts) == 4) & (parts[0] == "crates") & F.coalesce((F.try_element_at(parts, F.lit(3)) == "src") & F.try_element_at(parts, F.lit(4)).isin("lib.rs", "main.rs"), F.lit(False))
    crate &= F.coalesce(related(asked, signal_tokens(F.try_element_at(parts, F.lit(2)))) >= 1, F.lit(False))
    index = (F.size(parts) >= 2) & F.startswith(F.element_at(parts, -1), F.lit("index.")) & F.coalesce(stem_matches(asked, F.try_element_at(parts, F.lit(-2))), F.lit(False))
    # When each factor applies.
    rules = [
        (starts("doc/") & ~wants(DOCUMENTATION_INTENT, EXAMPLE_INTENT), 0.80),
        (starts("docs/tutorial/") & ~wants(DOCUMENTATION_INTENT, EXAMPLE_INTENT), 0.80),
        (starts("docs/source/") & ~wants(DOCUMENTATION_INTENT), 0.80),
        (private_folder_missed(path, asked), 0.80),
        (under(lower, SCAFFOLD_ROOTS) & ~wants(EXAMPLE_INTENT), 0.80),
        (is_fixture(lower) & ~wants(FIXTURE_INTENT), 0.80),
        (F.arrays_overlap(lexical_tokens(path), _texts(EXPERIMENT_PATHS)) & ~wants(EXPERIMENT_INTENT), 0.70),
        (starts("src/") & wants(IMPLEMENTATION_INTENT), 1.12),
        (crate, 1.35),
        (ends("/__init__.py") & ~wants(PUBLIC_INIT), 0.82),
        (ends("/core.py") & wants(COMMAND_RUNTIME), 1.20),
        (ends("/models.py") & wants(PARAMETER_METADATA), 1.20),
        (ends("/utils.py") & wants(PARAMETER_METADATA) & ~wants(UTILITY_INTENT), 0.75),
        (ends("/cli.py") & ~wants(CLI_INTENT), 0.90),
        (F.contains(slashed, F.lit("/_click/termui.py")) & wants(TERMINAL_UI), 1.20),
        (index, 1.50),
    ]
    factor = reduce(lambda out, rule: out * F.when(rule[0], rule[1]).otherwise(1.0), rules, kind) * symbol_factor(path, content, asked)
    return F.when(F.coalesce(path, F.lit("")) == "", 1.0).otherwise(factor)


def is_file_card(title: Column, section: Column) -> Column:
    return F.endswith(title, F.lit(" file metadata")) | F.startswith(section, F.lit("File metadata:"))


def card_path_bonus(path: Column, query: Column) -> Column:
    """1.30 for a file named as asked, 1.05 for a path with two asked tokens, else null."""
    asked = signal_tokens(query)
    return F.when(stem_matches(asked, file_stem(relative(path))), 1.30).when(related(asked, signal_tokens(path)) >= 2, 1.05)


def card_group_factor(bonus: Column, overlap: Column) -> Column:
    """The factor of a group of file cards alone: its best path bonus, else by the most asked tokens of a card's text."""
    return F.coalesce(bonus, F.when(overlap >= 3, 0.90).otherwise(0.75))


def test_stem(path: Column) -> Column:
    """The stem of what a test file is about: without test_ before or _test behind."""
    return F.regexp_replace(F.regexp_replace(file_stem(path), "^test_", ""), "_test$", "")


def companion_strength(path: Column, title: Column, section: Column, content: Column, query: Column, top_stem: Column) -> Column:
    """How well a test or documentation file goes with the first source file: 3 for a test of it, 10 and more asked tokens for documentation, 12 at least if named as asked."""
    path = relative(path)
    lower, asked, stem = F.lower(path), signal_tokens(query), test_stem(path)
    about = related(asked, signal_tokens(F.concat_ws(" ", title, section, F.substring(content, 1, 2000))))
    docs = F.when(stem_matches(asked, file_stem(path)), F.greatest(F.lit(12), about)).when(about >= 10, about).otherwise(0)
    return F.when(is_tests(lower), F.when(stem_matches(asked, stem) | F.coalesce(stem == top_stem, F.lit(False)), 3).otherwise(0)).when(F.startswith(lower, F.lit("docs/")), docs).otherwise(0)
