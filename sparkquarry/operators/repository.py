"""Source files as Markdown pages: headings by line range with the symbols around, and a card of what a file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions.repo import language as language_of
from sparkquarry.functions.text import file_extension, file_stem, identifier_tokens

# What is prose, and how much of each list is shown.
MARKDOWN, PROSE = [".markdown", ".md", ".mdx"], [".adoc", ".rst", ".txt"]
LINES, PATH_TOKENS, SYMBOLS, SYMBOL_TOKENS, BREADCRUMBS, BEFORE = 80, 80, 80, 120, 20, 3
DECLARATION = r"^\s*(?:async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"


def lines_of(text: Column) -> Column:
    """Lines without the empty one behind a last line end."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def symbol_positions(lines: Column, language: Column) -> Column:
    """(line from 1, symbol) of each function and class of a Python file; none of others."""
    found = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, DECLARATION, 1).alias("symbol")))
    named = F.filter(found, lambda s: s["symbol"] != "")
    return F.when(language == "python", named).otherwise(F.slice(named, 1, 0))


def metadata_lines(path: Column, positions: Column) -> Column:
    """What a search may meet a file by: tokens of its path, its stem, its symbols and their tokens, as lines."""
    symbols = F.array_distinct(F.transform(positions, lambda s: s["symbol"]))
    shown = lambda x, n, joint: F.array_join(F.slice(x, 1, n), joint)
    tokens = identifier_tokens(F.replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("/"), F.lit(" ")))
    own = identifier_tokens(F.array_join(symbols, " "))
    return F.array_compact(F.array(
        F.lit("Search metadata:"), F.concat(F.lit("Path tokens: "), shown(tokens, PATH_TOKENS, " ")), F.concat(F.lit("File stem: "), file_stem(path)),
        F.when(F.size(symbols) > 0, F.concat(F.lit("Symbols: "), shown(symbols, SYMBOLS, ", "))), F.when(F.size(own) > 0, F.concat(F.lit("Symbol tokens: "), shown(own, SYMBOL_TOKENS, " "))),
    ))


def _head(path: Column, language: Column, title: Column) -> list[Column]:
    tick = lambda label, x: F.concat(F.lit(f"{label}: `"), x, F.lit("`"))
    return [F.concat(F.lit("# "), title), F.lit(""), tick("Repository file", path), tick("Language", language)]


def code_markdown(path: Column, lines: Column, positions: Column, language: Column, metadata: bool, size: int = LINES) -> Column:
    """A page of fenced blocks of ``size`` lines, each under its range and, with metadata, the symbols inside or the last ones before."""
    fence = F.when(F.contains(F.array_join(lines, "\n"), F.lit("```")), "~~~~").otherwise("```")
    name = F.when(language != "text", language).otherwise("")

    def block(first: Column) -> Column:
        last = F.least(first + size - 1, F.size(lines))
        inside = F.filter(positions, lambda s: (s["line"] >= first) & (s["line"] <= last))
        before = F.filter(positions, lambda s: s["line"] <= first)
        shown = F.when(F.size(inside) > 0, F.slice(inside, 1, BREADCRUMBS)).otherwise(F.slice(before, F.greatest(F.lit(1), F.size(before) - BEFORE + 1), F.lit(BEFORE)))
        crumbs = F.when(F.lit(metadata) & (F.size(shown) > 0), F.concat(F.lit("Symbol breadcrumbs: "), F.array_join(F.transform(shown, lambda s: s["symbol"]), ", "), F.lit("\n\n"))).otherwise("")
        title = F.concat(F.lit("\n## Lines "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("\n\n"))
        return F.concat(title, crumbs, fence, name, F.lit("\n"), F.array_join(F.slice(lines, first, F.lit(size)), "\n"), F.lit("\n"), fence)

    blocks = F.when(F.size(lines) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)), F.lit(size)), block)).otherwise(F.array().cast("array<string>"))
    head = F.array(*_head(path, language, path))
    more = F.concat(F.array(F.lit("")), metadata_lines(path, positions)) if metadata else F.array().cast("array<string>")
    return F.array_join(F.concat(head, more, blocks), "\n")


def as_pages(files: DataFrame, metadata: bool = True) -> DataFrame:
    """(path, language, n_symbols, page, card) of files(path, text): Markdown as it is, prose under its path, code in fenced blocks; card: the metadata alone."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    rows = files.select("path", text.alias("text"), language_of(path).alias("language"), lines_of(F.col("text")).alias("lines"))
    rows = rows.withColumn("positions", symbol_positions(F.col("lines"), F.col("language")))
    extension, language, positions = file_extension(path), F.col("language"), F.col("positions")
    prose = F.concat(F.lit("# "), path, F.lit("\n\n"), F.regexp_replace("text", r"^\s+|\s+$", ""))
    page = F.when(extension.isin(MARKDOWN), F.col("text")).when(extension.isin(PROSE), prose).otherwise(code_markdown(path, F.col("lines"), positions, language, metadata))
    card = F.array_join(F.concat(F.array(*_head(path, language, F.concat(F.lit("File metadata: "), path)), F.lit("")), metadata_lines(path, positions)), "\n")
    return rows.select("path", "language", F.size("positions").alias("n_symbols"), page.alias("page"), card.alias("card"))
