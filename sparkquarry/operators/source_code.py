"""Python source files as chunks that follow their definitions; other files in fixed line ranges."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators.chunking import LINES, line_ranges


def definitions(source: str) -> list[tuple[int, int, str]]:
    """(first line with decorators, last line, dotted name) of each function and class; a SyntaxError passes on."""
    found = []

    def walk(node: ast.AST, names: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = (*names, child.name)
                found.append((min([child.lineno, *(d.lineno for d in child.decorator_list)]), child.end_lineno, ".".join(own)))
                walk(child, own)
            else:
                walk(child, names)

    walk(ast.parse(source), ())
    return found


def owned_ranges(source: str) -> list[tuple[int, int, str]]:
    """Contiguous line ranges by innermost definition ('' outside); blank and comment lines go with what follows them."""
    lines = source.split("\n")
    owner = [""] * len(lines)
    for first, last, name in sorted(definitions(source), key=lambda d: (d[0], -d[1])):
        owner[first - 1 : last] = [name] * (last - first + 1)
    for i in range(len(lines) - 2, -1, -1):
        if not lines[i].strip() or lines[i].lstrip().startswith("#"):
            owner[i] = owner[i + 1]
    out, start = [], 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or owner[i] != owner[start]:
            out.append((start + 1, i, owner[start]))
            start = i
    return out


def chunk_source(files: DataFrame, size: int = LINES) -> DataFrame:
    """(path, first_line, last_line, symbol, content) of files(path, text); every line is in exactly one chunk.

    Files that aren't Python, and Python that doesn't parse, are cut every ``size`` lines with an empty symbol.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                lines = text.split("\n")
                try:
                    spans = owned_ranges(text)
                except (SyntaxError, ValueError, RecursionError):
                    spans = [(a, min(a + size - 1, len(lines)), "") for a in range(1, len(lines) + 1, size)]
                rows += [(path, a, b, name, "\n".join(lines[a - 1 : b])) for a, b, name in spans]
            yield pd.DataFrame(rows, columns=["path", "first_line", "last_line", "symbol", "content"])

    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    python = F.endswith("path", F.lit(".py"))
    parsed = files.where(python).mapInPandas(run, "path string, first_line long, last_line long, symbol string, content string")
    rest = line_ranges(files.where(~python), "path", "text", size).withColumn("symbol", F.lit(""))
    return parsed.unionByName(rest)
