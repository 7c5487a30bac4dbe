"""Exact token counts by a given tokenizer file, and chunks that keep to a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 512


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text by the ``tokenizers`` JSON file at this path, which every worker must see; null has none."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer)
        made.encode_special_tokens = True
        for series in texts:
            yield pd.Series([len(e.ids) for e in made.encode_batch([t or "" for t in series], add_special_tokens=False)], dtype="int64")

    return count(text)


def fit_lines(files: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(path, first_line, last_line, tokens) of files(path, text): each range is the longest that keeps to the limit.

    A line that alone exceeds the limit is a range of its own.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer)
        made.encode_special_tokens = True

        def size(lines: list[str]) -> int:
            return len(made.encode("\n".join(lines), add_special_tokens=False).ids)

        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                lines, first = (text or "").split("\n"), 0
                while first < len(lines):
                    low, step = first + 1, 1
                    while low + step <= len(lines) and size(lines[first : low + step]) <= limit:
                        low, step = low + step, step * 2
                    high = min(low + step, len(lines) + 1)
                    while high - low > 1:
                        middle = (low + high) // 2
                        low, high = (middle, high) if size(lines[first:middle]) <= limit else (low, middle)
                    rows.append((path, first + 1, low, size(lines[first:low])))
                    first = low
            yield pd.DataFrame(rows, columns=["path", "first_line", "last_line", "tokens"])

    return files.select("path", "text").mapInPandas(run, "path string, first_line long, last_line long, tokens long")
