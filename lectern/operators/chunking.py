"""Pack the sentences of documents into chunks of bounded size with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CUT = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9(])")


def pack(units: list[str], words: int, chars: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Half-open ranges of sentences.  A chunk takes sentences while it stays
    within both limits (a longer sentence is a chunk of its own); the next one
    starts as many sentences back as hold at most ``overlap`` words; a last
    chunk shorter than ``least`` characters joins the one before."""
    sizes = [(len(u.split()), len(u)) for u in units]
    out, start = [], 0
    while start < len(units):
        end, w, c = start, 0, 0
        while end < len(units) and (end == start or (w + sizes[end][0] <= words and c + 1 + sizes[end][1] <= chars)):
            w, c, end = w + sizes[end][0], c + 1 + sizes[end][1], end + 1
        out.append((start, end))
        if end == len(units):
            break
        back, kept = end, 0
        while back - 1 > start and kept + sizes[back - 1][0] <= overlap:
            back, kept = back - 1, kept + sizes[back - 1][0]
        start = back
    if len(out) > 1 and sum(sizes[i][1] + 1 for i in range(*out[-1])) - 1 < least:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def chunk_documents(df: DataFrame, key: str, text: str, words: int = 850, chars: int = 5000, overlap: int = 125, least: int = 400) -> DataFrame:
    """(key, chunk_index, text, word_count, char_count) of each document, rows on
    their own: no shuffle.  Null and blank texts have no chunks."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t in zip(part[key], part[text]):
                units = [u for u in CUT.split(" ".join((t or "").split())) if u]
                for i, (a, b) in enumerate(pack(units, words, chars, overlap, least)):
                    whole = " ".join(units[a:b])
                    rows.append((k, i, whole, len(whole.split()), len(whole)))
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "text", "word_count", "char_count"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, text string, word_count int, char_count int")
