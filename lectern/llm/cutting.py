"""Problem 4: cut long texts at natural boundaries, with overlaps.

Recursive bisection: a span that is still too long is cut at the strongest
boundary near its midpoint, both halves are cut again while they exceed the
limit minus the overlap, and at last every piece but the first is given the end
of the piece before it.  Each text is cut on its own inside an Arrow batch, so
Spark may split the texts over tasks at will and no shuffle is needed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f"
#: Strengths of boundaries, strongest first.
KINDS = ("paragraph", "sentence", "word", "none")
PARAGRAPH = re.compile(r"\n[ \t\r\f]*\n[ \t\r\n\f]*|\r[ \t\f]*\r(?!\n)[ \t\r\f]*")
SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n\f]+")
WORD = re.compile(r"[ \t\r\n\f]+")


def boundaries(text: str) -> dict[int, int]:
    """Place after each boundary's white space -> strength (0 paragraph .. 2 word)."""
    found = {m.end(): 2 for m in WORD.finditer(text)}
    found.update((m.end(), 1) for m in SENTENCE.finditer(text))
    found.update((m.end(), 0) for m in PARAGRAPH.finditer(text))
    return found


def weakest_needed(text: str, limit: int) -> str:
    """The first kind at whose ends (and those of stronger kinds) alone the text
    falls into units of at most ``limit`` characters without outer white space."""
    places = sorted(boundaries(text).items())
    for kind in range(3):
        start, longest = 0, 0
        for place in [p for p, k in places if k <= kind] + [len(text)]:
            longest = max(longest, len(text[start:place].strip(BLANKS)))
            start = place
        if longest <= limit:
            return KINDS[kind]
    return KINDS[3]


def bisect(text: str, limit: int, overlap: int) -> list[str]:
    """Pieces of at most ``limit`` characters; each but the first begins with
    about the last ``overlap`` characters of the piece before it.

    A text of at most ``limit`` characters (without outer white space) is one
    piece; an empty one has none.  Without any white space the cut falls at the
    middle.  The overlap starts at a word where there is one.
    """
    body = text.strip(BLANKS)
    if len(body) <= limit:
        return [body] if body else []
    room = limit - overlap
    places = sorted(boundaries(body).items())
    at = [p for p, _ in places]
    kinds = [k for _, k in places]
    from bisect import bisect_left, bisect_right

    def cut(lo: int, hi: int):
        stack, spans = [(lo, hi)], []
        while stack:
            lo, hi = stack.pop()
            if len(body[lo:hi].strip(BLANKS)) <= room:
                spans.append((lo, hi))
                continue
            middle, reach = (lo + hi) // 2, max(1, (hi - lo) // 4)
            best = None
            i, j = bisect_right(at, lo), bisect_left(at, hi)
            near = range(bisect_left(at, middle - reach, i, j), bisect_right(at, middle + reach, i, j))
            # the strongest near the midpoint, of equal ones the nearest to it, then the first
            for n in near or range(i, j):
                rank = (kinds[n], abs(at[n] - middle), at[n]) if near else (abs(at[n] - middle), kinds[n], at[n])
                if best is None or rank < best[0]:
                    best = (rank, at[n])
            place = best[1] if best else middle
            stack += [(place, hi), (lo, place)]
        return spans

    spans = [s for s in cut(0, len(body)) if body[s[0] : s[1]].strip(BLANKS)]
    pieces = []
    for n, (lo, hi) in enumerate(spans):
        start = lo
        if n and overlap:
            # the overlap is cut from the text before, so that it reads on
            start = max(spans[n - 1][0], lo - overlap)
            k = bisect_left(at, start)
            if start > spans[n - 1][0] and k < len(at) and at[k] < lo:
                start = at[k]
        piece = body[start:hi].strip(BLANKS)
        pieces.append(piece)
    return pieces


def split_long(df: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Cut ``text`` of each row: ``keys``, piece_no (from 1), piece, boundary.

    ``boundary`` is the weakest kind of boundary that the row's text needs, null
    where the text is within the limit.  Rows whose text is null, empty or only
    white space have no pieces; repeated rows are the caller's matter; other
    columns are ignored, whatever their names.  Whole texts are cut, however
    long.  Each piece is at most ``limit`` characters without outer white space.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    source = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__text")).where(F.trim(F.translate("__text", "\t\r\n\f", "    ")) != "")
    schema = source.drop("__text").withColumns({"piece_no": F.lit(1), "piece": F.lit(""), "boundary": F.lit("").cast("string")}).schema
    for field in schema.fields:
        field.nullable = True

    def run(batches):
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            rows, number, piece, kind = [], [], [], []
            for i, t in enumerate(texts):
                parts = bisect(t, limit, overlap)
                need = weakest_needed(t, limit) if len(t.strip(BLANKS)) > limit else None
                rows += [i] * len(parts)
                number += range(1, len(parts) + 1)
                piece += parts
                kind += [need] * len(parts)
            left = batch.drop_columns(["__text"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(number, pa.int32()), pa.array(piece, pa.string()), pa.array(kind, pa.string())], [*left.schema.names, "piece_no", "piece", "boundary"])

    return source.mapInArrow(run, schema)
