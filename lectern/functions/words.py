"""Folding text to plain words, the same everywhere in the library."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = re.compile(r"[^\W_]+")
SPACE = " \t\r\n\f\v "


def fold(text: str) -> str:
    """Lower case, accents and compatibility forms folded to plain characters."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFKD", text)
    return unicodedata.normalize("NFKD", "".join(c for c in plain if not unicodedata.combining(c)).lower())


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text; none for null."""
    return RUN.findall(fold(text)) if text else []


@F.pandas_udf(T.StringType())
def folded_words(text: pd.Series) -> pd.Series:
    """The words of each text joined by one space; null stays null."""
    return text.map(lambda x: None if x is None else " ".join(words(x)))


def tidy(column):
    """Trimmed and in lower case; blank becomes null."""
    clean = F.lower(F.expr(f"trim(BOTH '{SPACE}' FROM {column})") if isinstance(column, str) else F.trim(column))
    return F.when(clean != "", clean)
