"""Text normalisation shared by every operator that compares texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """NFKC and case folding; plain ASCII takes the short way to the same result."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores after NFKC and case folding; null has none."""
    return _WORD.findall(fold(text)) if text else []


@F.pandas_udf(StringType())
def normalize(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Exact form: the words of a text joined by one space; null stays null (B1)."""
    for s in texts:
        yield s.map(lambda x: None if x is None else " ".join(words_of(x)))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_native(c: Column | str) -> Column:
    """JVM-side form of :func:`normalize` for text that is already in NFKC form.

    Lower-casing and ``ß`` folding are built-ins, so the expression stays in generated code; texts in
    other Unicode forms need :func:`normalize`.
    """
    return F.array_join(words_native(c), " ")


def normalize_exact(c: Column | str) -> Column:
    """The result of :func:`normalize`; ASCII texts stay in the JVM, only the others go to Python."""
    c = _c(c)
    ascii_only = F.length(c) == F.octet_length(c)
    return F.when(ascii_only, normalize_native(c)).otherwise(normalize(F.when(~ascii_only, c)))


def words_native(c: Column | str) -> Column:
    """The words of :func:`normalize_native` as an array."""
    return F.regexp_extract_all(F.replace(F.lower(_c(c)), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
