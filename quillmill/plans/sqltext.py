"""Pieces of DuckDB SQL that several equivalents share."""

from __future__ import annotations


def words(x: str) -> str:
    """The words of a text."""
    return f"regexp_extract_all(replace(lower(replace({x}, 'İ', 'i\u0307')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"


def norm(x: str) -> str:
    """The words joined by one space."""
    return f"array_to_string({words(x)}, ' ')"


def toks(x: str) -> str:
    """Tokens of the sparse retrievers."""
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(replace({x}, 'İ', 'i\u0307')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"
