"""Normalising, tokenising and screening of names and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a question as unsafe.
RESTRICTED_KEYWORDS = [
    "DELETE", "UPDATE", "MODIFY", "INSERT", "DROP", "ALTER", "ADD", "TRUNCATE", "DEL",
]

TOKEN = r"[\p{L}\p{N}_]+"


def normalize_name(name: Column) -> Column:
    """Lower case, without round brackets and outer blanks."""
    return F.trim(F.regexp_replace(F.trim(F.lower(name)), "[()]", ""))


def normalize_question(text: Column) -> Column:
    """Lower case, every run of whitespace one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def has_restricted_keyword(text: Column, keywords: list[str] = RESTRICTED_KEYWORDS) -> Column:
    """True when a keyword stands in the text as a whole word, in any case.

    The boundaries are spelled out because ``\\b`` in Java knows only ASCII letters.
    """
    edge = r"[^\p{L}\p{N}_]"
    return text.rlike(f"(?i)(^|{edge})({'|'.join(keywords)})({edge}|$)")


def has_high_score(scores: Column, limit: float = 0.6) -> Column:
    """True when any attribute score exceeds the limit; missing scores count as 0."""
    return F.coalesce(
        F.exists(F.map_values(scores), lambda s: F.coalesce(s, F.lit(0.0)) > limit),
        F.lit(False),
    )
