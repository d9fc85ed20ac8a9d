"""Text columns: trimming, tokens, term counts, query cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrank.fixed_values import FILLERS, LEAD_INS, LEAD_INS_LEGACY, NO_TITLE_FOR


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Stripped text; null for an empty string or the word nan."""
    return F.regexp_substr(strip(text.cast("string")), F.lit(r"(?is)^(?!nan\z).+\z"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; empty for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def term_counts(words: Column) -> Column:
    """``array<struct<term, tf>>`` of one row's tokens, without a shuffle.

    Sorting puts equal words next to each other; each run's length is the
    distance between its start and the next one.
    """
    def runs(ordered: Column) -> Column:
        places = F.transform(ordered, lambda _, at: at)
        starts = F.filter(places, lambda at: (at == 0) | (F.get(ordered, at) != F.get(ordered, at - 1)))

        def measured(begin: Column) -> Column:
            return F.transform(begin, lambda at, nth: F.struct(
                F.get(ordered, at).alias("term"),
                (F.coalesce(F.get(begin, nth + 1), F.size(ordered)) - at).cast("long").alias("tf"),
            ))

        return let(starts, measured)

    return let(F.sort_array(words), runs)


def clean_query(query: Column, legacy: bool = False) -> Column:
    """Drop a conversational opening and filler words; keep the query if under two characters remain.

    An article at the end of an opening must be a whole word, so that
    "looking for antique mirror" keeps its "antique"; ``legacy=True`` also
    removes an article that is only the start of the next word.
    """
    phrases = LEAD_INS_LEGACY if legacy else LEAD_INS
    opening = r"(?iU)^\s*(?:" + "|".join(phrases) + r")\s*"
    without_opening = strip(F.regexp_replace(query, opening, ""))
    return let(
        strip(F.regexp_replace(without_opening, "(?iU)" + FILLERS, " ")),
        lambda short: F.when(F.length(short) >= 2, short).otherwise(query),
    )


def wants_title(query: Column) -> Column:
    """False for model numbers, media look-ups and single words."""
    words = F.size(F.filter(F.split(query, r"(?U)\s+"), lambda w: w != ""))
    return ~(F.rlike(query, F.lit("(?iU)" + NO_TITLE_FOR)) | (words <= 1))
