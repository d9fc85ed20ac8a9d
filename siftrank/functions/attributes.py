"""Product attributes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrank.fixed_values import BASE_COLORS, COLOR_SEPARATORS, RATING_RANGE
from siftrank.functions.text import clean, strip

DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def brand(raw: Column) -> Column:
    return F.lower(clean(raw))


def colors(raw: Column) -> Column:
    """Known colour words in first-seen order; empty for null."""
    words = F.split(F.lower(strip(raw)), COLOR_SEPARATORS)
    known = F.array_distinct(F.filter(words, lambda w: w.isin(BASE_COLORS)))
    return F.coalesce(known, F.array().cast("array<string>"))


def number(raw: Column) -> Column:
    """A decimal number as a double; null for suffixes and other forms that only a cast would take."""
    text = strip(raw.cast("string"))
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def rating(raw: Column) -> Column:
    value = number(raw)
    return F.when(value.between(*RATING_RANGE), value)


def count(raw: Column) -> Column:
    """Whole part of a number; null when it is not one, not finite or too large."""
    return number(raw).try_cast("bigint")


def features(raw: Column) -> Column:
    """``key:value|key:value`` as a map in order of first key; the last value of a key wins."""
    pairs = F.filter(
        F.transform(F.split(raw, r"\|"), lambda p: F.struct(
            F.lower(strip(F.substring_index(p, ":", 1))).alias("key"),
            strip(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1)).alias("value"),
        )),
        lambda p: (p["key"] != "") & (p["value"] != ""),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.struct(
        k.alias("key"),
        F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"),
    ))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def text_of(*segments: Column) -> Column:
    """Segments in order, without null, empty, nan and exact repeats, joined by a space."""
    known = F.array_compact(F.array(*[clean(s) for s in segments]))
    return F.array_join(F.array_distinct(known), " ")


def bullets(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, r"[|\n\r]+", " "))


def gain(label: Column, gains: dict[str, float]) -> Column:
    """Gain of a label in any case and with surrounding space; null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in gains.items() for x in pair])
    return F.try_element_at(table, F.upper(strip(label.cast("string"))))
