"""Texts shown to a model and the reading of its answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrank.fixed_values import NO_HITS, PASSAGE_CHARS, SUMMARY_CHARS, SUMMARY_HITS
from siftrank.functions.text import let


def permutation(answer: Column, n: Column) -> Column:
    """Order such as ``[2] > [1]`` as 1-based positions; positions left out follow in order.

    Numbers out of range and repeats are ignored; no answer keeps the order.
    """
    numbers = F.coalesce(
        F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), F.array().cast("array<string>")
    )
    asked = F.transform(numbers, lambda s: s.try_cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(let(
        F.array_distinct(F.filter(asked, lambda i: i.isNotNull() & (i >= 1) & (i <= n))),
        lambda kept: F.concat(kept, F.array_except(F.sequence(F.lit(1), n.cast("int")), kept)),
    ))


def shown(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; all of them for None."""
    return text if chars is None else F.substring(text, 1, chars)


def passages(texts: Column, chars: int | None = PASSAGE_CHARS) -> Column:
    """``[1] text`` lines for an ordered array of texts, each cut to ``chars`` (None: whole)."""
    lines = F.transform(texts, lambda text, at: F.concat(
        F.lit("["), (at + 1).cast("string"), F.lit("] "), shown(text, chars)
    ))
    return F.array_join(lines, "\n")


def ranking_prompt(query: Column, texts: Column, chars: int | None = PASSAGE_CHARS) -> Column:
    """Instruction that asks for the order of all passages."""
    n = F.size(texts).cast("string")
    return F.concat(
        F.lit("Rank the "), n, F.lit(" numbered products by how well they match the query: "), query,
        F.lit("\n\n"), passages(texts, chars), F.lit("\n\nAnswer with all "), n,
        F.lit(" identifiers, best first, in the form [2] > [1] > [3]."),
    )


def hits_summary(hits: Column, n: int | None = SUMMARY_HITS, chars: int | None = SUMMARY_CHARS) -> Column:
    """The first ``n`` hits (None: all) of an ordered ``array<struct<score, product_class, text>>``, one line each."""
    first = hits if n is None else F.slice(hits, 1, n)
    lines = F.transform(first, lambda hit, at: F.concat(
        (at + 1).cast("string"),
        F.lit(". score="), F.format_string("%.3f", hit["score"]),
        F.lit(" ["), F.coalesce(hit["product_class"], F.lit("Unknown")), F.lit("] "),
        shown(F.coalesce(hit["text"], F.lit("")), chars),
    ))
    return F.when(F.size(hits) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_HITS))
