"""Quality rules whose cutoffs are chosen under a proven risk.

Every text is measured; each rule fires where one of its shares exceeds a
cutoff.  Cutoffs come from labelled documents, for each stratum on its own: one
half of them proposes, per rule, the cutoff that catches most bad documents
for the good ones it costs; the other half must prove it.  A cutoff is proven if
the exact binomial test rejects that good documents fire more often than the
rule's part of the tolerated rate.  Cutoffs of a rule are tested from the
loosest to the tightest until one fails (a fixed sequence, which needs no
correction); the error level is divided by the number of rules proposed in all
strata, the tolerated rate by those proposed in the stratum.  So
with probability ``1 - DELTA``, in no stratum more than ``ALPHA`` of the good
documents that pass the base checks are rejected.  A stratum with too few
labels proves nothing and keeps all that passes the base checks.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.common import named, whole_text, without
from siftrank.scratch import materialize

ALPHA = 0.05   # good documents of a stratum that may be rejected
DELTA = 0.05   # chance that this is exceeded anywhere
COST = 20      # bad documents that must be caught for each good one lost
SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 5     # words of a repeat

# Each rule's cutoffs, from the loosest to the tightest.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "upper_share": (0.9, 0.7, 0.5, 0.35, 0.25),
    "repeat_share": (0.15, 0.1, 0.05),
    "dup_line_share": (0.8, 0.6, 0.4, 0.3),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *RULES]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measures; columns of these names are replaced.  A null text has no words."""
    kept = without(docs, [*MEASURES, "_text", "_words", "_hashes", "_lines", "_twice", "_windows", "_places"])
    rows = kept.select("*", whole_text(named(docs, text)).alias("_text"))
    bare = F.btrim("_text", F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumns({
        "_words": F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+")),
        "_lines": F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != ""),
    })
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.char_length("_text") - F.regexp_count("_text", F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "upper_share": _share(F.regexp_count("_text", F.lit("\\p{Lu}")), F.regexp_count("_text", F.lit("\\p{L}"))),
        "_n_lines": F.size("_lines"),
        # One hash per window of words: if all differ, no window repeats.
        "_hashes": F.when(F.size("_words") > WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("_words") - WINDOW),
            lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(WINDOW)]))),
    }).drop("_lines", "_text")
    rows = rows.withColumn("_twice", F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False)))
    # Only where hashes meet are the windows themselves compared, in order.
    rows = rows.withColumn("_windows", F.when(F.col("_twice"), F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size("_words") - WINDOW),
        lambda i: F.struct(F.array_join(F.slice("_words", i + 1, WINDOW), " ").alias("w"), i.alias("i")))))).drop("_words", "_hashes")
    same = lambda i, j: F.get("_windows", i)["w"] == F.get("_windows", j)["w"]
    rows = rows.withColumn("_places", F.when(F.col("_twice"), F.sort_array(F.transform(F.filter(
        F.sequence(F.lit(0), F.size("_windows") - 1),
        lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
        lambda i: F.get("_windows", i)["i"])))).drop("_windows")
    covered = F.aggregate(
        "_places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda had, i: F.struct((i + WINDOW).alias("end"), (had["n"] + i + WINDOW - F.greatest(had["end"], i)).alias("n")),
        lambda had: had["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_twice", "_places")
    return rows.select(
        *[named(kept, c) for c in kept.columns], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        _share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"), "upper_share",
        _share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        _share(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_share"))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of n trials, summed in logarithms from the smallest term on; exact up to rounding."""
    odds = p / (1 - p)
    first = n * F.log(1 - p)
    step = lambda had, j: F.struct(
        (had["term"] + F.log((n - j + 1) / j * odds)).alias("term"),
        (F.greatest(had["sum"], had["term"] + F.log((n - j + 1) / j * odds))
         + F.log1p(F.exp(-F.abs(had["sum"] - had["term"] - F.log((n - j + 1) / j * odds))))).alias("sum"))
    start = F.struct(first.alias("term"), first.alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.exp(F.aggregate(steps, start, step, lambda had: had["sum"]))


def labelled_counts(measured: DataFrame, labels: DataFrame, strata: list[str], doc_id: str) -> DataFrame:
    """Per stratum: n good documents in the proving half, and for each rule and cutoff who fires."""
    marks = labels.groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    marks = marks.filter("lo = hi and lo in (0, 1)").select("_label_id", (F.col("lo") == 1).alias("_good"))
    own = measured.filter(~F.col("base_failed")).select(
        *[named(measured, s).alias(f"_s{i}") for i, s in enumerate(strata)], *RULES, named(measured, doc_id).alias("_id"))
    joined = own.join(marks, F.col("_id") == F.col("_label_id")).withColumn(
        "_prove", F.substring(F.md5(F.col("_id").cast("string")), 1, 1) >= "8")
    count = lambda which: F.sum(which.cast("long"))
    sums, steps = [], []
    for rule, cutoffs in RULES.items():
        for i, cutoff in enumerate(cutoffs):
            fires = F.col(rule) > cutoff
            name = f"{rule}_{i}"
            sums += [count(fires & ~F.col("_good") & ~F.col("_prove")).alias(f"{name}_bad"),
                     count(fires & F.col("_good") & ~F.col("_prove")).alias(f"{name}_good"),
                     count(fires & F.col("_good") & F.col("_prove")).alias(f"{name}_k")]
            steps.append(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cutoff).alias("cutoff"),
                                  F.col(f"{name}_bad").alias("bad"), F.col(f"{name}_good").alias("good"),
                                  F.col(f"{name}_k").alias("k")))
    keys = [f"_s{i}" for i in range(len(strata))]
    counted = joined.groupBy(*keys).agg(count(F.col("_good") & F.col("_prove")).alias("n"), *sums)
    return counted.select(*keys, "n", F.explode(F.array(*steps)).alias("_step")).select(*keys, "n", "_step.*")


def proposed(counts: DataFrame, strata: int, alpha: float = ALPHA) -> DataFrame:
    """The cutoffs of rules that the first half proposes, up to the one that gains most, with each rule's tolerated rate."""
    keys = [f"_s{i}" for i in range(strata)]
    rows = counts.withColumn("gain", F.col("bad") - COST * F.col("good"))
    rows = rows.withColumn("aim", F.max(F.struct("gain", (-F.col("step")).alias("turn"))).over(Window.partitionBy(*keys, "rule")))
    rows = rows.filter(F.col("aim.gain") > 0)
    rules = F.sum(F.when(F.col("step") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.lit(alpha) / rules).filter(F.col("step") <= -F.col("aim.turn"))


def cutoffs_of(steps: DataFrame, strata: int, tests: int, delta: float = DELTA) -> DataFrame:
    """The proven cutoffs: one row per stratum, one column per rule, null where a rule is not used."""
    keys = [f"_s{i}" for i in range(strata)]
    few = F.col("k") < F.col("n") * F.col("share")
    proven = few & (F.when(few, binomial_cdf(F.col("k"), F.col("n"), F.col("share"))) <= delta / max(tests, 1))
    rows = steps.withColumn("proven", F.coalesce(proven, F.lit(False)))
    line = Window.partitionBy(*keys, "rule").orderBy("step")
    rows = rows.withColumn("open", F.min(F.col("proven").cast("int")).over(line) == 1).filter("open")
    return rows.groupBy(*keys).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judge(measured: DataFrame, cutoffs: DataFrame, strata: list[str]) -> DataFrame:
    """``measured`` with ``kept``; a column of this name is replaced."""
    rows = without(measured, ["kept"])
    same = reduce(lambda a, b: a & b, [named(rows, s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)], F.lit(True))
    fires = reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES])
    joined = rows.join(cutoffs, same, "left")
    return joined.select(*[named(rows, c) for c in rows.columns], (~F.col("base_failed") & ~fires).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, strata: tuple[str, ...] = ("lang",), doc_id: str = "doc_id",
                  text: str = "text", drop_text: bool = False, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` with the measures and ``kept``.

    ``labels`` has doc_id and quality (0 or 1); documents whose labels disagree
    or are null are not used.  Null strata are a stratum; without labels only
    the base checks reject; an empty table stays empty.
    """
    measured = measure(docs, text)
    if drop_text:
        measured = measured.drop(named(measured, text))
    measured = materialize(measured, "quality_measures")
    counts = labelled_counts(measured, labels, list(strata), doc_id)
    steps = materialize(proposed(counts, len(strata), alpha), "quality_steps")
    cutoffs = materialize(cutoffs_of(steps, len(strata), steps.filter("step = 0").count(), delta), "quality_cutoffs")
    return judge(measured, cutoffs, list(strata))


def kept_documents(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    own = docs.columns
    packed = docs.select(F.struct(*[named(docs, c) for c in own]).alias("_row"), *[
        named(docs, c).alias(c) for c in dict.fromkeys([*options.get("strata", ("lang",)), options.get("doc_id", "doc_id"),
                                                        options.get("text", "text")])])
    judged = quality_rules(packed, labels, drop_text=True, **options)
    return judged.filter("kept").select("_row.*")
