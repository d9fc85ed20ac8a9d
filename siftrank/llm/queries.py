"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.llm import (
    hamming_search, huffman_ids, jaccard_join, language_id, packing, periodic_runs, quality_rules, sentencepiece_bpe, sharding,
    suffix_dedup, token_counts, warc_zip, whitening,
)

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _quality_sql() -> str:
    """The measures, the counted cutoffs and the exact test, with the operator's own figures."""
    own = quality_rules
    steps = ", ".join(f"('{rule}', {i}, {c}::double)" for rule, cuts in own.RULES.items() for i, c in enumerate(cuts))
    words, blank = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]"
    fires = " or ".join(f"coalesce(f.{rule} > c.cut_{rule}, false)" for rule in own.RULES)
    cuts = ", ".join(f"min(case when rule = '{rule}' then cutoff end) as cut_{rule}" for rule in own.RULES)
    value = " ".join(f"when '{rule}' then {rule}" for rule in own.RULES)
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t,
             regexp_extract_all(coalesce(text, ''), '{words}') as w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{words}')) as lines
           from documents),
v as (select rid, unnest(list_transform(range(0, greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) as win,
        unnest(range(0, greatest(len(w) - 4, 0))) as p from d),
twice as (select rid, p from (select *, count(*) over (partition by rid, win) as n from v) where n > 1),
steps as (select rid, least(5, coalesce(lead(p) over (partition by rid order by p) - p, 5)) as n from twice),
cover as (select rid, sum(n)::bigint as n from steps group by rid),
m as (select d.rid, doc_id, lang, len(w)::bigint as n_words,
        length(regexp_replace(t, '{blank}', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
        coalesce(cover.n, 0) as n_repeat_words,
        length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) as n_upper,
        length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) as n_letters
      from d left join cover using (rid)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        case when word_chars > 0 then n_symbols::double / word_chars else 0 end as symbol_share,
        case when n_letters > 0 then n_upper::double / n_letters else 0 end as upper_share,
        case when n_words > 0 then n_repeat_words::double / n_words else 0 end as repeat_share,
        case when n_lines > 0 then n_dup_lines::double / n_lines else 0 end as dup_line_share from m),
marks as (select doc_id, min(quality) as q from labels group by doc_id
          having min(quality) = max(quality) and min(quality) in (0, 1)),
l as (select f.*, q = 1 as good, substr(md5(doc_id::varchar), 1, 1) >= '8' as prove
      from f join marks using (doc_id) where not base_failed),
e as (select lang, good, prove, rule, step, cutoff, (case rule {value} end) > cutoff as fires
      from l, (values {steps}) as s(rule, step, cutoff)),
c0 as (select lang, rule, step, any_value(cutoff) as cutoff, count(*) filter (good and prove) as n,
         count(*) filter (fires and not good and not prove) as bad,
         count(*) filter (fires and good and not prove) as lost,
         count(*) filter (fires and good and prove) as k from e group by lang, rule, step),
c1 as (select *, bad - {own.COST} * lost as gain from c0),
c2 as (select *, first(step) over (partition by lang, rule order by gain desc, step) as aim,
         max(gain) over (partition by lang, rule) as most from c1),
c3 as (select *, {own.ALPHA}::double / count(*) filter (step = 0) over (partition by lang) as share,
         count(*) filter (step = 0) over () as tests from c2 where most > 0),
c4 as (select *, k < n * share and list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1)
         - lgamma(n - j + 1) + j * ln(share) + (n - j) * ln(1 - share)))) <= {own.DELTA} / greatest(tests, 1) as proven
       from c3 where step <= aim),
c5 as (select *, bool_and(coalesce(proven, false)) over (partition by lang, rule order by step) as open from c4),
cuts as (select lang, {cuts} from c5 where open group by lang)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not ({fires}) as kept
from f left join cuts c on f.lang is not distinct from c.lang
"""


@query("op1_quality_rules", _quality_sql())
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.quality_rules(docs, table(spark, sf, "labels"), drop_text=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf, "documents"))


@query("op3_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_sharding")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents"))


@query("op7_hamming_search")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return hamming_search.nearest(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepiece_bpe.piece_digests(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_huffman_ids")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    manifest = huffman_ids.coded_ids(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return huffman_ids.read_ids(manifest, digest=True)


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as top from s)
select page_id, payload_bytes, payload_digest,
  case when top > page_id then 'revisit' else 'response' end as record_type,
  case when top > page_id then top end as refers_to
from m
"""


@query("op10_warc", OP10_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return warc_zip.warc_round_trip(table(spark, sf, "pages"))


@query("op11_token_counts")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query("op12_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"), components=4, scale=256)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.collapse_runs(periodic_runs.plant_repeats(table(spark, sf, "documents")), digest=True)
