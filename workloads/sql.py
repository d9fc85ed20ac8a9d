"""Pieces of SQL for DuckDB that describe the inputs and the expected results."""

from __future__ import annotations

from siftrank import fixed_values as fixed


def with_ctes(*parts: str) -> str:
    *ctes, final = parts
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + final


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' OR lower({strip(x)}) = 'nan' THEN NULL ELSE {strip(x)} END"


def distinct_list(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def text_of(*segments: str) -> str:
    known = "list_filter([" + ", ".join(clean(s) for s in segments) + "], lambda x: x IS NOT NULL)"
    return f"array_to_string({distinct_list(known)}, ' ')"


def bullets(x: str) -> str:
    return strip(rf"regexp_replace({x}, '[|\n\r]+', ' ', 'g')")


def colors(x: str) -> str:
    words = ", ".join(f"'{c}'" for c in fixed.BASE_COLORS)
    split = rf"string_split_regex(lower({strip(x)}), '[/,|&\-\s]+')"
    return f"coalesce({distinct_list(f'list_filter({split}, lambda w: w IN ({words}))')}, [])"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def clean_query(x: str, phrases: list[str] = fixed.LEAD_INS) -> str:
    opening = (r"^\s*(?:" + "|".join(phrases) + r")\s*").replace("'", "''")
    short = strip(f"regexp_replace({strip(f'''regexp_replace({x}, '{opening}', '', 'i')''')}, "
                  f"'{fixed.FILLERS}', ' ', 'gi')")
    return f"CASE WHEN length({short}) >= 2 THEN {short} ELSE {x} END"


EXAMPLES = """
examples AS (
  SELECT CAST(o_custkey AS VARCHAR) AS query_id, 'looking for a ' || p_name AS query,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CASE WHEN l_linestatus = 'F' THEN 'us' ELSE 'es' END AS product_locale,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ' exact ' WHEN '2' THEN 'S' WHEN '3' THEN 'complement'
              WHEN '4' THEN 'I' ELSE 'unknown' END AS esci_label,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS small_version,
         CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END AS split,
         l_orderkey * 8 + l_linenumber AS row_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""

ESCI_RAW = """
esci_raw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, locale AS product_locale, prefix || p_name AS product_title,
         p_type || ' part of size ' || p_size AS product_description,
         'Size: ' || p_size || '|' || chr(10) || 'Type: ' || p_type AS product_bullet_point,
         CASE WHEN p_size = 10 THEN 'nan' ELSE ' ' || p_brand || chr(9) END AS product_brand,
         replace(p_name, ' ', '/') || '-Gold, deep RED' AS product_color
  FROM part, (VALUES ('us', ''), ('es', 'pieza ')) AS l(locale, prefix))
"""

ESCI = """
esci AS (
  SELECT e.query_id, e.query, e.product_id, e.esci_label, e.split, e.row_no, p.product_title,
         p.product_description, p.product_bullet_point, p.product_brand, p.product_color
  FROM examples e LEFT JOIN esci_raw p ON e.product_id = p.product_id AND e.product_locale = p.product_locale
  WHERE e.small_version = 1 AND e.product_locale = 'us')
"""

WANDS_RAW = """
wands_raw AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS product_id, s_name AS product_name, n_name AS product_class,
         r_name || ' / ' || n_name AS category, 'Supplier in ' || n_name AS product_description,
         'Color:Red/Blue | Nation: ' || n_name || ' |note|Region :' || r_name || '| nation:last:' || n_name
           AS product_features,
         CASE WHEN s_acctbal > 9000 THEN 'nan' ELSE printf('%.1f', floor(s_acctbal / 100) / 10) END AS average_rating,
         ' ' || CAST(floor(s_acctbal) AS BIGINT) || '.75' AS review_count
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

WANDS = """
wands AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS query_id, 'great rugs from ' || lower(n_name) AS query, 'rugs' AS query_class,
         l_orderkey * 8 + l_linenumber AS id,
         CASE l_returnflag WHEN 'A' THEN 'Exact' WHEN 'N' THEN ' partial' ELSE 'Irrelevant' END AS label, p.*
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN wands_raw p ON p.product_id = CAST(l_suppkey AS VARCHAR))
"""


def split_ids(rows: str, name: str = "sides", share: float = 0.3, seed: int = 42) -> str:
    return f"""
{name} AS (
  SELECT query_id, CASE WHEN place <= floor(n * (1 - {share}e0)) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT query_id, row_number() OVER (ORDER BY md5('{seed}|' || query_id), query_id) AS place,
               count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM {rows})))
"""


GAIN_CASE = {
    "esci": """CASE upper({x}) WHEN 'EXACT' THEN 3.0 WHEN 'E' THEN 3.0 WHEN 'SUBSTITUTE' THEN 2.0 WHEN 'S' THEN 2.0
               WHEN 'COMPLEMENT' THEN 1.0 WHEN 'C' THEN 1.0 WHEN 'IRRELEVANT' THEN 0.0 WHEN 'I' THEN 0.0 END""",
    "wands": "CASE upper({x}) WHEN 'EXACT' THEN 2.0 WHEN 'PARTIAL' THEN 1.0 WHEN 'IRRELEVANT' THEN 0.0 END",
}


def qrels(name: str, rows: str, kind: str, label: str, prefix: str = "", where: str = "true",
          keep_irrelevant: bool = False, cap: int | None = fixed.JUDGED_PER_QUERY) -> str:
    gain = GAIN_CASE[kind].format(x=strip(label))
    least = "gain IS NOT NULL" if keep_irrelevant else "gain > 0"
    limit = f"WHERE place <= {cap}" if cap else ""
    return f"""
{name} AS (
  SELECT query_id, product_id, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, product_id) AS place FROM (
      SELECT '{prefix}' || query_id AS query_id, '{prefix}' || product_id AS product_id, max(gain) AS gain
      FROM (SELECT *, CAST({gain} AS DOUBLE) AS gain FROM {rows} WHERE {where}) WHERE {least} GROUP BY 1, 2)) {limit})
"""


SHOP_QRELS = qrels("shop_qrels", "examples", "esci", "esci_label")

SHOP_RUN = """
shop_run AS (
  SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS rank FROM shop_qrels)
"""


def esci_products(name: str, rows: str, order: str) -> str:
    return f"""
{name} AS (
  SELECT 'amz_' || product_id AS product_id, 'ESCI' AS source,
         {text_of('product_title', 'product_brand', bullets('product_bullet_point'), 'product_description')} AS full_text,
         {text_of('product_title', 'product_brand', f"array_to_string({colors('product_color')}, ' ')")} AS encode_text,
         lower({clean('product_brand')}) AS brand,
         array_to_string({colors('product_color')}, ',') AS color,
         CAST(NULL AS VARCHAR) AS product_class, CAST(NULL AS VARCHAR) AS category_path,
         CAST(NULL AS DOUBLE) AS average_rating, CAST(NULL AS BIGINT) AS review_count,
         {clean('product_title')} AS title, {clean('product_brand')} AS brand_text,
         {bullets(clean('product_bullet_point'))} AS bullets, {clean('product_description')} AS description
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {order}) AS first_row FROM {rows})
  WHERE first_row = 1)
"""


DECIMAL = r"regexp_matches({x}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
RATING = """CASE WHEN """ + DECIMAL + """ AND TRY_CAST({x} AS DOUBLE) BETWEEN 0 AND 5 THEN TRY_CAST({x} AS DOUBLE) END"""


def wands_products(name: str, rows: str, order: str) -> str:
    # The features of these rows are: Color, Nation (twice, the last one wins), Region.
    values = "'Red/Blue ' || 'last:' || product_class || ' ' || split_part(category, ' / ', 1)"
    return f"""
{name} AS (
  SELECT 'wands_' || product_id AS product_id, 'WANDS' AS source,
         {text_of('product_name', 'product_class', 'category', values, 'product_description')} AS full_text,
         {text_of('product_name', 'product_class', "'red blue'")} AS encode_text,
         CAST(NULL AS VARCHAR) AS brand, 'red,blue' AS color, product_class, category AS category_path,
         {RATING.format(x='average_rating')} AS average_rating,
         CAST(trunc(CAST({strip('review_count')} AS DOUBLE)) AS BIGINT) AS review_count,
         product_name AS title, CAST(NULL AS VARCHAR) AS brand_text, CAST(NULL AS VARCHAR) AS bullets,
         product_description AS description
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {order}) AS first_row FROM {rows})
  WHERE first_row = 1)
"""


PRODUCTS = [
    EXAMPLES, ESCI_RAW, ESCI, esci_products("esci_products", "esci", "row_no"),
    WANDS_RAW, WANDS, split_ids("wands"), "wands_split AS (SELECT wands.*, split FROM wands JOIN sides USING (query_id))",
    wands_products("wands_products", "wands_split", "id"),
]

MERGED_QRELS = [
    qrels("esci_train", "esci", "esci", "esci_label", "amz_", "split = 'train'"),
    qrels("esci_test", "esci", "esci", "esci_label", "amz_", "split = 'test'"),
    qrels("wands_train", "wands_split", "wands", "label", "wands_", "split = 'train'"),
    qrels("wands_test", "wands_split", "wands", "label", "wands_", "split = 'test'"),
]

DOCUMENTS = "docs AS (SELECT doc_id AS product_id, source, 'text' AS field, text FROM documents)"
TEXT_QUERIES = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

SHOP_PRODUCTS = [
    ESCI_RAW, esci_products("shop", "(SELECT * FROM esci_raw WHERE product_locale = 'us')", "product_id"),
]
SHOP_FIELDS = """docs AS (
  SELECT product_id, source, 'title' AS field, title AS text FROM shop
  UNION ALL SELECT product_id, source, 'brand_text', brand_text FROM shop
  UNION ALL SELECT product_id, source, 'bullets', bullets FROM shop
  UNION ALL SELECT product_id, source, 'description', description FROM shop)"""
SHOP_QUERIES = """asked AS (
  SELECT DISTINCT p_name || ' ' || lower(p_type) AS query_id,
         'I''m looking for a nice ' || p_name || ' ' || lower(p_type) AS query FROM part)"""


def bm25(boosts: dict[str, float], k: int, name: str = "lexical", asked: str = "asked", docs: str = "docs",
         source: str | None = None, tables: bool = True) -> str:
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}e0" for f, b in boosts.items()) + " END"
    where = f"WHERE source = '{source}'" if source else ""
    index = f"""
postings AS (
  SELECT field, term, product_id, source, count(*) AS tf FROM (
    SELECT field, product_id, source, unnest({tokens('text')}) AS term FROM {docs}) GROUP BY ALL),
lengths AS (SELECT field, product_id, sum(tf) AS dl FROM postings GROUP BY ALL),
stats AS (SELECT field, count(*) AS n_docs, sum(dl) / count(*) AS avgdl FROM lengths GROUP BY field),
frequency AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
saturated AS (
  SELECT field, term, product_id, source,
         {boost} * ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0))
           * tf / (tf + {fixed.BM25_K1}e0 * (1 - {fixed.BM25_B}e0 + {fixed.BM25_B}e0 * dl / avgdl)) AS part
  FROM postings JOIN lengths USING (field, product_id) JOIN frequency USING (field, term) JOIN stats USING (field)),
""" if tables else ""
    return index + f"""
{name}_words AS (SELECT query_id, unnest({tokens(clean_query('query'))}) AS term FROM {asked}),
{name}_scored AS (
  SELECT query_id, product_id, any_value(source) AS source, round(max(total), 6) AS score FROM (
    SELECT query_id, product_id, any_value(source) AS source, field, sum(part) AS total
    FROM {name}_words JOIN saturated USING (term) GROUP BY query_id, product_id, field)
  {where} GROUP BY query_id, product_id),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank
                 FROM {name}_scored) WHERE rank <= {k})
"""


def knn(k: int, products: str, asked: str, name: str = "dense", where: str = "true") -> str:
    """Vectors as lists in ``embedding``."""
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM (
      SELECT query_id, product_id, source,
             round((1 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) / 2, 6)
               AS score
      FROM {asked} q, {products} p WHERE {where})) WHERE rank <= {k})
"""


def word_vectors(name: str, rows: str, keys: str, text: str) -> str:
    """Words counted in 64 buckets, as a list; rows without words have no vector."""
    return f"""
{name} AS (
  SELECT {keys}, list_transform(range(64), lambda b: CAST(len(list_filter(buckets, lambda x: x = b)) AS DOUBLE))
           AS embedding
  FROM (SELECT {keys}, list_transform({tokens(text)},
               lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64) AS buckets FROM {rows})
  WHERE len(buckets) > 0)
"""


def candidates(pool: int, name: str = "found", lexical: str = "lexical", dense: str = "dense") -> str:
    return f"""
{name} AS (
  SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.product_id, d.product_id) AS product_id,
         coalesce(d.score, l.score) AS score, coalesce(d.source, l.source) AS source,
         CASE WHEN l.rank IS NULL THEN 1 ELSE 0 END AS leg, coalesce(l.rank, d.rank) AS rank
  FROM (SELECT * FROM {lexical} WHERE rank <= {pool}) l
  FULL OUTER JOIN (SELECT * FROM {dense} WHERE rank <= {pool}) d
    ON l.query_id = d.query_id AND l.product_id = d.product_id)
"""


def overlap(query: str, text: str) -> str:
    words = f"list_distinct({tokens(query)})"
    return f"coalesce(len(list_intersect({words}, {tokens(text)})) / nullif(len({words}), 0), 0)"


def rerank(k: int, name: str, texts: str, asked: str = "asked", found: str = "found", join: str = "JOIN") -> str:
    """``texts``: product_id, text; with a left join a candidate without one has an empty text."""
    text = "t.text" if join == "JOIN" else "coalesce(t.text, '')"
    return f"""
{name} AS (
  SELECT query_id, product_id, source, score, rank FROM (
    SELECT query_id, product_id, source, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leg, place) AS rank
    FROM (SELECT f.query_id, f.product_id, f.source, f.leg, f.rank AS place,
                 round({overlap('a.query', text)}, 6) AS score
          FROM {found} f JOIN {asked} a USING (query_id) {join} {texts} t USING (product_id))) WHERE rank <= {k})
"""


def listwise(k: int, name: str, texts: str, asked: str = "asked", found: str = "found") -> str:
    """The stand-in ranker orders by the overlap with what the prompt shows; scores stay."""
    return f"""
{name} AS (
  SELECT query_id, product_id, source, score, rank FROM (
    SELECT query_id, product_id, source, score,
           row_number() OVER (PARTITION BY query_id ORDER BY share DESC, leg, place) AS rank
    FROM (SELECT f.query_id, f.product_id, f.source, f.score, f.leg, f.rank AS place,
                 {overlap('a.query', f'substr(t.text, 1, {fixed.PASSAGE_CHARS})')} AS share
          FROM {found} f JOIN {asked} a USING (query_id) JOIN {texts} t USING (product_id))) WHERE rank <= {k})
"""


def rrf(k: int, name: str, runs: str, rrf_k: int = fixed.RRF_K) -> str:
    return f"""
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM (
    SELECT query_id, product_id, round(sum(1e0 / ({rrf_k} + rank)), 9) AS score FROM ({runs}) GROUP BY ALL))
  WHERE rank <= {k})
"""


def metrics(judged: str, run: str, ks: list[int], threshold: float = 1.0, gain: str = "linear",
            wanted: str = "true") -> list[str]:
    """Tables and final SELECT over ``judged(query_id, product_id, gain)`` and ``run(strategy, query_id, product_id, rank)``."""
    value = "gain" if gain == "linear" else "(pow(2, gain) - 1)"
    deepest = max(ks)
    rows = []
    for k in ks:
        rows += [
            ("mrr", k, f"CASE WHEN first_hit <= {k} THEN 1e0 / first_hit ELSE 0 END"),
            ("ndcg", k, f"coalesce(dcg{k} / nullif(ideal{k}, 0), 0)"),
            ("recall", k, f"coalesce(hits{k} / nullif(relevant, 0), 0)"),
        ]
    ideal = ", ".join(f"sum(CASE WHEN r <= {k} THEN {value} / log2(r + 1) END) AS ideal{k}" for k in ks)
    sums = ", ".join(
        f"sum(CASE WHEN rank <= {k} THEN {value} / log2(rank + 1) END) AS dcg{k}, "
        f"count(*) FILTER (gain >= {threshold} AND rank <= {k}) AS hits{k}" for k in ks
    )
    cases = ", ".join(
        f"{{'metric': '{metric}', 'k': {k}, 'value': CAST({formula} AS DOUBLE)}}" for metric, k, formula in rows
    )
    return [
        f"""ideals AS (
  SELECT query_id, {ideal}, count(*) FILTER (gain >= {threshold}) AS relevant FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, product_id) AS r FROM {judged}) GROUP BY 1)""",
        f"""hit_sums AS (
  SELECT strategy, query_id, min(rank) FILTER (gain >= {threshold}) AS first_hit, {sums}
  FROM {run} JOIN {judged} USING (query_id, product_id) WHERE rank <= {deepest} GROUP BY 1, 2)""",
        f"answered AS (SELECT DISTINCT strategy, query_id FROM {run} JOIN ideals USING (query_id))",
        f"""by_query AS (
  SELECT strategy, unnest([{cases}], recursive := true)
  FROM answered JOIN ideals USING (query_id) LEFT JOIN hit_sums USING (strategy, query_id))""",
        f"""
SELECT strategy, metric, k, round(sum(value) / (SELECT count(*) FROM ideals), 6) AS score,
       round(sum(value) / count(*), 6) AS score_answered,
       (SELECT count(*) FROM ideals) AS n_queries, (SELECT count(*) FROM ideals) - count(*) AS n_missing
FROM by_query WHERE {wanted} GROUP BY strategy, metric, k""",
    ]
