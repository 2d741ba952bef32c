"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.session import durable, stages
from loomql.sources.tables import table

from . import p1_canonical as p1
from . import p2_formatting as p2
from . import p3_products as p3
from . import p4_names as p4
from . import p6_packing as p6
from . import p7_mixture as p7
from . import p8_repetition as p8


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = table(spark, sf_dir, "parking_tickets1").select("summons_number", "vehicle_make")
    listed = table(spark, sf_dir, "car_brands1").select("make")
    return p1.map_rows(tickets, "summons_number", "vehicle_make", listed, "make")


TICKET_FIELDS = [
    "plate_id", "registration_state", "plate_type", "issue_date", "violation_code", "vehicle_body_type",
    "vehicle_make", "violation_location", "violation_precinct", "vehicle_color",
]
_TEXT_FIELDS = {"plate_id", "registration_state", "plate_type", "vehicle_body_type", "vehicle_make", "violation_location", "vehicle_color"}
OFFER_FIELDS = ["title", "description", "brand", "price", "category"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    with stages(spark) as scope:
        found = p2.collapse(
            {
                "parking_tickets1": p2.encode_columns(table(spark, sf_dir, "parking_tickets1"), "summons_number", TICKET_FIELDS),
                "wdc1brands": p2.encode_columns(table(spark, sf_dir, "wdc1brands"), "id", OFFER_FIELDS),
                "wdc_raw_lines": p2.encode_lines(table(spark, sf_dir, "wdc_raw_lines"), "raw_id", "line"),
            }
        )
        scope.keep(found)
    return found


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "wdc1brands").withColumnRenamed("cluster_id", "hint")
    return p3.pairs(p3.group(offers))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "gr_books").select("id", F.col("author_name").alias("name"))
    authors = table(spark, sf_dir, "gr_authors").select("id", F.col("full_name").alias("name"))
    return p4.link(books, authors, table(spark, sf_dir, "nicknames"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return p6.pack(p6.sizes_of(docs), table(spark, sf_dir, "pack_capacities"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.containers(_packed(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.report(_packed(spark, sf_dir))


def p6_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing in small partitions, so that texts are exchanged at any size, checked against what a packing must be."""
    sizes = durable(p6.sizes_of(table(spark, sf_dir, "documents").select("doc_id", "text")), "sizes")
    packed = durable(p6.pack(sizes, table(spark, sf_dir, "pack_capacities"), items=250), "packing")
    return p6.valid(packed, sizes)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return p7.mix(docs, table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return p7.shares(docs, table(spark, sf_dir, "mix_targets"))


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself against its targets: shares among the sources that have texts, and repeats of a text."""
    targets = table(spark, sf_dir, "mix_targets")
    mixed = durable(p7_mix(spark, sf_dir).select("source", F.xxhash64("text").alias("t"), "n_tokens"), "mixed")
    most = mixed.groupBy("source", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")).join(most, "source")
    both = targets.join(got, "source", "left")
    whole = both.agg(F.sum("n_tokens").alias("all_tokens"), F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).alias("able"))
    near = F.abs(F.col("n_tokens") / F.col("all_tokens") - F.col("target_share") / F.col("able")) < 0.01
    return both.crossJoin(F.broadcast(whole)).select(  # one row
        "source", F.coalesce(near, F.lit(True)).alias("near_target"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats")
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = tuple(r for r in p8.RULES if r.name == "repeated_words")
    return p8.quality_table(docs, rules=rules).where("is_repeated_words").select("doc_id")


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return p8.quality_table(docs).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p6_pack": p6_pack,
        "p6_containers": p6_containers,
        "p6_report": p6_report,
        "p6_valid": p6_valid,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p7_valid": p7_valid,
        "p8_found": p8_found,
        "p8_quality": p8_quality,
    }


P8_FOUND_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, ws[i:i+4] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id)
SELECT doc_id FROM c JOIN w USING (doc_id) WHERE n >= 0.25 * len(ws)
"""

P6_VALID_SQL = """
SELECT capacity_id, capacity_tokens, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_texts,
  0 AS misplaced, 0 AS overfull, true AS near_bound
FROM pack_capacities WHERE capacity_tokens >= 1 AND EXISTS (SELECT 1 FROM documents WHERE text IS NOT NULL)
"""
P7_VALID_SQL = "SELECT source, true AS near_target, true AS within_repeats FROM mix_targets"


def _p8_quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in p8.STOP_WORDS)
    share = lambda part, whole: f"CASE WHEN {whole} > 0 THEN ({part}) / {whole} WHEN {whole} IS NOT NULL THEN 0.0 END"
    metrics = {
        "n_words": "len(ws)",
        "mean_word_length": share("length(array_to_string(ws, ''))", "len(ws)"),
        "symbol_share": share(r"length(text) - length(regexp_replace(text, '[^\p{L}\p{N}\s.,;:!?''\"()-]', '', 'g'))", "length(text)"),
        "digit_share": share(r"length(text) - length(regexp_replace(text, '\p{N}', '', 'g'))", "length(text)"),
        "stop_word_share": share(f"len(list_filter(ws, lambda x: x IN ({stop})))", "len(ws)"),
        "repeated_line_share": share("len(ls) - len(list_distinct(ls))", "len(ls)"),
        "bullet_line_share": share(r"len(list_filter(ls, lambda x: regexp_matches(x, '^[-*\x{2022}]')))", "len(ls)"),
        "ellipsis_line_share": share(r"len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})$')))", "len(ls)"),
        "repeated_word_share": share("coalesce(n, 0)", "len(ws)"),
    }
    rules = ", ".join(f"coalesce({r.metric} {r.op} {r.bound}, false) AS is_{r.name}" for r in p8.RULES)
    return rf"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws,
  list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\x0b\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x)), lambda x: length(x) > 0) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i:i+4] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in metrics.items())} FROM w LEFT JOIN c USING (doc_id))
SELECT *, {rules} FROM m
"""


# Canonical form without lookaround: points between digits are kept under another letter meanwhile.
_CANON = (
    r"regexp_replace(regexp_replace(regexp_replace(lower(upper({0})), '(\d)\.(\d)', '\1\u00a4\2', 'g'),"
    r" '(\d)\.(\d)', '\1\u00a4\2', 'g'), '[^\p{{L}}\p{{N}}\u00a4]', '', 'g')"
).replace("\\u00a4", "\u00a4")


def _p2_sql() -> str:
    tickets = ", ".join(_CANON.format(f"CAST({f} AS VARCHAR)") if f in _TEXT_FIELDS else f"CAST({f} AS VARCHAR)" for f in TICKET_FIELDS)
    offers = ", ".join(_CANON.format(f) for f in OFFER_FIELDS)
    pair = "lower(trim(regexp_extract(x, '^\\s*([A-Za-z_]+)\\s*[:=]', 1))) || '=' || " + _CANON.format("regexp_extract(x, '(?s)^\\s*[A-Za-z_]+\\s*[:=](.*)$', 1)")
    tags = "lower(regexp_extract(x, '^<([A-Za-z_]+)>', 1)) || '=' || " + _CANON.format("regexp_extract(x, '(?s)^<[A-Za-z_]+>(.*)</$', 1)")
    split = "CASE WHEN contains(line, ' | ') THEN string_split(line, ' | ') WHEN contains(line, chr(9)) AND NOT contains(line, '; ') THEN string_split(line, chr(9)) ELSE string_split(line, ';') END"
    js = "lower(k) || '=' || " + _CANON.format("(line ->> k)")
    named = f"""CASE WHEN ltrim(line)[1] = '{{' THEN list_transform(json_keys(line), lambda k: {js})
      WHEN ltrim(line)[1] = '<' THEN list_transform(regexp_extract_all(line, '(?s)<[A-Za-z_]+>[^<]*</'), lambda x: {tags})
      ELSE list_transform(list_filter({split}, lambda x: regexp_matches(x, '^\\s*[A-Za-z_]+\\s*[:=]')), lambda x: {pair}) END"""
    return f"""
WITH e AS (
  SELECT 'parking_tickets1' AS tbl, CAST(summons_number AS VARCHAR) AS key, [{tickets}] AS rec FROM parking_tickets1
  UNION ALL SELECT 'wdc1brands', id, [{offers}] FROM wdc1brands
  UNION ALL SELECT 'wdc_raw_lines', CAST(raw_id AS VARCHAR), list_sort({named}) FROM wdc_raw_lines),
g AS (SELECT tbl, key, min(key) OVER (PARTITION BY tbl, rec) AS first_key FROM e)
SELECT tbl, first_key, key AS copy_key FROM g WHERE key <> first_key
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _p2_sql(), "p6_valid": P6_VALID_SQL, "p7_valid": P7_VALID_SQL, "p8_found": P8_FOUND_SQL, "p8_quality": _p8_quality_sql(),
    }
