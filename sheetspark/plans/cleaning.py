"""Cleaning, types and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import chart, clean, dates, filters, joins, reshape, types
from .registry import Tables, query


def dirty_events(t: Tables):
    """Events with null and blank types and infinite values."""
    return t.events.select(
        "event_id",
        F.expr("CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS event_type"),
        F.expr("CASE WHEN event_id % 13 = 0 THEN double('infinity') ELSE value END AS value"),
    )


DIRTY_SQL = """dirty AS (SELECT event_id,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS event_type,
  CASE WHEN event_id % 13 = 0 THEN CAST('infinity' AS DOUBLE) ELSE value END AS value FROM events)"""


def text_values(t: Tables):
    """Event ids as text, with error texts and blanks."""
    return t.events.selectExpr(
        "event_id",
        "CASE WHEN event_id % 17 = 0 THEN '#N/A' WHEN event_id % 19 = 0 THEN '' ELSE string(event_id) END AS v",
        "string(value) AS price",
        "event_type AS kind",
    )


TEXT_SQL = """tv AS (SELECT event_id,
  CASE WHEN event_id % 17 = 0 THEN '#N/A' WHEN event_id % 19 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS v,
  CAST(value AS VARCHAR) AS price, event_type AS kind FROM events)"""


@query(
    """
WITH m AS (
  SELECT coalesce(n_name, '') AS n_name, strftime(o_orderdate, '%Y-%m') AS order_month, o_orderstatus AS s, o_totalprice AS p
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT n_name, order_month,
  sum(CASE WHEN s = 'F' THEN p ELSE 0 END) AS f, sum(CASE WHEN s = 'O' THEN p ELSE 0 END) AS o,
  sum(CASE WHEN s = 'P' THEN p ELSE 0 END) AS q FROM m GROUP BY ALL)
SELECT n_name, order_month, round(f / (f + o + q) * 100, 4) AS filled_share,
  round(o / (f + o + q) * 100, 4) AS open_share, round(q / (f + o + q) * 100, 4) AS partial_share FROM g"""
)
def flagship_share(t: Tables):
    cleaned = clean.clean(
        t.orders.select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus"), lowercase_columns=["o_orderstatus"]
    )
    customers = t.customer.select("c_custkey", "c_nationkey")
    mapped = joins.map_columns(cleaned, customers, {"o_custkey": "c_custkey"}, fill=None)
    named = joins.map_columns(mapped, t.nation.select("n_nationkey", "n_name"), {"c_nationkey": "n_nationkey"}, fill=None)
    dated = dates.add_date_columns(named, ["o_orderdate"]).withColumnRenamed("o_orderdate_month_year", "order_month")
    series = {"filled_share": "f", "open_share": "o", "partial_share": "p"}
    wide = dated.select(
        "n_name", "order_month", *[F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).alias(n) for n, s in series.items()]
    )
    sums = chart.chart_aggregate(wide, ["n_name", "order_month"], list(series))
    shares = reshape.stacked100(sums, ["n_name", "order_month"], list(series))
    return shares.select("n_name", "order_month", *[F.round(n, 4).alias(n) for n in series])


@query(
    """SELECT p_partkey, replace(lower(p_name), ' ', '') AS p_name, replace(replace(p_brand, '#', ''), 'B', '') AS p_brand,
  lower(p_type) AS p_type FROM part"""
)
def clean_text(t: Tables):
    return clean.clean(
        t.part.select("p_partkey", "p_name", "p_brand", "p_type"),
        lowercase_columns=["p_name", "p_type", "no_such_column"],
        remove_spaces_columns=["p_name"],
        remove_special_chars={"p_brand": {"#": True, "B": True, "a": False}},
    )


@query(
    r"""SELECT doc_id, trim(regexp_replace(text,
  '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text
  FROM documents"""
)
def collapse_whitespace(t: Tables):
    return clean.collapse_ws(t.documents.select("doc_id", "text"), ["text"])


@query(
    f"""WITH {DIRTY_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(event_type, 'NA') AS event_type,
  CASE WHEN isinf(value) THEN 'NA' ELSE CAST(value AS VARCHAR) END AS value FROM dirty"""
)
def fill_na(t: Tables):
    return clean.fill_missing(dirty_events(t))


@query(f"WITH {DIRTY_SQL} SELECT event_id, CASE WHEN NOT isinf(value) THEN value END AS value FROM dirty")
def null_inf(t: Tables):
    return clean.null_infinite(dirty_events(t).select("event_id", "value"))


@query(
    """SELECT o_orderkey, round_even(o_totalprice * 0.07 * 100, 0) / 100 AS tax,
  round_even(o_totalprice / 3 * 100, 0) / 100 AS third FROM orders"""
)
def round_numeric(t: Tables):
    return clean.round_numeric(t.orders.selectExpr("o_orderkey", "o_totalprice * 0.07D AS tax", "o_totalprice / 3 AS third"))


@query(
    """SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END AS ts,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS kind, CAST(value AS VARCHAR) AS value,
  CASE WHEN value > 10 THEN 'True' ELSE 'False' END AS high, '[' || event_id || ',' || user_id || ']' AS ids FROM events"""
)
def export_text(t: Tables):
    source = t.events.select(
        "event_id",
        "ts",
        F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('Period_', event_type) END AS kind"),
        "value",
        (F.col("value") > 10).alias("high"),
        F.array("event_id", "user_id").alias("ids"),
    )
    return clean.export_text(source)


@query("SELECT event_id AS \"event id\", value AS value_usd, event_type AS kind FROM events")
def sanitize_names(t: Tables):
    renamed = t.events.selectExpr("event_id AS `event\nid`", "value AS ` Period_value/usd`", "event_type AS `period_kind\r`")
    return clean.sanitize_names(renamed)


@query(
    """SELECT CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS nation, s_name,
  'suppliers.csv' AS source_sheet FROM supplier"""
)
def project_columns(t: Tables):
    source = t.supplier.selectExpr("s_suppkey", "s_name", "CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey END AS ` nation `")
    keyed = clean.stringify_keys(clean.trim_names(source), ["nation"])
    return clean.add_constant(clean.select_in_order(keyed, ["nation", "s_name"]), "source_sheet", "suppliers.csv")


@query(
    f"""WITH {TEXT_SQL}, f AS (SELECT
  arg_min(v, event_id) FILTER (v <> '' AND v NOT IN ('#VALUE!', '#N/A', '#DIV/0!', '#REF!', '#NAME?', '#NULL!', '#NUM!')) AS v,
  arg_min(price, event_id) FILTER (price <> '') AS price, arg_min(kind, event_id) FILTER (kind <> '') AS kind FROM tv),
l AS (SELECT 'v' AS "column", v AS x FROM f UNION ALL SELECT 'price', price FROM f UNION ALL SELECT 'kind', kind FROM f)
SELECT "column", CASE WHEN x IS NULL THEN 'Unknown' WHEN regexp_full_match(x, '\\d+') THEN 'int'
  WHEN regexp_full_match(x, '\\d+\\.\\d*|\\.\\d+') THEN 'float' ELSE 'str' END AS column_type FROM l"""
)
def sniff_types(t: Tables):
    return types.sniff_types(text_values(t), "event_id")


@query(
    f"""WITH {TEXT_SQL} SELECT event_id, event_id AS id_text, CAST(price AS DOUBLE) AS price, v AS mixed, kind FROM tv"""
)
def coerce_numeric(t: Tables):
    return types.coerce_numeric(text_values(t).selectExpr("event_id", "string(event_id) AS id_text", "price", "v AS mixed", "kind"))


@query(
    f"""WITH {TEXT_SQL} SELECT event_id, TRY_CAST(v AS DOUBLE) AS number, coalesce(TRY_CAST(v AS DOUBLE), 0) AS or_zero,
  CAST(round(CAST(TRY_CAST(price AS DOUBLE) / 7 AS DECIMAL(38, 12)), 2) AS DOUBLE) AS two_places FROM tv"""
)
def number_functions(t: Tables):
    value = F.col("v")
    return text_values(t).select(
        "event_id",
        numbers.to_number(value).alias("number"),
        numbers.to_number_or_zero(value).alias("or_zero"),
        numbers.two_decimals(numbers.to_number(F.col("price")) / 7).alias("two_places"),
    )


@query(
    r"""SELECT p_partkey, substring(rtrim(regexp_replace('Plot_' || p_partkey || '_' || substring(p_name || ' / ' || p_brand, 1, 20),
  '[^\p{L}\p{N} _-]', '', 'g')), 1, 31) AS title FROM part"""
)
def sheet_title(t: Tables):
    name = F.concat("p_name", F.lit(" / "), "p_brand")
    return t.part.select("p_partkey", text.sheet_title(F.col("p_partkey"), name).alias("title"))


@query(
    r"""WITH n AS (SELECT p_partkey, regexp_replace(substring(p_name, 1, 10), '[^\p{L}\p{N} _-]', '', 'g') || '+'
  || regexp_replace(substring(p_brand, 1, 10), '[^\p{L}\p{N} _-]', '', 'g') || '+'
  || regexp_replace(substring(p_type, 1, 10), '[^\p{L}\p{N} _-]', '', 'g') || '.csv' AS name FROM part)
SELECT p_partkey, CASE WHEN length(name) > 28 THEN 'concatenated.csv' ELSE name END AS file_name FROM n"""
)
def short_names(t: Tables):
    names = F.array("p_name", "p_brand", "p_type")
    return t.part.select("p_partkey", text.joined_short_names(names, "concatenated.csv", longest=28).alias("file_name"))


@query(
    r"""SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS base,
  regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '^(\.*[^.].*)\.[^.]*$', '\1') AS stem,
  regexp_extract(regexp_extract(url || '.html', '([^/\\]*)$', 1), '^\.*[^.].*(\.[^.]*)$', 1) AS extension FROM pages"""
)
def path_parts(t: Tables):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        text.file_basename(url).alias("base"),
        text.file_stem(url).alias("stem"),
        text.file_extension(F.concat(url, F.lit(".html"))).alias("extension"),
    )


@query(
    f"""WITH {TEXT_SQL} SELECT v IS NULL OR v = '' AS empty, v = '#N/A' AS error_text, count(*) AS cells FROM tv GROUP BY ALL"""
)
def error_tokens(t: Tables):
    value = F.col("v")
    return (
        text_values(t)
        .groupBy(text.is_empty(value).alias("empty"), text.is_error_token(value).alias("error_text"))
        .agg(F.count("*").alias("cells"))
    )


@query(
    """SELECT c_custkey, c_name, c_mktsegment FROM customer
  WHERE lower(c_mktsegment) LIKE '%build%' AND c_nationkey = 11 AND lower(c_name) <> 'customer#000000000'"""
)
def filters_ci(t: Tables):
    kept = filters.filter_contains_ci(t.customer, "c_mktsegment", "Build")
    kept = filters.filter_equal(kept, {"c_nationkey": 11, "c_name": ""})
    return kept.where(~text.equals_ci(F.col("c_name"), "CUSTOMER#000000000")).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT lower(o_orderpriority) AS priority, count(*) AS orders FROM orders WHERE lower(o_orderpriority) = '2-high' GROUP BY ALL")
def equals_ci(t: Tables):
    kept = filters.filter_equals_ci(t.orders, "o_orderpriority", "2-High")
    return kept.groupBy(F.lower("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"))


@query("SELECT doc_id, source FROM documents WHERE NOT (contains(lower(text), 'the') OR contains(lower(text), 'qui'))")
def exclude_any(t: Tables):
    return filters.exclude_any(t.documents, "text", ["THE", "qui"]).select("doc_id", "source")


@query(
    """SELECT event_id, event_type, value FROM events
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'"""
)
def time_range(t: Tables):
    return filters.filter_time(t.events, "ts", "2024-01-05", "2024-01-12").select("event_id", "event_type", "value")


@query("SELECT count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate >= DATE '1998-01-01'")
def open_time_range(t: Tables):
    kept = filters.filter_time(t.lineitem, "l_shipdate", "1998-01-01", "not a date")
    return kept.agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P')
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def id_lists(t: Tables):
    listed = filters.in_list(t.orders, "o_orderstatus", ["F", "P"])
    listed = filters.in_list(listed, "o_orderpriority", [])
    return filters.in_list(listed, "o_custkey", t.customer.where("c_acctbal < 0").select("c_custkey")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice * 2 AS double_price FROM orders WHERE o_totalprice > 400000")
def row_predicate(t: Tables):
    kept = filters.filter_expr(t.orders, "o_totalprice > 400000")
    return kept.select("o_orderkey", (F.col("o_totalprice") * 2).alias("double_price"))


@query(
    """SELECT doc_id FROM documents
  WHERE list_contains(string_split(text, ' '), 'the') AND list_contains(string_split(text, ' '), 'is')"""
)
def tagged_documents(t: Tables):
    tagged = t.documents.select("doc_id", F.split("text", " ").alias("tags"))
    return filters.has_all_tags(tagged, "tags", ["the", "is"]).select("doc_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def records_with_keys(t: Tables):
    records = t.events.select("event_id", F.from_json("props", "map<string,string>").alias("record"))
    kept = filters.rows_with_columns(records, "record", ["k"])
    return kept.select("event_id", F.col("record")["k"].cast("long").alias("k"))
