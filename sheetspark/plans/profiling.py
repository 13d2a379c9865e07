"""Profiles, dates and row order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import print_like
from ..operators import dates, order, profile
from .cleaning import DIRTY_SQL, TEXT_SQL, dirty_events, text_values
from .registry import Tables, query


def _rounded(df, *columns, places=4):
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


@query(
    f"""WITH {DIRTY_SQL} SELECT 'event_id' AS "column", count(*) FILTER (event_id IS NULL) AS empty_count FROM dirty
UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL OR event_type = '') FROM dirty
UNION ALL SELECT 'value', count(*) FILTER (value IS NULL OR isinf(value)) FROM dirty"""
)
def null_profile(t: Tables):
    return profile.null_profile(dirty_events(t))


@query(
    f"""WITH {DIRTY_SQL} SELECT 'event_type' AS "column", count(*) FILTER (event_type IS NULL) AS missing_count,
  round(count(*) FILTER (event_type IS NULL) * 100.0 / count(*), 4) AS missing_percentage FROM dirty"""
)
def missing_stats(t: Tables):
    return _rounded(profile.missing_stats(dirty_events(t)), "missing_percentage")


@query(
    f"""WITH {TEXT_SQL} SELECT 'v' AS "column", count(DISTINCT v) AS unique_values FROM tv
UNION ALL SELECT 'price', count(DISTINCT CAST(price AS DOUBLE)) FROM tv UNION ALL SELECT 'kind', count(DISTINCT kind) FROM tv"""
)
def distinct_counts(t: Tables):
    return profile.distinct_count(text_values(t), ["v", "price", "kind"], coerce=["price"])


@query(
    """WITH l AS (SELECT event_id, 'event_type' AS "column", event_type AS value, event_type AS shown FROM events
  UNION ALL SELECT event_id, 'value', CAST(value AS VARCHAR), CAST(CAST(round(CAST(value AS DECIMAL(38, 12)), 2) AS DOUBLE) AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'user_id', CAST(user_id AS VARCHAR), CAST(CAST(user_id AS DOUBLE) AS VARCHAR) FROM events),
g AS (SELECT "column", value, any_value(shown) AS shown, min(event_id) AS seen FROM l GROUP BY ALL),
r AS (SELECT "column", shown AS value, row_number() OVER (PARTITION BY "column" ORDER BY seen, g.value) AS position FROM g)
SELECT "column", CAST(position AS INTEGER) AS position, value FROM r"""
)
def distinct_head(t: Tables):
    events = t.events.select("event_id", "event_type", "value", "user_id")
    return profile.distinct_head(events, ["event_type", "value", "user_id"], "event_id")


@query(
    f"""WITH {TEXT_SQL}, n AS (SELECT 'v' AS "column", v AS raw, TRY_CAST(v AS DOUBLE) AS x FROM tv
  UNION ALL SELECT 'price', price, TRY_CAST(price AS DOUBLE) FROM tv UNION ALL SELECT 'kind', kind, NULL FROM tv)
SELECT "column", CAST(round(CAST(min(x) AS DECIMAL(38, 12)), 2) AS DOUBLE) AS min, CAST(round(CAST(max(x) AS DECIMAL(38, 12)), 2) AS DOUBLE) AS max,
  round(avg(x), 1) AS average, round(count(x) / count(raw), 6) AS parse_ratio FROM n GROUP BY ALL"""
)
def numeric_summary(t: Tables):
    summary = profile.numeric_summary(text_values(t), ["v", "price", "kind"])
    return _rounded(_rounded(summary, "parse_ratio", places=6), "average", places=1)


@query(
    """WITH n AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT "column", round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS std,
  min(x) AS min, max(x) AS max FROM n GROUP BY ALL"""
)
def describe_numeric(t: Tables):
    stats = profile.describe_numeric(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return _rounded(stats, "mean", "median", "std")


@query(
    """WITH c AS (SELECT l_quantity AS q, l_extendedprice AS e, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount END AS d FROM lineitem),
p AS (SELECT 'q' AS a, 'e' AS b, corr(q, e) AS r FROM c UNION ALL SELECT 'q', 'd', corr(q, d) FROM c UNION ALL SELECT 'e', 'd', corr(e, d) FROM c
  UNION ALL SELECT 'q', 'k', 0 FROM c UNION ALL SELECT 'e', 'k', 0 UNION ALL SELECT 'd', 'k', 0)
SELECT a AS column_a, b AS column_b, round(r, 6) AS correlation FROM p GROUP BY ALL
UNION ALL SELECT b, a, round(r, 6) FROM p GROUP BY ALL"""
)
def correlation(t: Tables):
    lines = t.lineitem.selectExpr(
        "l_quantity AS q", "l_extendedprice AS e", "CASE WHEN l_partkey % 3 = 0 THEN double('infinity') ELSE l_discount END AS d", "7 AS k"
    )
    return _rounded(profile.correlation_matrix(lines), "correlation", places=6)


@query(
    """WITH c AS (SELECT l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS x FROM lineitem),
p AS (SELECT 'q' AS a, 'e' AS b, corr(q, e) AS r FROM c UNION ALL SELECT 'q', 'd', corr(q, d) FROM c UNION ALL SELECT 'e', 'd', corr(e, d) FROM c
  UNION ALL SELECT 'q', 'x', corr(q, x) FROM c UNION ALL SELECT 'e', 'x', corr(e, x) FROM c UNION ALL SELECT 'd', 'x', corr(d, x) FROM c)
SELECT a AS column_a, b AS column_b, round(r, 6) AS correlation FROM p UNION ALL SELECT b, a, round(r, 6) FROM p"""
)
def correlation_wide(t: Tables):
    lines = t.lineitem.selectExpr("l_quantity AS q", "l_extendedprice AS e", "l_discount AS d", "l_tax AS x")
    return _rounded(profile.correlation_matrix(lines), "correlation", places=6)


@query(
    """WITH s AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
    quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders),
w AS (SELECT *, least(greatest(2 * iqr / n ** (1.0 / 3), (hi - lo) / sqrt(n) / 2), (hi - lo) / (log2(n) + 1)) AS width FROM s),
b AS (SELECT *, CAST(ceil((hi - lo) / width) AS BIGINT) AS bins FROM w),
p AS (SELECT least(CAST(floor((o_totalprice - lo) * (bins / (hi - lo))) AS BIGINT), bins - 1) AS bin FROM orders, b)
SELECT i AS bin, round(lo + i * (hi - lo) / bins, 4) AS lower, round(lo + (i + 1) * (hi - lo) / bins, 4) AS upper,
  (SELECT count(*) FROM p WHERE p.bin = i) AS occurrences FROM b, unnest(range(bins)) AS r(i)"""
)
def histogram_auto(t: Tables):
    return _rounded(profile.histogram(t.orders, "o_totalprice"), "lower", "upper")


@query(
    """WITH l AS (SELECT o_orderkey, 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders
  UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
g AS (SELECT "column", value, count(*) AS occurrences, min(o_orderkey) AS seen FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY occurrences DESC, seen, value) AS position FROM g)
SELECT "column", CAST(position AS INTEGER) AS position, value, occurrences FROM r WHERE position <= 10"""
)
def top_values(t: Tables):
    return profile.top_values(t.orders, ["o_orderpriority", "o_custkey"], "o_orderkey")


@query(
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem
  GROUP BY l_orderkey, l_linenumber, l_returnflag)"""
)
def duplicate_rows(t: Tables):
    return profile.duplicate_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    """SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS "column",
  unnest(['numerical', 'datetime', 'numerical', 'categorical', 'numerical', 'categorical']) AS column_type,
  (SELECT count(*) FROM events) AS total_rows, CAST(6 AS BIGINT) AS total_columns"""
)
def basic_info(t: Tables):
    return profile.basic_info(t.events)


@query(
    """WITH n AS (SELECT 'p_size' AS "column", CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part)
SELECT "column", count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS stddev, min(x) AS min,
  quantile_disc(x, 0.25) AS p25, quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.75) AS p75, max(x) AS max FROM n GROUP BY ALL"""
)
def overview(t: Tables):
    return _rounded(profile.overview(t.part, ["p_size", "p_retailprice"]), "mean", "stddev")


@query(
    """WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
c AS (SELECT i, unnest(regexp_extract_all(text, '[^a-zA-Z0-9 ]')) AS character FROM d),
r AS (SELECT i, character, count(*) AS n FROM c GROUP BY ALL)
SELECT 'text' AS "column", character, CAST(sum(n) AS BIGINT) AS total_occurrences, count(*) AS rows_containing,
  min(i) AS min_row_index, max(i) AS max_row_index,
  round_even(CAST(sum(n) AS DOUBLE) / count(*) * 100, 0) / 100 AS avg_occurrences_per_row FROM r GROUP BY character"""
)
def special_characters(t: Tables):
    return profile.special_characters(t.documents.select("doc_id", "text"), ["text"], "doc_id")


@query(
    """SELECT 'text' AS "column", CAST(0 AS BIGINT) AS blank_cells_count,
  CAST(sum(length(regexp_replace(text, '[a-zA-Z0-9 ]', '', 'g'))) AS BIGINT) AS total_special_char_occurrences FROM documents
UNION ALL SELECT 'source', count(*) FILTER (source IS NULL), CAST(sum(length(regexp_replace(source, '[a-zA-Z0-9 ]', '', 'g'))) AS BIGINT) FROM documents"""
)
def special_character_totals(t: Tables):
    return profile.special_character_totals(t.documents, ["text", "source"])


@query(
    f"""WITH {TEXT_SQL}, x AS (SELECT tv.*, strftime(ts, '%d/%m/%Y') AS day FROM tv JOIN events USING (event_id))
SELECT 'v' AS "column", 'str' AS data_type, 'numeric' AS type, count(*) FILTER (v = '') AS empty_count, count(DISTINCT TRY_CAST(v AS DOUBLE)) AS unique_values,
  min(TRY_CAST(v AS DOUBLE)) AS min, max(TRY_CAST(v AS DOUBLE)) AS max, NULL AS granularity, NULL AS date_format, NULL AS min_date FROM x
UNION ALL SELECT 'kind', 'str', 'string', count(*) FILTER (kind = ''), count(DISTINCT kind), NULL, NULL, NULL, NULL, NULL FROM x
UNION ALL SELECT 'day', 'str', 'datetime', 0, count(DISTINCT day), NULL, NULL, 'daily', 'DD/MM/YYYY', strftime(min(strptime(day, '%d/%m/%Y')), '%Y-%m-%d %H:%M:%S') FROM x"""
)
def column_profile(t: Tables):
    days = t.events.select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("day"))
    source = text_values(t).join(days, "event_id").select("event_id", "v", "kind", "day")
    return profile.column_profile(source, "event_id", ["v", "kind", "day"]).select(
        "column", "data_type", "type", "empty_count", "unique_values", "min", "max", "granularity", "date_format", "min_date"
    )


@query(
    """WITH q AS (SELECT quantile_cont(p_retailprice, 0.5) AS m FROM part),
d AS (SELECT coalesce(sum(n - 1), 0) AS n FROM (SELECT count(*) AS n FROM part GROUP BY p_partkey, p_brand, p_type, p_size, p_retailprice)),
k AS (SELECT 'p_type' AS c, p_type AS v, p_partkey FROM part UNION ALL SELECT 'p_brand', p_brand, p_partkey FROM part),
g AS (SELECT c, v, count(*) AS n, min(p_partkey) AS seen FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, seen) AS i FROM g)
SELECT 'basic_info' AS section, NULL AS "column", 'total_rows' AS item, CAST(count(*) AS DOUBLE) AS number FROM part
UNION ALL SELECT 'basic_info', NULL, 'duplicate_rows', CAST(n AS DOUBLE) FROM d
UNION ALL SELECT 'numerical_stats', 'p_retailprice', 'median', round(m, 4) FROM q
UNION ALL SELECT 'numerical_stats', 'p_retailprice', 'mean', round(avg(p_retailprice), 4) FROM part
UNION ALL SELECT 'numerical_stats', 'p_retailprice', 'std', round(stddev_samp(p_retailprice), 4) FROM part
UNION ALL SELECT 'numerical_stats', 'p_retailprice', 'min', min(p_retailprice) FROM part
UNION ALL SELECT 'numerical_stats', 'p_retailprice', 'max', max(p_retailprice) FROM part
UNION ALL SELECT 'categorical_stats', c, 'unique_values', count(DISTINCT v) FROM k GROUP BY c
UNION ALL SELECT 'top_categories', c, v, n FROM r WHERE i <= 10
UNION ALL SELECT 'correlation', 'p_size', 'p_retailprice', round(corr(p_size, p_retailprice), 4) FROM part
UNION ALL SELECT 'correlation', 'p_retailprice', 'p_size', round(corr(p_size, p_retailprice), 4) FROM part"""
)
def eda_report(t: Tables):
    parts = t.part.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    report = profile.eda_report(parts, "p_partkey")
    wanted = (
        F.col("item").isin("total_rows", "duplicate_rows")
        | F.col("section").isin("categorical_stats", "top_categories")
        | ((F.col("section") == "numerical_stats") & (F.col("column") == "p_retailprice"))
        | ((F.col("section") == "correlation") & (F.col("column") != "p_partkey") & (F.col("item") != "p_partkey"))
    )
    return _rounded(report.where(wanted).select("section", "column", "item", "number"), "number")


def _text_dates(t: Tables, pattern: str, name: str = "day"):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", pattern).alias(name))


@query(
    """SELECT unnest(['us', 'eu', 'slash', 'iso', 'dots', 'none']) AS "column",
  unnest(['MM/DD/YYYY', 'DD/MM/YYYY', 'YYYY/MM/DD', 'YYYY-MM-DD', 'DD.MM.YYYY', 'Unknown']) AS date_format,
  unnest([(SELECT count(DISTINCT o_orderdate) FROM orders), (SELECT count(DISTINCT o_orderdate) FROM orders WHERE day(o_orderdate) > 12),
    (SELECT count(DISTINCT o_orderdate) FROM orders), (SELECT count(DISTINCT o_orderdate) FROM orders),
    (SELECT count(DISTINCT o_orderdate) FROM orders WHERE day(o_orderdate) > 12), 0]) AS votes"""
)
def detect_format(t: Tables):
    day = F.col("o_orderdate")
    texts = t.orders.select(
        F.date_format(day, "MM/dd/yyyy").alias("us"),
        F.date_format(day, "dd/MM/yyyy").alias("eu"),
        F.date_format(day, "yyyy/MM/dd").alias("slash"),
        F.date_format(day, "yyyy-MM-dd").alias("iso"),
        F.date_format(day, "dd.MM.yyyy").alias("dots"),
        F.col("o_orderpriority").alias("none"),
    )
    return dates.format_votes(texts, texts.columns).select("column", "date_format", F.col("votes").cast("long").alias("votes"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, CAST(year(o_orderdate) AS INTEGER) AS day_year,
  'kept' AS day_month, strftime(o_orderdate, '%m/%Y') AS day_month_year FROM orders"""
)
def add_dates(t: Tables):
    spaced = _text_dates(t, "'  'dd/MM/yyyy ").withColumn("day_month", F.lit("kept"))
    return dates.add_date_columns(spaced, ["day"])


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') AS day_month_year, CAST(month(o_orderdate) AS INTEGER) AS day_month FROM orders"""
)
def add_dates_year_first(t: Tables):
    return dates.add_date_columns(_text_dates(t, "yyyy/MM/dd"), ["day"]).select("o_orderkey", "day_month_year", "day_month")


@query("SELECT o_orderkey, strftime(o_orderdate, '%m.%d.%Y') AS dotted, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def print_dates(t: Tables):
    """Text dates parsed by their voted format and printed in others."""
    texts = _text_dates(t, "dd-MM-yyyy")
    stamp = dates.as_timestamp(texts, "day", dates.detect_date_formats(texts, ["day"])["day"])
    return texts.select(
        "o_orderkey", print_like(stamp, "MM.DD.YYYY").alias("dotted"), print_like(stamp, "Unknown").alias("iso")
    )


_GRANULARITY = """SELECT 'day' AS "column", 'daily' AS granularity UNION ALL SELECT 'month', 'monthly' UNION ALL SELECT 'year', 'yearly'"""


def _granular(t: Tables):
    day = F.col("o_orderdate")
    kept = F.when((F.quarter(day) != 2) & (F.year(day) != 1997), day)
    return t.orders.select(kept.alias("o_orderdate")).select(
        F.date_format(F.when(F.dayofmonth(day) % 5 != 0, day), "yyyy-MM-dd").alias("day"),
        F.date_format(F.trunc(day, "month"), "yyyy-MM-dd").alias("month"),
        F.date_format(F.trunc(day, "year"), "yyyy-MM-dd").alias("year"),
    )


@query(_GRANULARITY)
def granularity(t: Tables):
    return dates.granularity(_granular(t), ["day", "month", "year"])


@query(
    """WITH b AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders WHERE quarter(o_orderdate) <> 2 AND year(o_orderdate) <> 1997),
x AS (SELECT d FROM b WHERE day(d) % 5 <> 0),
e AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM x),
m AS (SELECT DISTINCT date_trunc('month', d) AS d FROM b),
em AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 MONTH)) AS d FROM m),
y AS (SELECT DISTINCT year(d) AS y FROM b),
ey AS (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM y)
SELECT 'day' AS "column", 'daily' AS granularity, strftime(d, '%Y-%m-%d') AS missing_date FROM e WHERE d NOT IN (SELECT d FROM x)
UNION ALL SELECT 'month', 'monthly', strftime(d, '%Y-%m') FROM em WHERE d NOT IN (SELECT d FROM m)
UNION ALL SELECT 'year', 'yearly', CAST(y AS VARCHAR) FROM ey WHERE y NOT IN (SELECT y FROM y)"""
)
def missing_dates(t: Tables):
    return dates.missing_dates(_granular(t), ["day", "month", "year"])


@query(
    """SELECT 'ts' AS "column", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_date FROM events"""
)
def date_range(t: Tables):
    return dates.date_range(t.events, ["ts"])


@query(
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE day(ts) % 5 <> 0),
e AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM d)
SELECT 'day' AS "column", 'daily' AS granularity, 'MM-DD-YYYY' AS date_format, strftime(min(d), '%Y-%m-%d 00:00:00') AS min_date,
  strftime(max(d), '%Y-%m-%d 00:00:00') AS max_date,
  (SELECT string_agg(strftime(d, '%Y-%m-%d'), '|' ORDER BY d) FROM e WHERE d NOT IN (SELECT d FROM d)) AS missing_dates,
  string_agg(strftime(d, '%m-%d-%Y'), '|' ORDER BY d) AS unique_elements, count(*) AS unique_values FROM d"""
)
def date_profile(t: Tables):
    gaps = t.events.select(F.date_format(F.when(F.dayofmonth("ts") % 5 != 0, F.col("ts")), "MM-dd-yyyy").alias("day"))
    lists = {c: F.array_join(c, "|") for c in ("missing_dates", "unique_elements")}
    return dates.date_profile(gaps, ["day"]).withColumns(lists)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events")
def row_index(t: Tables):
    return order.row_index(t.events.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row_index")


@query("SELECT event_id, round(value - lag(value) OVER (ORDER BY event_id), 6) AS diff FROM events")
def consecutive_diff(t: Tables):
    return _rounded(order.consecutive_diff(t.events.select("event_id", "value"), "value", ["event_id"]).select("event_id", "diff"), "diff", places=6)


@query(
    "SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS diff FROM events"
)
def consecutive_diff_by_user(t: Tables):
    events = t.events.select("event_id", "user_id", "value")
    diffs = order.consecutive_diff(events, "value", ["event_id"], partition_by=["user_id"], partitions=5)
    return _rounded(diffs.select("event_id", "user_id", "diff"), "diff", places=6)
