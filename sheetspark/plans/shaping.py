"""Joins, unions, reshaping and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chart, joins, reshape, steps, unions
from .registry import Tables, query


@query(
    """WITH l AS (SELECT DISTINCT CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS cust,
    o_orderkey, o_orderstatus FROM orders),
  r AS (SELECT DISTINCT CASE WHEN c_custkey = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS cust, c_name FROM customer)
SELECT coalesce(l.cust, r.cust) AS cust, o_orderkey, o_orderstatus, c_name FROM l FULL JOIN r ON l.cust = r.cust"""
)
def merge_outer(t: Tables):
    left = t.orders.selectExpr(
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS ` cust`", "o_orderkey", "o_orderstatus"
    )
    right = t.customer.selectExpr(
        "CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey END AS cust", "c_name", "c_nationkey AS o_orderstatus"
    )
    # The second union repeats rows that the merge must not multiply.
    return joins.merge_sheets(left.unionAll(left), right.unionAll(right), ["cust"])


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice, coalesce(c_name, 'NA') AS c_name,
  coalesce(CAST(c_nationkey AS VARCHAR), 'NA') AS c_nationkey FROM orders
  LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey"""
)
def map_left(t: Tables):
    mapping = t.customer.where("c_acctbal >= 0").selectExpr(
        "c_acctbal", "c_custkey", "c_name", "c_nationkey", "c_mktsegment AS `Unnamed: 4`", "c_acctbal AS after_blank"
    )
    return joins.map_columns(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), mapping, {"o_custkey": "c_custkey"})


@query(
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS nk FROM customer),
  n AS (SELECT CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey END AS nk, n_name, n_regionkey FROM nation)
SELECT c_custkey, c.nk AS nation_key, n_name, n_regionkey, r_name FROM c LEFT JOIN n ON c.nk IS NOT DISTINCT FROM n.nk
  LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def map_multi(t: Tables):
    customers = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS nation_key")
    nations = t.nation.selectExpr("CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey END AS nk", "n_name", "n_regionkey")
    named = joins.map_columns(customers, nations, {"nation_key": "nk"}, fill=None, require_unique=True)
    return joins.map_columns(named, t.region, {"n_regionkey": "r_regionkey"}, fill=None)


@query(
    """SELECT o_custkey AS cust, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""
)
def map_large(t: Tables):
    """Both sides large: a shuffled join, then a partial aggregate."""
    lines = t.lineitem.select("l_orderkey", "l_extendedprice")
    mapped = joins.map_columns(lines, t.orders.select("o_orderkey", "o_custkey"), {"l_orderkey": "o_orderkey"}, fill=None)
    return mapped.groupBy(F.col("o_custkey").alias("cust")).agg(
        F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


_RECONCILE = """WITH r AS (SELECT DISTINCT c_custkey AS cust FROM customer WHERE c_mktsegment <> 'BUILDING'),
  f AS (SELECT DISTINCT o_custkey AS cust FROM orders)"""


def _registered(t: Tables):
    return t.customer.where("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey AS cust"), t.orders.selectExpr("o_custkey AS cust")


@query(
    f"""{_RECONCILE} SELECT coalesce(r.cust, f.cust) AS cust, r.cust IS NOT NULL AS exists_in_db,
  f.cust IS NOT NULL AS exists_in_fs FROM r FULL JOIN f ON r.cust = f.cust"""
)
def reconcile(t: Tables):
    registered, found = _registered(t)
    return joins.reconcile(registered, found, ["cust"])


@query(f"{_RECONCILE} SELECT cust FROM f WHERE cust NOT IN (SELECT cust FROM r)")
def unregistered_files(t: Tables):
    registered, found = _registered(t)
    return joins.unregistered(registered, found, ["cust"])


@query(
    """SELECT c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance, c_mktsegment AS segment, 'NA' AS nation, 'customers' AS source_sheet
  FROM customer UNION ALL
  SELECT s_name, CASE WHEN s_suppkey % 5 = 0 THEN 'NA' ELSE CAST(s_acctbal AS VARCHAR) END, 'NA', CAST(s_nationkey AS VARCHAR), 'suppliers'
  FROM supplier"""
)
def concat_sheets(t: Tables):
    customers = t.customer.selectExpr("c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    suppliers = t.supplier.selectExpr(
        "s_name AS name", "CASE WHEN s_suppkey % 5 = 0 THEN double('infinity') ELSE s_acctbal END AS balance", "s_nationkey AS nation"
    )
    return unions.concat_sheets({"customers": customers, "suppliers": suppliers})


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, '' AS size, 'crm' AS source_file,
    'customers' AS source_sheet FROM customer UNION ALL
  SELECT CAST(p_partkey AS VARCHAR), p_name, '', CAST(p_size AS VARCHAR), 'stock', 'parts' FROM part UNION ALL
  SELECT CAST(s_suppkey AS VARCHAR), s_name, '', '', 'crm', 'suppliers' FROM supplier"""
)
def concat_project(t: Tables):
    return unions.concat_project(
        {
            ("crm", "customers"): t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"),
            ("stock", "parts"): t.part.selectExpr("p_partkey AS id", "p_name AS name", "p_size AS size"),
            ("stock", "missing"): None,
            ("crm", "suppliers"): t.supplier.selectExpr("s_suppkey AS id", "s_name AS name"),
        }
    )


@query("SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS flag FROM lineitem")
def dedupe(t: Tables):
    lines = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS flag")
    return unions.dedupe(lines.unionAll(lines.where("l_linenumber = 1")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def except_rows(t: Tables):
    present = t.orders.where("o_orderstatus = 'F'").selectExpr("o_custkey AS c_custkey")
    return unions.except_rows(t.customer.select("c_custkey"), present, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def intersect_rows(t: Tables):
    present = t.orders.where("o_totalprice > 300000").selectExpr("o_custkey AS c_custkey")
    return unions.intersect_rows(t.customer.select("c_custkey", "c_name"), present, ["c_custkey"])


@query(
    """SELECT "Variable", count(*) AS cells, round(sum("Value"), 2) AS total FROM (
  UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME "Variable" VALUE "Value") GROUP BY ALL"""
)
def melt_numeric(t: Tables):
    wide = t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return reshape.melt(wide, ["l_returnflag"]).groupBy("Variable").agg(
        F.count("*").alias("cells"), F.round(F.sum("Value"), 2).alias("total")
    )


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS part, 'p_size' AS attribute, CAST(p_size AS VARCHAR) AS cell FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_retailprice', CAST(p_retailprice AS VARCHAR) FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'brand', coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_brand END, 'NA') FROM part"""
)
def melt_mixed(t: Tables):
    wide = t.part.selectExpr(
        "p_partkey AS part", "p_size", "p_retailprice", "CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS brand", "p_type"
    )
    return reshape.melt(wide, ["part"], ["p_size", "p_retailprice", "brand"], "attribute", "cell", fill="NA")


@query(
    """SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F",
  round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O" FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY ALL"""
)
def pivot_filtered(t: Tables):
    table = reshape.pivot(
        t.orders,
        ["o_orderpriority"],
        "o_orderstatus",
        {"o_totalprice": "sum"},
        filters={"o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"], "o_orderstatus": []},
        column_values=["F", "O"],
    )
    return table.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in ("F", "O")])


@query(
    """SELECT CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS kind,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS value, CAST(user_id AS DOUBLE) AS user_id, CAST(0 AS DOUBLE) AS absent FROM events"""
)
def stacked(t: Tables):
    source = t.events.selectExpr(
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind",
        "CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE string(value) END AS value",
        "user_id",
    )
    return reshape.stacked(source, ["kind"], ["value", "user_id", "absent"])


@query(
    """WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, sum(l_extendedprice) AS e, sum(l_discount) AS d
  FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(q / (q + e + d) * 100, 4) AS q, round(e / (q + e + d) * 100, 4) AS e,
  round(d / (q + e + d) * 100, 4) AS d FROM s"""
)
def stacked100(t: Tables):
    lines = t.lineitem.selectExpr("l_returnflag", "l_linestatus", "l_quantity AS q", "l_extendedprice AS e", "l_discount AS d")
    x, y = ["l_returnflag", "l_linestatus"], ["q", "e", "d"]
    shares = reshape.stacked100(chart.chart_aggregate(lines, x, y), x, y)
    return shares.select(*x, *[F.round(c, 4).alias(c) for c in y])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY ALL")
def chart_sum(t: Tables):
    sums = chart.chart_aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_extendedprice"])
    return sums.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@query(
    """SELECT CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS kind,
  round(avg(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END), 4) AS value FROM events GROUP BY ALL"""
)
def chart_avg(t: Tables):
    source = t.events.selectExpr(
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind",
        "CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE string(value) END AS value",
    )
    return chart.chart_aggregate(source, ["kind"], ["value"], "avg").withColumn("value", F.round("value", 4))


@query(
    """SELECT p_brand, p_type, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY ALL"""
)
def chart_min_max(t: Tables):
    x = ["p_brand", "p_type"]
    low = chart.chart_aggregate(t.part, x, ["p_retailprice"], "min").withColumnRenamed("p_retailprice", "low")
    high = chart.chart_aggregate(t.part, x, ["p_retailprice"], "max").withColumnRenamed("p_retailprice", "high")
    return low.join(high, x)


@query(
    """SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice, CAST(sum(o_custkey) AS DOUBLE) AS o_custkey
  FROM orders GROUP BY ALL"""
)
def chart_multi(t: Tables):
    table = chart.series_table(t.orders, ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"])
    return table.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    """SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice
  FROM orders GROUP BY ALL"""
)
def chart_by_quarter(t: Tables):
    table = chart.chart_aggregate(t.orders, ["o_orderdate"], ["o_totalprice"], date_grouping="quarter")
    return table.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT l_shipdate AS l_shipdate, round(sum(l_quantity), 2) AS quantity FROM (SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate, l_quantity FROM lineitem) GROUP BY ALL")
def chart_raw_dates(t: Tables):
    table = chart.chart_aggregate(t.lineitem, ["l_shipdate"], ["l_quantity"])
    return table.select("l_shipdate", F.round("l_quantity", 2).alias("quantity"))


@query("SELECT p_type, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY ALL")
def group_mean(t: Tables):
    return chart.group_mean(t.part, "p_type", "p_retailprice").withColumn("p_retailprice", F.round("p_retailprice", 4))


@query(
    """SELECT p_brand, round(avg(p_retailprice), 4) AS mean_price FROM part WHERE p_size > 25 GROUP BY ALL"""
)
def step_sql(t: Tables):
    return steps.run_sql_step(
        t.part, "SELECT p_brand, round(avg(p_retailprice), 4) AS mean_price FROM {df} WHERE p_size > 25 GROUP BY p_brand"
    )


@query("SELECT p_partkey, p_retailprice * 2 AS price_double FROM part WHERE p_size > 25")
def step_function(t: Tables):
    return steps.run_step(
        t.part,
        lambda df: df.where("p_size > 25").select("p_partkey", (F.col("p_retailprice") * 2).alias("price_double")),
    )


@query("SELECT o_orderkey, o_totalprice * 2 AS price_double, upper(o_orderpriority) AS priority FROM orders WHERE o_totalprice > 1000")
def step_pandas(t: Tables):
    def double(batch):
        batch = batch[batch["o_totalprice"] > 1000]
        return batch.assign(price_double=batch["o_totalprice"] * 2, priority=batch["o_orderpriority"].str.upper())[
            ["o_orderkey", "price_double", "priority"]
        ]

    return steps.run_pandas_step(
        t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), double, "o_orderkey long, price_double double, priority string"
    )


@query("SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY ALL")
def step_pandas_groups(t: Tables):
    """A step over the batches of each group."""

    def spread(key, batches):
        import pandas as pd

        low, high = float("inf"), float("-inf")
        for batch in batches:
            low, high = min(low, batch["o_totalprice"].min()), max(high, batch["o_totalprice"].max())
        yield pd.DataFrame({"o_custkey": [key[0]], "spread": [high - low]})

    orders = t.orders.select("o_custkey", "o_totalprice")
    return steps.run_pandas_step(orders, spread, "o_custkey long, spread double", by=["o_custkey"])


@query(
    """SELECT l_returnflag, CAST(max(l_quantity) - min(l_quantity) AS DOUBLE) AS spread, count(*) AS lines, count(DISTINCT l_shipdate) AS days
  FROM lineitem GROUP BY ALL"""
)
def step_pandas_aggregate(t: Tables):
    """Few large groups: partial results where the rows are, merged by group."""
    import pandas as pd

    def partial(rows):
        days = rows.groupby("l_returnflag")["l_shipdate"].agg(lambda d: sorted(set(d)))
        found = rows.groupby("l_returnflag")["l_quantity"].agg(low="min", high="max", lines="count")
        return found.join(days.rename("days")).reset_index()

    def merge(states):
        days = states.groupby("l_returnflag")["days"].agg(lambda lists: sorted({d for days in lists for d in days}))
        found = states.groupby("l_returnflag").agg(low=("low", "min"), high=("high", "max"), lines=("lines", "sum"))
        return found.join(days).reset_index()

    def finish(states):
        return pd.DataFrame(
            {"l_returnflag": states["l_returnflag"], "spread": states["high"] - states["low"], "lines": states["lines"], "days": states["days"].map(len)}
        )

    lines = t.lineitem.select("l_returnflag", "l_quantity", F.col("l_shipdate").cast("date").cast("string").alias("l_shipdate"))
    state = "l_returnflag string, low double, high double, lines long, days array<string>"
    return steps.run_pandas_aggregate(lines, partial, merge, state, ["l_returnflag"], finish, "l_returnflag string, spread double, lines long, days long")


@query(
    """SELECT lower(p_type) AS p_type, round(sum(p_retailprice), 2) AS p_retailprice, CAST(sum(p_size) AS DOUBLE) AS p_size
  FROM part WHERE p_size > 10 AND p_brand <> 'Brand#1' GROUP BY ALL"""
)
def recipe(t: Tables):
    table = steps.recipe(
        t.part,
        [
            ("lowercase", {"columns": ["p_type"]}),
            ("filter_expr", {"condition": "p_size > 10"}),
            ("sql", {"sql": "SELECT * FROM {df} WHERE p_brand <> 'Brand#1'"}),
            ("chart_aggregate", {"x": ["p_type"], "y": ["p_retailprice", "p_size"]}),
        ],
    )
    return table.withColumn("p_retailprice", F.round("p_retailprice", 2))
