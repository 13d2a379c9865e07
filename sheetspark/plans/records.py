"""Keyed tables, logs, shares, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import second_text
from ..operators import audit, catalog, chart, filters, tables, templates, unions
from .registry import Tables, query


@query(
    """SELECT event_id, event_type, CAST(3 AS INTEGER) AS page, (SELECT count(*) FROM events) AS total_count,
  CAST((SELECT ceil(count(*) / 40) FROM events) AS INTEGER) AS total_pages, true AS has_next, true AS has_previous
  FROM events ORDER BY ts DESC, event_id LIMIT 40 OFFSET 80"""
)
def page(t: Tables):
    events = t.events.select("event_id", "event_type", "ts")
    return tables.page(events, [F.col("ts").desc(), "event_id"], 3, 40).drop("ts")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE i > (SELECT (ceil(count(*) / 500.0) - 2) * 500 FROM lineitem)
  AND i <= (SELECT (ceil(count(*) / 500.0) - 1) * 500 FROM lineitem)"""
)
def deep_page(t: Tables):
    """Last but one page: its skipped rows never reach the driver."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    last = -(-lines.count() // 500)
    return tables.page(lines, lines.columns, last - 1, 500).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def head_rows(t: Tables):
    return tables.head(t.orders.select("o_orderkey", "o_totalprice"), 10, [F.col("o_totalprice").desc(), "o_orderkey"])


@query("SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders")
def recent_first(t: Tables):
    listed = tables.recent_first(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return listed.select("o_orderkey", second_text(F.col("o_orderdate")).alias("day"))


@query(
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1"""
)
def latest_per_key(t: Tables):
    return tables.latest_per_key(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


_BATCH = """b AS (SELECT c_custkey * 2 AS c_custkey, any_value(c_name) AS c_name, max(c_acctbal) AS c_acctbal
  FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL)"""


@query(
    f"""WITH {_BATCH} SELECT c_custkey, c_name, c_acctbal, NULL AS created FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b)
UNION ALL SELECT c_custkey, c_name || ' new', c_acctbal, c_custkey NOT IN (SELECT c_custkey FROM customer) FROM b"""
)
def upsert(t: Tables):
    table = t.customer.select("c_custkey", "c_name", "c_acctbal")
    batch = t.customer.where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey * 2 AS c_custkey", "c_name || ' new' AS c_name", "c_acctbal", "1 AS at")
    older = batch.withColumn("c_name", F.lit("older")).withColumn("at", F.lit(0))
    return tables.upsert(table, batch.unionAll(older), ["c_custkey"], order_by=["at"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def delete_by_key(t: Tables):
    gone = t.customer.where("c_acctbal > 0").selectExpr("c_custkey AS o_custkey")
    return tables.delete_by_key(t.orders.select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query(
    """SELECT o_orderkey, o_orderstatus <> 'O' AND o_totalprice <= 200000 AS is_active,
  CASE WHEN o_orderstatus <> 'O' AND o_totalprice > 200000 THEN '2024-06-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated FROM orders"""
)
def deactivate(t: Tables):
    shares = t.orders.selectExpr("o_orderkey", "o_orderstatus <> 'O' AS is_active", "o_orderdate AS updated_at", "o_totalprice")
    changed = tables.deactivate(shares, "o_totalprice > 200000", F.lit("2024-06-01"))
    return changed.select("o_orderkey", "is_active", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def retain(t: Tables):
    return tables.retain(t.events.select("event_id", "ts"), "ts", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query(
    """SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS deleted FROM events"""
)
def retention_report(t: Tables):
    return tables.retention_report(t.events, "ts", F.lit("2024-01-20").cast("timestamp_ntz"))


def logs(t: Tables):
    """Events as request logs."""
    return t.events.selectExpr(
        "event_id AS request_id",
        "user_id",
        "event_id % 20 AS project_id",
        "concat('/api/', event_type, '/', CASE WHEN event_id % 6 = 0 THEN 'upload' ELSE string(user_id % 30) END) AS endpoint",
        "CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method",
        "int(200 + 100 * (event_id % 4)) AS response_status",
        "bigint(value) AS duration_ms",
        "CASE WHEN event_id % 50 = 0 THEN 'failed' END AS error_message",
        "concat('file', event_id % 3) AS file_name",
        "concat('sheet', event_id % 5) AS sheet_name",
        "ts AS request_timestamp",
    )


LOGS_SQL = """logs AS (SELECT event_id AS request_id, user_id, event_id % 20 AS project_id,
  '/api/' || event_type || '/' || CASE WHEN event_id % 6 = 0 THEN 'upload' ELSE CAST(user_id % 30 AS VARCHAR) END AS endpoint,
  CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, CAST(200 + 100 * (event_id % 4) AS INTEGER) AS response_status,
  CAST(trunc(value) AS BIGINT) AS duration_ms, CASE WHEN event_id % 50 = 0 THEN 'failed' END AS error_message,
  'file' || (event_id % 3) AS file_name, 'sheet' || (event_id % 5) AS sheet_name, ts AS request_timestamp FROM events)"""


@query(
    f"""WITH {LOGS_SQL}, r AS (SELECT * FROM logs WHERE request_timestamp >= TIMESTAMP '2024-01-13' AND request_timestamp <= TIMESTAMP '2024-01-20'),
o AS (SELECT count(*) AS n, count(*) FILTER (response_status BETWEEN 200 AND 299) AS s,
  count(*) FILTER (response_status >= 400 OR error_message IS NOT NULL) AS e, round(avg(duration_ms), 2) AS d FROM r)
SELECT 'overview' AS section, 'total_requests' AS item, CAST(n AS DOUBLE) AS value FROM o UNION ALL SELECT 'overview', 'successful_requests', s FROM o
UNION ALL SELECT 'overview', 'error_requests', e FROM o UNION ALL SELECT 'overview', 'success_rate', round(s * 100.0 / n, 6) FROM o
UNION ALL SELECT 'overview', 'avg_response_time_ms', d FROM o
UNION ALL (SELECT 'top_endpoints', endpoint, count(*) FROM r GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL (SELECT 'error_statuses', CAST(response_status AS VARCHAR), count(*) FROM r WHERE response_status >= 400 GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL (SELECT 'top_users', CAST(user_id AS VARCHAR), n FROM (SELECT user_id, count(*) AS n FROM r GROUP BY ALL) ORDER BY n DESC, user_id LIMIT 10)
UNION ALL SELECT 'method_distribution', method, count(*) FROM r GROUP BY ALL"""
)
def log_stats(t: Tables):
    week = audit.recent(logs(t), 7, F.lit("2024-01-20").cast("timestamp_ntz"))
    stats = audit.log_stats(week)
    return stats.select("section", "item", F.round("value", 6).alias("value"))


@query(
    f"""WITH {LOGS_SQL} SELECT request_id, endpoint, response_status, response_status BETWEEN 200 AND 299 AS is_success,
  response_status >= 400 AS is_error, count(*) OVER () AS total_count FROM logs
  WHERE lower(endpoint) LIKE '%click%' AND lower(method) = 'post' AND request_timestamp >= TIMESTAMP '2024-01-03'
    AND request_timestamp < TIMESTAMP '2024-01-26' ORDER BY request_timestamp DESC, request_id LIMIT 50 OFFSET 50"""
)
def query_logs(t: Tables):
    found = audit.query_logs(
        logs(t), endpoint="CLICK", method="post", start_date="2024-01-03", end_date="2024-01-25", page_number=2
    )
    return found.select("request_id", "endpoint", "response_status", "is_success", "is_error", "total_count")


@query(
    f"""WITH {LOGS_SQL} SELECT request_id, endpoint, sheet_name, count(*) OVER () AS total_count FROM logs
  WHERE NOT contains(lower(endpoint), 'upload') AND NOT contains(lower(endpoint), 'auth')
    AND project_id = 7 AND file_name = 'file1' AND sheet_name = 'sheet2' ORDER BY request_timestamp DESC, request_id LIMIT 15"""
)
def activity_feed(t: Tables):
    feed = audit.activity_feed(logs(t), "sheet", {"project_id": 7, "file_name": "file1", "sheet_name": "sheet2"})
    return feed.select("request_id", "endpoint", "sheet_name", "total_count")


@query(
    """SELECT event_type, 200 + 100 * (event_id % 4) BETWEEN 200 AND 299 AS success, count(*) AS requests,
  CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS total_ms FROM events GROUP BY ALL"""
)
def durations(t: Tables):
    started = F.col("ts")
    ended = F.timestamp_add("MILLISECOND", F.col("value").cast("bigint"), started)
    status = (F.col("event_id") % 4) * 100 + 200
    timed = t.events.select("event_type", numbers.is_success(status).alias("success"), numbers.duration_ms(started, ended).alias("ms"))
    return timed.groupBy("event_type", "success").agg(F.count("*").alias("requests"), F.sum("ms").alias("total_ms"))


@query(
    """SELECT event_id, '***MASKED***' AS token, CAST(user_id AS VARCHAR) AS name, '***MASKED***' AS inner_key,
  event_type AS kept FROM events"""
)
def mask_payloads(t: Tables):
    inner = F.array(F.struct(F.col("value").alias("API_Key"), F.col("event_type").alias("kind")))
    payload = F.to_json(
        F.struct(F.col("props").alias("userToken"), F.col("user_id").alias("name"), F.struct(inner.alias("items")).alias("body"))
    )
    masked = t.events.select("event_id", audit.mask_json(payload).alias("p"))
    return masked.select(
        "event_id",
        F.get_json_object("p", "$.userToken").alias("token"),
        F.get_json_object("p", "$.name").alias("name"),
        F.get_json_object("p", "$.body.items[0].API_Key").alias("inner_key"),
        F.get_json_object("p", "$.body.items[0].kind").alias("kept"),
    )


@query(
    """SELECT event_id, '***MASKED***' AS secret, event_type AS kind, '***MASKED***' AS auth, CAST(user_id AS VARCHAR) AS user, CAST(1 AS INTEGER) AS headers FROM events"""
)
def mask_typed(t: Tables):
    record = t.events.select(
        "event_id",
        F.array(F.struct(F.col("props").alias("client_secret"), F.col("event_type").alias("kind"))).alias("items"),
        F.create_map(F.lit("AuthCode"), "props", F.lit("user"), F.col("user_id").cast("string")).alias("form"),
        F.create_map(F.lit("Cookie"), "props", F.lit("Accept"), "event_type").alias("headers"),
    )
    masked = {c: audit.mask_value(F.col(c), record.schema[c].dataType) for c in ("items", "form")}
    shown = record.withColumns(masked).withColumn("headers", audit.drop_keys(F.col("headers"), audit.DROPPED_HEADERS))
    return shown.select(
        "event_id",
        F.col("items")[0]["client_secret"].alias("secret"),
        F.col("items")[0]["kind"].alias("kind"),
        F.col("form")["AuthCode"].alias("auth"),
        F.col("form")["user"].alias("user"),
        F.size("headers").alias("headers"),
    )


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS pu, CASE WHEN event_id % 2 = 0 THEN user_id + 1 END AS qu, event_id % 40 AS pid,
  value, event_type FROM events),
k AS (SELECT c_custkey AS u FROM customer WHERE c_acctbal >= 0)
SELECT event_id AS request_id, coalesce(a.u, b.u, pid % 7) AS user_id, '/api/' || event_type AS endpoint, CAST(200 AS INTEGER) AS response_status,
  CAST(trunc(value) AS BIGINT) AS duration_ms, 'kpi' AS file_type, CAST(1 AS INTEGER) AS headers
FROM e LEFT JOIN k a ON a.u = pu LEFT JOIN k b ON b.u = qu"""
)
def build_log(t: Tables):
    users = t.customer.where("c_acctbal >= 0").selectExpr("c_custkey AS user_id")
    projects = t.customer.selectExpr("c_custkey AS project_id", "c_custkey % 7 AS user_id")
    requests = t.events.selectExpr(
        "event_id AS request_id",
        "concat('/api/', event_type) AS path",
        "'POST' AS method",
        "'10.0.0.1' AS ip_address",
        "to_json(named_struct('user_id', CASE WHEN event_id % 3 = 0 THEN user_id END, 'project_id', event_id % 40, 'file_type', 'kpi', 'password', event_type)) AS body",
        "map('user_id', CASE WHEN event_id % 2 = 0 THEN string(user_id + 1) END) AS params",
        "map('cookie', props, 'accept', 'json') AS headers",
        "bigint(null) AS session_user",
        "ts AS started_at",
        "timestampadd(MILLISECOND, bigint(value), ts) AS ended_at",
        "200 AS status",
        "string(null) AS error_message",
    )
    built = audit.build_log(requests, users, projects)
    return built.select(
        "request_id", "user_id", "endpoint", "response_status", "duration_ms", "file_type", F.size("request_headers").alias("headers")
    )


def shares(t: Tables):
    """Orders as share grants."""
    return t.orders.selectExpr(
        "o_orderkey AS share_id",
        "o_custkey AS project_id",
        "o_orderkey % 50 AS shared_with",
        "o_custkey % 97 AS shared_by",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'project' ELSE 'file' END AS share_type",
        "CASE WHEN o_orderstatus = 'F' THEN 'kpi' ELSE 'media' END AS file_type",
        "concat('file', o_orderkey % 4) AS file_name",
        "CASE WHEN o_orderkey % 5 <> 0 THEN concat('sheet', o_orderkey % 2) END AS sheet_name",
        "CASE WHEN o_orderpriority < '2' THEN 'admin' WHEN o_orderpriority < '4' THEN 'edit' ELSE 'view' END AS permission_level",
        "o_orderkey % 7 <> 0 AS is_active",
        "o_orderdate AS created_at",
    )


SHARES_SQL = """shares AS (SELECT o_orderkey AS share_id, o_custkey AS project_id, o_orderkey % 50 AS shared_with, o_custkey % 97 AS shared_by,
  CASE WHEN o_orderkey % 3 = 0 THEN 'project' ELSE 'file' END AS share_type, CASE WHEN o_orderstatus = 'F' THEN 'kpi' ELSE 'media' END AS file_type,
  'file' || (o_orderkey % 4) AS file_name, CASE WHEN o_orderkey % 5 <> 0 THEN 'sheet' || (o_orderkey % 2) END AS sheet_name,
  CASE WHEN o_orderpriority < '2' THEN 'admin' WHEN o_orderpriority < '4' THEN 'edit' ELSE 'view' END AS permission_level,
  o_orderkey % 7 <> 0 AS is_active, o_orderdate AS created_at FROM orders)"""


@query(
    f"""WITH {SHARES_SQL}, r AS (SELECT share_id AS request_id, shared_with AS user_id, project_id,
  CASE WHEN share_id % 4 < 2 THEN file_type END AS file_type, CASE WHEN share_id % 4 < 2 THEN file_name END AS file_name,
  CASE WHEN share_id % 4 = 0 THEN sheet_name END AS sheet_name FROM shares),
p AS (SELECT c_custkey AS project_id, c_custkey % 50 AS owner FROM customer WHERE c_acctbal >= 0),
l AS (SELECT *, CASE permission_level WHEN 'view' THEN 1 WHEN 'edit' THEN 2 ELSE 3 END AS k FROM shares WHERE is_active),
g AS (SELECT request_id, max(k) AS k FROM r JOIN l ON l.project_id = r.project_id AND l.shared_with = r.user_id
  AND CASE WHEN r.file_type IS NULL THEN l.share_type = 'project'
    ELSE l.share_type = 'file' AND l.file_type = r.file_type AND l.file_name = r.file_name AND (r.sheet_name IS NULL OR l.sheet_name = r.sheet_name) END
  GROUP BY ALL)
SELECT r.request_id, r.project_id, CASE WHEN p.owner = r.user_id THEN 'admin' WHEN p.owner IS NOT NULL THEN
  CASE g.k WHEN 1 THEN 'view' WHEN 2 THEN 'edit' WHEN 3 THEN 'admin' END END AS permission_level
FROM r LEFT JOIN p ON p.project_id = r.project_id LEFT JOIN g ON g.request_id = r.request_id"""
)
def permissions(t: Tables):
    granted = shares(t)
    requests = granted.selectExpr(
        "share_id AS request_id",
        "shared_with AS user_id",
        "project_id",
        "CASE WHEN share_id % 4 < 2 THEN file_type END AS file_type",
        "CASE WHEN share_id % 4 < 2 THEN file_name END AS file_name",
        "CASE WHEN share_id % 4 = 0 THEN sheet_name END AS sheet_name",
    )
    projects = t.customer.where("c_acctbal >= 0").selectExpr("c_custkey AS project_id", "c_custkey % 50 AS user_id")
    return catalog.effective_permission(requests, projects, granted).select("request_id", "project_id", "permission_level")


def share_items(t: Tables):
    """Events as catalog items of projects."""
    return t.events.selectExpr(
        "event_id AS item",
        "user_id AS project_id",
        "CASE WHEN event_id % 2 = 0 THEN 'kpi' ELSE 'media' END AS file_type",
        "concat('file', event_id % 4) AS file_name",
        "concat('sheet', event_id % 3) AS sheet_name",
    )


_ITEMS_SQL = f"""{SHARES_SQL}, items AS (SELECT event_id AS item, user_id AS project_id, CASE WHEN event_id % 2 = 0 THEN 'kpi' ELSE 'media' END AS file_type,
  'file' || (event_id % 4) AS file_name, 'sheet' || (event_id % 3) AS sheet_name FROM events),
opened AS (SELECT s.share_id, s.shared_with, i.item FROM shares s JOIN items i ON s.project_id = i.project_id AND (share_type = 'project'
  OR (s.file_type = i.file_type AND s.file_name = i.file_name AND (s.sheet_name IS NULL OR s.sheet_name = i.sheet_name))) WHERE is_active)"""


@query(f"WITH {_ITEMS_SQL} SELECT DISTINCT item FROM opened WHERE shared_with = 7")
def shared_items(t: Tables):
    return catalog.share_scoped(share_items(t), shares(t), 7).select("item")


@query(
    f"""WITH {_ITEMS_SQL} SELECT s.share_id, s.shared_with, count(o.item) AS items FROM shares s LEFT JOIN opened o USING (share_id)
  WHERE s.is_active GROUP BY ALL"""
)
def share_sizes(t: Tables):
    return catalog.share_sizes(share_items(t), shares(t))


@query(f"WITH {SHARES_SQL} SELECT share_id, permission_level FROM shares WHERE is_active AND shared_with = 7")
def active_shares(t: Tables):
    mine = filters.filter_equal(shares(t), {"shared_with": 7})
    return filters.active_only(mine).select("share_id", "permission_level")


@query(
    f"""WITH {SHARES_SQL} SELECT share_id, shared_with, c_name AS project_name, s_name AS shared_by_name,
  CASE WHEN share_type = 'file' THEN file_name END AS file_name, permission_level FROM shares
  JOIN customer ON project_id = c_custkey JOIN supplier ON shared_by = s_suppkey WHERE is_active"""
)
def shared_projects(t: Tables):
    projects = t.customer.selectExpr("c_custkey AS project_id", "c_name AS name")
    users = t.supplier.selectExpr("s_suppkey AS user_id", "s_name AS username", "concat(s_suppkey, '@example.com') AS email")
    listed = catalog.shared_with(shares(t), projects, users)
    return listed.select("share_id", "shared_with", "project_name", "shared_by_name", "file_name", "permission_level")


@query(
    """WITH p AS (SELECT c_custkey, c_name, c_nationkey, string_split(c_mktsegment, 'I') AS kpi, [c_name, c_mktsegment] AS media FROM customer),
l AS (SELECT *, 'kpi' AS file_type, kpi AS files FROM p UNION ALL SELECT *, 'media', media FROM p),
u AS (SELECT c_custkey, c_name, c_nationkey, file_type, unnest(range(1, len(files) + 1)) AS id, unnest(files) AS file_name FROM l)
SELECT c_custkey AS project_id, c_name AS name, file_type, CAST(id AS INTEGER) AS id,
  'user_' || c_nationkey || '/project_' || c_custkey || '/' || file_type || '/' || file_name AS path, file_name FROM u"""
)
def project_listing(t: Tables):
    projects = t.customer.select(
        F.col("c_custkey").alias("project_id"),
        F.col("c_nationkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.split("c_mktsegment", "I").alias("kpi_file"),
        F.array("c_name", "c_mktsegment").alias("media_file"),
    )
    return catalog.project_listing(projects)


@query(
    """SELECT o_orderkey, o_orderpriority AS plot_name, CAST(2 AS INTEGER) AS page, count(*) OVER () AS total_count FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20"""
)
def list_plots(t: Tables):
    plots = t.orders.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("plot_name"),
        F.col("o_orderstatus").alias("file_type"),
        F.array("o_orderpriority", "o_orderstatus").alias("tags"),
        F.col("o_orderdate").alias("updated_at"),
    )
    listed = catalog.list_catalog(plots, {"file_type": "F", "sheet_name": ""}, ["2-HIGH", "F"], tie="o_orderkey", page_number=2)
    return listed.select("o_orderkey", "plot_name", "page", "total_count")


@query(
    """SELECT p_name AS plot_name, CASE WHEN p_size % 3 = 0 THEN 'STACKED (2 series)' WHEN p_size % 3 = 1 THEN 'STACKED100 (2 series)' ELSE 'bar' END AS chart_type,
  CASE WHEN p_size % 2 = 0 THEN 'N/A' ELSE p_brand END AS x_axes, p_brand || ', ' || p_type AS y_axes, '2024-05-06 07:08' AS created_at,
  CASE WHEN p_size < 25 THEN 'No description' ELSE p_type END AS description FROM part"""
)
def plot_summary(t: Tables):
    plots = t.part.select(
        F.col("p_name").alias("plot_name"),
        F.expr("CASE p_size % 3 WHEN 0 THEN 'stacked' WHEN 1 THEN 'stacked100' ELSE 'bar' END AS chart_type"),
        F.when(F.col("p_size") % 2 != 0, F.array("p_brand")).alias("x_axes"),
        F.array("p_brand", "p_type").alias("y_axes"),
        F.lit("2024-05-06 07:08:09").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("p_size") >= 25, F.col("p_type")).otherwise("").alias("description"),
    )
    return chart.plot_summary(plots)


def order_sheets(t: Tables):
    """Orders as sheets whose headers are the names of the parts ordered."""
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    named = lines.join(t.part.select("p_partkey", "p_name"), "p_partkey")
    return named.groupBy(F.col("l_orderkey").alias("sheet")).agg(F.sort_array(F.collect_set("p_name")).alias("columns"))


def brand_templates(t: Tables):
    """Brands as templates that want their first and last part name."""
    names = t.part.groupBy(F.col("p_brand").alias("template")).agg(
        F.min("p_name").alias("low"), F.max("p_name").alias("high"), F.min("p_partkey").alias("first")
    )
    word = F.element_at(F.split("low", " "), -1)
    kind = F.col("first") % 3
    pattern = F.when(kind == 0, F.struct(F.lit("contains").alias("type"), F.upper(word).alias("value"))).when(
        kind == 1, F.struct(F.lit("regex").alias("type"), F.concat(F.lit("^[a-m].*"), F.upper(word), F.lit("$")).alias("value"))
    ).otherwise(F.struct(F.lit("regex").alias("type"), F.lit("(").alias("value")))
    plot = F.struct(
        F.lit("Totals").alias("name"),
        F.lit("bar_chart").alias("plot_type"),
        F.array("low").alias("x_axes"),
        F.array("high").alias("y_axes"),
        F.lit("bar").alias("chart_type"),
        F.lit(None).cast("string").alias("aggregation_method"),
        F.lit(None).cast("string").alias("date_grouping"),
    )
    return names.select(
        "template",
        F.concat(F.lit("Format "), F.col("template")).alias("format_name"),
        F.array("low").alias("required_columns"),
        F.create_map("low", pattern).alias("column_patterns"),
        F.array(plot).alias("plots"),
        F.array("template").alias("tags"),
    )


def template_requests(t: Tables):
    brands = F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 25 + 1).cast("string"))
    return t.orders.select(brands.alias("template"), F.col("o_orderkey").alias("sheet"))


TEMPLATES_SQL = """n AS (SELECT p_brand AS template, min(p_name) AS low, max(p_name) AS high, min(p_partkey) % 3 AS kind,
  upper(string_split(min(p_name), ' ')[-1]) AS word FROM part GROUP BY ALL),
s AS (SELECT l_orderkey AS sheet, list_sort(list_distinct(list(p_name))) AS cols FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
q AS (SELECT 'Brand#' || (o_orderkey % 25 + 1) AS template, o_orderkey AS sheet FROM orders),
m AS (SELECT n.template, s.sheet, n.low, n.high, s.cols, CASE WHEN list_contains(cols, low) THEN low
  WHEN kind = 0 THEN list_filter(cols, lambda c: contains(lower(c), lower(word)))[1]
  WHEN kind = 1 THEN list_filter(cols, lambda c: regexp_matches(c, '^[a-m].*' || word || '$', 'i'))[1] END AS x,
  CASE WHEN list_contains(cols, high) THEN high WHEN high <> low THEN NULL WHEN kind = 0 THEN list_filter(cols, lambda c: contains(lower(c), lower(word)))[1]
  WHEN kind = 1 THEN list_filter(cols, lambda c: regexp_matches(c, '^[a-m].*' || word || '$', 'i'))[1] END AS y
FROM q JOIN n USING (template) JOIN s USING (sheet))"""


@query(
    f"""WITH {TEMPLATES_SQL} SELECT template, sheet, x IS NOT NULL AS is_compatible, coalesce(x, '') AS matched,
  CASE WHEN x IS NULL THEN low ELSE '' END AS missing FROM m"""
)
def match_templates(t: Tables):
    matched = templates.match_columns(brand_templates(t), order_sheets(t), template_requests(t))
    return templates.compatible(matched).select(
        "template",
        "sheet",
        "is_compatible",
        F.array_join("matched_columns", ",").alias("matched"),
        F.array_join("missing_columns", ",").alias("missing"),
    )


@query(
    f"""WITH {TEMPLATES_SQL.replace("FROM q JOIN n USING (template) JOIN s USING (sheet)", "FROM n CROSS JOIN s")}
SELECT template, sheet, x AS matched FROM m WHERE x IS NOT NULL"""
)
def fitting_templates(t: Tables):
    """Every template against every sheet, by the index of column names."""
    fitting = templates.fitting_pairs(brand_templates(t), order_sheets(t))
    return fitting.select("template", "sheet", F.array_join("matched_columns", ",").alias("matched"))


@query(
    f"""WITH {TEMPLATES_SQL} SELECT template, sheet, 'Format ' || template || ' - Totals' AS plot_name, x AS x_axis, y AS y_axis,
  CASE WHEN x = y THEN x ELSE x || ',' || y END AS columns_analyzed, 'sum' AS aggregation_method,
  template || ',auto-generated,format-applied' AS tags FROM m WHERE x IS NOT NULL AND y IS NOT NULL"""
)
def apply_template(t: Tables):
    plots = templates.apply_template(brand_templates(t), order_sheets(t), template_requests(t))
    return plots.select(
        "template",
        "sheet",
        "plot_name",
        F.col("x_axes")[0].alias("x_axis"),
        "y_axis",
        F.array_join("columns_analyzed", ",").alias("columns_analyzed"),
        "aggregation_method",
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    """SELECT c_custkey AS template, c_nationkey + count(o_orderkey) AS usage_count,
  strftime(greatest(TIMESTAMP '1999-01-01', max(o_orderdate)), '%Y-%m-%d') AS last_used
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey"""
)
def template_usage(t: Tables):
    known = t.customer.selectExpr(
        "c_custkey AS template", "bigint(c_nationkey) AS usage_count", "timestamp_ntz '1999-01-01' AS last_used"
    )
    uses = t.orders.selectExpr("o_custkey AS template", "o_orderdate AS used_at")
    counted = templates.usage_count(known, uses)
    return counted.withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd"))


@query(
    """SELECT p_partkey, CAST(i AS INTEGER) AS position, [p_type, p_brand, p_name][i] AS axis
  FROM part, unnest([1, 2, 3]) AS r(i)"""
)
def chart_axes(t: Tables):
    axes = t.part.select(
        "p_partkey", unions.union_axes(F.array("p_type", "p_brand"), F.array("p_brand", "p_name")).alias("axes")
    )
    return catalog.enumerate_items(axes, "axes", "axis")
