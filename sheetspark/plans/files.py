"""Files and payloads derived from the tables, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import as_text
from ..operators.order import row_index
from ..operators.unions import union_all
from ..sinks import sheets as sinks
from ..sinks import versions as store
from ..sinks import workbooks as book_sinks
from ..sources import payloads, sheets, workbooks
from .registry import Tables, query


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS "total price",
  CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE o_orderpriority END AS "o.priority" FROM orders"""
)
def csv_text(t: Tables):
    path = t.scratch("orders-csv")
    source = t.orders.select(
        "o_orderkey",
        "o_orderstatus",
        as_text(F.col("o_totalprice"), t.orders.schema["o_totalprice"].dataType).alias("total price"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE o_orderpriority END").alias("o.priority"),
    )
    sinks.write_sheet(source, path)
    return sheets.read_sheet(t.spark, path)


@query(
    """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
  o_orderstatus = 'F' AS filled FROM orders"""
)
def csv_typed(t: Tables):
    path = t.scratch("orders-typed-csv")
    source = t.orders.selectExpr(
        "o_orderkey",
        "o_totalprice",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE o_orderpriority END AS priority",
        "CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS filled",
    )
    sinks.write_sheet(source, path)
    return sheets.read_sheet(t.spark, path, infer=True)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def csv_order(t: Tables):
    """Rows of a sorted sheet keep their file order."""
    path = t.scratch("orders-sorted-csv")
    t.orders.select("o_orderkey").orderBy("o_orderkey").write.option("header", True).csv(path)
    ordered = sheets.read_sheet(t.spark, path, ordered=True)
    indexed = row_index(ordered, ["__source_order"])
    return indexed.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "row_index")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def csv_documents(t: Tables):
    """Whole texts with line breaks, quotes and separators, written and read."""
    path = t.scratch("documents-csv")
    sinks.write_sheet(t.documents.select("doc_id", "text"), path)
    return sheets.read_sheet(t.spark, path)


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, html FROM pages")
def csv_pages(t: Tables):
    path = t.scratch("pages-csv")
    sinks.write_sheet(t.pages.select("page_id", "html"), path)
    return sheets.read_sheet(t.spark, path)


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN lang <> 'fr' THEN text END AS text, CASE WHEN lang = 'fr' THEN text END AS "Body",
  source, 'lang=' || lang AS file_name FROM documents"""
)
def sheet_set(t: Tables):
    """Documents in a folder for each language, with two different headers."""
    path = t.scratch("documents-set")
    for name, column in (("lang <> 'fr'", "text"), ("lang = 'fr'", "Body")):
        chosen = t.documents.where(name).select("doc_id", F.col("text").alias(column), "source", "lang")
        sinks.append_partitions(chosen, path, "lang")
    found = sheets.read_sheet_set(t.spark, path)
    return found.select("doc_id", "text", "Body", "source", "file_name")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, source || '-é' AS "café", CASE WHEN lang = 'fr' THEN 'à' || lang END AS "été" FROM documents"""
)
def sheet_set_latin(t: Tables):
    """A folder of utf-8 and latin-1 files whose headers hold accents."""
    path = t.scratch("latin-set")
    accents = t.documents.select("doc_id", F.concat("source", F.lit("-é")).alias("café"), F.concat(F.lit("à"), "lang").alias("été"), "lang")
    sinks.write_sheet(accents.where("lang <> 'fr'").select("doc_id", "café"), f"{path}/utf")
    sinks.write_sheet(accents.where("lang = 'fr'").select("doc_id", "café", "été"), f"{path}/latin", encoding="ISO-8859-1")
    return sheets.read_sheet_set(t.spark, path).select("doc_id", "café", "été")


@query(
    """SELECT 'event_id' AS "column", 'int' AS column_type, (SELECT count(*) FROM events) AS shown_rows
UNION ALL SELECT 'price', 'float', (SELECT count(*) FROM events)
UNION ALL SELECT 'kind', 'str', (SELECT count(*) FROM events)"""
)
def preview(t: Tables):
    source = t.events.select("event_id", F.col("value").cast("string").alias("price"), F.col("event_type").alias("kind"))
    texts = source.select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("event_id"), "price", "kind")
    shown, kinds = sheets.preview_raw(texts, "ord")
    return kinds.withColumn("shown_rows", F.lit(shown.count()).cast("long"))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS user FROM events")
def payload_rows(t: Tables):
    """A payload per event: sheets and record lists by turns."""
    sheet = F.to_json(
        F.struct(
            F.array(F.lit("user"), F.lit("kind")).alias("columns"),
            F.array(F.array(F.col("user_id").cast("string"), F.col("event_type"))).alias("data"),
        )
    )
    records = F.to_json(F.array(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))))
    source = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, sheet).otherwise(records).alias("payload"))
    return payloads.from_records(source, "payload", ["kind", "user"], keep=["event_id"])


@query("SELECT count(*) FILTER (event_id % 3 <> 0) AS valid, count(*) FILTER (event_id % 3 = 0) AS invalid FROM events")
def payload_checks(t: Tables):
    cells = F.when(F.col("event_id") % 3 == 0, F.array("event_type")).otherwise(F.array("event_type", "props"))
    sheet = F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("columns"), F.array(cells).alias("data")))
    checked = payloads.validate_payload(t.events.select(sheet.alias("payload")), "payload")
    return checked.agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))


@query("SELECT c_custkey, c_acctbal, c_name, c_custkey + 1 AS next FROM customer")
def export_numeric(t: Tables):
    texts = t.customer.selectExpr("string(c_custkey) AS c_custkey", "string(c_acctbal) AS c_acctbal", "c_name", "string(c_custkey + 1) AS next")
    path = t.scratch("customer-export")
    sinks.export_sheet(texts, path)
    return sheets.read_sheet(t.spark, path, infer=True)


@query(
    """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_custkey":'
  || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE CAST(o_custkey AS VARCHAR) END || '}' AS row, (SELECT count(*) FROM orders) AS total_rows,
  'o_orderkey,o_orderstatus,o_custkey' AS columns, true AS is_complete_data FROM orders"""
)
def payload_out(t: Tables):
    source = t.orders.selectExpr("o_orderkey", "o_orderstatus", "CASE WHEN o_custkey % 2 <> 0 THEN o_custkey END AS o_custkey")
    return sinks.to_payload(source, ["o_orderkey"]).withColumn("columns", F.array_join("columns", ","))


@query(
    """SELECT count(*) AS total_rows, CAST(4 AS BIGINT) AS total_columns, 's_suppkey,s_name,s_nationkey,s_acctbal' AS columns,
  '/out/supplier' AS output_path, 'supplier' AS file_processed FROM supplier"""
)
def result_record(t: Tables):
    return sinks.result_record(t.supplier, "/out/supplier", "supplier")


def _catalog(t: Tables):
    return t.lineitem.selectExpr(
        "CASE l_linenumber % 3 WHEN 0 THEN 'kpi' WHEN 1 THEN 'media' ELSE 'concatenated' END AS file_type",
        "concat('file', l_suppkey) AS file_name",
        "concat('sheet', l_partkey) AS sheet_name",
        "concat('/data/', l_orderkey, '/', l_suppkey, '/', l_partkey) AS path",
        "l_partkey % 100 AS project",
        "bigint(l_quantity) AS size",
        "l_shipdate AS modified",
    )


_CATALOG_SQL = """c AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'kpi' WHEN 1 THEN 'media' ELSE 'concatenated' END AS file_type,
  'file' || l_suppkey AS file_name, 'sheet' || l_partkey AS sheet_name, '/data/' || l_orderkey || '/' || l_suppkey || '/' || l_partkey AS path,
  l_partkey % 100 AS project, CAST(l_quantity AS BIGINT) AS size, l_shipdate AS modified FROM lineitem)"""


@query(
    f"""WITH {_CATALOG_SQL}, w AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'kpi' WHEN 1 THEN 'media' ELSE 'concatenated' END AS file_type,
  'file' || (p_partkey % 10) AS file_name, 'sheet' || p_partkey AS sheet_name FROM part)
SELECT p_partkey, (SELECT min(path) FROM c WHERE c.file_type = w.file_type AND c.sheet_name = w.sheet_name
  AND (w.file_type = 'concatenated' OR c.file_name = w.file_name)) AS path FROM w"""
)
def locate_sheets(t: Tables):
    wanted = t.part.selectExpr(
        "p_partkey",
        "CASE p_partkey % 3 WHEN 0 THEN 'kpi' WHEN 1 THEN 'media' ELSE 'concatenated' END AS file_type",
        "concat('file', p_partkey % 10) AS file_name",
        "concat('sheet', p_partkey) AS sheet_name",
    )
    return sheets.locate_all(_catalog(t), wanted).select("p_partkey", "path")


@query(
    f"""WITH {_CATALOG_SQL} SELECT path FROM c WHERE file_type = 'concatenated' AND sheet_name = 'sheet17' ORDER BY path LIMIT 1"""
)
def locate_one(t: Tables):
    return sheets.locate(_catalog(t), "concatenated", "any", "sheet17").select("path")


@query(
    f"""WITH {_CATALOG_SQL} SELECT project, file_type, file_name, count(*) AS sheets, CAST(sum(size) AS BIGINT) AS size,
  strftime(max(modified), '%Y-%m-%d') AS last_modified FROM c GROUP BY ALL"""
)
def sheet_catalog(t: Tables):
    from ..operators.catalog import sheet_catalog as summarize

    return summarize(_catalog(t)).withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd"))


@query(
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 7 = 0 THEN 'value error' ELSE event_type END AS event_type,
  CASE WHEN event_id % 5 = 0 THEN 'value error' ELSE CAST(value AS VARCHAR) END AS value FROM events"""
)
def restore_version(t: Tables):
    """First version of a sheet, brought back after a second one."""
    root = t.scratch("versions")
    first = t.events.selectExpr(
        "event_id", "CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type", "CASE WHEN event_id % 5 = 0 THEN double('infinity') ELSE value END AS value"
    )
    original = store.commit(first, root, "events", "uploaded")
    store.commit(first.withColumn("event_type", F.upper("event_type")), root, "events", "cleaned")
    restored = store.restore(t.spark, root, "events", original)
    return store.as_of(t.spark, root, restored, display=True)


@query("SELECT * FROM supplier")
def parquet_copy(t: Tables):
    path = t.scratch("supplier-parquet")
    sinks.write_parquet(t.supplier, path)
    return t.spark.read.parquet(path)


@query("SELECT o_orderstatus, count(*) AS orders, 'refused' AS one_fewer FROM orders GROUP BY ALL")
def limited_result(t: Tables):
    """A table at its limit passes; with a limit of one row fewer it is refused."""
    from ..operators.steps import check_result_size

    rows = t.orders.count()
    kept = check_result_size(t.orders, rows)
    try:
        check_result_size(t.orders, rows - 1)
        outcome = "accepted"
    except ValueError:
        outcome = "refused"
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.lit(outcome).alias("one_fewer"))


@query(
    """SELECT CAST(event_id AS VARCHAR) AS id, upper(event_type) AS kind, CAST(user_id AS VARCHAR) AS user, props, strftime(ts, '%Y-%m-%d') AS day FROM events"""
)
def replaced_sheet(t: Tables):
    """A sheet overwritten by a table of other columns, as a new version."""
    root = t.scratch("replaced")
    store.commit(t.events.select("event_id", "value"), root, "events", "uploaded")
    texts = ["string(event_id)", "upper(event_type)", "string(user_id)", "props", "date_format(ts, 'yyyy-MM-dd')"]
    version = store.replace_sheet(t.spark, root, "events", ["id", "kind", "user", "props", "day"], t.events.selectExpr(*texts))
    return store.as_of(t.spark, root, version)


@query(
    """SELECT v AS version, count(*) AS rows, min(event_type) AS least FROM (SELECT event_type, unnest(['first', 'undo']) AS v FROM events
  UNION ALL SELECT upper(event_type), unnest(['second', 'redo']) FROM events) GROUP BY v"""
)
def undo_and_redo(t: Tables):
    """Two versions, an undo to the first and a redo of the second: pointers only."""
    root = t.scratch("undo")
    first = store.commit(t.events.select("event_type"), root, "events", "uploaded")
    second = store.commit(t.events.select(F.upper("event_type").alias("event_type")), root, "events", "cleaned")
    undo = store.restore(t.spark, root, "events", first)
    redo = store.restore(t.spark, root, "events", second, "redo")
    parts = []
    for name, version in (("first", first), ("second", second), ("undo", undo), ("redo", redo)):
        content = store.as_of(t.spark, root, version)
        parts.append(content.agg(F.lit(name).alias("version"), F.count("*").alias("rows"), F.min("event_type").alias("least")))
    return union_all(parts)


_BOOKS_SQL = """b AS (SELECT 'orders-' || strftime(o_orderdate, '%Y') AS book, o_orderpriority AS sheet, *,
  row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y'), o_orderpriority ORDER BY o_orderkey) AS row_number FROM orders)"""


def _order_books(t: Tables):
    """Workbooks of the orders: a book a year, a sheet a priority."""
    root = t.scratch("workbooks")
    year = F.concat(F.lit("orders-"), F.year("o_orderdate"))
    written = book_sinks.write_workbooks(t.orders, root, year, "o_orderpriority", ["o_orderkey"])
    return root, written


@query(
    f"""WITH {_BOOKS_SQL} SELECT book || '.xlsx' AS book, sheet AS sheet_name, ordinal, sheets FROM (SELECT book, sheet,
  CAST(row_number() OVER (PARTITION BY book ORDER BY sheet) - 1 AS INTEGER) AS ordinal, CAST(count(*) OVER (PARTITION BY book) AS INTEGER) AS sheets
  FROM (SELECT DISTINCT book, sheet FROM b))"""
)
def workbook_sheets(t: Tables):
    """Sheet lists of written workbooks, beside what the writer says."""
    root, written = _order_books(t)
    name = F.element_at(F.split("path", "/"), -1).alias("book")
    listed = workbooks.list_sheets(t.spark, root).select(name, "sheet_name", "ordinal")
    return listed.join(written.select(name, "sheets"), "book")


@query(
    f"""WITH {_BOOKS_SQL} SELECT book || '.xlsx' AS book, sheet AS sheet_name, row_number, o_orderkey, o_custkey, o_orderstatus,
  o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM b"""
)
def workbook_rows(t: Tables):
    """Every cell of the written workbooks, with the types of the table again."""
    root, _ = _order_books(t)
    cells = workbooks.read_workbooks(t.spark, root, task_bytes=200_000)
    rows = workbooks.sheet_table(cells, t.orders.columns)
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("book"),
        "sheet_name",
        "row_number",
        F.col("o_orderkey").cast("long").alias("o_orderkey"),
        F.col("o_custkey").cast("long").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.substring("o_orderdate", 1, 10).alias("o_orderdate"),
        "o_orderpriority",
    )


@query(f"WITH {_BOOKS_SQL} SELECT book || '.xlsx' AS book, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM b WHERE sheet = '2-HIGH' GROUP BY book")
def workbook_one_sheet(t: Tables):
    """One sheet of each workbook; the others are not read."""
    root, _ = _order_books(t)
    rows = workbooks.sheet_table(workbooks.read_workbooks(t.spark, root, sheets=["2-HIGH"]), t.orders.columns)
    name = F.element_at(F.split("path", "/"), -1).alias("book")
    return rows.groupBy(name).agg(F.count("*").alias("orders"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"))
