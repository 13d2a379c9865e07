"""Request logs: masking, building, querying, statistics, retention."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..functions.text import ident
from .filters import exclude_any, filter_contains_ci, filter_equal, filter_equals_ci, filter_time, scope_filter
from .tables import page

MASK = "***MASKED***"
# A key that contains one of these words is masked.
SENSITIVE_WORDS = [
    "password",
    "token",
    "access",
    "refresh",
    "secret",
    "key",
    "authorization",
    "auth",
    "credential",
    "private",
]
# Headers and form fields that are dropped.
DROPPED_HEADERS = ["authorization", "cookie", "x-csrftoken", "x-api-key"]
DROPPED_FIELDS = ["password", "token", "access", "refresh", "secret", "key"]
# Endpoints the activity feed leaves out.
QUIET_ENDPOINTS = [
    "getCommits",
    "getCommitsArray",
    "auth",
    "projectss",
    "get-shared-projects",
    "save-pivot",
    "save-plots",
    "fetch-pivot-plots",
    "update-sheet-data",
    "upload",
    "fetch_scripts",
    "project-details",
    "fetch-report-pivot",
]


def is_sensitive(key: str) -> bool:
    return any(word in key.lower() for word in SENSITIVE_WORDS)


def _masked(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: MASK if is_sensitive(k) else _masked(v) for k, v in value.items()}
    return [_masked(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def mask_json(texts: pd.Series) -> pd.Series:
    """JSON object text with sensitive values masked at any depth.

    Text that is no JSON object is returned as it is.
    """

    def mask(text):
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            return text
        if not isinstance(value, dict):
            return text
        return json.dumps(_masked(value), separators=(",", ":"), ensure_ascii=False)

    return texts.map(mask)


def mask_value(value: Column, dtype: T.DataType) -> Column:
    """Same for typed columns, rebuilt by expression from the known schema."""
    if isinstance(dtype, T.StructType):
        fields = []
        for field in dtype.fields:
            inner = value.getField(field.name)
            masked = F.lit(MASK) if is_sensitive(field.name) else mask_value(inner, field.dataType)
            fields.append(masked.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: mask_value(item, dtype.elementType))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        words = "|".join(SENSITIVE_WORDS)
        if isinstance(dtype.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: F.when(F.lower(k).rlike(words), MASK).otherwise(v))
        return F.transform_values(
            value, lambda k, v: F.when(~F.lower(k).rlike(words), mask_value(v, dtype.valueType))
        )
    return value


def drop_keys(value: Column, names: Sequence[str]) -> Column:
    """Map without the listed keys, in any case."""
    return F.map_filter(value, lambda k, _: ~F.lower(k).isin(list(names)))


def resolve_user(logs: DataFrame, users: DataFrame, projects: DataFrame) -> DataFrame:
    """Add ``user_id``: the first that exists of the payload's user, the query
    parameter's, the session's, and the owner of the payload's project."""
    sources = ["payload_user", "param_user", "session_user"]
    known = users.select("user_id").distinct()
    resolved = logs
    for name in sources:
        side = known.select(F.col("user_id").alias(name), F.col("user_id").alias(f"__{name}"))
        resolved = resolved.join(side, name, "left")
    owners = projects.select(F.col("project_id"), F.col("user_id").alias("__owner"))
    resolved = resolved.join(owners, "project_id", "left")
    user = F.coalesce(*[F.col(f"__{name}") for name in sources], F.col("__owner"))
    return resolved.select(*map(ident, logs.columns), user.alias("user_id"))


def build_log(requests: DataFrame, users: DataFrame, projects: DataFrame) -> DataFrame:
    """Log rows from raw requests: masked payload, safe headers, user, duration."""
    context = ["file_type", "file_name", "sheet_name"]
    body = F.get_json_object("body", "$")
    pulled = requests.select(
        "*",
        F.get_json_object("body", "$.user_id").try_cast("long").alias("payload_user"),
        F.try_element_at("params", F.lit("user_id")).try_cast("long").alias("param_user"),
        F.get_json_object("body", "$.project_id").try_cast("long").alias("project_id"),
        *[F.get_json_object("body", f"$.{c}").alias(c) for c in context],
    )
    status = F.when(F.col("error_message").isNotNull(), 500).otherwise(F.coalesce("status", F.lit(500)))
    return resolve_user(pulled, users, projects).select(
        "request_id",
        "user_id",
        F.col("path").alias("endpoint"),
        "method",
        "ip_address",
        mask_json(F.when(body.startswith("{"), F.col("body")).otherwise("{}")).alias("request_payload"),
        drop_keys(F.col("headers"), DROPPED_HEADERS).alias("request_headers"),
        "params",
        F.col("started_at").alias("request_timestamp"),
        status.cast("int").alias("response_status"),
        numbers.duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"),
        "error_message",
        "project_id",
        *context,
    )


def with_status_flags(logs: DataFrame) -> DataFrame:
    status = F.col("response_status")
    return logs.withColumn("is_success", numbers.is_success(status)).withColumn("is_error", numbers.is_error(status))


def query_logs(
    logs: DataFrame,
    user_id: int | None = None,
    project_id: int | None = None,
    endpoint: str | None = None,
    method: str | None = None,
    response_status: int | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    page_number: int = 1,
    page_size: int = 50,
    tie: str | None = "request_id",
) -> DataFrame:
    """One page of matching logs, newest first, with status flags."""
    kept = filter_equal(logs, {"user_id": user_id, "project_id": project_id, "response_status": response_status})
    kept = filter_equals_ci(filter_contains_ci(kept, "endpoint", endpoint), "method", method)
    kept = filter_time(kept, "request_timestamp", start_date, end_date)
    order = [F.col("request_timestamp").desc(), *([ident(tie)] if tie else [])]
    return page(with_status_flags(kept), order, page_number, page_size, past_end="last")


def activity_feed(
    logs: DataFrame, level: str, keys: dict[str, Any], page_number: int = 1, page_size: int = 15, tie: str | None = "request_id"
) -> DataFrame:
    """One page of a user's, project's or sheet's requests without the quiet ones."""
    kept = scope_filter(exclude_any(logs, "endpoint", QUIET_ENDPOINTS), level, keys)
    order = [F.col("request_timestamp").desc(), *([ident(tie)] if tie else [])]
    return page(kept, order, page_number, page_size)


def log_overview(logs: DataFrame) -> DataFrame:
    """One row: requests, successes, errors, success rate, mean duration."""
    row = logs.agg(
        F.count("*").alias("total_requests"),
        F.count_if(numbers.is_success(F.col("response_status"))).alias("successful_requests"),
        F.count_if(
            F.coalesce(numbers.is_error(F.col("response_status")), F.lit(False)) | F.col("error_message").isNotNull()
        ).alias("error_requests"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("__mean"),
    )
    return row.select(
        "total_requests",
        "successful_requests",
        "error_requests",
        numbers.percent_of(F.col("successful_requests"), F.col("total_requests")).alias("success_rate"),
        numbers.round_half_even_scaled(F.col("__mean")).alias("avg_response_time_ms"),
    )


def distribution(df: DataFrame, key: str) -> DataFrame:
    """(key, count), most frequent first."""
    return df.groupBy(ident(key)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), ident(key))


def top_groups(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n most frequent values; equal counts by value."""
    return distribution(df, key).limit(n)


def recent(logs: DataFrame, days: int, now: Column) -> DataFrame:
    stamp = F.col("request_timestamp")
    return logs.where((stamp >= now - F.make_dt_interval(F.lit(days))) & (stamp <= now))


def log_stats(logs: DataFrame, n: int = 10) -> DataFrame:
    """(section, item, value): overview, top endpoints, statuses, users, methods."""
    summary = log_overview(logs)
    parts = [
        summary.select([F.col(c).cast("double").alias(c) for c in summary.columns])
        .unpivot([], summary.columns, "item", "value")
        .select(F.lit("overview").alias("section"), "item", "value")
    ]
    groups = [
        ("top_endpoints", top_groups(logs, "endpoint", n)),
        ("error_statuses", top_groups(logs.where(numbers.is_error(F.col("response_status"))), "response_status", n)),
        ("top_users", top_groups(logs.where("user_id is not null"), "user_id", n)),
        ("method_distribution", distribution(logs, "method")),
    ]
    for section, frame in groups:
        parts.append(
            frame.select(
                F.lit(section).alias("section"),
                ident(frame.columns[0]).cast("string").alias("item"),
                F.col("count").cast("double").alias("value"),
            )
        )
    stats = parts[0]
    for part in parts[1:]:
        stats = stats.unionByName(part)
    return stats
