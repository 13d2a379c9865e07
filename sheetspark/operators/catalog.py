"""Projects, shares and catalog listings as table work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ident
from .filters import filter_equal, has_all_tags
from .tables import page

_RANK = {"view": 1, "edit": 2, "admin": 3}
_SCOPE = ["scope", "file_type", "file_name", "sheet_name"]


def _rank(level: Column) -> Column:
    branches = F
    for name, rank in _RANK.items():
        branches = branches.when(level == name, rank)
    return branches.otherwise(0)


def _given(column: str) -> Column:
    return F.coalesce(ident(column), F.lit("")) != ""


def _scoped_requests(requests: DataFrame) -> DataFrame:
    in_file = _given("file_type") & _given("file_name")
    scope = F.when(in_file & _given("sheet_name"), "sheet").when(in_file, "file").otherwise("project")
    blank = F.lit("")
    return requests.select(
        "*",
        scope.alias("__scope"),
        F.when(scope == "project", blank).otherwise(F.col("file_type")).alias("__file_type"),
        F.when(scope == "project", blank).otherwise(F.col("file_name")).alias("__file_name"),
        F.when(scope == "sheet", F.col("sheet_name")).otherwise(blank).alias("__sheet_name"),
    )


def _scoped_grants(shares: DataFrame) -> DataFrame:
    """One row per user, project and exact scope, with the highest level."""
    blank = F.lit("")

    def scope(name: str, file_type: Column, file_name: Column, sheet_name: Column) -> Column:
        return F.struct(
            F.lit(name).alias("scope"),
            file_type.alias("file_type"),
            file_name.alias("file_name"),
            sheet_name.alias("sheet_name"),
        )

    is_file = F.col("share_type") == "file"
    scopes = F.array(
        F.when(F.col("share_type") == "project", scope("project", blank, blank, blank)),
        F.when(is_file, scope("file", F.col("file_type"), F.col("file_name"), blank)),
        F.when(is_file & _given("sheet_name"), scope("sheet", F.col("file_type"), F.col("file_name"), F.col("sheet_name"))),
    )
    active = shares.where("is_active").select(
        "project_id",
        F.col("shared_with").alias("user_id"),
        F.col("permission_level"),
        F.inline(F.array_compact(scopes)),
    )
    return active.groupBy("project_id", "user_id", *_SCOPE).agg(
        F.max_by("permission_level", _rank(F.col("permission_level"))).alias("__level")
    )


def effective_permission(requests: DataFrame, projects: DataFrame, shares: DataFrame) -> DataFrame:
    """Requests with ``permission_level``: admin for the owner, else the level of
    an active share of exactly that scope, else null.

    Grants are unique per scope before the join, so requests never multiply.
    """
    owners = projects.select(F.col("project_id"), F.col("user_id").alias("__owner"))
    scoped = _scoped_requests(requests).join(owners, "project_id", "left")
    grants = _scoped_grants(shares).select(
        "project_id", "user_id", "__level", *[F.col(c).alias(f"__{c}") for c in _SCOPE]
    )
    joined = scoped.join(grants, ["project_id", "user_id", *[f"__{c}" for c in _SCOPE]], "left")
    level = F.when(F.col("__owner") == F.col("user_id"), "admin").when(F.col("__owner").isNotNull(), F.col("__level"))
    return joined.select(*map(ident, requests.columns), level.alias("permission_level"))


def shared_with(shares: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    """Active grants with project name and giver; sort by ``created_at`` to list."""
    names = projects.select("project_id", F.col("name").alias("project_name"))
    givers = users.select(
        F.col("user_id").alias("shared_by"), F.col("username").alias("shared_by_name"), F.col("email").alias("shared_by_email")
    )
    is_file = F.col("share_type") == "file"
    return (
        shares.where("is_active")
        .join(names, "project_id")
        .join(givers, "shared_by")
        .select(
            "share_id",
            "shared_with",
            "project_id",
            "project_name",
            "share_type",
            "permission_level",
            "shared_by",
            "shared_by_name",
            "shared_by_email",
            *[F.when(is_file, F.col(c)).alias(c) for c in ("file_type", "file_name", "sheet_name")],
            "created_at",
        )
    )


def _share_kinds(shares: DataFrame) -> list[tuple[DataFrame, list[str]]]:
    """Active shares by the keys an item must match."""
    active = shares.where("is_active")
    is_file, names_sheet = F.col("share_type") == "file", _given("sheet_name")
    in_file = ["project_id", "file_type", "file_name"]
    return [
        (active.where("share_type = 'project'"), ["project_id"]),
        (active.where(is_file & ~names_sheet), in_file),
        (active.where(is_file & names_sheet), [*in_file, "sheet_name"]),
    ]


def share_scoped(items: DataFrame, shares: DataFrame, user: object) -> DataFrame:
    """Items that the active shares of one user open, each item once.

    A project share opens all items of the project, a file share those of its
    file, and only those of its sheet when it names one. Items meet the distinct
    scopes of each kind, so they never multiply.
    """
    opened = items
    flags = []
    for i, (grants, keys) in enumerate(_share_kinds(shares.where(F.col("shared_with") == F.lit(user)))):
        scopes = grants.select(*keys).distinct().withColumn(f"__open{i}", F.lit(True))
        opened = opened.join(scopes, keys, "left")
        flags.append(F.col(f"__open{i}"))
    return opened.where(F.coalesce(*flags, F.lit(False))).select(*map(ident, items.columns))


def share_sizes(items: DataFrame, shares: DataFrame) -> DataFrame:
    """(share_id, shared_with, items): how many items each active share opens.

    Items are counted per scope before they meet the shares, so neither a large
    project nor a much shared one is paired row by row.
    """
    parts = []
    for grants, keys in _share_kinds(shares):
        counts = items.groupBy(*keys).agg(F.count("*").alias("items"))
        parts.append(grants.join(counts, keys, "left").select("share_id", "shared_with", F.coalesce("items", F.lit(0)).alias("items")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def list_catalog(
    df: DataFrame,
    filters: Mapping[str, Any] | None = None,
    tags: Sequence[str] = (),
    tags_column: str = "tags",
    order_by: str = "updated_at",
    tie: str | None = None,
    page_number: int = 1,
    page_size: int = 20,
) -> DataFrame:
    """One page of catalog rows, newest first, after equality and tag filters."""
    kept = filter_equal(df, filters or {})
    if tags:
        kept = has_all_tags(kept, tags_column, tags)
    order = [ident(order_by).desc(), *([ident(tie)] if tie else [])]
    return page(kept, order, page_number, page_size)


def project_listing(projects: DataFrame) -> DataFrame:
    """(project_id, name, file_type, id, path, file_name): files numbered from 1."""
    kinds = {"kpi": "kpi_file", "media": "media_file", "concatenated": "concatenated_file"}
    lists = F.array(
        *[
            F.struct(F.lit(kind).alias("file_type"), ident(column).alias("files"))
            for kind, column in kinds.items()
            if column in projects.columns
        ]
    )
    kinds_rows = projects.select("project_id", "user_id", "name", F.inline(lists))
    numbered = kinds_rows.select("project_id", "user_id", "name", "file_type", F.posexplode("files").alias("pos", "file_name"))
    folder = F.concat(
        F.lit("user_"), F.col("user_id").cast("string"), F.lit("/project_"), F.col("project_id").cast("string"), F.lit("/")
    )
    return numbered.select(
        "project_id",
        "name",
        "file_type",
        (F.col("pos") + 1).alias("id"),
        F.concat(folder, F.col("file_type"), F.lit("/"), F.col("file_name")).alias("path"),
        "file_name",
    )


def sheet_catalog(catalog: DataFrame) -> DataFrame:
    """(project, file_type, file_name) with number of sheets, bytes and last change."""
    return catalog.groupBy("project", "file_type", "file_name").agg(
        F.count("*").alias("sheets"), F.sum("size").alias("size"), F.max("modified").alias("last_modified")
    )


def enumerate_items(df: DataFrame, column: str, name: str = "item") -> DataFrame:
    """List items with their 1-based position."""
    others = [ident(c) for c in df.columns if c != column]
    rows = df.select(*others, F.posexplode(ident(column)).alias("position", name))
    return rows.withColumn("position", F.col("position") + 1)
