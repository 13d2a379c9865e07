"""Reusable chart templates matched to sheets by column name.

A request names one template and one sheet. Both sides arrive by equi-join and
the matching itself stays inside the row: a sheet's headers are one array, so
no pairs of wanted and available columns are ever shuffled. Which requests are
worth making, of all templates and sheets, comes from an index of the distinct
column names by their grams (``candidate_pairs``).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved
from .unions import union_axes


@F.pandas_udf(T.ArrayType(T.StringType()))
def _regex_hits(patterns: pd.Series, available: pd.Series) -> pd.Series:
    """First available column each pattern is found in; a bad pattern finds none."""

    def first_hit(pattern, columns):
        if pattern is None:
            return None
        try:
            search = re.compile(pattern, re.IGNORECASE).search
        except re.error:
            return None
        return next((c for c in columns if c is not None and search(c)), None)

    return pd.Series(
        [
            None if wanted is None or columns is None else [first_hit(p, columns) for p in wanted]
            for wanted, columns in zip(patterns, available)
        ]
    )


# Declared non-deterministic only so that a later filter on the result does not
# make Spark run the Python part a second time.
_regex_hits = _regex_hits.asNondeterministic()


def match_map(wanted: Column, patterns: Column, available: Column) -> tuple[Column, Column]:
    """Regex hits (to be kept as ``__hits``) and the map wanted -> available or null.

    Exact name first; else the column's pattern, ``contains`` or ``regex``, both
    in any case, taking the first hit in sheet order.
    """
    kinds = F.transform(wanted, lambda w: F.try_element_at(patterns, w))
    regexes = F.transform(kinds, lambda p: F.when(p["type"] == "regex", p["value"]))
    any_regex = F.exists(regexes, lambda r: r.isNotNull())
    # Rows without a regex send nulls, so Python sees only the rows that need it.
    hits = _regex_hits(F.when(any_regex, regexes), F.when(any_regex, available))

    def match(w: Column, i: Column) -> Column:
        pattern = F.try_element_at(patterns, w)
        holding = F.filter(available, lambda c: F.lower(c).contains(F.lower(pattern["value"])))
        return (
            F.when(F.array_contains(available, w), w)
            .when(pattern["type"] == "contains", F.get(holding, F.lit(0)))
            .when(pattern["type"] == "regex", F.get(F.col("__hits"), i))
        )

    return hits, F.map_from_arrays(wanted, F.transform(wanted, match))


def match_columns(templates: DataFrame, sheets: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with ``matches``: wanted column -> sheet column or null.

    ``templates(template, required_columns, column_patterns, plots, ...)``,
    ``sheets(sheet, columns)``, ``requests(template, sheet)``.
    """
    axes = [F.flatten(F.coalesce(F.col(f"plots.{a}"), F.array().cast("array<array<string>>"))) for a in ("x_axes", "y_axes")]
    required = F.coalesce("required_columns", F.array().cast("array<string>"))
    joined = (
        requests.join(templates, "template")
        .join(sheets, "sheet")
        .withColumn("__wanted", F.array_distinct(F.concat(required, *axes)))
    )
    hits, matches = match_map(F.col("__wanted"), F.col("column_patterns"), F.col("columns"))
    return joined.withColumn("__hits", hits).withColumn("matches", matches).drop("__hits", "__wanted")


#: Gram of names that are not plain ASCII, whose case folding differs between engines.
FOREIGN = "\x00"


def _grams(text: Column, size: int) -> Column:
    """Runs of ``size`` characters of a text; none if it is shorter."""
    last = F.length(text) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: text.substr(i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def sure_text(pattern: Column) -> Column:
    """Lower-case text that every plain ASCII match of a regular expression holds; empty
    where that is not plain to see (alternatives, groups, escapes, repeats of text)."""
    simple = F.regexp_replace(F.regexp_replace(pattern, r"\[[^\[\]\\]+\]", "."), r"\.[*+?]+", ".")
    plain = simple.rlike(r"\A[\x20-\x7e]*\z") & ~simple.rlike(r"[|?*{}\\()\[\]]")
    runs = F.split(F.lower(simple), r"[.^$+]")
    longest = F.aggregate(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    return F.when(plain, longest).otherwise("")


@F.pandas_udf(T.BooleanType())
def _regex_found(patterns: pd.Series, names: pd.Series) -> pd.Series:
    """Whether the pattern is found in the name; a bad pattern is not."""

    def found(pattern, name):
        try:
            return re.search(pattern, name, re.IGNORECASE) is not None
        except re.error:
            return False

    return pd.Series([found(p, n) for p, n in zip(patterns, names)], dtype=bool)


def _name_hits(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, kind, value, column): the names that serve each wanted column.

    Every name is posted under its runs of one to three characters. A pattern looks
    up one of them, of those it must contain the one with the fewest names, and is
    then tried on the names found. Patterns without sure text are tried on every
    distinct name.
    """
    low = F.lower("column")
    grams = F.concat(F.array(F.lit("")), *[_grams(low, n) for n in (1, 2, 3)], F.when(F.col("column").rlike(r"[^\x00-\x7f]"), F.array(F.lit(FOREIGN))).otherwise(F.array().cast("array<string>")))
    postings = saved(names.select("column", F.explode(grams).alias("gram")))
    sizes = postings.groupBy("gram").agg(F.count("*").alias("names"))
    same = asked.join(names, F.col("wanted") == F.col("column")).select("wanted", "kind", "value", "column")
    patterns = asked.where("kind IN ('contains', 'regex')").select("kind", "value").distinct()
    text = F.when(F.col("kind") == "contains", F.lower("value")).otherwise(sure_text(F.col("value")))
    sought = F.when(F.length("text") >= 3, _grams(F.col("text"), 3)).otherwise(F.array("text"))
    each = patterns.withColumn("text", text).select("kind", "value", F.explode(sought).alias("gram"))
    rarest = each.join(sizes, "gram", "left").groupBy("kind", "value").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram"))
    foreign = rarest.where("kind = 'regex' AND gram <> ''").withColumn("gram", F.lit(FOREIGN))
    tried = rarest.union(foreign).join(postings, "gram").select("kind", "value", "column").distinct()
    held = tried.where("kind = 'contains'").where(F.lower("column").contains(F.lower("value")))
    found = tried.where("kind = 'regex'").where(_regex_found("value", "column"))
    return same.union(asked.join(held.union(found), ["kind", "value"]).select("wanted", "kind", "value", "column")).distinct()


def candidate_pairs(templates: DataFrame, sheets: DataFrame) -> DataFrame:
    """(template, sheet): every pair that can fit, for ``match_columns`` to verify.

    Each template is anchored at the required column that the fewest sheets can
    serve, so pairs are made for those sheets only. A template with a column that no
    sheet can serve has no pair. Templates that require nothing fit every sheet by
    rule and are left out, as their pairs say nothing.
    """
    required = templates.select("template", "column_patterns", F.explode(F.array_distinct("required_columns")).alias("wanted"))
    pattern = F.try_element_at("column_patterns", F.col("wanted"))
    usable = pattern["value"].isNotNull() & pattern["type"].isin("contains", "regex")
    asks = saved(
        required.select(
            "template",
            "wanted",
            F.when(usable, pattern["type"]).otherwise("").alias("kind"),
            F.when(usable, pattern["value"]).otherwise("").alias("value"),
        )
    )
    columns = saved(sheets.select("sheet", F.explode(F.array_distinct("columns")).alias("column")).where("column IS NOT NULL"))
    names = saved(columns.groupBy("column").agg(F.count("*").alias("sheets")))
    ask = ["wanted", "kind", "value"]
    hits = saved(_name_hits(asks.select(*ask).distinct(), names.select("column")))
    reach = hits.join(names, "column").groupBy(*ask).agg(F.sum("sheets").alias("reach"))
    weighed = asks.join(reach, ask, "left").withColumn("reach", F.coalesce("reach", F.lit(0)))
    anchors = weighed.groupBy("template").agg(F.min_by(F.struct(*ask), F.struct("reach", *ask)).alias("anchor"), F.min("reach").alias("least"))
    anchors = anchors.where("least > 0").select("template", "anchor.*")
    return anchors.join(hits, ask).join(columns, "column").select("template", "sheet").distinct()


def fitting_pairs(templates: DataFrame, sheets: DataFrame) -> DataFrame:
    """All templates against all sheets: the matched rows of the pairs that fit, but
    for templates that require nothing."""
    pairs = candidate_pairs(templates, sheets)
    return compatible(match_columns(templates, sheets, pairs)).where("is_compatible")


def compatible(matched: DataFrame) -> DataFrame:
    """Add ``missing_columns``, ``matched_columns``, ``is_compatible``.

    A template that requires nothing fits every sheet and matches all of it.
    """
    required = F.coalesce("required_columns", F.array().cast("array<string>"))
    missing = F.filter(required, lambda r: F.col("matches")[r].isNull())
    found = F.array_compact(F.transform(required, lambda r: F.col("matches")[r]))
    return matched.select(
        "*",
        missing.alias("missing_columns"),
        F.when(F.size(required) == 0, F.col("columns")).otherwise(found).alias("matched_columns"),
        (F.size(missing) == 0).alias("is_compatible"),
    )


def remap_axes(axes: Column, matches: Column) -> Column:
    """Axes under their sheet names; null when any of them has no match."""
    mapped = F.transform(axes, lambda a: matches[a])
    return F.when(F.forall(mapped, lambda m: m.isNotNull()), mapped)


def apply_template(templates: DataFrame, sheets: DataFrame, requests: DataFrame) -> DataFrame:
    """Plots of every compatible request, with the axes of the sheet.

    A plot with an axis that cannot be mapped is left out.
    """
    fitting = compatible(match_columns(templates, sheets, requests)).where("is_compatible")
    plots = fitting.select("*", F.explode("plots").alias("plot"))
    mapped = (
        plots.withColumn("x_axes", remap_axes(F.col("plot.x_axes"), F.col("matches")))
        .withColumn("y_axes", remap_axes(F.col("plot.y_axes"), F.col("matches")))
        .where("x_axes is not null and y_axes is not null")
    )
    return mapped.select(
        "template",
        "sheet",
        F.concat(F.col("format_name"), F.lit(" - "), F.coalesce("plot.name", F.lit("Plot"))).alias("plot_name"),
        F.coalesce("plot.plot_type", F.lit("custom")).alias("plot_type"),
        "x_axes",
        "y_axes",
        F.get("y_axes", F.lit(0)).alias("y_axis"),
        F.coalesce("plot.chart_type", F.lit("bar")).alias("chart_type"),
        F.coalesce("plot.aggregation_method", F.lit("sum")).alias("aggregation_method"),
        F.coalesce("plot.date_grouping", F.lit("raw")).alias("date_grouping"),
        union_axes(F.col("x_axes"), F.col("y_axes")).alias("columns_analyzed"),
        F.concat(F.lit("Auto-generated from format: "), F.col("format_name")).alias("description"),
        F.concat(
            F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("auto-generated"), F.lit("format-applied"))
        ).alias("tags"),
    )


def usage_count(templates: DataFrame, uses: DataFrame, used_at: str = "used_at") -> DataFrame:
    """Templates with ``usage_count`` and ``last_used`` brought up to date."""
    counted = uses.groupBy("template").agg(F.count("*").alias("__uses"), F.max(used_at).alias("__last"))
    joined = templates.join(counted, "template", "left")
    changes = {
        "usage_count": F.coalesce("usage_count", F.lit(0)) + F.coalesce("__uses", F.lit(0)),
        "last_used": F.greatest("last_used", "__last"),
    }
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in templates.columns])
