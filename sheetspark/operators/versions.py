"""Version history of sheets: operations, graph, undo and script links, replay.

A versions table has ``sheet, ordinal, hash, parents, message`` (and optionally
``operation``). Lists whose length grows with the history (the children of a
version, the scripts before it) are given as edge rows or as a count into the
sheet's numbered scripts; that keeps results whole without a row, task or group
that grows without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .order import range_ordered, running
from .replay import replayed

# Words looked for in a commit message and the operation each
# stands for; the first word found wins.
OPERATION_WORDS = [
    ("undo", "undo"),
    ("redo", "redo"),
    ("cleaned", "cleaning"),
    ("melted", "melting"),
    ("mapping", "mapping"),
    ("merging", "merging"),
    ("uploaded", "uploaded"),
    ("script", "script"),
    ("updated", "updated"),
    ("google", "google sheet"),
]
# The words the replayed history looks for instead.
REPLAY_WORDS = [
    ("undo", "undo"),
    ("redo", "redo"),
    ("cleaned", "cleaning"),
    ("melted", "melting"),
    ("mapped", "mapping"),
    ("merged", "merging"),
    ("uploaded", "uploaded"),
]
SCRIPT_TARGETS = ["cleaning", "melting", "mapping"]


def classify_operation(message: Column, words: list[tuple[str, str]] = OPERATION_WORDS) -> Column:
    """Operation named by a message; what follows " - " is a path and not read."""
    head = F.lower(F.substring_index(message, " - ", 1))
    branches = F
    for word, operation in words:
        branches = branches.when(head.contains(word), operation)
    return branches.otherwise("other")


def with_operation(versions: DataFrame, words: list[tuple[str, str]] = OPERATION_WORDS) -> DataFrame:
    if "operation" in versions.columns:
        return versions
    return versions.withColumn("operation", classify_operation(F.col("message"), words))


def child_edges(versions: DataFrame) -> DataFrame:
    """(sheet, parent, child, child_ordinal) for parents in the sheet's history."""
    links = versions.select(
        "sheet",
        F.explode("parents").alias("parent"),
        F.col("hash").alias("child"),
        F.col("ordinal").alias("child_ordinal"),
    )
    known = versions.select("sheet", F.col("hash").alias("parent"))
    return links.join(known, ["sheet", "parent"], "left_semi").select("sheet", "parent", "child", "child_ordinal")


def _with_child_count(versions: DataFrame) -> DataFrame:
    counts = child_edges(versions).groupBy("sheet", F.col("parent").alias("hash")).agg(F.count("*").alias("children"))
    return versions.join(counts, ["sheet", "hash"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


def history(versions: DataFrame, sheet: str | None = None) -> DataFrame:
    """Versions with operation and number of children; oldest first by ordinal."""
    chosen = versions if sheet is None else versions.where(F.col("sheet") == sheet)
    listed = _with_child_count(with_operation(chosen)).select(
        "sheet", "ordinal", "hash", "operation", "message", "parents", "children"
    )
    return listed if sheet is None else listed.orderBy("ordinal")


def version_graph(versions: DataFrame, sheet: str | None = None) -> DataFrame:
    """Hash, parents, message and number of children; newest first for one sheet."""
    chosen = versions if sheet is None else versions.where(F.col("sheet") == sheet)
    graph = _with_child_count(chosen).select("sheet", "ordinal", "hash", "parents", "message", "children")
    return graph if sheet is None else graph.orderBy(F.desc("ordinal"))


def rewire_undo(versions: DataFrame) -> DataFrame:
    """An undo with one known parent takes that parent's first parent instead.

    An undo of an undo sees the parent already rewired, so a run of undos all
    point where its first one does. The first undo of each run is found by
    doubling: the number of joins is the logarithm of the longest run, and undos
    in a circle are an error after as many. Rows repeated with one hash count once
    as parents.
    """
    rows = with_operation(versions)
    nodes = rows.select("sheet", "hash", "parents")
    known = nodes.groupBy("sheet", F.col("hash").alias("target")).agg(F.min("parents").alias("target_parents"))
    undos = (
        rows.where((F.col("operation") == "undo") & (F.size("parents") == 1))
        .select("sheet", "hash", F.get("parents", F.lit(0)).alias("target"))
        .join(known, ["sheet", "target"])
    )
    marked = undos.select("sheet", F.col("hash").alias("target"), F.lit(True).alias("is_undo"))
    # ``head`` walks up the run; ``open`` says the walk may go on.
    runs = saved(
        undos.join(marked, ["sheet", "target"], "left").select(
            "sheet",
            "hash",
            "target",
            "target_parents",
            F.when(F.col("is_undo"), F.col("target")).otherwise(F.col("hash")).alias("head"),
            F.coalesce("is_undo", F.lit(False)).alias("open"),
        )
    )
    rounds = runs.count().bit_length() + 1
    while runs.where("open").limit(1).count():
        rounds -= 1
        if rounds < 0:
            raise ValueError("undos that point at each other in a circle have no first one")
        step = runs.select(
            "sheet", F.col("hash").alias("head"), F.col("head").alias("next_head"), F.col("open").alias("next_open")
        )
        runs = saved(
            runs.join(step, ["sheet", "head"]).select(
                "sheet", "hash", "target", "target_parents", F.col("next_head").alias("head"), F.col("next_open").alias("open")
            )
        )
    ends = runs.select(
        "sheet",
        F.col("hash").alias("head"),
        F.coalesce(F.get("target_parents", F.lit(0)), F.col("target")).alias("new_parent"),
    )
    moved = runs.select("sheet", "hash", "head").join(ends, ["sheet", "head"]).select("sheet", "hash", "new_parent")
    joined = rows.join(moved, ["sheet", "hash"], "left")
    parents = F.when(F.col("new_parent").isNotNull(), F.array("new_parent")).otherwise(F.col("parents"))
    return joined.withColumn("parents", parents).drop("new_parent").select(*rows.columns)


def numbered_scripts(versions: DataFrame, partitions: int | None = None) -> DataFrame:
    """(sheet, script_no, hash): scripts of each sheet numbered from 1."""
    scripts = with_operation(versions).where("operation = 'script'").select("sheet", "ordinal", "hash")
    ordered = range_ordered(scripts, ["sheet", "ordinal"], partitions)
    numbered = running(ordered, ["sheet"], {"script_no": ("count", F.lit(1))})
    return numbered.select("sheet", "script_no", "hash")


def link_scripts(versions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``script_parents``: how many of the sheet's scripts are parents too.

    Every cleaning, melting or mapping version has each earlier script of its
    sheet as a parent: scripts 1..n of :func:`numbered_scripts`, with n here.
    """
    rows = with_operation(versions)
    is_script = F.when(F.col("operation") == "script", 1)
    counted = running(range_ordered(rows, ["sheet", "ordinal"], partitions), ["sheet"], {"__n": ("count", is_script)})
    linked = F.when(F.col("operation").isin(SCRIPT_TARGETS), F.col("__n")).otherwise(F.lit(0)).cast("long")
    return counted.select(*rows.columns, linked.alias("script_parents"))


def history_linked(versions: DataFrame, partitions: int | None = None) -> DataFrame:
    """History with undo parents rewired and script parents counted."""
    return link_scripts(rewire_undo(with_operation(versions)), partitions).select(
        "sheet", "ordinal", "hash", "operation", "parents", "script_parents"
    )


def script_edges(linked: DataFrame, scripts: DataFrame, sheet: str) -> DataFrame:
    """Edges (parent, child) from scripts to the later versions of one sheet."""
    children = linked.where((F.col("sheet") == sheet) & (F.col("script_parents") > 0))
    numbers = children.select(
        F.col("hash").alias("child"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("script_parents"))).alias("script_no")
    )
    chosen = scripts.where(F.col("sheet") == sheet).select("script_no", F.col("hash").alias("parent"))
    return numbers.join(chosen, "script_no").select("parent", "child")


def replay_parents(versions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every version with the parent a replay gives it.

    Replaying keeps a stack per sheet: an upload resets it, an undo pops it, a
    redo hangs under the version popped last, anything else under the top; both
    are pushed. No sheet is replayed in one task: tasks replay stretches of the sorted
    versions, and their effects on the stack are combined.
    """
    rows = with_operation(versions, REPLAY_WORDS).select("sheet", "ordinal", "hash", "operation")
    return replayed(rows, partitions)


def replay_history(versions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Replayed versions without undos and redos, with their number of children."""
    parents = replay_parents(versions, partitions)
    counts = (
        parents.where("parent is not null")
        .groupBy("sheet", F.col("parent").alias("hash"))
        .agg(F.count("*").alias("children"))
    )
    kept = parents.where(~F.col("operation").isin("undo", "redo"))
    return kept.join(counts, ["sheet", "hash"], "left").select(
        "sheet", "ordinal", "hash", "operation", "parent", F.coalesce("children", F.lit(0)).cast("long").alias("children")
    )
