"""Versions, shares, logs and templates on hand-made rows."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheetspark.operators import audit, catalog, chart, templates, versions

VERSION = "sheet string, ordinal int, hash string, parents array<string>, message string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_classify_reads_only_the_operation(spark):
    cases = {
        "uploaded - 1/2/undo.csv": "uploaded",
        "undo - x": "undo",
        "Script execution: kpi/merged": "script",
        "mapping - melted/a": "mapping",
        "merge - 1/2": "other",
        "Google import": "google sheet",
        "anything": "other",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r[0]: r[1] for r in df.select("m", versions.classify_operation(F.col("m"))).collect()} == cases


def replay(history):
    """Brute force of one sheet."""
    stack, popped, parents = [], None, {}
    for name, operation in history:
        parents[name] = None
        if operation == "uploaded":
            stack = [name]
        elif operation == "undo":
            if stack:
                popped = stack.pop()
        else:
            if operation == "redo" and popped:
                parents[name] = popped
            elif stack:
                parents[name] = stack[-1]
            stack.append(name)
    return parents


@pytest.mark.parametrize("partitions", [1, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_replay_with_a_hot_sheet(spark, partitions, seed):
    rng = random.Random(seed)
    data, expected = [], {}
    for sheet, length in (("hot", 400), ("a", 9), ("b", 1), ("c", 30)):
        history = [
            (f"{sheet}{i}", rng.choice(["uploaded"] + ["undo"] * 6 + ["redo"] * 3 + ["cleaned", "melted", "other"] * 2))
            for i in range(length)
        ]
        expected.update(replay(history))
        data += [(sheet, i, name, [], f"{operation} - x") for i, (name, operation) in enumerate(history)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, VERSION)
    found = {r["hash"]: r["parent"] for r in versions.replay_parents(df, partitions).collect()}
    assert found == expected
    kept = versions.replay_history(df, partitions).collect()
    children = {}
    for child, parent in expected.items():
        if parent:
            children[parent] = children.get(parent, 0) + 1
    assert {r["hash"]: r["children"] for r in kept} == {r["hash"]: children.get(r["hash"], 0) for r in kept}
    assert not {r["operation"] for r in kept} & {"undo", "redo"}


@pytest.mark.parametrize("partitions", [5, 37])
def test_replay_of_random_histories_over_task_borders(spark, partitions):
    rng = random.Random(partitions)
    data, expected = [], {}
    for sheet in range(25):
        weights = [rng.choice([0, 0, 1]), rng.randrange(1, 9), rng.randrange(0, 4), rng.randrange(1, 6)]
        history = [(f"{sheet}-{i}", rng.choices(["uploaded", "undo", "redo", "cleaned"], weights)[0]) for i in range(rng.choice([1, 40, 160]))]
        expected.update(replay(history))
        data += [(None if sheet == 7 else f"s{sheet}", i, name, [], operation) for i, (name, operation) in enumerate(history)]
    deep = [(f"deep{i}", "cleaned" if i < 300 else "undo" if i < 560 else rng.choice(["redo", "undo", "cleaned"])) for i in range(700)]
    expected.update(replay(deep))
    data += [("deep", i, name, [], operation) for i, (name, operation) in enumerate(deep)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, VERSION)
    assert {r["hash"]: r["parent"] for r in versions.replay_parents(df, partitions).collect()} == expected
    plan = versions.replay_parents(df, partitions)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan


def test_replay_of_no_versions(spark):
    assert versions.replay_history(spark.createDataFrame([], VERSION)).count() == 0


def rewire(history):
    """Brute force in commit order."""
    parents = {name: list(p) for name, _, p in history}
    for name, operation, _ in history:
        if operation == "undo" and len(parents[name]) == 1 and parents[name][0] in parents:
            above = parents[parents[name][0]]
            if above:
                parents[name] = [above[0]]
    return parents


@pytest.mark.parametrize("seed", [3, 4])
def test_rewire_undo_runs(spark, seed):
    rng = random.Random(seed)
    history = []
    for i in range(120):
        known = [f"v{j}" for j in range(max(0, i - 2), i)]
        parents = [] if not known else [known[-1]] if rng.random() < 0.8 else rng.sample([*known, "elsewhere"], rng.randint(1, len(known)))
        history.append((f"v{i}", rng.choice(["undo", "undo", "undo", "cleaned"]), parents))
    df = spark.createDataFrame([("s", i, h, p, op) for i, (h, op, p) in enumerate(history)], VERSION)
    found = {r["hash"]: r["parents"] for r in versions.rewire_undo(df).collect()}
    assert found == rewire(history)


def test_scripts_and_children(spark):
    df = spark.createDataFrame(
        [
            ("s", 0, "a", [], "uploaded - x"),
            ("s", 1, "b", ["a"], "Script execution: x"),
            ("s", 2, "c", ["b"], "cleaned - x"),
            ("s", 3, "d", ["c"], "script - y"),
            ("s", 4, "e", ["d", "gone"], "melted - x"),
            ("s", 5, "f", ["e"], "undo - x"),
            ("t", 0, "g", ["a"], "mapping - x"),
        ],
        VERSION,
    )
    linked = versions.history_linked(df, 3)
    assert {r["hash"]: r["script_parents"] for r in linked.collect()} == {"a": 0, "b": 0, "c": 1, "d": 0, "e": 2, "f": 0, "g": 0}
    assert {r["hash"]: r["parents"] for r in linked.collect()}["f"] == ["d"]
    scripts = versions.numbered_scripts(df)
    assert rows(versions.script_edges(linked, scripts, "s")) == [("b", "c"), ("b", "e"), ("d", "e")]
    assert rows(versions.child_edges(df), "parent", "child") == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")]
    assert [r["hash"] for r in versions.version_graph(df, "s").collect()] == list("fedcba")
    assert [r["children"] for r in versions.history(df, "s").collect()] == [1, 1, 1, 1, 1, 0]


SHARE = (
    "share_id int, project_id int, shared_with int, shared_by int, share_type string, file_type string, file_name string, "
    "sheet_name string, permission_level string, is_active boolean, created_at timestamp_ntz"
)
NOW = datetime(2024, 5, 6)
SHARES = [
    (1, 10, 2, 1, "project", None, None, None, "edit", True, NOW),
    (2, 10, 3, 1, "file", "kpi", "f", "s", "view", True, NOW),
    (3, 10, 3, 1, "file", "kpi", "f", "t", "admin", True, NOW),
    (4, 10, 4, 1, "file", "media", "g", None, "edit", True, NOW),
    (5, 10, 5, 1, "project", None, None, None, "admin", False, NOW),
]


def test_effective_permission(spark):
    shares = spark.createDataFrame(SHARES, SHARE)
    projects = spark.createDataFrame([(10, 1)], "project_id int, user_id int")
    cases = [
        (1, 10, "kpi", "f", "s", "admin"),  # owner
        (2, 10, None, None, None, "edit"),
        (2, 10, "kpi", "f", None, None),  # a project share is no file share
        (3, 10, "kpi", "f", "s", "view"),
        (3, 10, "kpi", "f", None, "admin"),  # highest of the file's grants
        (3, 10, "kpi", "f", "zz", None),
        (4, 10, "media", "g", "", "edit"),
        (4, 10, "media", "g", "s", None),
        (5, 10, None, None, None, None),  # inactive
        (2, 99, None, None, None, None),  # no such project
    ]
    requests = spark.createDataFrame(
        [(i, *c[:5]) for i, c in enumerate(cases)],
        "id int, user_id int, project_id int, file_type string, file_name string, sheet_name string",
    )
    found = {r["id"]: r["permission_level"] for r in catalog.effective_permission(requests, projects, shares).collect()}
    assert found == {i: c[5] for i, c in enumerate(cases)}


def test_share_scoped_items(spark):
    items = spark.createDataFrame(
        [(1, 10, "kpi", "f", "s"), (2, 10, "kpi", "f", "t"), (3, 10, "media", "g", "s"), (4, 11, "kpi", "f", "s")],
        "item int, project_id int, file_type string, file_name string, sheet_name string",
    )
    shares = spark.createDataFrame(SHARES, SHARE)
    opened = {user: [r["item"] for r in catalog.share_scoped(items, shares, user).orderBy("item").collect()] for user in (2, 3, 4, 5)}
    assert opened == {2: [1, 2, 3], 3: [1, 2], 4: [3], 5: []}
    sizes = {r["share_id"]: r["items"] for r in catalog.share_sizes(items, shares).collect()}
    assert sizes == {1: 3, 2: 1, 3: 1, 4: 1}


def brute_mask(value):
    words = audit.SENSITIVE_WORDS
    if isinstance(value, dict):
        return {k: audit.MASK if any(w in k.lower() for w in words) else brute_mask(v) for k, v in value.items()}
    return [brute_mask(v) for v in value] if isinstance(value, list) else value


def test_mask_json(spark):
    payloads = [
        {"password": "x", "a": {"API_KEY": {"b": 1}, "list": [{"accessLevel": 2, "ok": "é"}, [{"secret": 1}], 3]}},
        {"monkey": 1, "plain": None},
        {},
    ]
    texts = [json.dumps(p) for p in payloads] + ["[1]", "not json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in df.orderBy("i").select(audit.mask_json(F.col("t"))).collect()]
    assert [json.loads(t) for t in found[:3]] == [brute_mask(p) for p in payloads]
    assert found[3:] == ["[1]", "not json", None]


def test_mask_typed(spark):
    df = spark.createDataFrame(
        [({"Token": "t", "n": "v"}, (1, [("k", "s")]), None)],
        "m map<string,string>, s struct<auth:int,items:array<struct<my_secret:string,ok:string>>>, n struct<key:int>",
    )
    masked = df.select(*[audit.mask_value(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert masked["m"] == {"Token": audit.MASK, "n": "v"}
    assert masked["s"].asDict(True) == {"auth": audit.MASK, "items": [{"my_secret": audit.MASK, "ok": "s"}]}
    assert masked["n"] is None


def test_resolve_user_order(spark):
    users = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "user_id int")
    projects = spark.createDataFrame([(10, 4)], "project_id int, user_id int")
    logs = spark.createDataFrame(
        [(0, 1, 2, 3, 10), (1, 99, 2, 3, 10), (2, None, None, 3, 10), (3, None, 99, None, 10), (4, None, None, None, 11)],
        "i int, payload_user int, param_user int, session_user int, project_id int",
    )
    found = {r["i"]: r["user_id"] for r in audit.resolve_user(logs, users, projects).collect()}
    assert found == {0: 1, 1: 2, 2: 3, 3: 4, 4: None}


def test_fitting_pairs_against_all_pairs(spark):
    """The index of names finds exactly the pairs that trying every pair finds."""
    names = ["id", "Order Date", "order", "Größe", "STRASSE", "straße", "K\u212a", "desk", "a.b", "", "x", "Sales [EUR]", "sales total", "ſum", "İd"]
    rng = random.Random(4)
    sheets = [(i, rng.sample(names, rng.randint(1, 5))) for i in range(60)] + [(60, []), (61, ["id", None])]
    patterns = [
        None, ("contains", "ORD"), ("contains", "s"), ("contains", ""), ("contains", "straß"), ("contains", None), ("contains", "no such"),
        ("regex", "^or.*date$"), ("regex", "("), ("regex", "s[ak]les?"), ("regex", "order|x"), ("regex", "des+k"), ("regex", "dk"), ("regex", "kk"),
        ("regex", r"a\.b"), ("regex", "[st]um"), ("regex", "sum"), ("regex", "größe"), ("regex", ""), ("regex", ".+total"), ("other", "id"),
    ]
    wanted = ["w", "id", "order"]
    formats = [(f"t{i}", [wanted[i % 3]], {wanted[i % 3]: p} if p else {}, []) for i, p in enumerate(patterns * 3)]
    formats += [(f"two{i}", ["id", "v"], {"v": p}, []) for i, p in enumerate(patterns) if p] + [("none", [], {}, []), ("null", None, None, None)]
    plot = "array<struct<x_axes: array<string>, y_axes: array<string>>>"
    kind = f"template string, required_columns array<string>, column_patterns map<string, struct<type: string, value: string>>, plots {plot}"
    table, all_sheets = spark.createDataFrame(formats, kind), spark.createDataFrame(sheets, "sheet int, columns array<string>")
    every = spark.createDataFrame([(f[0], s[0]) for f in formats if f[1] for s in sheets], "template string, sheet int")
    expected = templates.compatible(templates.match_columns(table, all_sheets, every)).where("is_compatible")
    found = templates.fitting_pairs(table, all_sheets)

    def shown(df):
        return sorted((r.template, r.sheet, tuple(r.matched_columns)) for r in df.collect())

    assert shown(found) == shown(expected) and len(shown(found)) > 300
    assert templates.fitting_pairs(table, all_sheets.limit(0)).count() == 0
    assert templates.fitting_pairs(table.limit(0), all_sheets).count() == 0


def test_templates(spark):
    pattern = "map<string,struct<type:string,value:string>>"
    plot = "struct<name:string,plot_type:string,x_axes:array<string>,y_axes:array<string>,chart_type:string,aggregation_method:string,date_grouping:string>"
    rules = {"month": ("contains", "MON"), "sales": ("regex", r"(?P<n>^rev|^sale)"), "cost": ("regex", "("), "odd": ("exact", "x")}
    table = spark.createDataFrame(
        [
            ("t1", "Fmt", ["month", "sales"], rules, [("P", None, ["month"], ["sales", "region"], None, "avg", None), (None, "line", ["month"], ["cost"], "line", None, None)], ["a"]),
            ("t2", "Free", [], rules, [("Q", None, ["odd"], [], None, None, None)], None),
            ("t3", "None", ["cost"], None, [], []),
        ],
        f"template string, format_name string, required_columns array<string>, column_patterns {pattern}, plots array<{plot}>, tags array<string>",
    )
    sheets = spark.createDataFrame(
        [("s1", ["Revenue", "Sales total", "Month", "month_no", "region"]), ("s2", ["x"])], "sheet string, columns array<string>"
    )
    requests = spark.createDataFrame([(t, s) for t in ("t1", "t2", "t3") for s in ("s1", "s2")], "template string, sheet string")
    checked = templates.compatible(templates.match_columns(table, sheets, requests))
    found = {(r["template"], r["sheet"]): (r["is_compatible"], r["matched_columns"], r["missing_columns"]) for r in checked.collect()}
    assert found["t1", "s1"] == (True, ["Month", "Revenue"], [])
    assert found["t1", "s2"] == (False, [], ["month", "sales"])
    assert found["t2", "s2"] == (True, ["x"], [])
    assert found["t3", "s1"] == (False, [], ["cost"])
    plots = templates.apply_template(table, sheets, requests).collect()
    assert len(plots) == 1
    only = plots[0].asDict()
    assert only["plot_name"] == "Fmt - P" and only["y_axes"] == ["Revenue", "region"] and only["y_axis"] == "Revenue"
    assert only["columns_analyzed"] == ["Month", "Revenue", "region"]
    assert (only["chart_type"], only["aggregation_method"], only["date_grouping"], only["plot_type"]) == ("bar", "avg", "raw", "custom")
    assert only["tags"] == ["a", "auto-generated", "format-applied"]


def test_plot_summary(spark):
    df = spark.createDataFrame(
        [("p", "stacked", ["a"], ["b", "c"], NOW, None), ("q", "bar", [], None, NOW, "text")],
        "plot_name string, chart_type string, x_axes array<string>, y_axes array<string>, created_at timestamp_ntz, description string",
    )
    assert rows(chart.plot_summary(df)) == [
        ("p", "STACKED (2 series)", "a", "b, c", "2024-05-06 00:00", "No description"),
        ("q", "bar", "N/A", "N/A", "2024-05-06 00:00", "text"),
    ]


def test_enumerate_and_listing(spark):
    df = spark.createDataFrame([(1, 7, "n", ["a", "b"], [])], "project_id int, user_id int, name string, kpi_file array<string>, media_file array<string>")
    assert rows(catalog.project_listing(df), "file_type", "id", "path") == [("kpi", 1, "user_7/project_1/kpi/a"), ("kpi", 2, "user_7/project_1/kpi/b")]
    assert rows(catalog.enumerate_items(df.select("project_id", "kpi_file"), "kpi_file")) == [(1, 1, "a"), (1, 2, "b")]
