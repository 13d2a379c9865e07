"""Ids and columns of odd tables, links at low thresholds, notices over lines, ids kept by workers."""

import random
import struct

import brute
import numpy as np
import pytest
from sheetspark.llm import curvepack, decontam, jaccard, licenses, tokens, warc

BIG = 2**53 + 1


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_decontamination_passes_other_columns_on(spark):
    schema = "doc_id long, text string, t string, items int, `A b` struct<`A b`:long,c:array<date>>, m map<string,double>, n_hit string, ts timestamp, v void"
    data = [
        (BIG, "one two three", "t", 7, (BIG, None), {"k": 1.5}, "h", None, None),
        (None, None, None, None, None, None, None, None, None),
        (BIG, "one two three", "t", 7, (None, []), {}, "h", None, None),
    ]
    docs = spark.createDataFrame(data, schema).coalesce(1)
    items = spark.createDataFrame([(1, "two three"), (None, "one two")], "item_id int, text string")
    for size in (1, 10_000):
        found = decontam.decontaminate(docs, items, block_chars=size)
        same = ["doc_id", "text", "t", "A b", "m", "ts"]
        assert [found.schema[c].dataType for c in same] == [docs.schema[c].dataType for c in same]
        quoted = ["doc_id", "text", "t", "`A b`", "m", "ts"]
        assert rows_of(found, *quoted) == rows_of(docs, *quoted)
        assert rows_of(found, "doc_id", "n_hit", "items") == sorted([(BIG, 3, ["", "1"])] * 2 + [(None, 0, [])], key=repr)
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


def test_records_name_the_ids_of_their_rows(spark):
    page = "x" * 1500
    data = [(7, "u1", page), (7, "u2", page), (900, "u3", page), (None, "u4", page), (BIG, "u5", "short"), (None, "u6", None)]
    got = warc.listed_records(spark.createDataFrame(data, "page_id long, url string, html string"))
    found = rows_of(got, "page_id", "payload_bytes", "record_type", "refers_to")
    # The null id is the last of the order, so its record is the response.
    expected = [(7, 1500, "revisit", None)] * 2 + [(900, 1500, "revisit", None), (None, 1500, "response", None), (BIG, 5, "response", None), (None, 0, "response", None)]
    assert found == sorted(expected, key=repr)
    twice = spark.createDataFrame([(1, "u", page), (5, "u", page), (5, "v", page), (2, "w", "s")], "id int, key string, kind string")
    named = warc.listed_records(twice.withColumnRenamed("kind", "digest"), "id", "key", "digest")
    assert rows_of(named, "id", "record_type", "refers_to") == [(1, "revisit", 5), (2, "response", None), (5, "response", None), (5, "revisit", 5)]
    assert named.schema["id"].dataType == named.schema["refers_to"].dataType == twice.schema["id"].dataType


@pytest.mark.parametrize("percent", [30, 60])
def test_linked_sets_share_a_signature_at_any_threshold(percent):
    rng = np.random.default_rng(percent)
    linked = 0
    for _ in range(1500):
        n = int(rng.integers(2, 400))
        base = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a = np.unique(base[:n])
        kept = rng.random(len(a)) < rng.uniform(percent / 100, 1)
        extra = base[n : n + int(rng.integers(0, n))]
        b = np.unique(np.concatenate([a[kept], extra]))
        if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        linked += 1
        rare = rng.uniform(0, 1)
        def frequent(x, least=rare):
            return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 > least
        assert np.intersect1d(jaccard.signatures(a, frequent(a), percent)[0], jaccard.signatures(b, frequent(b), percent)[0]).size
    assert linked > 300


def test_components_at_thirty_percent(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(0, 60, 3):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        rows += [(i, " ".join(base)), (i + 1, " ".join(base[: len(base) // 2])), (i + 2, " ".join(rng.choice(words) for _ in range(40)))]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=2, percent=30, slots=1 << 16)
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)}
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 30 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r.doc_id: r.component_id for r in found.collect()} == root


BSD = ["/* Redistribution and use in source and binary forms, with or without", " * modification, are permitted provided that the following", " * conditions are met: */"]


def test_notices_wrapped_over_lines(spark):
    prose = "\n".join(f"quorvan {i} lemtis dovar" for i in range(6))
    mit = next(b for n, b in licenses.TEMPLATES if n == "MIT" and len(b) > 900).split()
    wrapped = "\n".join("// " + " ".join(mit[i : i + 11]) + ("\n//" if i == 33 else "") for i in range(0, len(mit), 11))
    texts = [
        (1, prose + "\n" + "\n".join(BSD) + "\n" + prose),
        (2, f"# quorvan\n{wrapped}\nint lemtis;"),
        (3, "Released under the MIT License.\n" * 400),
        (4, prose),
        (5, None),
        (6, ""),
    ]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {(r.doc_id, r.line, r.lines): (r.license, r.dice) for r in licenses.license_scan(df).collect()}
    assert got[1, 6, 3] == ("BSD-3-Clause", 100.0) and got[2, 1, (len(mit) + 10) // 11 + 1] == ("MIT", 100.0)
    assert got[3, None, None][0] == "MIT" and got[3, 0, 400][0] == "MIT" and got[3, 17, 1] == ("MIT", 100.0)
    assert not {k for k in got if k[0] > 3}


def test_licences_of_odd_tables_equal_their_sql(spark):
    import duckdb

    rng = random.Random(1)
    lines = [b for _, b in licenses.TEMPLATES[:6]] + BSD + ["", "  ", "quorvan lemtis", "the software", "any person of this"]
    data = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 9))), i, "x", "y") for i in range(200)] + [(500, None, 1, "x", "y"), (501, " \n\n", 1, "x", "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, line int, license string, u string")
    connection = duckdb.connect()
    connection.register("documents", df.toArrow())
    got = licenses.license_scan(df)
    result = connection.execute(licenses.OP6_SQL)
    assert [c[0] for c in result.description] == got.columns
    assert sorted(result.fetchall(), key=repr) == rows_of(got, *got.columns)
    again = licenses.license_scan(df.unionAll(df))
    assert again.count() == 2 * got.count()
    long = spark.createDataFrame([(1, "quorvan lemtis " * 400_000), (2, "the\n" * 200_000)], "doc_id int, text string")
    assert licenses.license_scan(long).count() == 0


def test_ids_of_texts_closed_and_kept(data_dir, spark):
    rng = random.Random(9)
    pool = ["abc", "Über", "x-y.", "<|endoftext|>", "1,2", "¿", "漢字", "...", "don't"]
    texts = [None, "", " ", "<|endoftext|>"] + [" ".join(rng.choices(pool, k=rng.randrange(0, 12))) for _ in range(300)]
    words = tokens.word_ids()
    assert tokens.word_ids() is words
    plain = [x.tobytes() for x in words.encode(texts)]
    closed = [x.tobytes() for x in words.encode(texts, 2)]
    assert [c for c in closed] == [p + struct.pack("<I", 2) for p in plain]
    whole = [np.array(words.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert plain == whole


def test_packing_is_in_the_order_of_the_curve(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    pieces = curvepack.pack_along_curve(docs).orderBy("sequence_id", "offset").collect()
    signs, words = curvepack._signs(), tokens.word_ids()
    points, ids = [], []
    for doc_id, text in docs.collect():
        full = np.append(np.array(words.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(2))
        counts = np.zeros(curvepack.FEATURES)
        for token in full.tolist():
            counts[(token * 2654435761 % 2**32) >> 22] += 1
        points.append(np.floor((np.sqrt(counts) / np.sqrt(len(full)) @ signs + 4) / 8 * 4096).clip(0, 4095))
        ids.append(doc_id)
    key = dict(zip(ids, curvepack.hilbert_keys(np.array(points), curvepack.BITS).tolist()))
    assert all(abs(p.curve - key[p.doc_id]) == 0 for p in pieces)
    # Within a task the sequences follow the curve, but for the rest that is cut last.
    by_task = {}
    for p in pieces:
        by_task.setdefault(p.sequence_id >> 36, []).append((p.curve, p.doc_id))
    for order in by_task.values():
        firsts = list(dict.fromkeys(order))
        assert firsts == sorted(firsts) and len(firsts) > 1
    borders = sorted((min(x), max(x)) for x in by_task.values())
    assert all(a[1] < b[0] for a, b in zip(borders, borders[1:]))


def edited_copies(rnd, copies, words, most):
    """Copies of one text, each with some words replaced; some edits are shared."""
    base = [f"t{rnd.randint(0, 10**6)}" for _ in range(words)]
    made = []
    for i in range(copies):
        text = list(base)
        for _ in range(rnd.randint(0, most)):
            text[rnd.randrange(words)] = f"e{rnd.choice([i, i, i // 3])}"
        made.append(" ".join(text[rnd.randint(0, 3) : words - rnd.randint(0, 3)]))
    return made


def test_large_groups_of_near_copies_make_few_pairs(spark, monkeypatch):
    looked, plausible = [], jaccard._plausible
    def counted(shared, percent):
        looked.append(shared.count())
        return plausible(shared, percent)
    monkeypatch.setattr(jaccard, "_plausible", counted)
    rnd = random.Random(11)
    for copies in (120, 360):
        rows = list(enumerate(edited_copies(rnd, copies, 400, 40)))
        rnd.shuffle(rows)
        found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85, slots=1 << 16)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute.jaccard_components(rows, 4, 85)
    assert looked[0] <= 20 * 120 and looked[1] <= 20 * 360


@pytest.mark.parametrize("seed, words, percent", [(1, 60, 85), (2, 90, 80), (3, 40, 60), (4, 30, 30)])
def test_links_around_pivots_are_all_links(spark, monkeypatch, seed, words, percent):
    monkeypatch.setattr(jaccard, "TOGETHER", 3)
    rnd = random.Random(seed)
    texts = [t for _ in range(3) for t in edited_copies(rnd, 50, words, words // 3)]
    texts += [" ".join(rnd.choice(texts).split()[: words // 2] + rnd.choice(texts).split()[words // 2 :]) for _ in range(40)]
    rows = list(enumerate(texts))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=2, percent=percent, slots=1 << 12)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute.jaccard_components(rows, 2, percent)
