"""Source divergence, fingerprints and centroid clustering against plain re-statements."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from sheetspark.llm import centroids, divergence, improbable

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


# Source divergence


def divergence_brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [TERM.findall(t.translate(UPPER)) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(t, r[2]) for t, r in zip(terms, rows) if r[1] == lang]
        docs = Counter(w for t, _ in mine for w in set(t))
        kept = {w for w, n in docs.items() if n >= min_docs}
        count = defaultdict(Counter)
        for t, source in mine:
            count[source].update(w for w in t if w in kept)
            count[source] += Counter()
        whole = Counter(w for t, _ in mine for w in t if w in kept)

        def share(c, w):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in count.items():
            pairs = [(sum(apart(share(c, w), share(count[o], w)) for w in kept), o) for o in count if o != s]
            found = [(apart(share(c, w), share(whole, w)), w) for w in c if share(c, w) > share(whole, w)]
            for part, values, most in (("pair", pairs, len(pairs)), ("term", found, top)):
                for n, (v, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, n))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_divergence_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["Ab", "ab", "ß", "é1é", "zz", "q", "Ünder", "x-y", "漢", "𝒳", "c", "d"]
    rows = []
    for _ in range(150):
        source = rng.choice(["h", "h", "h", "h", "b", "c", None])
        lang = rng.choice(["en", "en", "de", None])
        text = None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randrange(0, 9)))
        rows.append((text, lang, source))
    rows += [("once only", "fr", "a"), ("", "fr", "b"), ("a a a", "en", "lone"), (None, "en", "silent")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    got = divergence.source_divergence(df, min_docs=4, top=3, held=9)
    found = {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()}
    assert found == divergence_brute(rows, 4, 3) and got.count() == len(found)
    assert any(r[1] == "silent" and r[2] == "pair" for r in found) and ("fr", "a", "pair", "b", 0, 1) in found


def test_divergence_on_odd_tables(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(empty).count() == 0
    long = " ".join(["lang"] * 300_000 + ["rare"] * 200_000)
    rows = [(long, "en", "a", "x", 1, None)] + [("lang rare g", "en", "b", "y", 2, None)] * 12
    df = spark.createDataFrame(rows, "text string, lang string, source string, term string, g int, v void")
    got = {tuple(r) for r in divergence.source_divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == divergence_brute([r[:3] for r in rows], 10, 10)


def test_terms_in_pieces():
    raw = ("aBé " * 50 + "漢" * 40).encode()
    for piece in (1, 7, 64, 10_000):
        got = [t.decode() for part in divergence.pieces_of_terms(raw, piece) for t in part]
        assert got == TERM.findall(raw.decode().translate(UPPER))


# Fingerprints


def level_brute(window: bytes) -> int:
    total = sum(int(improbable._SUMS[n]) for n in Counter(window).values())
    return ((improbable.LEVELS << 20) - total) >> 20


def features_brute(raw: bytes, ranks) -> list[bytes]:
    w, reach = improbable.WIDTH, improbable.REACH
    if len(raw) < w:
        return [raw] if raw else []
    rank = [int(ranks[level_brute(raw[i : i + w])]) for i in range(len(raw) - w + 1)]
    popular = Counter()
    for s in range(-reach + 1, len(rank)):
        run = range(max(0, s), min(len(rank), s + reach))
        popular[min(run, key=lambda i: (rank[i], i))] += 1
    return list(dict.fromkeys(raw[i : i + w] for i in sorted(popular) if popular[i] >= improbable.POPULAR))


def print_brute(raw: bytes, ranks) -> str:
    found = features_brute(raw, ranks)
    out = b""
    for at in range(0, len(found), improbable.FULL):
        bits = np.zeros(improbable.BITS, bool)
        for f in found[at : at + improbable.FULL]:
            h = len(f) * 0x9E3779B97F4A7C15 % 2**64
            padded = f.ljust(improbable.WIDTH, b"\0")
            for i in range(0, improbable.WIDTH, 8):
                h = (h ^ int.from_bytes(padded[i : i + 8], "little")) * 0xD6E8FEB86659FD93 % 2**64
                h ^= h >> 32
            for i in range(improbable.HASHES):
                bits[(h >> 11 * i) % improbable.BITS] = True
        out += np.packbits(bits).tobytes()
    return f"{len(found)}:{base64.b64encode(out).decode()}"


def parsed(text: str):
    n, _, code = text.partition(":")
    return int(n), [np.unpackbits(np.frombuffer(base64.b64decode(code)[i : i + 256], np.uint8)) for i in range(0, len(base64.b64decode(code)), 256)]


def likeness_brute(a: str, b: str) -> float:
    (n, one), (m, two) = parsed(a), parsed(b)
    if not n or not m:
        return float(n == m)
    if (m, b"".join(map(bytes, two))) < (n, b"".join(map(bytes, one))):
        (n, one), (m, two) = (m, two), (n, one)
    total = 0.0
    for i, f in enumerate(one):
        best = 0.0
        for g in two:
            least, most = sorted((int(f.sum()), int(g.sum())))
            chance = least * most / improbable.BITS
            beyond = int((f & g).sum()) - chance
            if beyond > math.sqrt(9 + 2 * math.log(len(two))) * math.sqrt(chance * (1 - most / improbable.BITS)):
                best = max(best, beyond / (least - chance))
        total += best * min(improbable.FULL, n - i * improbable.FULL)
    return min(1.0, total / n)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "βeta", "gamma7", "of", "the", "漢字", "zygote", "-", "Delta"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.mark.parametrize("seed", range(2))
def test_fingerprints_equal_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    texts = [prose(rng, n) for n in (0, 1, 2, 4, 5, 6, 9, 30, 80, 200, 900)] + [None, "a" * 500, "ab" * 300, "x"]
    texts += [texts[8], texts[9]]
    rng.shuffle(texts)
    rows = [(3 * i + 5, t, i) for i, t in enumerate(texts)]
    monkeypatch.setattr(improbable, "PART_BYTES", 1500)
    df = spark.createDataFrame(rows, "doc_id int, text string, key int").repartition(5)
    got = {r.doc_id: r for r in improbable.fingerprints(df).collect()}
    assert len(got) == len(rows)
    counts = Counter(level_brute(raw[i : i + improbable.WIDTH]) for raw in ((t or "").encode() for t in texts) for i in range(len(raw) - improbable.WIDTH + 1))
    ranks = improbable.rarity(np.array([counts[i] for i in range(improbable.LEVELS + 1)]))
    ordered = sorted(rows, reverse=True)
    for (i, t, _), (j, u, _) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = t or "", u or ""
        changed = improbable.edited(t, u).encode()
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(changed).hexdigest())
        assert got[i].fingerprint == print_brute(t.encode(), ranks)
        assert got[i].edited_fingerprint == print_brute(changed, ranks)
        assert got[i].near_edited == pytest.approx(likeness_brute(got[i].fingerprint, got[i].edited_fingerprint))
        assert got[i].near_next == pytest.approx(likeness_brute(got[i].fingerprint, got[j].fingerprint))


def test_levels_and_features_over_chunk_borders(monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, n).encode() for n in (3, 700, 0, 40, 5, 2500)]
    ranks = improbable.rarity(improbable.level_counts(texts))
    whole = [str(d) for d in improbable.digests(texts, ranks)]
    monkeypatch.setattr(improbable, "CHUNK", 257)
    assert (improbable.rarity(improbable.level_counts(texts)) == ranks).all()
    assert [str(d) for d in improbable.digests(texts, ranks)] == whole
    assert [str(improbable.digests([t], ranks)[0]) for t in texts] == whole
    data = np.frombuffer(texts[1], np.uint8)
    assert improbable.levels(data).tolist() == [level_brute(texts[1][i : i + improbable.WIDTH]) for i in range(len(data) - improbable.WIDTH + 1)]


def test_likeness_follows_what_is_shared(spark, data_dir):
    found = improbable.op12_fingerprints(spark, data_dir).toPandas()
    long = found[found.n_chars >= 600]
    assert 0.4 < long.near_edited.median() < 0.65 and (long.near_edited > 0.25).mean() > 0.97
    assert (found.near_next < 0.2).mean() > 0.97
    assert found.groupby("fingerprint").n_chars.nunique().max() == 1


def test_fingerprints_of_odd_tables(spark):
    names = "doc_id long, text string, n_chars long, fingerprint string, part int, border boolean, t string"
    blank = spark.createDataFrame([], names)
    assert improbable.fingerprints(blank).count() == 0
    assert improbable.fingerprints(blank).schema == improbable.fingerprints(spark.createDataFrame([(1, "a", 1, "f", 2, True, "t")], names)).schema
    one = improbable.fingerprints(spark.createDataFrame([(7, "just one text of some words, long enough for a window", 1, "f", 2, True, "t")], names)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(7, 1.0)]
    odd = [(None, "x", 1, "f", 2, True, "t"), (None, None, 1, "f", 2, True, "t"), (3, "same text", 1, "f", 2, True, "t")] + [(4, "same text", 0, "", 0, False, "")] * 3
    rows = improbable.fingerprints(spark.createDataFrame(odd, names)).collect()
    assert Counter(r.doc_id for r in rows) == {None: 2, 3: 1, 4: 3} and len({r.fingerprint for r in rows if r.doc_id}) == 1
    named = spark.createDataFrame([("b", "second"), ("a", "first"), ("c", None)], "name string, text string")
    assert {r.name: r.n_chars for r in improbable.fingerprints(named, id_col="name").collect()} == {"a": 5, "b": 6, "c": 0}


def test_fingerprint_of_a_very_long_text(spark):
    rng = random.Random(2)
    text = prose(rng, 300_000)
    got = {r.doc_id: r for r in improbable.fingerprints(spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id int, text string")).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0 and got[1].n_chars == len(text)
    assert 0.4 < got[1].near_edited <= 1.0


# Centroid clustering


def clusters_brute(rows, k=8, rounds=10, width=64):
    kept = [
        (i, [math.floor(1024 * float(v)) for v in x]) for i, x in rows
        if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)
    ]
    start = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()), r[1]))[:k]
    centres = [x for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centres)]
    placed = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, c, d in placed:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in placed), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    kind = [lambda: rng.gauss(0, 0.3), lambda: rng.choice([0.0, 0.5, -0.5]), lambda: rng.choice([1e4, -1e4, 1e-5])][seed]
    rows = [(i, [float(np.float32(kind())) for _ in range(64)]) for i in range(60)]
    rows += [rows[3], rows[3], (3, rows[4][1]), (None, rows[5][1])]
    rows += [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 63 + [None]), (104, [math.nan] * 64), (105, [math.inf] + [0.0] * 63)]
    df = spark.createDataFrame([(i, x, "x", 1, 2) for i, x in rows], "vec_id long, embedding array<float>, x string, cluster int, id int").repartition(4)
    got = centroids.cluster_centroids(df)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == clusters_brute(rows)


def test_clusters_of_few_vectors_and_errors(spark):
    schema = "vec_id int, embedding array<double>"
    few = [(i, [i / 7 + j for j in range(64)]) for i in range(3)]
    got = centroids.cluster_centroids(spark.createDataFrame(few, schema))
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == clusters_brute(few)
    none = centroids.cluster_centroids(spark.createDataFrame([(1, None)], schema))
    assert none.count() == 0 and none.schema == got.schema
    with pytest.raises(Exception, match="does not fit a long"):
        centroids.cluster_centroids(spark.createDataFrame([(1, [2e5] * 64)], schema)).collect()


def test_threshold_walk_finds_the_nearest_and_stops_early():
    rng = np.random.default_rng(4)
    for spread, k in ((5, 40), (500, 40), (1, 3), (100, 1)):
        table = rng.integers(-spread, spread + 1, (k, 16))
        x = rng.integers(-2 * spread, 2 * spread + 1, (300, 16))
        exact = ((x[:, None, :] - table[None]) ** 2).sum(axis=2)
        number, best = centroids.Lists(table).nearest(x)
        assert (best == exact.min(axis=1)).all() and (number == exact.argmin(axis=1)).all()


def test_sql_of_clusters_on_odd_vectors(spark):
    rows = [Row(vec_id=i, embedding=[float(np.float32(((i * 37 + j * 11) % 23 - 11) / 7)) for j in range(64)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    connection = duckdb.connect()
    connection.register("embeddings", df.toArrow())
    expected = connection.execute(centroids.OP13_SQL).fetchall()
    assert sorted(expected) == sorted(tuple(r) for r in centroids.cluster_centroids(df).select(*COLUMNS).collect())
