"""The numbered operators against brute force, round trips, and odd input."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from sheetspark.llm import bestfit, curvepack, decontam, jaccard, licenses, linealign, maxent, quality, queries, suffixes, tokens, warc
from sheetspark.llm.components import components

ODD = [(None, None), (1, ""), (2, "x y"), (2, "x y"), (3, "a b c\n" * 40), (5, None)]


@pytest.fixture(scope="module")
def docs(spark, data_dir):
    return [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", i, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key long, kept string")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# Quality rules


def test_frequent_lines_go_and_depleted_documents_fail(spark):
    prose = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Menu  {i % 10}\n{prose} a{i} b{i}", "h") for i in range(30)]
    rows += [(100 + i, f"menu {i % 10}\n" * 40 + f"own{i} " * 3, "h") for i in range(5)]
    judged = quality.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string"), max_repeat_percent=100)
    by = {r.doc_id: r for r in judged.collect()}
    assert by[3].clean_text == f"{prose} a3 b3" and by[3].kept and by[3].n_line_words == 2
    assert by[101].clean_text.strip() == "own1 own1 own1" and not by[101].kept and not by[101].base_failed


def test_copies_alone_make_no_line_frequent(spark):
    text = " ".join(f"w{i}" for i in range(60))
    judged = quality.quality_rules(spark.createDataFrame([(i, text, "h") for i in range(40)], "doc_id int, text string, source string"))
    assert judged.where("kept AND n_line_words = 0").count() == 40


def test_quality_on_odd_input(spark, odd):
    judged = quality.quality_rules(odd, min_docs=2, max_host_share=0.0)
    assert judged.count() == len(ODD) and judged.where("kept").count() == 0
    assert judged.columns[:4] == ["doc_id", "text", "source", "key"] and "kept" in judged.columns
    assert quality.quality_rules(odd.limit(0)).count() == 0


# N-gram Jaccard join


def test_components_match_brute_force(spark, data_dir, docs):
    assert rows_of(queries.QUERIES["op2_jaccard_join"](spark, data_dir), "doc_id", "n_shingles", "component_id") == sorted(
        brute.jaccard_components(docs, 4, 85), key=repr
    )


def test_near_copies_around_the_threshold(spark):
    rnd = random.Random(7)
    base = [f"t{rnd.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = f"e{i}"
        rows.append((i, " ".join(words)))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85, slots=1 << 16)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(rows, 4, 85), key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_linked_sets_share_a_signature(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(2, 200))
    x = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
    gone = int(rnd.integers(0, max(1, len(x) // 6)))
    y = np.unique(np.concatenate([x[gone:], rnd.integers(0, 2**63, int(rnd.integers(0, gone + 1))).astype(np.uint64)]))
    share = rnd.random()

    def frequent(tokens):
        return (tokens % np.uint64(1000)).astype(float) / 1000 < share

    both = len(np.intersect1d(x, y))
    if both and 100 * both >= 85 * (len(x) + len(y) - both) and len(x) + len(y) > 2 * both:
        a, b = (jaccard.signatures(t, frequent(t), 85)[0] for t in (x, y))
        assert len(np.intersect1d(a, b))
    odd = np.unpackbits((jaccard.parities(x) ^ jaccard.parities(y)).view(np.uint8)).sum()
    assert odd <= len(x) + len(y) - 2 * both


def test_jaccard_on_odd_input(spark, odd):
    found = jaccard.jaccard_components(odd, slots=1 << 16)
    assert found.count() == len(ODD) and found.where("n_shingles = 1").select("component_id").distinct().count() == 1
    assert jaccard.jaccard_components(odd.limit(0), slots=1 << 16).count() == 0


def test_components_of_chains(spark):
    rows = [(i, i + 1) for i in range(40) if i % 10] + [(50, 55), (55, 50), (60, 60)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(found[i] == (i - 1) // 10 * 10 + 1 for i in range(1, 41)) and found[55] == 50 and 60 not in found


# Decontamination


def test_hits_match_brute_force(spark, data_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect()]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows_of(queries.QUERIES["op3_decontamination"](spark, data_dir), *columns) == sorted(brute.decontaminated(docs, items), key=repr)


def test_blocks_and_offsets(spark):
    items = spark.createDataFrame([(1, "One two, three"), (2, "four é five"), (3, None), (4, "!")], "item_id int, text string")
    texts = spark.createDataFrame([(1, "ß ONE-two  three! x Four É four é FIVE."), (2, None), (3, "")], "doc_id int, text string")
    for size in (5, 1000):
        found = {r.doc_id: r for r in decontam.decontaminate(texts, items, block_chars=size).collect()}
        r = found[1]
        assert [r.text[a:b] for a, b in zip(r.char_from, r.char_to, strict=True)] == ["ONE-two  three", "four é FIVE"]
        assert (r.n_words, r.n_hit, r["items"]) == (10, 6, ["1", "2"]) and not found[2].contaminated and found[3].n_words == 0
    assert decontam.decontaminate(texts, items.limit(0)).where("contaminated").count() == 0


# Tokens and packing


def test_word_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(tokens.vocabulary_path(None)), tokens.WordIds()
    rnd = random.Random(1)
    letters = "aAbsStT'’.,!*<|>0 1\n\té́Éñ—̇İßŁłŉÿÀ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    texts += [None, "", "x<|endoftext|>y <|STARTOFTEXT|>", "中文。abc —,x ñ*** \x1c\x85\xa0z"]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert ids == np.array(whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes(), text


def check_pieces(rows, docs, size, whole):
    of, at = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
    assert set(of) == {key for key, _ in docs}
    for key, text in docs:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        place = 0
        for r in sorted(of[key], key=lambda r: r.start):
            assert r.start == place and r.ids_crc32 == zlib.crc32(ids[place : place + r.length].tobytes())
            place += r.length
        assert place == len(ids)
    fill = []
    for parts in at.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= size
        fill.append(place)
    return fill


@pytest.mark.parametrize("name", ["op4_curve_packing", "op7_packed_binary"])
def test_pieces_hold_every_id_once(spark, data_dir, docs, name):
    from tokenizers import Tokenizer

    fill = check_pieces(queries.QUERIES[name](spark, data_dir).collect(), docs, 4096, Tokenizer.from_file(tokens.vocabulary_path(None)))
    padded = sum(4096 - n for n in fill if name != "op4_curve_packing" or n & (n - 1))
    assert padded <= (0 if name == "op4_curve_packing" else 0.05 * sum(fill))


def test_hilbert_curve_visits_neighbours():
    points = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = curvepack.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512)) and set(np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)) == {1}


def test_packing_odd_input(spark, odd):
    pieces = curvepack.pack_along_curve(odd, size=8).collect()
    assert sum(r.length for r in pieces if r.doc_id is None) == 1 and sum(r.length for r in pieces if r.doc_id == 2) == 6
    assert curvepack.pack_along_curve(odd.limit(0)).count() == 0
    packed = bestfit.pack_best_fit(odd, size=8)
    assert sum(r.n_tokens for r in packed.collect()) == sum(r.length for r in pieces)
    assert bestfit.pack_best_fit(odd.limit(0)).count() == 0


def test_best_fit_matches_a_plain_search():
    rnd = random.Random(3)
    for _ in range(200):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(0, 40))]
        free = []
        for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = [(f, i) for i, f in enumerate(free) if f >= lengths[at]]
            if fit:
                free[min(fit)[1]] -= lengths[at]
            else:
                free.append(20 - lengths[at])
        bins = bestfit.best_fit_decreasing(lengths, 20)
        assert sorted(20 - sum(lengths[i] for i in b) for b in bins) == sorted(free)


# Language model


def test_scores(spark, data_dir, docs):
    rows = queries.QUERIES["op5_maxent_scores"](spark, data_dir).collect()
    expected = brute.base_scores(docs)
    for r in rows:
        held, n, known, train, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_probabilities_add_up():
    rnd = np.random.default_rng(0)
    weights = rnd.normal(size=(700, maxent.CLASSES)).astype(np.float32)
    features = rnd.integers(0, 700, (maxent.FEATURES, 50))
    bias = rnd.normal(size=maxent.CLASSES).astype(np.float32)
    logs = [maxent.log_chances(weights, bias, features, np.full(50, k)) for k in range(maxent.CLASSES)]
    assert np.exp(logs).sum(axis=0) == pytest.approx(np.ones(50), rel=1e-4)


def test_segments_sum_up():
    rnd = np.random.default_rng(1)
    for most in (3, 500, 100_000):
        rows, values = rnd.integers(0, most, 2000), rnd.normal(size=(2000, 32)).astype(np.float32)
        order = maxent.ordered(rows, most)
        assert (order == np.argsort(rows, kind="stable")).all()
        ranked = rows[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        sums = maxent.summed(values, order, starts, np.diff(np.r_[starts, 2000]))
        expected = np.zeros((most, 32))
        np.add.at(expected, rows, values)
        assert sums == pytest.approx(expected[ranked[starts]], abs=1e-3)


def test_gradient_step_matches_plain_softmax():
    rnd = np.random.default_rng(2)
    classes, features = rnd.integers(0, maxent.CLASSES, 40), rnd.integers(0, 9, (maxent.FEATURES, 40))
    learner = maxent.Learner(rnd.normal(size=(9, maxent.CLASSES)).astype(np.float32), np.zeros(maxent.CLASSES, np.float32), 0.3)
    before, slopes = learner.weights.astype(float), np.zeros((9, maxent.CLASSES))
    for i, kind in enumerate(classes):
        chance = np.exp(sum(before[r] for r in features[:, i]))
        chance /= chance.sum()
        chance[kind] -= 1
        for r in features[:, i]:
            slopes[r] += chance
    learner.learn(classes, features)
    rate = 0.3 / np.sqrt(1 + (slopes**2).sum(axis=1, keepdims=True))
    assert learner.weights == pytest.approx(before - rate * slopes, abs=1e-4)


def test_scores_match_plain_forward_pass(spark, monkeypatch):
    """Scores of the operator against the model written out word by word, over chunks
    that share words, texts without words, and a document longer than a part."""
    dice = random.Random(5)
    texts = [" ".join(dice.choice("a b c de fgh Fgh naïve x1".split()) for _ in range(dice.randint(0, 60))) for _ in range(150)]
    rows = list(enumerate([*texts, None, "", "only-here " * 3, "a b " * 60_000]))
    models = []
    plain = maxent.trained
    monkeypatch.setattr(maxent, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(maxent, "trained", lambda *x: models.append(plain(*x)) or models[-1])
    found = {r.doc_id: r for r in maxent.class_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute.class_scores(rows, models[0])
    assert found.keys() == expected.keys() and np.abs(models[0].weights).max() > 0
    for key, score in expected.items():
        assert found[key].score == pytest.approx(score, rel=1e-4)


def test_scores_on_odd_input(spark, odd):
    assert maxent.class_scores(odd).where("n_tokens >= 1").count() == len(ODD)
    assert maxent.class_scores(odd.limit(0)).count() == 0


# Licences


def test_licences_on_odd_input(spark):
    rows = [(None, "Released under the MIT license"), (1, None), (2, ""), (2, "x\nreleased under THE MIT-License!"), (3, "mit")]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id int, text string"))
    assert {(r.doc_id, r.line) for r in found.collect()} == {(None, None), (None, 0), (2, None), (2, 1)}
    assert found.where("license <> 'MIT'").count() == 0 and licenses.license_scan(found.selectExpr("doc_id", "license AS text").limit(0)).count() == 0


# Line dedup


def test_patience_diff():
    assert linealign.patience("abcxd", "abyd") == [(0, 0), (1, 1), (4, 3)]
    assert linealign.common_blocks([1, 2, 3, 4, 5, 6], [9, 4, 5, 8, 1, 2, 3, 7], [10] * 8, 20) == [(1, 3), (4, 7)]
    assert linealign.common_blocks([1, 1, 2], [1, 1, 2], [5] * 3, 15) == [(0, 3)] and linealign.common_blocks([], [1], [3], 1) == []


def test_blocks_repeated_on_either_side():
    x, p, y, z, u, m, v = [1], [2, 3, 4], [5], [6], [7], [8], [9]
    for a, b, blocks in [
        (x + p + y + p + z, u + p + v, [(1, 4)]),
        (x + p + z, u + p + m + p + v, [(1, 4), (5, 8)]),
        (x + p + z, u + p + v, [(1, 4)]),
    ]:
        assert linealign.common_blocks(a, b, [30] * len(b), 50) == blocks


def test_blocks_match_brute_force():
    dice = random.Random(8)
    for _ in range(500):
        size, least = dice.choice([2, 4, 8]), dice.choice([1, 8, 20])
        words = [dice.randint(1, 9) for _ in range(size)]
        a, b = ([dice.randrange(size) for _ in range(dice.randint(0, 14))] for _ in "ab")
        blocks = linealign.common_blocks(a, b, [words[x] for x in b], least)
        assert [j for s, e in blocks for j in range(s, e)] == brute.lines_in_common_runs(a, b, [words[x] for x in b], least)


def test_line_dedup_against_earliest_holders(spark, data_dir, docs):
    """What goes is in an earlier document; lines of 20 words or more that stay alone are new."""
    first, lines_of = brute.kept_lines([d for d in docs if d[1]])
    cut = {r.doc_id: r for r in linealign.dedup_lines(spark.read.parquet(f"{data_dir}/documents.parquet")).collect()}
    for key, lines in lines_of.items():
        left = [" ".join(x.split()) for x in brute.low(cut[key].clean_text).split("\n")]
        gone = [x for x in lines if x]
        for x in left:
            if x in gone:
                gone.remove(x)
        assert all(first[x] < key for x in gone)
        assert sum(bool(x) for x in lines) - sum(bool(x) for x in left) == cut[key].n_removed_lines
        assert not [x for x in left if len(x.split()) >= 20 and first[x] < key and lines.count(x) == 1]


def test_line_dedup_where_lines_have_other_holders(spark):
    """A block goes though each line of it also stands alone in a still earlier document."""
    p = [f"{'w ' * 5}p{i}" for i in range(5)]
    rows = [(i, f"a{i}\n{line}\nb{i}") for i, line in enumerate(p)]
    rows += [(10, "\n".join(["c", *p[:4], "d"])), (11, "\n".join(["e", *p, "f"])), (12, "\n".join(["g", *p, "h"])), (13, "\n".join(["i", *p[:3], "j"]))]
    found = linealign.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare_lines=1).collect()
    cut = {r.doc_id: r.clean_text for r in found}
    assert cut[10] == rows[5][1] and cut[11] == f"e\n{p[4]}\nf" and cut[12] == "g\nh" and cut[13] == rows[8][1]


def test_line_dedup_matches_brute_force(spark):
    dice = random.Random(4)
    words = [f"{'w ' * dice.randint(0, 7)}v{i}" for i in range(12)]
    rows = [(n, "\n".join(words[dice.randrange(12)] for _ in range(dice.randint(1, 15)))) for n in range(60)]
    lines = [text.split("\n") for _, text in rows]
    cut = {r.doc_id: r.clean_text for r in linealign.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare_lines=5).collect()}
    for n, own in enumerate(lines):
        sizes = [len(x.split()) for x in own]
        gone = {j for earlier in lines[:n] for j in brute.lines_in_common_runs(earlier, own, sizes, 20)}
        assert cut[n] == "\n".join(x for j, x in enumerate(own) if j not in gone)


def test_line_dedup_on_odd_input(spark, odd):
    cut = linealign.dedup_lines(odd, block_words=2)
    assert cut.count() == len(ODD) and cut.where("n_removed_lines > 0").count() == 1
    assert linealign.dedup_lines(odd.limit(0)).count() == 0


# WARC


def test_records_round_trip(spark):
    big = "x" * 2000
    rows = [(1, "u\r\n1", big), (2, "http://a b", big), (3, None, None), (3, "z", "é\r\n\r\ny"), (None, "q", "")]
    index, _, _ = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string"))
    read = warc.read_records(index).collect()
    assert sorted(x.payload.decode() for x in read if x.payload is not None) == sorted(["", "", "é\r\n\r\ny", big])
    assert all(hashlib.sha1(x.payload).hexdigest() == x.stated_digest for x in read if x.payload is not None)
    assert [x.refers for x in read if x.record_type == "revisit"] == [1]
    some = warc.read_records(index.where("url = 'z'")).collect()
    assert len(some) == 1 and some[0].url == "z"
    assert warc.read_records(index.limit(0)).count() == 0


def test_ranges_are_coalesced():
    entries = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 5), ("b", 0, 5)]
    assert [(x[0], x[1], x[2], len(x[3])) for x in warc.coalesced(entries, gap=10, most=1000)] == [("a", 0, 30, 3), ("a", 100, 105, 1), ("b", 0, 5, 1)]
    assert [x[1:3] for x in warc.coalesced(entries[:3], gap=10, most=20)] == [(0, 20), (25, 30)]


# Repeated strings


def test_repeats_match_brute_force(spark, data_dir, docs):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows_of(queries.QUERIES["op10_suffix_dedup"](spark, data_dir), *columns) == sorted(brute.cut_repeats(docs), key=repr)


def test_repeats_over_many_blocks(spark):
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(60, 200))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(pool) if rnd.random() < 0.7 else str(rnd.random()) * 3 for _ in range(rnd.randint(0, 6)))) for i in range(150)]
    rows += [(200, "x" * 500), (201, "ab" * 300), (202, "y" + "x" * 130)]
    cut = suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2000, bucket_rows=50)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.span_starts), hashlib.sha256(r.kept).hexdigest()) for r in cut.collect())
    assert got == brute.cut_repeats(rows)


def test_repeats_on_odd_input(spark, odd):
    assert suffixes.cut_repeats(odd).count() == len(ODD)
    assert suffixes.cut_repeats(odd.limit(0)).count() == 0
