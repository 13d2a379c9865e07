"""The corpus pipeline: each stage on what the one before it kept."""

import brute
import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def stages(spark, data_dir, tmp_path_factory):
    kept = [spark.read.parquet(f"{data_dir}/documents.parquet")]
    root = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], data_dir).write.parquet(str(root / name))
        kept.append(spark.read.parquet(str(root / name)))
    return kept


def test_columns(stages):
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[:-1])


def test_near_duplicates_keep_one_of_each_group(stages):
    before = [tuple(r) for r in stages[2].select("doc_id", "text").collect()]
    roots = {root for _, _, root in brute.jaccard_components(before, 5, 80)}
    assert {r.doc_id for r in stages[3].collect()} == roots


def test_contaminated_documents_go(spark, stages, data_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect()]
    before = [tuple(r) for r in stages[3].select("doc_id", "text").collect()]
    clean = {r[0] for r in brute.decontaminated(before, items) if not r[-1]}
    assert {r.doc_id for r in stages[4].collect()} == clean == {r.doc_id for r in stages[5].collect()}


def test_stages_on_an_empty_table(spark, data_dir, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data_dir).count() == 0


def test_stages_on_missing_repeated_and_copied_ids(spark, data_dir):
    """Every stage keeps the texts that it keeps of the same rows under different ids."""
    prose = {n: " ".join(f"{n}{i}" for i in range(60)) for n in "abcdefg"}
    rows = [(1, prose["a"]), (2, prose["b"]), (2, prose["b"]), (3, prose["c"]), (3, prose["d"]), (4, prose["a"] + " end"), (5, prose["e"]), (6, prose["g"] + " end")]
    rows += [(None, prose["f"]), (None, prose["g"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd, plain = (
        spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in listed], schema)
        for listed in (rows, [(n, t) for n, (_, t) in enumerate(rows)])
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd, plain = (stage(spark, x, data_dir).localCheckpoint() for x in (odd, plain))
        left = sorted(r.text for r in odd.collect())
        assert left == sorted(r.text for r in plain.collect()), name
        if name == "near_duplicates":
            assert left == sorted([*(prose[n] for n in "abcdef"), prose["g"] + " end"])
            assert odd.where("doc_id IS NULL").count() == 1
    totals = {"length": "sum", "doc_tokens": "sum", "start": "sum"}
    packed = [corpus_pipeline.packing(spark, x, data_dir).agg(totals).first() for x in (odd, plain)]
    assert packed[0] == packed[1] and all(packed[0])
