import hashlib

import pytest
from test_decontaminate import brute as contaminated
from test_near_dedup import brute as classes_of
from tokenizers import Tokenizer

import corpus_pipeline as cp
from cloudgrain.llm import bpe, pii, toxicity
from pyspark.sql import functions as F


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_on_all_its_predecessor_kept(spark, docs, sf):
    """Each stage against brute force on its own input, and the last one against the tokenizer."""
    before, seen = docs, {}
    for name, stage in cp.STAGES:
        after = stage(spark, before, sf)
        if name != "bpe":
            assert after.columns == docs.columns
            after = cp.settle(after)
        seen[name] = by_id(before), by_id(after)
        before = after
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    ordinary = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < cp.MAX_TOXICITY}
    assert set(seen["toxicity"][1]) == ordinary
    old, new = seen["near_dedup"]
    found = classes_of([(i, r.text) for i, r in old.items()])
    assert set(new) == {i for i in old if found[i] == i}
    old, new = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = {i: (n, hit) for i, n, hit, _ in contaminated([(i, r.text) for i, r in old.items()], items)}
    assert set(new) == {i for i in old if hits[i][1] <= 0.5 * hits[i][0]}
    assert all((new[i].text == old[i].text) == (not hits[i][1]) and new[i].n_chars == len(new[i].text) for i in new)
    old, new = seen["personal_data"]
    assert set(new) == set(old)
    for i, r in new.items():
        if not pii.base_spans(old[i].text):
            assert r.text == old[i].text or "[" in r.text
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    old, new = seen["bpe"]
    direct = Tokenizer.from_file(bpe.vocabulary_path())
    assert set(new) == set(old)
    for i, r in new.items():
        ids = direct.encode(old[i].text, add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("number", range(len(cp.STAGES)))
def test_stages_take_edge_rows(spark, edge, empty, sf, number):
    name, stage = cp.STAGES[number]
    rows = edge.withColumn("n_chars", F.length("text").cast("long"))
    out = stage(spark, rows, sf)
    assert name == "bpe" or out.columns == rows.columns
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in rows.collect()}
    assert stage(spark, rows.where("false"), sf).count() == 0


@pytest.mark.parametrize("rows", [[], [(10**9 + i, i % 2, i % 2) for i in range(40)], [(3, 1, 0)], [(i, 1, 1) for i in range(11)]])
def test_no_document_goes_without_a_model(spark, edge, tmp_path, rows):
    """Labels that are missing, match no document, are too few or of one class alone."""
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = cp.drop_toxic(spark, edge, str(tmp_path))
    assert kept.columns == edge.columns and sorted(map(str, kept.collect())) == sorted(map(str, edge.collect()))
