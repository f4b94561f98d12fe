"""The pipeline, stage by stage, against its operators' brute force on the small tables."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tests.llm.test_operators import RANKS, awkward_columns, base_rules, encoding, groups_brute, prose, repeats_brute, simhash_brute, sorted_rows

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        step(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.toPandas(), after.toPandas()))
        docs = after
    return out


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "byte_bpe"]


def test_columns_stay(steps):
    assert all(after.columns.tolist() == COLUMNS for _, after in steps[:-1])


def test_quality_stage(spark, steps):
    before, after = steps[0]
    failed = {r.doc_id for r in before.itertuples() if base_rules(r.text)[5]}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = set(after.doc_id)
    assert not kept & failed and (good & set(before.doc_id)) - failed <= kept


def test_near_dedup_stage(steps):
    before, after = steps[1]
    prints = [simhash_brute(t) for t in before.text]
    label = groups_brute(prints)
    first = {}
    for i, g in zip(before.doc_id, label):
        first[g] = min(first.get(g, i), i)
    assert sorted(after.doc_id) == sorted(first.values())


def test_suffix_stage(steps):
    before, after = steps[2]
    want = {i: kept.decode("utf-8", "ignore") for i, (_, _, kept) in zip(before.doc_id, repeats_brute(before.text, 200))}
    assert dict(zip(after.doc_id, after.text)) == {i: t for i, t in want.items() if t}
    assert (after.n_chars == after.text.str.len()).all()


@pytest.mark.parametrize("name", ["simhash_near_dedup", "suffix_array_dedup"])
def test_stages_keep_columns_of_any_name_and_type(spark, name):
    docs = awkward_columns(spark, [(1, prose(1, 30)), (None, prose(2, 30)), (3, prose(3, 30))])
    after = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert after.columns == docs.columns and [kind for _, kind in after.dtypes] == [kind for _, kind in docs.dtypes]
    assert sorted_rows(after.collect()) == sorted_rows(docs.collect())


def test_mixing_stage_keeps_every_document(steps):
    before, after = steps[3]
    assert set(after.doc_id) == set(before[before.text.str.split().str.len() > 0].doc_id)
    assert after.doc_id.value_counts().max() <= 2


def test_encoding_stage(steps):
    before, after = steps[4]
    texts, library = dict(zip(before.doc_id, before.text)), encoding()
    assert len(after) == len(before) and RANKS
    for r in after.itertuples():
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id]))


def test_run_equals_the_stages(spark, steps):
    got = entry.queries()["pipeline"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").toPandas()
    want = steps[-1][1][["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]
    order = ["doc_id", "n_tokens", "ids_sha256"]
    assert got.sort_values(order).values.tolist() == want.sort_values(order).values.tolist()


def test_every_operator_has_a_query():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
