"""Registered queries of the subpackage and the pipeline, over whole small tables."""

import corpus_pipeline
import pytest
from oracle_check import compare, connect

from qaloom.llm import decontamination, queries, rule_ensemble, sentencepieces, simhash, surrogates
from qaloom.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], ORACLES.get(name)) is None


def test_stages_do_to_their_documents_what_the_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "sentencepiece"]

    def ids(df):
        return sorted(r.doc_id for r in df.collect())

    good = by_name["quality_classifier"](spark, docs, SF)
    assert ids(good) == ids(rule_ensemble.quality_scores(docs, labels).where("predicted = 1"))
    single = by_name["simhash_near_dedup"](spark, docs, SF)
    assert ids(single) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
    clean = by_name["benchmark_decontamination"](spark, docs, SF)
    items = [decontamination.normal(r.text) for r in bench.collect()]
    assert ids(clean) == sorted(r.doc_id for r in docs.collect() if not any(i in decontamination.normal(r.text) for i in items))
    private = by_name["pii_surrogates"](spark, docs, SF)
    assert ids(private) == ids(docs)
    for frame in (good, single, clean, private):
        assert frame.dtypes == docs.dtypes
    seen = {m for r in docs.collect() for m in r.text.split() if "@" in m}
    assert not seen & {m for r in private.collect() for m in r.text.split()}
    assert all(r.n_chars == len(r.text) for r in private.collect())


def test_pipeline_is_its_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    want = {r.doc_id: (r.text, tuple(r.ids)) for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: (r.text, tuple(r.ids)) for r in got.collect()} == want
    assert 0 < len(want) < 200 and got.where("not round_trip").count() == 0
    assert surrogates.PATTERN and sentencepieces.MARK not in got.first().text
