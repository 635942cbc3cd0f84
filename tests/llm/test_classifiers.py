import random
import zlib

import numpy as np
import pytest
from llm.helpers import frame, odd_texts

from qaloom.llm import rule_ensemble, samples, toxicity

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_fold_is_the_crc_of_the_id(spark):
    got = spark.range(300).select("id", samples.fold(samples.F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


@pytest.mark.parametrize("score, label, folds, held, sf, least", [
    (rule_ensemble.quality_scores, "quality", 5, 0, SF, 0.97), (toxicity.toxicity_scores, "toxic", 4, 2, SF, 0.85)])
def test_held_out_documents_are_told(spark, score, label, folds, held, sf, least):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = score(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got[label]).mean() >= least
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(zlib.crc32(str(i).encode()) % folds == held for i in got.doc_id)


def test_held_out_labels_are_never_learnt(spark):
    labels = table(spark, "labels")
    turned = labels.withColumn("quality", samples.F.when(samples.fold(samples.F.col("doc_id"), 5) == 0, 1 - samples.F.col("quality")).otherwise(samples.F.col("quality")))
    assert rule_ensemble.train(table(spark, "documents"), labels) == rule_ensemble.train(table(spark, "documents"), turned)
    sample = samples.labelled(labels, "quality", 5, 0, 50).collect()
    assert len(sample) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)


@pytest.mark.parametrize("score", [rule_ensemble.quality_scores, toxicity.toxicity_scores])
def test_odd_texts_have_a_score(spark, score):
    labels = table(spark, "labels").where("doc_id < 60")
    docs = table(spark, "documents").where("doc_id < 60").select("doc_id", "text")
    odd = frame(spark, odd_texts() + ["x"], [1000 + k for k in range(len(odd_texts()))] + [None]).select("doc_id", "text")
    got = {r.doc_id: r.score for r in score(docs.unionByName(odd), labels).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] and got[1005] == got[1006]
    assert score(docs.limit(0), labels).count() == 0
    assert {r.score for r in score(odd, labels.limit(0)).collect()} == {0.5}


def test_compiled_score_is_that_of_the_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    model = rule_ensemble.fit(["a", "b", "c"], x, y)
    got = spark.createDataFrame(x.tolist(), "a double, b double, c double").select(model.score().alias("s")).toPandas().s.to_numpy()
    total = model.intercept + sum(w * rule_ensemble.holds(r, x) for r, w in zip(model.rules, model.weights))
    assert np.allclose(got, 1 / (1 + np.exp(-total))) and ((got > 0.5) == (y == 1)).mean() > 0.97
    assert 0 < len(model.rules) < 200


def test_lasso_gives_useless_columns_no_weight():
    rng = np.random.default_rng(2)
    r = rng.random((400, 20)) > 0.5
    w, _ = rule_ensemble.lasso(r, r[:, 3].astype(float), penalty=0.02)
    assert w[3] > 1 and np.abs(np.delete(w, 3)).max() < 1e-6


def test_accepted_documents_keep_their_columns(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    kept = rule_ensemble.keep_good(docs, labels)
    accepted = {r.doc_id for r in rule_ensemble.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == accepted


def test_an_unseen_misspelling_stands_out_in_a_long_text():
    rng = random.Random(6)
    plain = [a + b for a in ("ren", "tol", "mas", "ve", "lin", "dor") for b in ("ta", "sin", "gor", "pel", "wex", "nu")]
    texts, labels = [], []
    for k in range(240):
        words = rng.choices(plain, k=rng.randint(20, 80))
        if k % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["hatefool", "hatefools", "hatefooly"]))
        texts.append(" ".join(words))
        labels.append(float(k % 3 == 0))
    model = toxicity.fit(texts, np.array(labels))

    def score(text):
        words = sorted(set(toxicity.words_of(text)))
        return model.document(toxicity.features([sorted(model.words(words).tolist(), reverse=True)[:3]]))[0]

    clean = " ".join(rng.choices(plain, k=4000))
    assert score(clean) < 0.3 <= score(clean + " hateefool") and score(clean + " thehatefoolz") >= 0.3


def test_ngrams_of_a_word_do_not_depend_on_its_neighbours():
    alone = [toxicity.ngrams([w])[0] for w in ("a", "word", "größe")]
    both, starts = toxicity.ngrams(["a", "word", "größe"])
    assert [sorted(x.tolist()) for x in np.split(both, starts[1:])] == [sorted(x.tolist()) for x in alone]


def test_all_words_of_the_sample_are_trained_on(monkeypatch):
    # 90,000 common words of two documents each, and one of a single toxic document.
    common = [f"w{k}" for k in range(90_000)]
    docs = [np.arange(90_000), np.arange(90_000), np.array([90_000])]
    model = toxicity._learn(docs, np.array([0.0, 0.0, 1.0]), [*common, "zqxjkvbzz"], 5)
    used, _ = toxicity.ngrams(["zqxjkvbzz"])
    assert (model.table[used] != 0).all() and model.words(["zqxjkvbzz"])[0] > model.words(common[:1000]).max()
    # Batches change nothing but the order of sums.
    small = [d[:300] for d in docs[:2]] + [docs[2]]
    whole = toxicity._learn(small, np.array([0.0, 0.0, 1.0]), [*common, "zqxjkvbzz"], 5)
    monkeypatch.setattr(toxicity, "CHUNK", 70)
    assert np.allclose(whole.table, toxicity._learn(small, np.array([0.0, 0.0, 1.0]), [*common, "zqxjkvbzz"], 5).table)


@pytest.mark.parametrize("texts, labels", [
    (["", ""], [0, 1]), (["a", ""], [1, 0]), (["a", ""], [0, 1]), (["", None, "a b", "c"], [0, 0, 1, 1]), (["...", "!!"], [1, 0]),
    (["a"] * 8, [0, 1] * 4), (["", "a", "", "b", "", "c"], [1, 0, 1, 0, 1, 0]), ([], [])])
def test_samples_with_few_words_give_scores(texts, labels):
    model = toxicity.fit(texts, np.array(labels, float))
    for text in [*texts, "", "a", "something else"]:
        words = sorted(set(toxicity.words_of(text)))
        (score,) = model.document(toxicity.features([sorted(model.words(words).tolist(), reverse=True)[:3]]))
        assert 0 <= score <= 1
    assert np.isfinite(model.table).all() and np.isfinite(model.bias)


@pytest.mark.parametrize("sf, recall, alarms", [("sf0.1", 0.9, 0.01), ("sf0.01", 0.6, 0.1)])
def test_toxic_documents_are_caught_and_clean_ones_left_alone(spark, sf, recall, alarms):
    """With the 37 toxic documents of the small table, words of three languages are seen once or never; with 329 they are."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet") for name in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert len(toxic) and toxic.predicted.mean() >= recall and clean.predicted.mean() <= alarms
