import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import features, quality, toxicity
from verdigris.llm.common import TokenCache, held_out

GOOD = "The quiet river {0} runs past {1} old mills and the {2} fields."
BAD = "buy!!! now!!! {0}!!! cheap!!! {1}!!! {2}!!!"


def corpus(n=240):
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = (BAD if bad else GOOD).format(*(f"w{(i * k) % 17}" for k in (1, 3, 7)))
        docs.append((i, text + (" you idiot moron scum" if toxic else ""), "en"))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    extra = [(None, None, None), (1000, "", "en"), (1001, "x " * 60_000, "en"), (1001, "x " * 60_000, "en")]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_fold_is_the_one_stated(spark):
    got = {r["id"]: r["h"] for r in spark.range(200).select("id", held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_toxicity_on_the_held_out_fold(tables):
    docs, labels = tables
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(held_out("doc_id")).collect()
    assert scored and all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in scored)


def test_toxicity_scores_every_row(tables):
    docs, labels = tables
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)


def test_no_confirmed_toxic_examples(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, model).where("score > 0.01").count() == 0


def test_risk_on_negatives_is_kept_from_falling_below_zero():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(2, 1, (200, 5)), rng.normal(2, 1, (60, 5)), rng.normal(-2, 1, (340, 5))]).astype(np.float32)
    w, b = toxicity.fit_nnpu(x, np.arange(600) < 200, 0.15, toxicity.Settings())
    assert ((x[:260] @ w + b) > 0).mean() > 0.9 and ((x[260:] @ w + b) > 0).mean() < 0.1


def test_gradient_is_that_of_the_stated_risk():
    """One small step of the fit goes down the risk that the docstring states, written out here."""
    rng = np.random.default_rng(4)
    x, positive, prior = rng.poisson(1.0, (400, 6)).astype(np.float32), np.arange(400) < 90, 0.2
    x[positive, 0] += 2

    def risk(w, b):
        zp, zu = x[positive] @ w + b, x[~positive] @ w + b
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    fitted = [toxicity.fit_nnpu(x, positive, prior, toxicity.Settings(steps=k, decay=0.0)) for k in (1, 20, 300)]
    values = [risk(np.zeros(6), np.log(prior / (1 - prior))), *(risk(*f) for f in fitted)]
    assert values == sorted(values, reverse=True)
    scale = np.maximum(x.std(axis=0), 1e-3) ** 0.5
    base = np.append(np.zeros(6), np.log(prior / (1 - prior)))
    slope = np.array([(risk((base + d)[:6] / scale, (base + d)[6]) - risk((base - d)[:6] / scale, (base - d)[6])) / 2e-4 for d in np.eye(7) * 1e-4])
    moved = np.append(fitted[0][0] * scale, fitted[0][1]) - base
    # the first step, against numeric slopes of that risk; the intercept begins where its slope is 0
    assert (np.sign(moved[:6]) == -np.sign(slope[:6])).all() and abs(slope[6]) < 1e-6


def test_repeated_labelled_ids_are_one_example(spark, tables):
    docs, labels = tables
    some = docs.where("doc_id < 40")
    again = docs.unionByName(some).unionByName(some).unionByName(some.withColumn("text", F.lit("zzz")))
    for train in (toxicity.train, quality.train):
        one, many = train(docs, labels), train(again, labels)
        assert np.array_equal(one.chosen, many.chosen)


def test_quality_on_the_held_out_fold(spark, tables):
    docs, labels = tables
    judge = quality.score_udf(quality.train(docs, labels), spark)
    scored = docs.withColumn("score", judge("text")).join(labels, "doc_id").where(held_out("doc_id")).collect()
    assert scored and all((r["score"] >= 0.3) == (r["quality"] == 1) for r in scored)


def test_vote_is_brute_force_vote():
    rng = np.random.default_rng(1)
    known, votes, asked = quality.unit(rng.normal(size=(50, 6))), (rng.random(50) > 0.5).astype(float), quality.unit(rng.normal(size=(9, 6)))
    s = quality.Settings(neighbours=5)
    got = quality.vote(asked, quality.Model(np.zeros(0), np.zeros(0), np.zeros((0, 0)), known, votes, s))
    for v, score in zip(asked, got):
        cosine = known @ v
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 1e-6) ** s.sharpness
        assert abs(score - (weight @ votes[near]) / weight.sum()) < 1e-9


def test_empty_texts_and_labels(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    judged = docs.withColumn("p", quality.score_udf(model, spark)("text")).where("text IS NULL OR text = ''").collect()
    assert len(judged) == 2 and all(abs(r["p"] - model.prior) < 1e-6 for r in judged)
    nothing = quality.train(docs, labels.where("false"))
    assert docs.withColumn("p", quality.score_udf(nothing, spark)("text")).where("p < 1").count() == 0


def test_filters_keep_columns_and_empty_tables(tables):
    docs, labels = tables
    clash = docs.withColumns({"p": F.lit(1), "row": F.lit(2), "score": F.lit(3)})
    for stage in (quality.keep_good, toxicity.drop_toxic):
        kept = stage(clash, labels)
        assert kept.columns == clash.columns and 0 < kept.count() < clash.count()
        assert stage(clash.where("false"), labels).count() == 0


def test_token_cache_is_bounded():
    calls = []
    cache = TokenCache(lambda t: calls.append(t) or len(t), size=10)
    assert [cache[str(i)] for i in range(100)] == [len(str(i)) for i in range(100)] and len(cache) <= 10
    assert cache["x" * 100] == 100 and "x" * 100 not in cache


def test_shapes():
    assert features.shape("The,") == "Aa," and features.shape("%%%") == "%" and features.shape("a" * 100 + "1") == "a0" and features.words_and_shapes("a a")[-1] == "\x00again"
