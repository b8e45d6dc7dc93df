"""The pipeline, stage by stage against plain Python, over tables with every oddity its docstring names."""

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_classifiers import corpus
from tests.llm.test_text_operators import brute_components, brute_decontamination, brute_fingerprint
from verdigris.llm import features, quality, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PASSAGE = "the ferry leaves at nine and the old bridge opens again at noon today"
BENCHMARK = [(1, PASSAGE), (2, None), (None, "some other passage that nobody copied into any of the documents here")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, fp string, _hash int, _id string, score int, p int"


def documents():
    docs, labels = corpus(160)
    rng = random.Random(3)
    out = [(i, t, "en", "s", len(t), i, "k", "f", 1, "i", 2, 3) for i, t, _ in docs]
    for i in range(1000, 1030):  # good, different texts
        t = " ".join(["The quiet river runs past old mills and the fields."] * 2) + " " + " ".join(f"word{rng.randrange(10**6)}" for _ in range(60)) + "."
        out.append((i, t, None, None, None, i, None, None, None, None, None, None))
    leak = (2000, out[-1][1] + " " + PASSAGE.upper(), "en", "s", 1, 0, "k", "f", 1, "i", 2, 3)
    odd = [(None, None, None, None, None, None, None, None, None, None, None, None), (3000, "", "en", "s", 0, 0, "k", "f", 1, "i", 2, 3), (3001, None, "en", "s", 0, 0, "k", "f", 1, "i", 2, 3)]
    return [*out, out[-2], out[-2], leak, *odd], labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = documents()
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_are_what_plain_python_keeps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    model = quality.train(docs, labels)
    good = stages["quality"](spark, docs, sf_dir)
    assert rows(good) == sorted(((i, t) for i, t in rows(docs) if plain_quality(model, t) >= quality.THRESHOLD), key=str) and good.columns == columns

    tox = toxicity.train(good, labels)
    clean = stages["toxicity"](spark, good, sf_dir)
    assert rows(clean) == sorted(((i, t) for i, t in rows(good) if plain_toxicity(tox, t) < toxicity.THRESHOLD), key=str) and clean.columns == columns
    assert 0 < clean.count() < good.count() < docs.count()

    single = stages["near_duplicates"](spark, clean, sf_dir)
    assert single.columns == columns
    before, after = rows(clean), rows(single)
    groups = brute_components(list(range(len(before))), [brute_fingerprint(t) for _, t in before])
    first = lambda g: min((x for x, k in zip(before, groups) if k == g), key=lambda x: (x[0] is None, x[0] or 0))
    assert [i for i, _ in after] == [i for i, _ in sorted((first(g) for g in set(groups)), key=str)]

    kept = stages["decontamination"](spark, single, sf_dir)
    assert rows(kept) == [(i, t) for i, t in after if not brute_decontamination(t, BENCHMARK)[-1]] and kept.columns == columns
    assert 2000 in [i for i, _ in after] and 2000 not in [i for i, _ in rows(kept)]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = {r["doc_id"]: r for r in stages["bpe"](spark, kept, sf_dir).collect()}
    for i, t in rows(kept):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(encoded[i]["ids"], "<u4").tolist() == ids and encoded[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()

    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in ran.collect()) == sorted((str(i), r["ids_sha256"]) for i, r in encoded.items())


def plain_quality(model, text):
    """The vote, from the whole vocabulary's counts."""
    lookup = features.column_lookup(model.chosen)
    counts = np.zeros(max(1, len(model.chosen)), np.float32)
    for token in features.words_and_shapes(text or ""):
        if (c := lookup[features.hashed(token)]) >= 0:
            counts[c] += 1
    vector = (np.log1p(counts) * model.idf) @ model.projection
    return quality.vote(quality.unit(vector[None, :]).astype(np.float32), model)[0]


def plain_toxicity(model, text):
    lookup = features.column_lookup(model.chosen)
    found = re.findall(r"[^\W_]+", (text or "").lower())
    z = model.intercept
    for word in set(found):
        c = lookup[features.hashed(word)]
        z += min(found.count(word), model.most_count) * model.weights[c] if c >= 0 else 0
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_plain_python(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    tox, good = toxicity.train(docs, labels), quality.train(docs, labels)
    judged = docs.select("text", toxicity.score_udf(tox)("text").alias("t"), quality.score_udf(good, spark)("text").alias("q")).collect()
    for r in judged:
        assert abs(r["t"] - plain_toxicity(tox, r["text"])) < 1e-9 and abs(r["q"] - plain_quality(good, r["text"])) < 1e-4


def test_no_documents_at_all(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
