import math

import pytest
from pyspark.sql import functions as F

from verdigris.functions import similarity as S
from verdigris.functions import stats
from verdigris.functions import text as X
from verdigris.functions.percentiles import percentiles


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "values,kind,p,expected",
    [
        ([100, 200, 300, 400, 500], "rank", 0.0, 100), ([100, 200, 300, 400, 500], "rank", 0.5, 300), ([100, 200, 300, 400, 500], "rank", 0.95, 500),
        ([42], "rank", 0.5, 42), ([1, 2, 3, 4], "rank", 0.5, 3), ([1, 2, 3, 4], "nearest", 0.5, 2), ([1, 2, 3, 4], "middle", 0.5, 2.5), ([5, 5, 5, 1], "rank", 0.5, 5),
    ],
)
def test_percentiles(spark, values, kind, p, expected):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    assert percentiles(df, [], "v", {"x": (kind, p)}).first()["x"] == expected


def test_percentiles_of_nothing(spark):
    assert percentiles(spark.createDataFrame([], "g string, v long"), ["g"], "v", {"x": ("rank", 0.5)}).count() == 0


def test_student_t():
    assert abs(stats.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(stats.t_two_sided(0.0, 3) - 1) < 1e-12
    assert abs(stats.t_quantile(0.975, 10) - 2.228139) < 1e-4


def test_normal(spark):
    row = one(spark, stats.normal_quantile(F.lit(0.975)).alias("q"), stats.normal_quantile(F.lit(0.001)).alias("low"), stats.erf(F.lit(0.5)).alias("e"))
    assert abs(row["q"] - 1.959964) < 1e-5 and abs(row["low"] + 3.090232) < 1e-5 and abs(row["e"] - math.erf(0.5)) < 1e-6


def test_texts(spark):
    t = F.lit("Hi there. Next One! no. lower A. B. C")
    assert one(spark, F.size(X.sentences(t)).alias("n"))["n"] == 4
    assert one(spark, X.syllables(F.lit("table")).alias("n"))["n"] == 2
    assert one(spark, X.render(F.lit("{{a}} {{b}}"), F.create_map(F.lit("a"), F.lit("x"))).alias("t"))["t"] == "x {{b}}"
    assert one(spark, X.task_type(F.lit("Please debug this")).alias("t"))["t"] == "coding"


def test_similarities(spark):
    row = one(
        spark, S.levenshtein_similarity(F.lit("kitten"), F.lit("sitting")).alias("lev"), S.ngram_jaccard(F.lit("ab"), F.lit("ab")).alias("short"),
        S.strict_ngram_jaccard(F.lit("ab"), F.lit("ab")).alias("strict"), S.levenshtein_similarity(F.lit(""), F.lit("")).alias("empty"),
    )
    assert abs(row["lev"] - (1 - 3 / 7)) < 1e-9 and row["short"] == 1 and row["strict"] == 0 and row["empty"] == 1


def test_word_error_rate(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("", ""), ("", "a"), ("a b", "")], "r string, h string")
    assert [round(x["w"], 6) for x in S.with_word_error_rate(df, "r", "h", "w").collect()] == [round(1 / 3, 6), 0, 1, 1]


def test_weighted_ngrams(spark):
    df = spark.createDataFrame([("abc", "ABC"), ("ab", "cd"), ("", "x")], "a string, b string")
    assert [x["s"] for x in S.with_weighted_ngrams(df, "a", "b", "s").collect()] == [1.0, 0.0, 0.0]
