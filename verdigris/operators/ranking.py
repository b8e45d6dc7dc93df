"""Ranking, routing and cost advice over models.

A model row has: ordinal, provider, model, success, faithfulness, relevance, coherence (null where not
evaluated), latency_ms, cost. Whole-table extremes are aggregates that are broadcast as one row;
the final numbering sorts
range by range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verdigris.functions.ranges import border_lines, carried, ranged, runs
from verdigris.functions.running import running_sum

#: Weights of the evaluation scores, and of the parts of the overall score.
QUALITY = {"faithfulness": 0.4, "relevance": 0.3, "coherence": 0.3}
OVERALL = {"quality": 0.6, "performance": 0.2, "cost_efficiency": 0.2}


def check_weights(weights: dict[str, float]) -> None:
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError(f"weights sum to {sum(weights.values())}, not 1")


def quality() -> Column:
    """Weighted mean of the scores that are present; 0 if none is."""
    top = sum((F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in QUALITY.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in QUALITY.items()), F.lit(0.0))
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def scored(models: DataFrame, weights: dict[str, float] = OVERALL) -> DataFrame:
    """Successful models with quality, performance (min-max of latency, turned), cost efficiency
    (quality per cost over the largest; free models have their quality) and the overall score."""
    check_weights(weights)
    ok = models.where("success").withColumn("quality", quality()).withColumn("per_cost", F.when(F.col("cost") <= 0, F.col("quality")).otherwise(F.col("quality") / F.col("cost")))
    ends = ok.agg(
        F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"), F.max("per_cost").alias("top"),
        F.avg("quality").alias("avg_quality"), F.avg("latency_ms").alias("avg_latency"), F.avg("cost").alias("avg_cost"),
    )
    ok = ok.crossJoin(F.broadcast(ends))
    ok = ok.withColumns({
        "performance": F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(1 - (F.col("latency_ms") - F.col("lo")) / (F.col("hi") - F.col("lo"))),
        "cost_efficiency": F.when(F.col("top") <= 0, 0.0).otherwise(F.col("per_cost") / F.col("top")),
    })
    return ok.withColumn("overall", sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)))


def ranked(models: DataFrame, weights: dict[str, float] = OVERALL) -> DataFrame:
    """Rank 1 is the best; equal scores keep the order of ``ordinal``."""
    down = scored(models, weights).withColumn("_down", -F.round("overall", 9))
    return running_sum(down, "_down", F.lit(1), "rank", "ordinal").withColumn("rank", F.col("rank").cast("int")).drop("_down")


def traits(models: DataFrame) -> DataFrame:
    """Strengths and weaknesses of each model against the averages."""
    some = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in pairs]), lambda x: x.isNotNull())
    s = scored(models)
    q, latency, c = F.col("quality"), F.col("latency_ms"), F.col("cost")
    strong = some(
        ("High quality responses", q > F.col("avg_quality") + 0.1), ("Fast response time", latency < F.col("avg_latency") * 0.8), ("Cost-effective", c < F.col("avg_cost") * 0.8)
    )
    weak = some(("Lower quality scores", q < F.col("avg_quality") - 0.1), ("Slower response time", latency > F.col("avg_latency") * 1.2), ("Higher cost", c > F.col("avg_cost") * 1.2))
    strong = F.when(F.size(strong) == 0, F.array(F.lit("Balanced performance"))).otherwise(strong)
    return s.select("model", F.array_join(strong, "; ").alias("strengths"), F.array_join(weak, "; ").alias("weaknesses"))


def findings(models: DataFrame) -> DataFrame:
    """Best quality (of equal ones the last), fastest and cheapest with a cost (the first), reliability."""
    every = models.withColumn("q", F.round(quality(), 9))
    ok = F.col("success")
    one = every.agg(
        F.max(F.when(ok, F.struct("q", "ordinal", "model"))).getField("model").alias("best_quality"),
        F.min(F.when(ok, F.struct("latency_ms", "ordinal", "model"))).getField("model").alias("fastest"),
        F.min(F.when(ok & (F.col("cost") > 0), F.struct("cost", "ordinal", "model"))).getField("model").alias("cheapest"),
        F.round(F.count_if(ok) / F.count("*"), 6).alias("reliability"),
        F.round(F.var_pop(F.when(ok, F.col("q"))), 6).alias("quality_variance"),
    )
    return one.withColumn("divergent", F.col("quality_variance") > 0.1)


def recommendations(models: DataFrame) -> DataFrame:
    """The best overall, by quality, speed and cost efficiency. Of equal ones the last in rank order."""
    r = ranked(models)
    kinds = (("best_overall", "overall", 0.9), ("best_for_quality", "quality", 0.85), ("best_for_speed", "performance", 0.85), ("best_for_cost", "cost_efficiency", 0.85))
    picks = [
        (F.min(F.struct("rank", "model")) if kind == "best_overall" else F.max(F.struct(F.round(by, 9).alias("s"), "rank", "model"))).getField("model").alias(kind) for kind, by, _ in kinds
    ]
    one = r.agg(*picks)
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("model"), F.lit(c).alias("confidence")) for k, _, c in kinds])))


#: A group of a comparison's models, which is held against all of its models, has so many at least; there are so many groups for each of Spark's tasks.
MODELS_AT_ONCE, GROUPS_A_TASK = 250, 8


def to_six_places(x: Column) -> Column:
    """Rounded half away from zero, as SQL does it: on the product with 10^6, without decimal numbers, which take most of the time where
    rows are many. Zero has no sign."""
    up = F.abs(x) * 1e6
    whole = F.floor(up)
    near = (whole + F.when(up - whole >= 0.5, 1.0).otherwise(0.0)) / 1e6
    return F.when(up < 2.0**52, F.when(x < 0, 0.0 - near).otherwise(near)).otherwise(x)


def comparison_matrix(models: DataFrame, comparison: str) -> DataFrame:
    """Quality differences of the models of each comparison (a run of one prompt over some models), each against each. A comparison's
    models are dealt over groups, by its share of the pairs, and each group has all of the comparison's models beside it. There are no more groups than tasks need to
    be even, so what is shuffled grows with the models and not with their square, which is what comes out."""
    tasks = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = scored(models).select(comparison, "model", "quality")
    sizes = s.groupBy(comparison).agg(F.count("*").cast("double").alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n") * F.col("_n")).alias("_pairs"))
    enough = F.ceil(F.lit(GROUPS_A_TASK * tasks) * F.col("_n") * F.col("_n") / F.col("_pairs"))
    sizes = sizes.crossJoin(F.broadcast(pairs)).select(comparison, F.least(enough, F.ceil(F.col("_n") / MODELS_AT_ONCE)).cast("int").alias("_parts"))
    dealt = s.join(sizes, comparison)
    a = dealt.select(comparison, F.pmod(F.xxhash64("model"), F.col("_parts")).cast("int").alias("_part"), F.col("model").alias("model_a"), F.col("quality").alias("qa"))
    b = dealt.select(comparison, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("model").alias("model_b"), F.col("quality").alias("qb"))
    partitions = tasks * max(1, GROUPS_A_TASK // 2)
    both = a.repartition(partitions, comparison, "_part").join(b.repartition(partitions, comparison, "_part").hint("merge"), [comparison, "_part"])
    difference = F.when(F.col("model_a") == F.col("model_b"), 0.0).otherwise(F.col("qa") - F.col("qb"))
    return both.select(comparison, "model_a", "model_b", to_six_places(difference).alias("difference"))


#: What a model without a profile counts as.
DEFAULTS = {"quality": 0.7, "latency_ms": 1000, "cost_per_1k": 0.001}


def with_profiles(models: DataFrame, profiles: DataFrame) -> DataFrame:
    """Models (model) with their profiles (model, quality, latency_ms, cost_per_1k, context, strengths)."""
    return models.join(profiles.withColumn("has_profile", F.lit(True)), "model", "left").withColumn("has_profile", F.coalesce("has_profile", F.lit(False)))


def admissible(min_quality: float | None = None, max_latency: int | None = None, min_context: int | None = None, max_cost: float | None = None) -> Column:
    """Models without a profile pass."""
    ok = F.lit(True)
    for limit, test in (
        (min_quality, lambda v: F.col("quality") >= v), (max_latency, lambda v: F.col("latency_ms") <= v),
        (min_context, lambda v: F.col("context") >= v), (max_cost, lambda v: F.col("cost_per_1k") * 0.1 <= v),
    ):
        if limit is not None:
            ok = ok & test(limit)
    return ~F.col("has_profile") | ok


def route_score(strategy: str, task: str | None = None, min_quality: float = 0.0) -> Column:
    q, latency, c = F.col("quality"), 1000.0 / F.greatest("latency_ms", F.lit(1)), F.col("quality") / F.greatest("cost_per_1k", F.lit(0.0001))
    boost = F.when(F.array_contains("strengths", task), 1.2).otherwise(1.0) if task else F.lit(1.0)
    known = {"quality": q, "cost": F.when(q < min_quality, 0.0).otherwise(c), "latency": latency, "balanced": (q * 0.5 + latency * 0.25 + c * 0.25) * boost}
    if strategy not in known:
        raise ValueError(f"unknown strategy: {strategy}")
    return F.when(F.col("has_profile"), known[strategy]).otherwise(F.lit(DEFAULTS["quality"] if strategy == "quality" else 0.5))


def route(models: DataFrame, profiles: DataFrame, strategy: str, task: str | None = None, alternatives: int = 3, **limits) -> DataFrame:
    """The chosen model and the next ``alternatives``, for one request."""
    found = with_profiles(models, profiles).where(admissible(**limits)).withColumn("score", F.round(route_score(strategy, task, limits.get("min_quality") or 0.0), 9))
    top = found.orderBy(F.desc("score"), "ordinal").limit(alternatives + 1)  # few rows: the numbering below is over these
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "ordinal"))).select("place", "model", "score")


def smoothed_profiles(observations: DataFrame, weight: float = 0.1, reruns: list | None = None) -> DataFrame:
    """Exponentially weighted quality and latency per model, in order of time (``ts``, then ``tie``); latency is cut to whole
    milliseconds at each step. Observations without a quality or latency don't count.

    A hot model's fold is split over ranges of time. Quality is an affine map of what it was, so a range's is known at
    once. A step of the latency never lets a higher latency fall below a lower one: from the lowest and the highest there can be,
    a range is folded twice, and where both come out alike it is the same from anywhere between. Ranges where they don't are
    folded again when it is known where they begin; their numbers are put into ``reruns``.
    """
    kind = observations.schema["model"].dataType.simpleString()
    rows = observations.select("model", "ts", "tie", F.col("quality").cast("double").alias("q"), F.col("latency").cast("double").alias("l")).dropna(subset=["q", "l"])
    fixed = ranged(rows, "model", "ts", "tie")
    ends = fixed.agg(F.min("l").alias("low"), F.max("l").alias("high")).first()
    lines = border_lines(fixed, ["model"], lambda: Stretch(weight, ends["low"], ends["high"]), Stretch.after)

    def again(at: int, model, start: tuple) -> tuple:
        if reruns is not None:
            reruns.append(at)
        own = fixed.where((F.col("_range") == at) & F.col("model").eqNullSafe(F.lit(model)))
        return border_lines(own, ["model"], lambda: Stretch(weight, ends["low"], ends["high"], start), Stretch.after)[0][2].now

    def combine(at: int, start: tuple | None, line: Stretch) -> tuple:
        if start is None:
            return line.now
        return line.from_start(start) or again(at, line.model, start)

    starts, going_on = carried(lines, combine)
    shared = rows.sparkSession.sparkContext.broadcast((starts, going_on))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, going_on = shared.value
        done, held, at = [], None, None
        for new, _, part in runs(batches, ["model"]):
            if new:
                start = starts.get(part[0]["_range"]) if held is None else None
                done += [held] if held else []
                held = Stretch(weight, ends["low"], ends["high"], start)
            at = part[0]["_range"]
            held = held.after(part)
        done += [held] if held and at not in going_on else []
        if done:
            out = [(d.model, round(d.now[0], 6), int(d.now[1]), d.now[2]) for d in done]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["model", "quality", "latency_ms", "samples"])

    types = [to_arrow_type(observations.schema["model"].dataType), pa.float64(), pa.int64(), pa.int64()]
    return fixed.mapInArrow(last, f"model {kind}, quality double, latency_ms long, samples long")


class Stretch:
    """A model's observations in a range: what they come to from ``start`` (quality, latency, samples; None: from nothing), and what they make
    of any other start."""

    def __init__(self, weight: float, low: float, high: float, start: tuple | None = None):
        self.weight, self.model, self.n = weight, None, 0
        self.now = start
        self.keep, self.add = 1.0, 0.0
        self.low, self.high = float(math.floor(low)), float(high)

    def after(self, part: list[dict]) -> Stretch:
        w, now, low, high, keep, add = self.weight, self.now, self.low, self.high, self.keep, self.add
        for row in part:
            q, l = row["q"], row["l"]
            now = (now[0] * (1 - w) + q * w, float(math.floor(now[1] * (1 - w) + l * w)), now[2] + 1) if now else (q, l, 1)
            keep, add = keep * (1 - w), add * (1 - w) + q * w
            met = low == high
            low = float(math.floor(low * (1 - w) + l * w))
            high = low if met else float(math.floor(high * (1 - w) + l * w))
        self.model, self.n = part[-1]["model"], self.n + len(part)
        self.now, self.low, self.high, self.keep, self.add = now, low, high, keep, add
        return self

    def from_start(self, start: tuple) -> tuple | None:
        """What they come to from another start; None where its latency matters to the end."""
        return (start[0] * self.keep + self.add, self.low, start[2] + self.n) if self.low == self.high else None


def cheaper_model(stats: DataFrame, least_quality: float) -> DataFrame:
    """Of models (model, quality, cost) that are good enough, the cheapest, against the dearest as the
    one in use; savings at 100 requests an hour."""
    good = stats.where(F.col("quality") >= least_quality)
    both = good.agg(F.min(F.struct("cost", "model", "quality")).alias("r"), F.max(F.struct("cost", "model", "quality")).alias("c")).where("r is not null")
    saved = (F.col("c.cost") - F.col("r.cost")) * 30 * 24 * 100
    delta = F.col("r.quality") - F.col("c.quality")
    return both.select(
        F.col("r.model").alias("recommended"), F.col("c.model").alias("current"), F.round(saved, 6).alias("monthly_savings"), F.round(saved * 12, 6).alias("annual_savings"),
        F.round(delta, 6).alias("quality_delta"), F.round(0.9 * (1 - F.abs(delta) / F.col("c.quality")), 6).alias("confidence"),
    )


DEFAULT_PRICE = (0.01, 0.03)


def price_per_request(models: DataFrame, prices: DataFrame, prompt: int = 100, completion: int = 50) -> DataFrame:
    """Models with their price of one request; those without a price have the default."""
    cost = prompt / 1000 * F.coalesce("per_prompt", F.lit(DEFAULT_PRICE[0])) + completion / 1000 * F.coalesce("per_completion", F.lit(DEFAULT_PRICE[1]))
    return models.join(F.broadcast(prices), "model", "left").select("model", F.round(cost, 9).alias("cost"))
