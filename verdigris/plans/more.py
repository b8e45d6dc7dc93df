"""Queries and SQL: the parts of larger operators that stand alone in the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import similarity as S
from verdigris.functions import text as X
from verdigris.functions.storage import scratch
from verdigris.operators import benchmark, coherence, consistency, generation, inference, ranking, verification
from verdigris.plans import inference as P
from verdigris.plans import texts as T
from verdigris.plans.fixtures import RESULTS, model_results, references, results, table, turns
from verdigris.sources import builtin, files, report
from verdigris.streaming import monitoring

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# ranking parts


@query("WIN2_quality", P.SCORED + " SELECT model, round(quality, 6) AS quality FROM q")
def win2(spark, sf):
    return model_results(spark, sf).where("success").select("model", F.round(ranking.quality(), 6).alias("quality"))


@query("WIN3_performance", P.SCORED + " SELECT model, round(performance, 6) AS performance FROM s")
def win3(spark, sf):
    return ranking.scored(model_results(spark, sf)).select("model", F.round("performance", 6).alias("performance"))


@query("WIN4_cost_efficiency", P.SCORED + " SELECT model, round(cost_efficiency, 6) AS cost_efficiency FROM s")
def win4(spark, sf):
    return ranking.scored(model_results(spark, sf)).select("model", F.round("cost_efficiency", 6).alias("cost_efficiency"))


@query("WIN8_divergence", P.SCORED + ", g AS (SELECT provider, var_pop(quality) AS v FROM q GROUP BY provider) SELECT provider, round(v, 6) AS variance, v > 0.1 AS divergent FROM g")
def win8(spark, sf):
    g = model_results(spark, sf).where("success").groupBy("provider").agg(F.var_pop(ranking.quality()).alias("v"))
    return g.select("provider", F.round("v", 6).alias("variance"), (F.col("v") > 0.1).alias("divergent"))


#: Candidates with prices per million tokens in and out, quality and latency.
CANDIDATES = (
    ("openai", "gpt-4-turbo", 10.0, 30.0, 0.92, 1200.0), ("openai", "gpt-4", 30.0, 60.0, 0.92, 2500.0), ("openai", "gpt-3.5-turbo", 0.5, 1.5, 0.78, 800.0),
    ("anthropic", "claude-3-opus", 15.0, 75.0, 0.94, 2000.0), ("anthropic", "claude-3-sonnet", 3.0, 15.0, 0.88, 1000.0), ("anthropic", "claude-3-haiku", 0.25, 1.25, 0.82, 500.0),
)
CANDIDATE_VALUES = ", ".join(f"('{p}', '{m}', {a}::DOUBLE, {b}::DOUBLE, {q}::DOUBLE, {t}::DOUBLE, {i})" for i, (p, m, a, b, q, t) in enumerate(CANDIDATES))
OPTIMIZE = f"""WITH c(provider, model, a, b, quality, latency, n) AS (VALUES {CANDIDATE_VALUES}), m AS (SELECT *, (500 * a + 300 * b) / 1000000 * 100000 AS monthly FROM c), u AS (SELECT monthly AS mu, quality AS qu, latency AS lu FROM m WHERE model = 'gpt-4'),
  o AS (SELECT m.*, mu - monthly AS saved, (mu - monthly) / mu * 100 AS percent, quality - qu AS dq, latency - lu AS dl FROM m, u WHERE model <> 'gpt-4' AND quality >= 0.8)"""


def optimized(spark):
    """Alternatives to gpt-4 at 100,000 requests a month of 500 tokens in and 300 out. Prices are per
    million tokens, so they are divided by a million."""
    c = spark.createDataFrame([(*row, i) for i, row in enumerate(CANDIDATES)], "provider string, model string, a double, b double, quality double, latency double, n int")
    c = c.withColumn("monthly", (500 * F.col("a") + 300 * F.col("b")) / 1_000_000 * 100_000)
    now = F.broadcast(c.where("model = 'gpt-4'").select(F.col("monthly").alias("mu"), F.col("quality").alias("qu"), F.col("latency").alias("lu")))
    o = c.where("model != 'gpt-4' AND quality >= 0.8").join(now)
    return o.withColumns({"saved": F.col("mu") - F.col("monthly"), "dq": F.col("quality") - F.col("qu"), "dl": F.col("latency") - F.col("lu")}).withColumn("percent", F.col("saved") / F.col("mu") * 100)


@query("WIN13_optimize", OPTIMIZE + " SELECT CAST(row_number() OVER (ORDER BY saved DESC, n) AS INT) AS rank, model, round(monthly, 6) AS monthly, round(saved, 6) AS saved, round(percent, 6) AS percent FROM o")
def win13(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("saved"), "n"))  # six candidates
    return optimized(spark).select(rank.alias("rank"), "model", F.round("monthly", 6).alias("monthly"), F.round("saved", 6).alias("saved"), F.round("percent", 6).alias("percent"))


@query("WIN14_reasons", OPTIMIZE + " SELECT model, CASE WHEN saved > 0 AND dq >= 0 THEN printf('Saves $%.2f/month while maintaining or improving quality', saved) WHEN saved > 0 THEN printf('Saves $%.2f/month (%.1f%% reduction)', saved, percent) WHEN dq > 0 THEN printf('Improves quality by %.2f points', dq) ELSE 'Alternative option' END AS reason FROM o")
def win14(spark, sf):
    s, q = F.col("saved"), F.col("dq")
    reason = (
        F.when((s > 0) & (q >= 0), F.format_string("Saves $%.2f/month while maintaining or improving quality", s)).when(s > 0, F.format_string("Saves $%.2f/month (%.1f%% reduction)", s, F.col("percent")))
        .when(q > 0, F.format_string("Improves quality by %.2f points", q)).otherwise("Alternative option")
    )
    return optimized(spark).select("model", reason.alias("reason"))


@query("WIN16_degradation", P.REQUESTS + P.BREAKS + " SELECT pattern, count(*) AS n FROM br GROUP BY pattern")
def win16(spark, sf):
    from verdigris.operators import stress

    return stress.breaking_points(P.requests(spark, sf)).groupBy("pattern").agg(F.count("*").alias("n"))


@query("WIN26_caps", f"WITH {RESULTS} SELECT test_id, duration_ms FROM r ORDER BY duration_ms DESC, test_id LIMIT 1000")
def win26(spark, sf):
    """The cap of a report: its thousand slowest tests."""
    return results(spark, sf).orderBy(F.desc("duration_ms"), "test_id").limit(1000).select("test_id", "duration_ms")


@query("STA11_normal_welch", P.REGRESSIONS + " SELECT provider, model, metric, round(t, 6) AS t, round(p, 6) AS p_value FROM h")
def sta11(spark, sf):
    found = inference.regressions(P.runs(spark, sf), ["provider", "model"])
    return found.select("provider", "model", "metric", F.round("t", 6).alias("t"), F.round("p_value", 6).alias("p_value"))


# similarity parts

PAIRS = T.TURNS


def pairs(spark, sf):
    return consistency.pairs(turns(spark, sf))


def pair_query(name: str, sql: str, value):
    @query(name, PAIRS + f" SELECT group_id, i, j, round({sql}, 6) AS similarity FROM p")
    def run(spark, sf):
        return pairs(spark, sf).select("group_id", "i", "j", F.round(value(F.col("a"), F.col("b")), 6).alias("similarity"))

    return run


RATIO = "CASE WHEN greatest({0}, {1}) = 0 THEN 1.0 ELSE least({0}, {1}) / greatest({0}, {1})::DOUBLE END"
PARAS = "len(list_filter(regexp_split_to_array({}, '\\n\\n+'), lambda x: trim(x) <> ''))"
pair_query("SIM10_structural", f"0.5 * {RATIO.format('length(a)', 'length(b)')} + 0.5 * {RATIO.format(PARAS.format('a'), PARAS.format('b'))}", S.structural)
pair_query("SIM13_space_jaccard", T.jaccard_sql(T.SPACE.format("a"), T.SPACE.format("b"), "0.0"), S.space_jaccard)
pair_query("SIM15_description_jaccard", T.jaccard_sql(T.SPACE.format("b"), T.SPACE.format("a"), "0.0"), lambda a, b: S.space_jaccard(b, a))
pair_query("SIM12_token_jaccard", f"CASE WHEN len({T.STRIP.format('a')}) = 0 OR len({T.STRIP.format('b')}) = 0 THEN 0.0 ELSE {T.jaccard_sql(T.STRIP.format('a'), T.STRIP.format('b'))} END", S.token_jaccard)
pair_query("SIM11_keyword_coverage", f"CASE WHEN len({T.KW.format('a')}) = 0 THEN 0.0 ELSE len(list_intersect({T.KW.format('a')}, {T.KW.format('b')}))::DOUBLE / len({T.KW.format('a')}) END", S.keyword_coverage)
EXPECTED = "regexp_split_to_array(lower(b), '\\s+')"
CONTENT = "regexp_split_to_array(lower(a), '\\s+')"
pair_query("SIM14_expected_overlap", f"least(1.0, len(list_filter({EXPECTED}, lambda w: list_contains({CONTENT}, w)))::DOUBLE / len(list_distinct(list_concat({CONTENT}, {EXPECTED}))))", S.expected_overlap)


@query("SIM7_strict_ngrams", PAIRS + f", g AS (SELECT group_id, i, j, {T.char_grams_sql('na', 3)} AS ca, {T.char_grams_sql('nb', 3)} AS cb FROM p) SELECT group_id, i, j, round(CASE WHEN len(ca) = 0 OR len(cb) = 0 THEN 0.0 ELSE {T.jaccard_sql('ca', 'cb')} END, 6) AS similarity FROM g")
def sim7(spark, sf):
    p = consistency.pair_measure(turns(spark, sf).withColumn("content", X.normalized(F.col("content"))), S.strict_ngrams, "similarity")
    return p.withColumn("similarity", F.round("similarity", 6))


@query("SIM5_word_ngrams", PAIRS + f", g AS (SELECT group_id, i, j, {T.word_grams_sql('na', 2)} AS wa, {T.word_grams_sql('nb', 2)} AS wb FROM p) SELECT group_id, i, j, round({T.jaccard_sql('wa', 'wb')}, 6) AS similarity FROM g")
def sim5(spark, sf):
    p = consistency.pairs(turns(spark, sf).withColumn("content", X.normalized(F.col("content"))))
    p = p.withColumns({"x": F.split("a", " "), "y": F.split("b", " ")})
    return p.select("group_id", "i", "j", F.round(S.set_jaccard(S.word_ngrams(F.col("x"), 2), S.word_ngrams(F.col("y"), 2)), 6).alias("similarity"))


@query("SIM17_character_error_rate", PAIRS + f" SELECT group_id, i, j, round(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END ELSE {T.EDITS.format('a', 'b')} / length(a)::DOUBLE END, 6) AS cer FROM p")
def sim17(spark, sf):
    return pairs(spark, sf).select("group_id", "i", "j", F.round(S.character_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@query("JN7_group_pairs", PAIRS + " SELECT group_id, i, j FROM p")
def jn7(spark, sf):
    return pairs(spark, sf).select("group_id", "i", "j")


@query("JN10_perturbed_vs_base", PAIRS + f" SELECT group_id, j AS ordinal, round({T.jaccard_sql(T.SPACE.format('a'), T.SPACE.format('b'), '0.0')}, 6) AS similarity FROM p WHERE i = 0")
def jn10(spark, sf):
    """Each later turn against its group's first."""
    t = turns(spark, sf)
    base = t.where("ordinal = 0").select("group_id", F.col("content").alias("base"))
    return t.where("ordinal > 0").join(base, "group_id").select("group_id", "ordinal", F.round(S.space_jaccard(F.col("base"), F.col("content")), 6).alias("similarity"))


@query("JN12_vectors_over_threshold", "SELECT vec_id FROM embeddings WHERE vec_id <> 0 AND round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) >= 0.1")
def jn12(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    one = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return v.where("vec_id != 0").join(one).where(F.round(S.cosine(F.col("q"), F.col("embedding")), 6) >= 0.1).select("vec_id")


# text parts


@query("TXT5_flesch_kincaid", T.MEASURES + " SELECT id, round(CASE WHEN words = 0 OR sentences = 0 THEN 0.0 ELSE 0.39 * words::DOUBLE / sentences + 11.8 * syllables::DOUBLE / words - 15.59 END, 6) AS grade FROM d")
def txt5(spark, sf):
    return T.measures(spark, sf).select("id", F.round(X.flesch_kincaid(F.col("words"), F.col("sentences"), F.col("syllables")), 6).alias("grade"))


@query("TXT6_sentence_length", T.MEASURES + " SELECT id, round(CASE WHEN sentences = 0 THEN 0.0 ELSE words::DOUBLE / sentences END, 6) AS length FROM d")
def txt6(spark, sf):
    return T.measures(spark, sf).select("id", F.round(benchmark.ratio(F.col("words"), F.col("sentences")), 6).alias("length"))


SENTENCE_LIST = "list_filter(string_split(trim(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g')), chr(1)), lambda s: trim(s) <> '')"
UNITS = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+(?:[''’.][\\p{{L}}\\p{{N}}]+)*'))"
MARKS = " + ".join(f"len(regexp_extract_all(lower(text), '\\b{m}\\b'))" for marks in X.MARKERS.values() for m in marks)
VIOLATIONS = f"""WITH b AS (SELECT doc_id AS id, text, {SENTENCE_LIST} AS s, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w, {UNITS.format('text')} AS words, {MARKS} AS markers FROM documents),
  v AS (SELECT id, CAST(words AS INT) AS words, CAST(markers AS INT) AS markers, CAST(words < 3 AS INT) AS short, CAST(CASE WHEN words < 3 THEN 0 ELSE len(list_filter(s, lambda x: {UNITS.format('x')} > 40)) END AS INT) AS long_sentences,
    CAST(CASE WHEN words < 3 THEN 0 ELSE len(list_filter(s, lambda x: {UNITS.format('x')} = 1 AND NOT regexp_matches(x, '[?!]$'))) END AS INT) AS single_words,
    CAST(CASE WHEN words < 3 THEN 0 ELSE len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 3 AND regexp_matches(w[i], '[a-zA-Z]'))) END AS INT) AS repeats FROM b)"""


@query("TXT8_coherence_violations", VIOLATIONS + " SELECT * FROM v")
def txt8(spark, sf):
    return coherence.violations(T.documents(spark, sf))


@query(
    "TXT9_coherence_heuristic",
    VIOLATIONS
    + """, d AS (SELECT *, markers / greatest(words, 1)::DOUBLE AS density FROM v) SELECT id, round(greatest(0.0, least(1.0, 0.85 - 0.08 * short - 0.03 * (long_sentences + single_words + repeats) - CASE WHEN words < 10 THEN 0.1 ELSE 0 END
    + CASE WHEN density > 0.02 AND density < 0.15 THEN 0.05 ELSE 0 END))::DOUBLE, 6) AS score FROM d""",
)
def txt9(spark, sf):
    return coherence.violations(T.documents(spark, sf)).select("id", F.round(coherence.heuristic(), 6).alias("score"))


@query(
    "TXT10_coherence_overall",
    VIOLATIONS
    + """, d AS (SELECT *, markers / greatest(words, 1)::DOUBLE AS density, greatest(words, 1)::DOUBLE AS n FROM v),
    p AS (SELECT *, greatest(0.0, least(1.0, 0.85 - 0.08 * short - 0.03 * (long_sentences + single_words + repeats) - CASE WHEN words < 10 THEN 0.1 ELSE 0 END + CASE WHEN density > 0.02 AND density < 0.15 THEN 0.05 ELSE 0 END))::DOUBLE AS flow FROM d)
    SELECT id, round(greatest(0.0, least(1.0, 0.35 * flow + 0.25 * greatest(0.0, 1 - 10 * single_words / n) + 0.25 * greatest(0.0, 1 - 10 * repeats / n) + 0.15 * greatest(0.0, 1 - 40 * long_sentences / n) - 0.1 * (repeats > 5)::INT)), 9) AS score FROM p""",
)
def txt10(spark, sf):
    """The parts are what the text's own violations leave, by the words it has; many repeats are of high severity."""
    v = coherence.violations(T.documents(spark, sf)).withColumn("flow", coherence.heuristic())
    n = F.greatest("words", F.lit(1))
    left = lambda c, k: F.greatest(F.lit(0.0), 1 - k * F.col(c) / n)
    parts = v.withColumns({"logical_flow": F.col("flow"), "grammar": left("single_words", 10), "consistency": left("repeats", 10), "readability": left("long_sentences", 40)})
    return parts.select("id", F.round(coherence.overall((F.col("repeats") > 5).cast("int")), 9).alias("score"))


@query("TXT18_contradictions", T.EVIDENCE + " SELECT claim_id, count(*) AS n FROM e WHERE contradicts GROUP BY claim_id")
def txt18(spark, sf):
    from verdigris.plans.fixtures import claims

    return verification.support(claims(spark, sf), references(spark, sf)).where("against > 0").select("claim_id", F.col("against").alias("n"))


@query("TXT21_claim_types", T.SENTENCES + f" SELECT {T.TYPE} AS type, count(*) AS n FROM sc GROUP BY 1")
def txt21(spark, sf):
    return T.sentences_of_turns(spark, sf).groupBy(verification.claim_type(F.col("claim")).alias("type")).agg(F.count("*").alias("n"))


@query("TXT23_named_pairs", "SELECT doc_id AS id, CAST(len(list_slice(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')), 1, 10)) AS INT) AS entities FROM documents")
def txt23(spark, sf):
    """Capitalised word pairs, the first ten distinct ones: what a fabricated entity is looked for among."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+ [A-Z][a-z]+)"), F.lit(1)))
    return T.documents(spark, sf).select("id", F.size(F.slice(found, 1, 10)).alias("entities"))


@query("TXT25_bias_severity", T.bias_sql() + " SELECT severity, count(*) AS n FROM v GROUP BY severity")
def txt25(spark, sf):
    from verdigris.operators import bias

    return bias.detect(T.biased_texts(spark, sf)).groupBy(bias.severity(F.col("relevance")).alias("severity")).agg(F.count("*").alias("n"))


SPECIAL = r"[^a-zA-Z0-9_ \t\n\r\f\x0B]"


@query("TXT30_complexity", f"SELECT doc_id AS id, round(least(1.0, 0.5 + least(1.0, length(text) / 1000.0) * 0.2), 6) AS generated, round(least(1.0, least(0.3, length(text) / 5000.0) + least(0.2, len(regexp_extract_all(text, '{SPECIAL}')) / greatest(1, length(text))::DOUBLE) + 0.2), 6) AS adversarial FROM documents")
def txt30(spark, sf):
    n = F.char_length("text")
    special = F.regexp_count("text", F.lit(SPECIAL)) / F.greatest(F.lit(1), n)
    adversarial = F.least(F.lit(0.3), n / 5000) + F.least(F.lit(0.2), special) + 0.2
    return T.documents(spark, sf).select("id", F.round(F.least(F.lit(1.0), 0.5 + F.least(F.lit(1.0), n / 1000) * 0.2), 6).alias("generated"), F.round(F.least(F.lit(1.0), adversarial), 6).alias("adversarial"))


@query("TXT31_diff_summary", T.GOLDEN + " SELECT sample_id, CAST(greatest(0, length(output) - length(golden)) AS INT) AS chars_added, CAST(greatest(0, length(golden) - length(output)) AS INT) AS chars_removed FROM g")
def txt31(spark, sf):
    o, g = T.outputs_and_golden(spark, sf)
    n = F.char_length("output") - F.char_length("golden")
    return verification.golden(o, g).select("sample_id", F.greatest(F.lit(0), n).alias("chars_added"), F.greatest(F.lit(0), -n).alias("chars_removed"))


# surfaces


@query("UDF1_registered_evaluator", T.GOLDEN + " SELECT sample_id, CASE WHEN length(output) > length(golden) THEN 1.0 ELSE 0.0 END::DOUBLE AS longer FROM g")
def udf1(spark, sf):
    """A user's evaluator, registered and used by name."""
    verification.register("longer", lambda content, expected, _: (F.char_length(content) > F.char_length(expected)).cast("double"))
    o, g = T.outputs_and_golden(spark, sf)
    joined = verification.golden(o, g).select("sample_id", F.col("output").alias("content"), F.col("golden").alias("expected"))
    return verification.evaluate(joined, {"longer": ("longer", None)}).select("sample_id", "longer")


@query("STR1_subscribe", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def str1(spark, sf):
    """Events as a stream, counted by type for a subscriber."""
    at = scratch(spark)
    source = table(spark, sf, "events")
    source.select("event_id", "event_type").write.parquet(f"{at}/in")
    stream = monitoring.read_stream(spark, f"{at}/in", source.select("event_id", "event_type").schema, 1000)
    counts = stream.groupBy("event_type").agg(F.count("*").alias("n"))
    monitoring.publish(counts, lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out"), f"{at}/checkpoint", "complete").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("SRC3_jsonl_results", f"WITH {RESULTS} SELECT test_id, status, duration_ms FROM r")
def src3(spark, sf):
    """Results written as JSON lines and read back through the result schema."""
    at = f"{scratch(spark)}/results"
    files.append_jsonl(results(spark, sf).select("test_id", "status", "duration_ms"), at)
    return files.results_jsonl(spark, at).select("test_id", "status", "duration_ms")


@query("SRC1_datasets", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS prompt FROM part")
def src1(spark, sf):
    """A directory of dataset files, one per brand, read and taken apart into test cases."""
    at = f"{scratch(spark)}/datasets"
    cases = F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("prompt")))
    table(spark, sf, "part").groupBy(F.pmod(F.hash("p_partkey"), F.lit(200)).alias("k")).agg(cases.alias("test_cases")).select(
        F.concat(F.lit("set-"), F.col("k")).alias("name"), F.lit("1").alias("version"), "test_cases"
    ).write.option("maxRecordsPerFile", 1).json(at)
    return files.test_cases(files.datasets(spark, at)).select("id", "prompt")


@query("SNK1_csv_round_trip", f"WITH {RESULTS} SELECT test_id, status FROM r")
def snk1(spark, sf):
    at = f"{scratch(spark)}/csv"
    files.write_csv(results(spark, sf).select("test_id", "status"), at, delimiter=";")
    return spark.read.schema("test_id string, status string").option("header", True).option("delimiter", ";").csv(at)


@query("SRC5_builtin_datasets", "SELECT * FROM (VALUES " + ", ".join(f"('{d}', {len(c)}::BIGINT)" for d, c in builtin.DATASETS.items()) + ") d(dataset, cases)")
def src5(spark, sf):
    return builtin.datasets(spark).groupBy("dataset").agg(F.count("*").alias("cases"))


@query("SNK5_executive_report")
def snk5(spark, sf):
    """The page's lines, as executors write them."""
    at = f"{scratch(spark)}/report"
    report.write_report(results(spark, sf), at)
    return spark.read.text(at)


@query("AGG24_running_provider_stats", "SELECT 'provider-' || user_id % 5 AS provider, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate FROM events GROUP BY 1")
def agg24(spark, sf):
    from verdigris.plans.records import events

    s = monitoring.provider_stats(events(spark, sf))
    return s.select("provider", "requests", "errors", F.round((F.col("requests") - F.col("errors")) / F.col("requests"), 6).alias("success_rate"))


@query("GEN2_difficulty_draws")
def gen2(spark, sf):
    return spark.range(10_000).select(generation.difficulty(generation.uniform(5, "id")).alias("difficulty")).groupBy("difficulty").agg(F.count("*").alias("n"))


@query("UDF5_evaluate_all", T.SCORES + " SELECT sample_id, round((exact + part + length) / 3, 6) AS accuracy, round((words + format) / 2, 6) AS quality FROM s")
def udf5(spark, sf):
    s = T.scores(spark, sf)
    return s.select("sample_id", F.round((F.col("exact") + F.col("part") + F.col("length")) / 3, 6).alias("accuracy"), F.round((F.col("words") + F.col("format")) / 2, 6).alias("quality"))


@query("DML6_updated_at", "SELECT o_orderkey AS id, o_orderkey % 10 = 0 AS changed FROM orders")
def dml6(spark, sf):
    """Whatever an update touches is stamped."""
    from verdigris.operators import records
    from verdigris.plans.records import as_of, jobs

    j = jobs(spark, sf).select("id", "status", F.lit(None).cast("timestamp").alias("updated_at"))
    changed = records.update(j, j.where("id % 10 = 0").select("id", F.lit("cancelled").alias("status")), as_of())
    return changed.select("id", F.col("updated_at").isNotNull().alias("changed"))
