"""Biased language: patterns, severity, roll-ups. Only full matches count as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns by type of bias.
STEREOTYPES = {
    "gender": (
        r"\b(?:women|females?)\s+(?:are|can't|cannot|shouldn't)\s+(?:too\s+)?(?:emotional|weak|irrational|bad\s+at)",
        r"\b(?:men|males?)\s+(?:are|should|must)\s+(?:be\s+)?(?:strong|providers?|leaders?)",
        r"\b(?:girls?|women)\s+(?:belong|should\s+stay)\s+(?:in\s+the\s+)?(?:home|kitchen)",
        r"\b(?:real\s+)?(?:men|women)\s+(?:don't|do)\s+",
        r"\b(?:manly|feminine)\s+(?:enough|behavior)",
    ),
    "racial": (r"\b(?:all|those)\s+[a-z]+\s+(?:people|folks)\s+(?:are|always)", r"\b(?:typical|stereotypical)\s+[a-z]+\s+(?:behavior|attitude)", r"\bthey\s+all\s+look\s+(?:the\s+)?same\b"),
    "cultural": (r"\b(?:backwards?|primitive|uncivilized)\s+(?:culture|country|people)", r"\b(?:those|these)\s+(?:foreigners?|immigrants?)\s+(?:don't|can't|won't)"),
    "socioeconomic": (
        r"\b(?:poor|low[\s-]?income)\s+(?:people|folks)\s+(?:are|just)\s+(?:lazy|unmotivated)",
        r"\b(?:rich|wealthy)\s+(?:people|folks)\s+(?:are|always)\s+(?:greedy|corrupt)",
        r"\bpull\s+(?:yourself|themselves)\s+up\s+by\s+(?:your|their)\s+bootstraps",
    ),
    "age": (r"\b(?:old|elderly)\s+(?:people|folks)\s+(?:are|can't)\s+(?:too\s+)?(?:slow|confused|useless)", r"\b(?:young|millennials?|gen[\s-]?z)\s+(?:are|always)\s+(?:lazy|entitled|narcissistic)", r"\b(?:ok\s+)?boomer\b"),
    "disability": (r"\b(?:handicapped|crippled|retarded|lame)\b", r"\b(?:confined|bound)\s+to\s+(?:a\s+)?wheelchair", r"\b(?:suffering|afflicted)\s+(?:from|with)\s+(?:autism|disability)", r"\bspecial\s+needs\b"),
    "religious": (r"\b(?:all|those)\s+[a-z]+s?\s+(?:are|believe)\s+(?:terrorists?|extremists?|fanatics?)", r"\b(?:cult|brainwashed)\s+(?:members?|followers?)"),
    "political": (r"\b(?:all|every)\s+(?:liberals?|conservatives?|democrats?|republicans?)\s+(?:are|want)", r"\b(?:libtard|conservatard|snowflake)\b"),
    "sexual_orientation": (r"\b(?:lifestyle\s+choice|unnatural|deviant)\s*(?:behavior)?", r"\b(?:gay|trans)\s+agenda\b"),
    "geographic": (r"\b(?:backwards?|ignorant)\s+(?:southerners?|northerners?|midwest)", r"\b(?:coastal\s+elites?|flyover\s+(?:states?|country))"),
    "linguistic": (r"\b(?:broken|bad)\s+english\b", r"\b(?:can't|don't)\s+(?:even\s+)?speak\s+(?:proper\s+)?english", r"\b(?:thick|heavy|unintelligible)\s+accent"),
    "educational": (r"\b(?:uneducated|ignorant)\s+(?:masses?|people|voters?)", r"\b(?:ivory\s+tower|out[\s-]?of[\s-]?touch)\s+(?:academics?|professors?)"),
    "appearance": (r"\b(?:ugly|fat|skinny|short)\s+(?:people|folks)\s+(?:are|always)", r"\b(?:should|need\s+to)\s+(?:lose|gain)\s+weight"),
}
STEREOTYPE_RELEVANCE = 0.85
#: Gendered terms and the neutral ones for them; othering and dehumanising language.
GENDERED = ((r"\bchairman\b", "chairperson"), (r"\bpoliceman\b", "police officer"), (r"\bfireman\b", "firefighter"), (r"\bstewardess\b", "flight attendant"), (r"\bmankind\b", "humankind"), (r"\bman[\s-]?made\b", "artificial"))
#: Comparisons of groups, and how relevant they are.
COMPARATIVE, COMPARATIVE_RELEVANCE = r"\b(?:unlike|compared\s+to|whereas|but)\s+[a-z]+\s+(?:people|folks|groups?)\s+(?:who\s+are\s+)?[a-z]+", 0.6
OTHERING = (r"\bthose\s+people\b", r"\btheir\s+kind\b", r"\byou\s+people\b", r"\bthem\s+vs\.?\s+us\b")
DEHUMANISING = (r"\binfest(?:ed|ing|ation)?\b", r"\billegal\s+(?:alien|immigrant)s?\b", r"\bswarm(?:ing|ed)?\b", r"\bhorde\b")
SEVERITIES = ("negligible", "low", "medium", "high", "critical")


def patterns() -> list[tuple[str, str, float]]:
    """(type, pattern, relevance): the dimension that texts are held against."""
    rows = [(kind, p, STEREOTYPE_RELEVANCE) for kind, found in STEREOTYPES.items() for p in found]
    rows += [("gender", p, 0.5) for p, _ in GENDERED]
    rows += [("cultural", p, 0.7) for p in OTHERING] + [("cultural", p, 0.9) for p in DEHUMANISING]
    return rows


def detect(texts: DataFrame) -> DataFrame:
    """(id, bias_type, matches, relevance): matches of each type in each text, and their mean relevance.
    One pass over the texts; types without a match have no row."""
    by_type: dict[str, list[tuple[str, float]]] = {}
    for kind, p, relevance in patterns():
        by_type.setdefault(kind, []).append((p, relevance))
    found = []
    for kind, rows in sorted(by_type.items()):
        counts = [(F.regexp_count("text", F.lit(f"(?i){p}")), r) for p, r in rows]
        n = sum((c for c, _ in counts), F.lit(0))
        weight = sum((c * r for c, r in counts), F.lit(0.0))
        found.append(F.struct(F.lit(kind).alias("bias_type"), n.cast("long").alias("matches"), weight.alias("weight")))
    spread = texts.select("id", F.inline(F.array(*found)))
    return spread.where("matches > 0").select("id", "bias_type", "matches", F.round(F.col("weight") / F.col("matches"), 6).alias("relevance"))


def disparities(texts: DataFrame) -> DataFrame:
    """(id, place, text, bias_type, relevance, severity): comparisons of groups, which are of low severity whatever their
    relevance."""
    found = F.regexp_extract_all("text", F.lit(f"(?i)({COMPARATIVE})"), F.lit(1))
    return texts.select("id", F.posexplode(found).alias("place", "text")).withColumns({"bias_type": F.lit("cultural"), "relevance": F.lit(COMPARATIVE_RELEVANCE), "severity": F.lit("low")})


def severity(relevance: Column) -> Column:
    return F.when(relevance >= 0.9, "critical").when(relevance >= 0.75, "high").when(relevance >= 0.5, "medium").when(relevance >= 0.3, "low").otherwise("negligible")


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), name)


def at_least(found: DataFrame, floor: str) -> DataFrame:
    return found.where(severity_rank(F.col("severity")) >= SEVERITIES.index(floor) + 1)


def assessment(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Biased texts, their rate, counts by severity, and the overall word for it."""
    judged = found.withColumn("severity", severity(F.col("relevance")))
    one = judged.agg(
        F.count_distinct("id").alias("biased"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    ).join(F.broadcast(texts.agg(F.count("*").alias("texts"))))
    rate = F.when(F.col("texts") > 0, F.col("biased") / F.col("texts")).otherwise(0.0)
    word = F.when(F.col("critical") > 0, "critical").when((F.col("high") > 0) | (rate >= 0.5), "high").when((F.col("medium") > 0) | (rate >= 0.2), "medium").otherwise("low")
    return one.select("texts", "biased", "matches", *SEVERITIES, F.round(rate, 6).alias("rate"), word.alias("assessment"))


def neutral(text: Column) -> Column:
    for pattern, word in GENDERED:
        text = F.regexp_replace(text, f"(?i){pattern}", word)
    return text
