"""Synthetic test cases: each row's draws come from a hash of the seed and its number, so any part of
the rows can be made anew, in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of easy, medium and hard.
DIFFICULTY = (("easy", 0.33), ("medium", 0.67), ("hard", 1.0))
TEMPLATES = ("Summarize the following text about {topic}.", "Explain {topic} in simple terms.", "Write a function that handles {topic}.", "Compare two views of {topic}.")
TOPICS = ("sorting", "history", "chemistry", "trade", "music")


def uniform(seed: int, *parts) -> Column:
    """From 0 up to 1, fixed by the seed and the parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


#: The linear congruential generator that seeded runs draw from.
FACTOR, ADDEND, BITS = 1103515245, 12345, 31


def lcg(seed: int, n: Column) -> Column:
    """The state after ``n`` steps from ``seed``, below 2 ** 31, without making the steps before: each bit of n takes as
    many steps at once, whose factor and addend are known."""
    state, factor, addend, low = F.lit(seed % (1 << BITS)).cast("long"), FACTOR % (1 << BITS), ADDEND, F.lit((1 << BITS) - 1).cast("long")
    for bit in range(BITS):
        on = F.shiftright(n.cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))
        # both factors are below 2 ** 31, so the product is below 2 ** 62; where the bit is off, one and nothing
        state = (state * (on * (factor - 1) + 1) + on * addend).bitwiseAND(low)
        factor, addend = factor * factor % (1 << BITS), (factor * addend + addend) % (1 << BITS)
    return state


def difficulty(u: Column) -> Column:
    out = F.lit(DIFFICULTY[-1][0])
    for name, upto in reversed(DIFFICULTY[:-1]):
        out = F.when(u < upto, name).otherwise(out)
    return out


def pick(values, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def cases(spark: SparkSession, n: int, seed: int, strategy: str = "template") -> DataFrame:
    """(id, difficulty, prompt, hash). Strategies set the difficulty: edge cases are hard in 70 %,
    adversarial ones always, progressive ones by thirds of the run. Variations, distribution-aware and
    cross-domain cases differ from templates by name only, as in what they were modelled on."""
    u = uniform(seed, "id")
    hard = {
        **dict.fromkeys(("template", "variation", "distribution_aware", "cross_domain"), difficulty(u)), "edge_case": F.when(u < 0.7, "hard").otherwise("medium"), "adversarial": F.lit("hard"),
        "progressive": F.when(F.col("id") / n < 0.33, "easy").when(F.col("id") / n < 0.66, "medium").otherwise("hard"),
        "combinatorial": difficulty(uniform(seed + 1, F.col("id") % len(TEMPLATES), F.col("id") % len(TOPICS))),
    }
    if strategy not in hard:
        raise ValueError(f"unknown strategy: {strategy}")
    prompt = F.replace(pick(TEMPLATES, uniform(seed + 2, "id")), F.lit("{topic}"), pick(TOPICS, uniform(seed + 3, "id")))
    return spark.range(n).select("id", hard[strategy].alias("difficulty"), prompt.alias("prompt")).withColumn("hash", F.sha2("prompt", 256))


def keep_first(generated: DataFrame) -> DataFrame:
    firsts = generated.groupBy("hash").agg(F.min("id").alias("id"))
    return generated.join(firsts.select("id"), "id", "left_semi")


def quality(generated: DataFrame) -> DataFrame:
    n = F.count("*")
    return generated.agg(
        n.alias("cases"), F.round(F.count_distinct("hash") / n, 6).alias("unique_rate"), F.round(F.avg(F.char_length("prompt")), 6).alias("avg_length"),
        F.min(F.char_length("prompt")).alias("min_length"), F.max(F.char_length("prompt")).alias("max_length"),
        *[F.round(F.count_if(F.col("difficulty") == d) / n, 6).alias(d) for d, _ in DIFFICULTY],
    )


def sampled(df: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    return df.where(uniform(seed, key) < share)


def constrained(df: DataFrame, least: int, most: int, forbidden: list[str]) -> DataFrame:
    """Texts of an admitted length without any of the words, whatever their case."""
    low = F.lower("text")
    clean = F.lit(True)
    for word in forbidden:
        clean = clean & ~F.contains(low, F.lit(word.lower()))
    return df.where(F.char_length("text").between(least, most) & clean)


#: What extreme inputs are made of, by kind; emoji count twice.
HAN = "".join(chr(0x4E00 + k) for k in range(100))
EMOJI = "😀🎉🚀💡🔥✨🌟💪"
CHARACTERS = {
    "ascii": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "unicode": HAN, "emoji": EMOJI, "special": "!@#$%^&*()_+-=[]{}|;:'\",.<>?/\\`~",
    "mixed": "".join(f"{a}{b}{han}😀" for a, b, han in zip("ACEGIKMOQSUWY", "BDFHJLNPRTVXZ", HAN)),
}


def extreme(sizes: list[int], kinds: tuple[str, ...] = tuple(CHARACTERS)) -> Column:
    """Inputs of each size of each kind of characters, these in turn, so the same input comes out each time. A kind that
    is not known is ASCII."""
    made = []
    for size in sizes:
        for kind in kinds:
            letters, n = CHARACTERS.get(kind, CHARACTERS["ascii"]), size // 2 if kind == "emoji" else size
            text = F.substring(F.repeat(F.lit(letters), F.lit(-(-n // len(letters)))), 1, n)
            made.append(F.struct(F.lit(size).alias("size"), F.lit(kind).alias("kind"), text.alias("text")))
    return F.array(*made)


def perturbed(prompts: DataFrame, indexes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(id, kind, index, prompt): eight kinds of perturbation of each prompt (id, text), with their variant of each index;
    variants come round after three. Reduction and reversal change only the first, and only texts of more sentences."""
    p = F.col("text")
    marks = r"[.!?]+"
    first = F.element_at(F.split(p, marks), 1)
    sentences, ends = F.split(p, marks), F.regexp_extract_all(p, F.lit(f"({marks})"), F.lit(1))
    # sentences and the marks between them, from the last to the first
    turned = F.trim(F.array_join(F.reverse(F.flatten(F.zip_with(sentences, F.concat(ends, F.array(F.lit(""))), lambda s, m: F.array(s, m)))), ""))
    variants = {
        "paraphrase": [F.concat(F.lit(lead), F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2))) for lead in ("Please ", "Could you ", "I would like you to ")],
        "instruction_rephrase": [p, F.concat(p, F.lit("\n\nPlease be specific.")), F.concat(F.lit("Task: "), p)],
        "format_change": [p, F.concat(F.lit("# Request\n\n"), p), F.concat(F.lit("Question: "), p, F.lit("\n\nAnswer:"))],
        "tone_shift": [p, F.concat(F.lit("Formally speaking, "), p), F.concat(F.lit("Hey, "), F.lower(p))],
        "detail_expansion": [p, F.concat(p, F.lit(" Please provide a detailed explanation.")), F.concat(p, F.lit(" Be comprehensive in your response."))],
        "emphasis_change": [p, F.concat(F.lit("IMPORTANT: "), p), F.concat(p, F.lit(" (This is critical)"))],
    }
    several = p.rlike(marks)
    made = [F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("index"), v[i % 3].alias("prompt")) for kind, v in variants.items() for i in indexes]
    for kind, changed in (("detail_reduction", F.concat(first, F.lit("."))), ("order_change", turned)):
        made += [F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("index"), (F.when(several, changed).otherwise(p) if i == 0 else p).alias("prompt")) for i in indexes]
    return prompts.select("id", F.inline(F.array(*made)))
