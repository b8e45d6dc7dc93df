"""Synthetic items of ten types of content, and adversarial prompts out of a library of templates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.functions.running import running_sum
from verdigris.operators.generation import uniform

LEVELS = ("easy", "medium", "hard")
SEVERITIES = ("low", "medium", "high", "critical")
#: What items are made of, by type and difficulty; ``{n}`` is the item's number from 1.
ITEMS: dict[str, dict[str, list[dict]]] = {
    "text_prompt": {
        "easy": [{"prompt": "[Variant {n}] Say in one sentence what a kettle is for.", "instruction_type": "simple", "expected_response_length": "short"}, {"prompt": "[Variant {n}] Name three things that float.", "instruction_type": "simple", "expected_response_length": "short"}],
        "medium": [{"prompt": "[Variant {n}] Explain how a lock lets a boat change level.", "instruction_type": "moderate", "expected_response_length": "medium"}],
        "hard": [{"prompt": "[Variant {n}] Weigh two ways of keeping replicas of a ledger in step.", "instruction_type": "complex", "expected_response_length": "long"}],
    },
    "qa_pair": {
        "easy": [{"question": "[Q{n}] How many sides has a hexagon?", "answer": "Six", "category": "general_knowledge"}, {"question": "[Q{n}] Which month follows May?", "answer": "June", "category": "general_knowledge"}],
        "medium": [{"question": "[Q{n}] Which gas do leaves take in by day?", "answer": "Carbon dioxide", "category": "general_knowledge"}],
        "hard": [{"question": "[Q{n}] Why can no comparison sort beat n log n?", "answer": "A decision tree with n! leaves has that depth.", "category": "general_knowledge"}],
    },
    "multi_turn_conversation": {
        "easy": [{"conversation_id": "conv_{n}", "topic": "daily life", "turns": [{"role": "user", "content": "Is it raining?"}, {"role": "assistant", "content": "I can't see outside; is your window wet?"}], "turn_count": 2}],
        "medium": [{"conversation_id": "conv_{n}", "topic": "science", "turns": [{"role": "user", "content": "What makes tides?"}, {"role": "assistant", "content": "Mostly the moon's pull."}, {"role": "user", "content": "And the sun?"}, {"role": "assistant", "content": "It adds to it or takes from it."}], "turn_count": 4}],
        "hard": [{"conversation_id": "conv_{n}", "topic": "technology", "turns": [{"role": "user", "content": "When is eventual consistency enough?"}, {"role": "assistant", "content": "When readers can bear to be late."}], "turn_count": 2}],
    },
    "coding_task": {
        "easy": [{"task_id": "code_{n}", "title": "Largest of three", "description": "Return the largest of three numbers.", "function_signature": "largest(a, b, c)", "test_cases": [{"input": "1, 5, 3", "output": "5"}], "category": "algorithm"}],
        "medium": [{"task_id": "code_{n}", "title": "Balanced brackets", "description": "Say whether brackets in a text close in order.", "function_signature": "balanced(text)", "test_cases": [{"input": "([])", "output": "true"}, {"input": "([)]", "output": "false"}], "category": "algorithm"}],
        "hard": [{"task_id": "code_{n}", "title": "Shortest cover", "description": "Find the shortest window of a text with all letters of another.", "function_signature": "cover(text, letters)", "test_cases": [{"input": "abcba, ca", "output": "cba"}], "category": "algorithm"}],
    },
    "summarization": {
        "easy": [{"document_id": "doc_{n}", "document": "[Document {n}] The ferry runs twice a day. In winter it runs once.", "reference_summary": "A ferry that runs less in winter.", "word_count": 12}],
        "medium": [{"document_id": "doc_{n}", "document": "[Document {n}] The mill ground corn for a century, then wool; since the flood it stands still, and the town argues about its roof.", "reference_summary": "An old mill, idle since a flood, is disputed.", "word_count": 23}],
        "hard": [{"document_id": "doc_{n}", "document": "[Document {n}] Two surveys disagree: one counted nests, the other birds; where nests fail late, both are right.", "reference_summary": "Two counts differ as they count different things.", "word_count": 17}],
    },
    "creative_writing": {
        "easy": [{"prompt_id": "creative_{n}", "prompt": "Write about a door that sticks.", "genre": "story", "tone": "creative", "min_words": 50}],
        "medium": [{"prompt_id": "creative_{n}", "prompt": "Write a letter that was never sent.", "genre": "letter", "tone": "creative", "min_words": 150}],
        "hard": [{"prompt_id": "creative_{n}", "prompt": "Tell one evening from two sides that never meet.", "genre": "story", "tone": "creative", "min_words": 300}],
    },
    "classification": {
        "easy": [{"sample_id": "class_{n}", "text": "[Sample {n}] I love this lamp.", "label": "positive", "confidence": 0.9}, {"sample_id": "class_{n}", "text": "[Sample {n}] The lamp broke at once.", "label": "negative", "confidence": 0.9}],
        "medium": [{"sample_id": "class_{n}", "text": "[Sample {n}] It works, though I'd hoped for more.", "label": "neutral", "confidence": 0.8}],
        "hard": [{"sample_id": "class_{n}", "text": "[Sample {n}] Splendid: a third replacement in a month.", "label": "negative", "confidence": 0.7}],
    },
    "entity_extraction": {
        "easy": [{"sample_id": "entity_{n}", "text": "Ada met Grace in Turin.", "entities": [{"text": "Ada", "type": "PERSON"}, {"text": "Grace", "type": "PERSON"}, {"text": "Turin", "type": "LOCATION"}]}],
        "medium": [{"sample_id": "entity_{n}", "text": "On 3 May the Harbour Trust sold the pier.", "entities": [{"text": "3 May", "type": "DATE"}, {"text": "Harbour Trust", "type": "ORGANIZATION"}]}],
        "hard": [{"sample_id": "entity_{n}", "text": "May, of May & Sons, left Lincoln for Lincoln Street.", "entities": [{"text": "May", "type": "PERSON"}, {"text": "May & Sons", "type": "ORGANIZATION"}, {"text": "Lincoln", "type": "LOCATION"}]}],
    },
    "translation": {
        "easy": [{"translation_id": "trans_{n}", "source_text": "Good morning", "target_text": "Buenos días", "source_language": "en", "target_language": "es"}],
        "medium": [{"translation_id": "trans_{n}", "source_text": "The train is late again.", "target_text": "Le train est encore en retard.", "source_language": "en", "target_language": "fr"}],
        "hard": [{"translation_id": "trans_{n}", "source_text": "He let the matter rest.", "target_text": "Er ließ die Sache auf sich beruhen.", "source_language": "en", "target_language": "de"}],
    },
    "reasoning_chain": {
        "easy": [{"chain_id": "chain_{n}", "question": "Three bags hold four apples each. How many apples?", "steps": ["Each bag holds 4.", "3 times 4 is 12."], "answer": "12"}],
        "medium": [{"chain_id": "chain_{n}", "question": "A walk of 6 km takes 90 minutes. How fast is it?", "steps": ["90 minutes are 1.5 hours.", "6 over 1.5 is 4."], "answer": "4 km/h"}],
        "hard": [{"chain_id": "chain_{n}", "question": "All brass is metal; no metal here floats. Does brass here float?", "steps": ["Brass is metal.", "Metal here doesn't float."], "answer": "No"}],
    },
}


def library(kind: str) -> dict[str, list[str]]:
    if kind not in ITEMS:
        raise ValueError(f"unknown type of content: {kind}")
    return {level: [json.dumps(item | {"difficulty": level}, ensure_ascii=False) for item in ITEMS[kind][level]] for level in LEVELS}


def content(kind: str, difficulty: Column, number: Column, draw: Column | None = None) -> Column:
    """An item as JSON: one of its type and difficulty, drawn by ``draw`` (from 0 up to 1), or else in turn."""
    out = F.lit(None).cast("string")
    for level, items in library(kind).items():
        at = F.pmod(number, F.lit(len(items))) if draw is None else F.floor(draw * len(items))
        out = F.when(difficulty == level, F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))).otherwise(out)
    return F.replace(out, F.lit("{n}"), (number + 1).cast("string"))


def drawn(cases: DataFrame, kind: str, seed: int) -> DataFrame:
    """Cases (id, difficulty) with drawn content."""
    return cases.withColumn("content", content(kind, F.col("difficulty"), F.col("id"), uniform(seed, "id")))


#: What a severity adds to a prompt's complexity; signs that are neither letters, digits, _ nor white space.
COMPLEXITY = {"low": 0.1, "medium": 0.2, "high": 0.25, "critical": 0.3}
SIGN = r"[^a-zA-Z0-9_\s]"


def complexity(text: Column, severity: Column) -> Column:
    n = F.char_length(text)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in COMPLEXITY.items() for x in kv]), severity)
    return F.least(F.lit(1.0), F.least(F.lit(0.3), n / 5000) + F.least(F.lit(0.2), F.regexp_count(text, F.lit(SIGN)) / F.greatest(n, F.lit(1))) + weight)


def adversarial(templates: DataFrame, categories: list[str], severities: list[str], per_category: int, most: int) -> DataFrame:
    """(place, category, severity, template_id, text, attack_vector, tokens, complexity): of templates (template_id, category,
    severity, text, attack_vector) the first ``per_category`` of each category and severity, in the order these are asked for; of
    equal texts the first; ``most`` in all, which is the caller's cap on a run."""
    rank = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    asked = templates.withColumns({"_c": rank(categories, "category"), "_s": rank(severities, "severity")}).where("_c > 0 AND _s > 0")
    first = asked.withColumn("_k", F.row_number().over(Window.partitionBy("category", "severity").orderBy("template_id"))).where(F.col("_k") <= per_category)
    first = first.withColumn("_order", (F.col("_c") * len(severities) + F.col("_s")) * per_category + F.col("_k"))
    kept = first.join(first.groupBy(F.xxhash64("text").alias("_h"), F.col("text").alias("_t")).agg(F.min("_order").alias("_order")).select("_order"), "_order")
    placed = running_sum(kept, "_order", F.lit(1), "place").where(F.col("place") <= most)
    return placed.select("place", "category", "severity", "template_id", "text", "attack_vector", X.token_estimate_chars(F.col("text")).alias("tokens"), F.round(complexity(F.col("text"), F.col("severity")), 6).alias("complexity"))


def category_summaries(prompts: DataFrame) -> DataFrame:
    """Per category: prompts, how many of each severity, mean complexity and tokens."""
    return prompts.groupBy("category").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.round(F.avg("complexity"), 6).alias("avg_complexity"), F.round(F.avg("tokens"), 6).alias("avg_tokens"))


def generation_metrics(prompts: DataFrame, generated: int, categories: list[str]) -> DataFrame:
    """One row: prompts kept, filtered out of ``generated``, diversity (attack vectors over half the prompts, 1 at most), the
    share of the categories asked for that have a prompt, and the shares of severities."""
    n = F.count("*")
    share = lambda c: F.round(c / F.greatest(n, F.lit(1)), 6)
    covered = F.count_distinct(F.when(F.col("category").isin(*categories), F.col("category")))
    return prompts.agg(
        n.alias("total"), (F.lit(generated) - n).alias("filtered"), F.round(F.when(n > 0, F.least(F.lit(1.0), F.count_distinct("attack_vector") / F.greatest(n / 2, F.lit(1.0)))).otherwise(0.0), 6).alias("diversity"),
        F.round(covered / max(1, len(categories)), 6).alias("coverage"), *[share(F.count_if(F.col("severity") == s)).alias(s) for s in SEVERITIES],
    )
