"""Text measures and predicates as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Discourse markers by class.
MARKERS = {
    "contrast": ("however", "but", "although", "though", "nevertheless", "nonetheless", "on the other hand", "in contrast", "conversely", "yet", "still"),
    "addition": ("furthermore", "moreover", "additionally", "also", "besides", "in addition", "as well", "similarly", "likewise"),
    "causation": ("therefore", "thus", "consequently", "as a result", "hence", "accordingly", "because", "since", "so"),
    "example": ("for example", "for instance", "such as", "specifically", "namely", "to illustrate"),
    "temporal": ("then", "next", "finally", "first", "second", "third", "subsequently", "afterward", "meanwhile"),
    "conclusion": ("in conclusion", "to sum up", "to summarize", "in summary", "overall", "ultimately"),
}


def words_by_space(text: Column) -> Column:
    """Non-empty runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def normalized(text: Column) -> Column:
    """Trimmed, lower-cased, white space runs made one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def syllables(word: Column) -> Column:
    """Vowel groups (y is one), less a final e, plus a consonant with le; at least one."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = F.when((groups > 1) & w.endswith("e"), 1).otherwise(0)
    extra = F.when(w.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.greatest(groups - silent + extra, F.lit(1))


#: Letters that are no vowels; where a word of letters with apostrophes inside begins, and where it ends.
CONSONANT = "[b-df-hj-np-tv-xz]"
BEGINS, ENDS = "(?<![a-z])(?<![a-z]')", "(?![a-z]|'[a-z])"


def syllable_total(text: Column) -> Column:
    """``syllables`` of all words of a text, summed without taking it apart: its vowel groups, less the words that end
    in e and have another group, plus those that end in le after no vowel, plus those that have no group."""
    count = lambda pattern: F.regexp_count(text, F.lit(f"(?i){pattern}"))
    inner = f"(?:{CONSONANT}|'(?=[a-z]))"
    silent = count(f"e{ENDS}") - count(f"{BEGINS}{inner}*+[aeiouy]*e{ENDS}")
    extra = count(f"(?:{CONSONANT}|(?<=[a-z])')le{ENDS}")
    return count("[aeiouy]+") - silent + extra + count(f"{BEGINS}{CONSONANT}{inner}*+{ENDS}")


def letter_words(text: Column) -> Column:
    """Runs of letters, with apostrophes inside."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z]+(?:'[A-Za-z]+)*)"), F.lit(1))


def sentences(text: Column) -> Column:
    """Cut after . ! ? where white space and a capital follow; empty ones dropped."""
    parts = F.split(F.trim(F.regexp_replace(text, r"([.!?])\s+(?=[A-Z])", "$1\u0001")), "\u0001")
    return F.filter(parts, lambda s: F.trim(s) != "")


def word_count(text: Column) -> Column:
    """Words by an approximation of Unicode's word boundaries: letters and digits, joined by ' or ."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+(?:['’.][\p{L}\p{N}]+)*"))


def flesch_ease(words: Column, sents: Column, syl: Column) -> Column:
    return F.when((words == 0) | (sents == 0), 0.0).otherwise(206.835 - 1.015 * words / sents - 84.6 * syl / words)


def flesch_kincaid(words: Column, sents: Column, syl: Column) -> Column:
    return F.when((words == 0) | (sents == 0), 0.0).otherwise(0.39 * words / sents + 11.8 * syl / words - 15.59)


def any_of(phrases: Iterable[str]) -> str:
    """A pattern of where one of some phrases begins, as whole words, sorted by their first letters so that most words are left
    at once. It takes up nothing, so phrases that share a word all count."""
    by: dict[str, list[str]] = {}
    for p in phrases:
        by.setdefault(p[0], []).append(p[1:])
    rest = "|".join(f"{first}(?:{'|'.join(found)})" for first, found in by.items())
    return rf"(?=[{''.join(by)}])\b(?=(?:{rest})\b)"


def marker_counts(text: Column) -> dict[str, Column]:
    """Markers by class. No marker begins as a whole other one, so where one begins it is one."""
    low = F.lower(text)
    return {kind: F.regexp_count(low, F.lit(any_of(found))) for kind, found in MARKERS.items()}


def marker_count(text: Column) -> Column:
    """Markers of all classes, in one pass."""
    return F.regexp_count(F.lower(text), F.lit(any_of(m for found in MARKERS.values() for m in found)))


def token_estimate_bytes(text: Column) -> Column:
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(1))


def token_estimate_chars(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4)


def token_estimate_words(text: Column) -> Column:
    return F.ceil(F.size(words_by_space(text)) * 1.3)


#: Task types and the words that mark them, tried in this order.
TASKS = (
    ("coding", ("code", "function", "implement", "debug")),
    ("summarization", ("summarize", "summary", "tldr")),
    ("translation", ("translate", "translation")),
    ("classification", ("classify", "categorize", "label")),
    ("creative", ("story", "poem", "creative", "imagine")),
    ("reasoning", ("reason", "solve", "calculate", "analyze")),
    ("question_answering", ("what", "how", "why", "?")),
)


def task_type(prompt: Column) -> Column:
    low = F.lower(prompt)
    out = F.lit("general")
    for kind, marks in reversed(TASKS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m))
        out = F.when(hit, kind).otherwise(out)
    return out


def failure_mode(message: Column, status: Column) -> Column:
    """What kind of failure a message and an HTTP status (null if none) stand for; the first that holds."""
    low = F.lower(F.coalesce(message, F.lit("")))
    says = lambda *parts: low.rlike("|".join(parts))
    # fixed values: the words and statuses, and their order
    code = F.coalesce(status, F.lit(0))
    return (
        F.when(says("timeout", "aborted"), "timeout")
        .when((code == 429) | says("rate limit"), "rate_limited")
        .when((code == 400) & says("context", "token"), "context_exceeded")
        .when(code.isin(401, 403), "authentication_error")
        .when(code >= 500, "server_error")
        .when(says("network", "connect"), "connection_error")
        .when(says("filter", "blocked", "safety"), "content_filtered")
        .when(says("invalid", "malformed"), "invalid_response")
        .otherwise("unknown")
    )


def render(template: Column, variables: Column) -> Column:
    """Each {{name}} replaced by its value, name by name."""
    return F.aggregate(F.map_entries(variables), template, lambda t, v: F.replace(t, F.concat(F.lit("{{"), v["key"], F.lit("}}")), v["value"]))


def placeholders(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))
