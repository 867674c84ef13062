"""Text functions, all as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of the retrieval tokenizer, the lead words of a question, the affixes of
# biomedical terms, the labels of an answer in their order, and the prompt.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
LEAD_WORDS = "what who how why when where is are does do can should".split()
MEDICAL_AFFIXES = "mab tinib vir olol azepam azole statin cycline itis osis emia oma pathy cardio neuro hepato renal gastro pulmonary".split()
ANSWERS = ("yes", "no", "maybe")
PROMPT = (
    "You are a biomedical question-answering assistant.\nAnswer with one of: yes, no, maybe.\n"
    "Question: {q}\nEvidence:\n{ctx}\nFinal answer:"
)
NO_EVIDENCE = "(no retrieved evidence)"


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def prep_text(title: str, text: str) -> Column:
    """Title and text in one, null as empty."""
    return strip(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))))


def word_tokens(c: Column) -> Column:
    """The analysis tokenizer: ASCII words of two characters or more that start with a letter; repeats stay."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9\-]+"), F.lit(0)), F.lower)


def retrieval_tokens(c: Column) -> Column:
    """The retrieval tokenizer: lower-case words of two characters or more, without stop words, not stemmed."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def is_question(c: Column) -> Column:
    return c.rlike(rf"(?i)^\s*({'|'.join(LEAD_WORDS)})\b").cast("int")


def medical_share(tokens: Column) -> Column:
    """The share of tokens that contain a biomedical affix; 0 without tokens."""
    hits = F.size(F.filter(tokens, lambda t: t.rlike("|".join(MEDICAL_AFFIXES))))
    return F.when(F.size(tokens) > 0, hits / F.size(tokens)).otherwise(F.lit(0.0))


def normalise_answer(c: Column) -> Column:
    """The first label in the order yes, no, maybe that the text holds as a word, else unknown."""
    low = F.lower(strip(c))
    out = F.lit("unknown")
    for label in reversed(ANSWERS):
        out = F.when(low.rlike(rf"\b{label}\b"), F.lit(label)).otherwise(out)
    return out


def format_prompt(question: Column, passages: Column) -> Column:
    lines = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")
    evidence = F.when(F.coalesce(lines, F.lit("")) == "", F.lit(NO_EVIDENCE)).otherwise(lines)
    head, middle, tail = PROMPT.split("{q}")[0], *PROMPT.split("{q}")[1].split("{ctx}")
    return F.concat(F.lit(head), question, F.lit(middle), evidence, F.lit(tail))


def hoeffding_n(gap: Column, confidence: float = 0.95) -> Column:
    """Queries needed for a gap in a score between 0 and 1 to be outside the Hoeffding bound."""
    needed = F.ceil(F.log(F.lit(2.0) / F.lit(1.0 - confidence)) / (F.lit(2.0) * gap * gap))
    return F.when(F.abs(gap) < 1e-12, F.lit(10**9)).otherwise(needed).cast("bigint")


def string_list(c: Column) -> Column:
    """A list written as text: as JSON, else with single quotes, else empty; its members as strings."""
    as_json = F.from_json(c, "array<string>")
    return F.coalesce(as_json, F.from_json(F.translate(c, "'", '"'), "array<string>"), F.array().cast("array<string>"))
