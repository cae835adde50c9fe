"""Scalar text functions as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega", "τ": "tau", "σ": "sigma"}
STOPWORDS = ("the", "and", "for", "with", "who", "what", "where", "which", "whose", "that", "this", "did", "does", "was", "were", "are", "has", "have", "had", "into", "from", "over", "under", "about", "located")
PRONOUNS = ("it", "its", "they", "them", "their", "this", "that", "these", "those", "we", "our", "he", "she", "his", "her")
GENERIC_WORDS = ("approach", "method", "system", "technique", "model", "information", "results", "study", "findings", "data", "analysis", "set of rules", "relationship", "association", "support", "community", "change", "journey", "experience", "voice", "values", "challenges", "understanding")
GENERIC_LEADS = ("our ", "this ", "that ", "these ", "those ", "a set of ", "the ", "a ", "an ")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
TAXONOMIC = ("HYPONYM_OF", "SUBTYPE_OF", "TYPE_OF", "INSTANCE_OF", "PART_OF", "IS_PART_OF", "COMPONENT_OF")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"


def each(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def squeeze(text: Column) -> Column:
    return F.trim(each(text, r"\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case without marks, white space collapsed."""
    return each(each(F.trim(F.lower(text)), r"(?U)[^\w\s]"), r"\s+", " ")


def normalize_name(name: Column) -> Column:
    """Entity name for matching: Greek letters spelled out, hyphens and underscores as spaces."""
    out = F.lower(F.trim(name))
    for letter, word in GREEK.items():
        out = F.replace(out, F.lit(letter), F.lit(f" {word} "))
    return squeeze(each(out, "[-_]+", " "))


def matching_key(name: Column) -> Column:
    """Letters and digits only."""
    out = F.lower(F.trim(name))
    for letter, word in GREEK.items():
        out = F.replace(out, F.lit(letter), F.lit(word))
    return each(out, "[^a-z0-9]")


def terms(text: Column) -> Column:
    """Distinct tokens of three characters or more that are no stopwords."""
    found = F.regexp_extract_all(F.lower(F.replace(text, F.lit("_"), F.lit(" "))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS)))


def trigrams(text: Column) -> Column:
    """Distinct padded character trigrams."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def normalize_answer(text: Column) -> Column:
    out = each(F.lower(F.coalesce(text, F.lit(""))), PUNCT_CLASS)
    return squeeze(each(out, r"(?U)\b(a|an|the)\b", " "))


def normalize_spaced(text: Column) -> Column:
    """Underscores and punctuation as spaces."""
    return squeeze(each(F.lower(text), PUNCT_CLASS, " "))


def trim_marks(text: Column) -> Column:
    """Lower case, collapsed, without marks at either end."""
    marks = r"[.,;:!?()\[\]{}\"']+"
    return each(squeeze(F.lower(text)), f"^{marks}|{marks}$")


def surface(text: Column) -> Column:
    return squeeze(each(F.lower(text), "[_-]", " "))


def quote(text: Column) -> Column:
    return squeeze(F.lower(text))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def slug(text: Column) -> Column:
    return each(each(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$")


def value_type(text: Column) -> Column:
    """DATE, NUMBER, QUANTITY or null, by shape."""
    s = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("_"), F.lit(" "))
    month = F.arrays_overlap(F.split(s, r"\s+"), F.array(*map(F.lit, MONTHS)))
    return (
        F.when((s == "") | (F.length(s) > 40), F.lit(None))
        .when(month & s.rlike(r"\d"), "DATE")
        .when(s.rlike(r"^(1[0-9]{3}|20[0-9]{2})(\s*[-/]?\s*\d{2,4})?$"), "DATE")
        .when(s.rlike(r"^\d[\d,.]*$"), "NUMBER")
        .when(s.rlike(r"^\d[\d,.]*\s?%?\s*[a-z]{1,15}$"), "QUANTITY")
    )


def generic_reference(name: Column) -> Column:
    low = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    rest = F.when(low.contains(" "), F.expr("1")).isNotNull()
    after = F.when(rest, F.regexp_extract(low, r"^\S* (.*)$", 1)).otherwise(F.lit(""))
    leads = low.rlike("^(" + "|".join(GENERIC_LEADS) + ")")
    begins = after.rlike("^(" + "|".join(GENERIC_WORDS) + ")")
    return (low == "") | low.isin(*PRONOUNS, *GENERIC_WORDS) | (leads & begins)


def digit_runs(text: Column) -> Column:
    """Digit runs, thousands separators removed."""
    joined = each(F.coalesce(text, F.lit("")), r"(?<=\d)[,.](?=\d{3}(?:\D|$))")
    return F.regexp_extract_all(joined, F.lit(r"\d+"), 0)


def literal_conflict(a: Column, b: Column) -> Column:
    x, y = digit_runs(a), digit_runs(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def contains_words(longer: Column, shorter: Column) -> Column:
    """Whole-word containment in space-separated text."""
    return F.contains(F.concat(F.lit(" "), longer, F.lit(" ")), F.concat(F.lit(" "), shorter, F.lit(" ")))


def degenerate_pair(subject: Column, obj: Column, relation: Column, blank: bool = False) -> Column:
    """Equal surfaces, or one of two words or more inside the other unless the relation is taxonomic."""
    s, o = surface(F.coalesce(subject, F.lit(""))), surface(F.coalesce(obj, F.lit("")))
    n_s, n_o = F.size(F.split(s, " ")), F.size(F.split(o, " "))
    shorter, longer = F.when(n_s <= n_o, s).otherwise(o), F.when(n_s <= n_o, o).otherwise(s)
    taxonomic = F.upper(each(F.coalesce(relation, F.lit("")), "[- ]", "_")).isin(*TAXONOMIC)
    inside = (F.size(F.split(shorter, " ")) >= 2) & ~taxonomic & contains_words(longer, shorter)
    return F.when((s == "") | (o == ""), F.lit(blank)).otherwise((s == o) | inside)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two token lists, repeats counted."""
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda total, x: total + F.least(count(a, x), count(b, x)))


def token_f1(prediction: Column, gold: Column) -> Column:
    p, g = tokens(normalize_answer(prediction)), tokens(normalize_answer(gold))
    same = multiset_overlap(p, g)
    f1 = 2.0 * same / (F.size(p) + F.size(g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0) | (same == 0), 0.0).otherwise(f1)


def exact_match(prediction: Column, gold: Column) -> Column:
    return F.when(normalize_answer(prediction) == normalize_answer(gold), 1.0).otherwise(0.0)


def clean_prediction(prediction: Column, gold: Column) -> Column:
    text = F.trim(each(F.trim(each(F.trim(F.coalesce(prediction, F.lit(""))), r"\[Data:[^\]]+\]")), r"\[[0-9,\s]+\]"))
    low, wanted = F.lower(text), normalize_answer(gold)
    cut = F.trim(each(text, r"(?i)^(the answer is|answer:|short answer:|final answer:)"))
    plain = each(each(each(cut, '^"+|"+$'), "^'+|'+$"), r"\.+$")
    yes_no = wanted.isin("yes", "no")
    return F.when(yes_no & low.startswith("yes"), "yes").when(yes_no & low.startswith("no"), "no").otherwise(plain)


def verbalize(subject: Column, relation: Column, obj: Column) -> Column:
    return F.concat_ws(" ", *(F.when(c != "", F.replace(c, F.lit("_"), F.lit(" "))) for c in (subject, relation, obj)))


def uid(subject: Column, relation: Column, obj: Column) -> Column:
    return F.concat_ws("|", subject, relation, obj)


def evidence_confidence(base: Column, kind: Column, strength: Column, reference: Column, contradictions: Column) -> Column:
    """Weighted mean of extraction, type and strength of evidence, adjusted and clamped."""
    by_kind = F.when(kind == "explicit", 0.95).when(kind == "implicit", 0.75).otherwise(0.55)
    adjust = F.when(reference == "supported", 0.10).when(reference == "contradicted", -0.20).when(reference == "refined", 0.05).otherwise(0.0)
    total = 0.4 * F.coalesce(base, F.lit(0.7)) + 0.3 * by_kind + 0.3 * F.coalesce(strength, F.lit(0.7)) + adjust
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total - 0.05 * F.least(F.coalesce(contradictions, F.lit(0)), F.lit(3))))


def coerced_confidence(raw: Column, default: float = 0.5) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(raw.try_cast("double"), F.lit(default))))


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def clean_text(text: Column) -> Column:
    """Composed characters, white space collapsed, control characters dropped."""
    composed = F.pandas_udf(_composed, "string")(text)
    return F.trim(each(each(composed, r"\s+", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of normalized names; for blocked candidates only."""
    return normal_ratio(normalize(a), normalize(b))


def normal_ratio(a: Column, b: Column) -> Column:
    """The same of names that are normalized already."""
    return F.pandas_udf(_ratio, "double")(a, b)
