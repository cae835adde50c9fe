"""Functions on answers, values and replies of models; null in, null out unless said otherwise."""

from __future__ import annotations

import ast
import json
import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Fixed values.
ABSTAIN_CUES = (" no ", " not ", "does not", "do not", "cannot", "can't", "not contain", "no evidence", "not directly support", "unknown")
ABSTAIN_MARKERS = ("no information available", "not mentioned", "enough supported evidence", "do not have enough", "don't have enough", "cannot answer", "can't answer", "no information", "not enough information", "insufficient", "not in the conversation", "wasn't mentioned", "was not mentioned")
SUBJECT_TYPES = ("person", "human", "organization", "organisation", "company", "institution", "place", "location", "facility", "venue", "building", "work", "film", "album", "book", "event")
VALUE_PATTERNS = (
    (r"\b(?:born|died|opened|founded|released|launched|established)\s+(?:on\s+)?(?:\d{1,2}\s+[A-Z][a-z]+\s+\d{4}|[A-Z][a-z]+\s+\d{1,2},\s+\d{4}|\d{4})\b", "Date"),
    (r"\bfrom\s+(?:18|19|20)\d{2}\s+to\s+(?:18|19|20)\d{2}\b", "DateRange"),
    (r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+(?:18|19|20)\d{2}\b", "Date"),
    (r"\b\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+(?:18|19|20)\d{2}\b", "Date"),
    (r"\b(?:18|19|20)\d{2}\b", "Year"),
    (r"\b\d{1,3}(?:,\d{3})+(?:\s+(?:seated|seats|people|inhabitants|spectators|capacity))?\b", "Quantity"),
    (r"\b\d{1,3}(?:\.\d+)?\s*(?:km|mi|miles|kilometers|metres|meters|kg|lb|tons|million|billion|percent|%)\b", "Quantity"),
    (r"\b[A-Z][A-Za-z]+(?:\s+(?:of|the|and|for|in|on|at|de|van|von|[A-Z][A-Za-z]+)){1,6}(?:,\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*)?\b", "NamedEntity"),
)
LEADING_VERB = r"(?i)^(born|died|opened|founded|released|launched|established)\s+(on\s+)?"
HARVESTED, NO_SURFACES, CONTEXT_CHARS = 0.72, ("title", "return only", "json object"), 180
BOILERPLATE = (
    r"\((?:global_expert|[a-z_]+_expert)\)",
    r"\[(?:global_expert|[a-z_]+)\]",
    r"(?i)^Based on the (?:available|provided )?knowledge graph,\s*",
    r"(?i)^According to the (?:available|provided )?knowledge graph,\s*",
    r"(?i)^The (?:available )?knowledge graph (?:shows|indicates|suggests) that\s*",
    r"(?i)^The graph (?:shows|indicates|suggests) that\s*",
)


def support_text(text: Column) -> Column:
    """For support checks: punctuation and articles as spaces; null is empty."""
    return T.squeeze(T.each(T.each(F.lower(F.coalesce(text, F.lit(""))), T.PUNCT_CLASS, " "), r"(?U)\b(a|an|the)\b", " "))


def word_text(text: Column) -> Column:
    """Articles first, then everything but word characters, as spaces."""
    return T.squeeze(T.each(T.each(F.trim(F.lower(text)), r"(?U)\b(a|an|the)\b", " "), r"(?U)[^\w\s]", " "))


def _decomposed(text: str) -> str:
    text = unicodedata.normalize("NFD", text).replace(",", "").lower()
    text = re.sub(r"\b(a|an|the|and)\b", " ", text)
    return " ".join(text.translate(str.maketrans("", "", string.punctuation)).split())


def decomposed_text(text: Column) -> Column:
    """Decomposed characters, no commas, no articles or "and", no ASCII punctuation."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else _decomposed(t)), "string")(text)


def _spans(name: str, text: str) -> list[tuple[int, int]]:
    """Where the name stands in the text as whole words."""
    found, lo = [], text.find(name)
    while lo >= 0:
        hi = lo + len(name)
        if not (lo and (text[lo - 1] + name[0]).isalnum()) and not (hi < len(text) and (name[-1] + text[hi]).isalnum()):
            found.append((lo, hi))
        lo = text.find(name, lo + 1)
    return found


def values_in(docs: DataFrame, key: str = "doc_id", name: str | None = None) -> DataFrame:
    """key, text, type, confidence, context: values and names in each text, each surface once, by the first pattern that finds it.

    ``name``: a column with what the text is about.  A match within that name is no value: "Order 1995" has no year.
    """
    patterns = [(re.compile(p), kind) for p, kind in VALUE_PATTERNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for own, text, named in zip(rows["key"], rows["text"], rows["named"], strict=True):
                seen = {""}
                names = _spans(named, text) if named and text else []
                for pattern, kind in patterns:
                    for met in pattern.finditer(text or ""):
                        if any(lo <= met.start() and met.end() <= hi for lo, hi in names):
                            continue
                        surface = met.group(0).strip()
                        same = re.sub(r"[^a-z0-9]+", " ", surface.lower()).strip()
                        if len(surface) < 3 or surface.lower() in NO_SURFACES or same in seen:
                            continue
                        seen.add(same)
                        shown = re.sub(LEADING_VERB, "", surface).strip() if kind == "Date" else surface
                        out.append((own, shown, kind, HARVESTED, text[max(0, met.start() - CONTEXT_CHARS) : met.end() + CONTEXT_CHARS].strip()))
            yield pd.DataFrame(out, columns=["key", "text", "type", "confidence", "context"])

    kind = docs.schema[key].dataType.simpleString()
    named = (F.col(name) if name else F.lit(None)).cast("string").alias("named")
    return docs.select(F.col(key).alias("key"), "text", named).mapInPandas(run, f"key {kind}, text string, type string, confidence double, context string").withColumnRenamed("key", key)


def value_relation(kind: Column, context: Column) -> Column:
    """Relation of a value to its subject, by the value's type and what stands around it."""
    low, near = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(context, F.lit("")))
    return (
        F.when(low == "year", "HAS_YEAR")
        .when(low.isin("daterange", "date"), "HAS_TIMEFRAME")
        .when((low == "quantity") & near.rlike("capacity|seat"), "HAS_CAPACITY")
        .when(low == "quantity", "HAS_QUANTITY")
        .when(low.isin("role", "office"), "HELD_POSITION")
        .when(low == "nationality", "HAS_NATIONALITY")
        .when(low == "location", "LOCATED_IN")
        .otherwise("HAS_ATTRIBUTE")
    )


def attribute_relation(kind: Column, evidence: Column) -> Column:
    """Relation of a typed attribute: professions and birth dates have their own."""
    low, near = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(evidence, F.lit("")))
    return (
        F.when(low.isin("role", "profession", "occupation"), "EXERCISES_PROFESSIONAL_ROLE")
        .when(low.isin("office", "title"), "HELD_POSITION")
        .when(low.isin("date", "daterange") & near.contains("born"), "BORN_ON_DATE")
        .otherwise(value_relation(kind, evidence))
    )


def named_subject(kind: Column, surfaces: Column) -> Column:
    """Whether an entity may own facts: by its type, or a surface with two capitalized tokens or a single one of three letters."""
    words = lambda s: F.regexp_extract_all(s, F.lit(r"[A-Za-z][A-Za-z0-9'.\-]*"), F.lit(0))
    high = lambda s: F.size(F.filter(words(s), lambda w: F.substring(w, 1, 1).rlike("[A-Z]")))
    shaped = F.exists(surfaces, lambda s: (high(s) >= 2) | ((high(s) == 1) & (F.size(words(s)) == 1) & (F.length(words(s)[0]) >= 3)))
    return F.lower(F.coalesce(kind, F.lit(""))).rlike("|".join(SUBJECT_TYPES)) | F.coalesce(shaped, F.lit(False))


def plain_answer(answer: Column) -> Column:
    """Without marks of agents and introductory phrases; null is empty."""
    out = F.coalesce(answer, F.lit(""))
    for pattern in BOILERPLATE:
        out = T.each(out, pattern)
    return T.squeeze(out)


def expanded_evidence(evidence: Column, context: Column) -> Column:
    """Evidence with ellipses, from its first to its last fragment in the context; the whole context where one is missing."""
    said, around = F.trim(F.coalesce(evidence, F.lit(""))), F.trim(F.coalesce(context, F.lit("")))
    parts = F.filter(F.transform(F.split(said, r"\.\.\."), lambda p: F.trim(p)), lambda p: p != "")
    at = lambda p: F.instr(F.lower(around), F.lower(p))
    first = F.array_min(F.transform(parts, at))
    last = F.array_max(F.transform(parts, lambda p: at(p) + F.length(p)))
    return (
        F.when(said == "", around)
        .when(~said.contains("..."), said)
        .when(around == "", F.trim(F.replace(said, F.lit("..."), F.lit(""))))
        .when((F.size(parts) == 0) | (first == 0), around)
        .otherwise(F.trim(F.substring(around, first, last - first)))
    )


def batch_size(max_output_tokens: Column, item_chars: Column, chars_per_token: float = 4.0, overhead: int = 500, margin: float = 0.7) -> Column:
    """Items that fit into a reply: between 1 and 50."""
    room = F.floor(max_output_tokens * F.lit(margin)) * F.lit(chars_per_token) - overhead
    return F.least(F.lit(50), F.greatest(F.lit(1), (room / item_chars).cast("int")))


def surface_variants(*surfaces: Column) -> Column:
    """Distinct surfaces that are not blank, in order; one empty surface if there is none."""
    found = F.array_distinct(F.filter(F.array(*surfaces), lambda s: s.isNotNull() & (s != "")))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def abstains(answer: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(answer, F.lit(""))), F.lit(" "))
    return F.array(*map(F.lit, ABSTAIN_CUES)).isNotNull() & F.exists(F.array(*map(F.lit, ABSTAIN_CUES)), lambda cue: F.contains(padded, cue))


def mentioned_share(labels: Column, answer: Column) -> Column:
    """Share of the labels whose normalized name is in the normalized answer; null without labels."""
    text = T.normalize_name(F.coalesce(answer, F.lit("")))
    names = F.filter(F.transform(labels, T.normalize_name), lambda n: n.isNotNull() & (n != ""))
    return F.try_divide(F.size(F.filter(names, lambda n: F.contains(text, n))).cast("double"), F.size(names).cast("double"))


def relation_similarity(a: Column, b: Column) -> Column:
    """1 for equal normalized names, 0 if one is blank, else the overlap of their tokens."""
    x, y = T.normalize_spaced(F.coalesce(a, F.lit(""))), T.normalize_spaced(F.coalesce(b, F.lit("")))
    tokens = lambda s: F.array_distinct(T.tokens(s))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(T.jaccard(tokens(x), tokens(y)))


def _f1(a: str, b: str) -> float:
    p, g = _decomposed(a).split(), _decomposed(b).split()
    same = sum((Counter(p) & Counter(g)).values())
    return 2 * same / (len(p) + len(g)) if same else 0.0


def category_score(prediction: Column, gold: Column, category: Column) -> Column:
    """Score by kind of question: 1 the mean over comma-separated answers of the best F1, 3 the first answer before a
    semicolon, 5 whether the prediction abstains, others plain F1.  Words are not stemmed."""

    def one(p: str, g: str, kind: int) -> float:
        p, g = p or "", g or ""
        if kind == 5:
            return float(any(marker in p.lower() for marker in ABSTAIN_MARKERS))
        if kind == 1:
            golds = g.split(",")
            return sum(max(_f1(x, y) for x in p.split(",")) for y in golds) / len(golds)
        return _f1(p, g.split(";")[0] if kind == 3 else g)

    return F.pandas_udf(lambda p, g, k: pd.Series([one(*x) for x in zip(p, g, k, strict=True)], dtype="float64"), "double")(prediction, gold, category)


def _repaired(reply: str) -> str | None:
    """The JSON value in a reply: thoughts and fences go, what a cut left open is closed."""
    reply = re.sub(r"(?s)<think>.*?(</think>|$)", "", reply)
    fenced = re.search(r"(?s)```(?:json)?\s*(.*?)(```|$)", reply)
    reply = fenced.group(1) if fenced else reply
    begin = min((i for i in (reply.find("{"), reply.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    reply = reply[begin:].strip()
    try:
        value, _ = json.JSONDecoder().raw_decode(reply)
        return json.dumps(value, ensure_ascii=False)
    except ValueError:
        pass
    # Every place where an element is complete, with the brackets open there; the last that can be closed counts.
    open_, quoted, escaped, complete = [], False, False, []
    for i, char in enumerate(reply):
        if quoted:
            escaped, quoted = char == "\\" and not escaped, char != '"' or escaped
        elif char == '"':
            quoted = True
        elif char in "{[":
            open_.append("}" if char == "{" else "]")
        elif char in "}]" and open_:
            open_.pop()
            complete.append((i + 1, list(open_)))
        elif char == "," and open_:
            complete.append((i, list(open_)))
    complete.append((len(reply) if not quoted else len(reply), list(open_)))
    for end, left in reversed(complete):
        closed = reply[:end] + ('"' if quoted and end == len(reply) else "") + "".join(reversed(left))
        closed = re.sub(r",\s*([}\]])", r"\1", closed)
        try:
            return json.dumps(json.loads(closed), ensure_ascii=False)
        except ValueError:
            continue
    return None


def repaired_json(reply: Column) -> Column:
    """JSON inside a model's reply, repaired where it was cut; null where there is none."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else _repaired(t)), "string")(reply)


def _items(raw: str, keys: tuple[str, ...]) -> list[str]:
    try:
        value = json.loads(raw)
    except ValueError:
        return []
    if isinstance(value, dict):
        value = next((value[k] for k in keys if isinstance(value.get(k), list)), [value])
    flat = [x for one in value for x in (one if isinstance(one, list) else [one])] if isinstance(value, list) else []
    return [json.dumps(x, ensure_ascii=False) for x in flat if isinstance(x, dict)]


def items_of(raw: Column, *keys: str) -> Column:
    """Objects (as JSON) in a JSON value: under the first of the keys, one level flattened, what is no object left out."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else _items(t, keys)), "array<string>")(raw)


def _parsed(raw: str) -> str:
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(raw.strip())
        except (ValueError, SyntaxError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
    return "{}"


def parsed_object(raw: Column) -> Column:
    """An object as JSON, from JSON or from Python's notation with single quotes; {} where neither reads it."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else _parsed(t)), "string")(raw)


def string_list(raw: Column) -> Column:
    """A JSON array of strings as an array; any other text as an array of itself; null as an empty one."""
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(raw, "array<string>"), F.array(raw)))
