"""Extension points: functions that a user plugs in where a deployment has a model, and settings.

Each hook is an ordinary Python function; the engine calls it batch by batch on the executors, and without one a
deterministic rule stands in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = ("approve", "reject", "escalate")


@dataclass(frozen=True)
class AnswerFormat:
    """How an answer is to be worded."""

    max_sentences: int = 2
    short_answer_words: int = 8
    style: str = "minimal_span"
    commit_mode: bool = False


# Fixed values.
ANSWER_FORMATS = {
    "default": AnswerFormat(),
    "locomo": AnswerFormat(2, 5, "minimal_span"),
    "mab_substring": AnswerFormat(2, 8, "minimal_span", True),
    "longmemeval": AnswerFormat(3, 12, "minimal_span", False),
    "beam": AnswerFormat(5, 30, "verbose", False),
}


def answer_format(profile: str | None) -> AnswerFormat:
    """By name; an unknown one is the default."""
    return ANSWER_FORMATS.get((profile or "default").lower(), ANSWER_FORMATS["default"])


@dataclass(frozen=True)
class Retrieval:
    """Settings of a retrieval; wrong ones are refused when they are made."""

    mode: str = "hybrid"
    lexical_seeds: int = 12
    dense_seeds: int = 12
    focused: int = 50
    hops: int = 2
    most_paths: int = 8
    rank_constant: int = 60
    least_similarity: float = 0.0
    compress_above: int = 40

    def __post_init__(self) -> None:
        from .operators.answering import mode

        mode(self.mode, strict=True)
        if min(self.lexical_seeds, self.dense_seeds, self.focused, self.hops, self.most_paths, self.rank_constant) < 0 or not 0 <= self.least_similarity <= 1:
            raise ValueError("sizes must not be negative, and the similarity must lie between 0 and 1")

    def but(self, **changes) -> "Retrieval":
        return replace(self, **changes)


def _batched(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in batches:
            yield run(one)

    return rows.mapInPandas(each, schema)


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], at_once: int = 256, most_chars: int = 8000) -> DataFrame:
    """id, vector of rows (id, text): in calls of some texts, each cut to what the model takes; order is kept by place."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        for lo in range(0, len(rows), at_once):
            part = [(t or "")[:most_chars] for t in rows["text"].iloc[lo : lo + at_once]]
            got = embed(part)
            if len(got) != len(part):
                raise ValueError("the model gave another number of vectors than texts")
            out += got
        return pd.DataFrame({"id": rows["id"], "vector": out})

    kind = texts.schema["id"].dataType.simpleString()
    return _batched(texts.select("id", "text"), run, f"id {kind}, vector array<float>")


def reviewed(candidates: DataFrame, review: Callable[[dict], str] | None = None, least: float = 0.5) -> DataFrame:
    """Candidates with ``decision``: by a reviewer of one row, or by confidence; what the reviewer says must be a decision."""
    if review is None:
        return candidates.withColumn("decision", F.when(F.coalesce("confidence", F.lit(0.0)) >= least, "approve").otherwise("escalate"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        said = [review(r) for r in rows.to_dict("records")]
        return rows.assign(decision=[d if d in DECISIONS else "escalate" for d in said])

    return _batched(candidates, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields] + ["decision string"]))


def resolved(candidates: DataFrame, existing: DataFrame, resolve: Callable[[dict, list[dict]], dict]) -> DataFrame:
    """subject, relation, object, action, superseded: what a resolver makes of each candidate and the facts that share its
    subject and relation; indices outside those are left out, an unknown action lets both stand."""
    key = ["subject", "relation"]
    old = existing.groupBy(*key).agg(F.array_sort(F.collect_list("object")).alias("old"))
    met = candidates.select(*key, "object", "confidence").join(old, key)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.to_dict("records"):
            held = [{"subject": r["subject"], "relation": r["relation"], "object": o} for o in r["old"]]
            said = resolve({k: r[k] for k in ("subject", "relation", "object", "confidence")}, held) or {}
            action = said.get("action") if said.get("action") in ("supersede", "discard", "coexist") else "coexist"
            gone = [r["old"][i] for i in said.get("superseded_indices", []) if isinstance(i, int) and 0 <= i < len(held)] if action == "supersede" else []
            out.append((r["subject"], r["relation"], r["object"], action, gone))
        return pd.DataFrame(out, columns=["subject", "relation", "object", "action", "superseded"])

    return _batched(met, run, "subject string, relation string, object string, action string, superseded array<string>")


def summarized(facts: DataFrame, summarize: Callable[[list[str]], tuple[str, str]] | None = None, most: int = 60) -> DataFrame:
    """community_id, title, summary of facts (community_id, fact, confidence): from the most confident ones; without a
    summarizer the title is the first fact and the summary all of them."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "fact"))
    top = facts.withColumn("r", rank).filter(F.col("r") <= most).groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("r", "fact"))).alias("f"))
    top = top.select("community_id", F.transform("f", lambda x: x["fact"]).alias("facts"))
    if summarize is None:
        return top.select("community_id", F.col("facts")[0].alias("title"), F.array_join("facts", "; ").alias("summary"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        said = [summarize(list(f)) for f in rows["facts"]]
        return pd.DataFrame({"community_id": rows["community_id"], "title": [s[0] for s in said], "summary": [s[1] for s in said]})

    kind = facts.schema["community_id"].dataType.simpleString()
    return _batched(top, run, f"community_id {kind}, title string, summary string")


def extracted(documents: DataFrame, process: Callable[[str, str], list[tuple[str, str, str, float]]]) -> DataFrame:
    """subject, relation, object, confidence, source: the triples that a function finds in each document (document_id, text);
    a document that it fails on gives none and does not stop the others."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, text in zip(rows["document_id"], rows["text"], strict=True):
            try:
                out += [(*t, own) for t in process(text or "", own)]
            except Exception:  # the plugged-in function is not ours: its failure costs one document
                continue
        return pd.DataFrame(out, columns=["subject", "relation", "object", "confidence", "source"])

    return _batched(documents.select("document_id", "text"), run, "subject string, relation string, object string, confidence double, source string")
