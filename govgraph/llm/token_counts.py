"""Token counts by section, from the offsets of one encoding of the whole text.

A text is encoded once, whole; byte-level tokens spell it out, so their lengths give each token's
span.  The spans are joined with the sections (here: lines, each with its line end) by interval, and
a token that crosses a boundary is allocated by an explicit rule:

``first``  to the section that holds its first byte;
``last``   to the section that holds its last byte;
``most``   to the section that holds most of its bytes, the earliest among equals.

So the sections' counts always sum up to the text's.  Null and empty texts have no tokens and no
sections.  Rows are independent; extra columns of any name are not read unless kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import codec

RANKS = "byte_bpe_50k.tiktoken"
SCHEMA = "n_tokens long, n_sections long, n_crossing long, max_section_tokens long, section_tokens array<int>"


def line_ends(data: bytes) -> np.ndarray:
    """End of each line, its line end included."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not len(data) or (len(ends) and ends[-1] == len(data)) else np.r_[ends, len(data)]


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens by section, and how many cross a boundary; both are given by their ends and follow each other without gaps."""
    starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else ends
    first = np.searchsorted(sections, starts, "right")
    last = np.searchsorted(sections, ends - 1, "right")
    crossing = first != last
    chosen = first
    if rule == "last":
        chosen = last
    elif rule == "most":
        chosen = first.copy()
        for i in np.flatnonzero(crossing):
            edges = np.r_[starts[i], sections[first[i] : last[i]], ends[i]]
            chosen[i] += int(np.argmax(np.diff(edges)))
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(chosen, minlength=len(sections)), int(crossing.sum())


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = RANKS, rule: str = "first") -> DataFrame:
    """The columns ``keep`` with the tokens of the text and of each of its lines."""
    sent = docs.select(*dict.fromkeys((*keep, text)))
    types = {f.name: f.dataType.simpleString() for f in sent.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                out = []
                for value in part.column(text):
                    whole = value.as_py() or ""
                    ends = np.cumsum(c.length[c.encode(whole)])
                    counts, crossing = attribute(ends, line_ends(whole.encode()), rule)
                    out.append((len(ends), len(counts), crossing, int(counts.max(initial=0)), counts))
                columns = list(zip(*out, strict=True)) or [()] * 5
                numbers = [pa.array(x, pa.int64()) for x in columns[:4]]
                yield pa.record_batch([*(part.column(k) for k in keep), *numbers, pa.array(columns[4], pa.list_(pa.int32()))], names=[*keep, "n_tokens", "n_sections", "n_crossing", "max_section_tokens", "section_tokens"])

    named = ", ".join(f"`{k}` {types[k]}" for k in keep)
    return sent.mapInArrow(run, f"{named}, {SCHEMA}")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document with its tokens, and the tokens of each of its lines."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
