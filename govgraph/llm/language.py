"""Language identification with string kernels.

The kernel of two texts is the normalized number of n-grams of 1 to 3 bytes (blended spectrum, ASCII
lower-cased) that both hold, whatever their counts: all n-grams take part.  Nystroem features from
landmark texts stand for the kernel, and one-versus-rest kernel ridge regression learns a weight for
each language.  A batch of texts is scored by matrix products: presence of the landmarks' n-grams
(others meet no landmark, and count in the norm alone) by landmarks, features and weights, of which
the product of the last three is made once.

Learning reads a bounded sample of whole texts: of each language the ``PER_LANGUAGE`` rows with the
smallest hashes of their id, ``MOST_ROWS`` at most; the driver gets their sets of n-grams.
Prediction reads every text, whole.

Texts that are null or have no letter are ``und`` with score 0; so is every text when nothing can be
learned, as from an empty table.  A text that shares no n-gram with a landmark gets the language that
the regression's constant favours.  Rows with a null id are predicted, and learned from as others
are.  Equal rows get equal results.  Only text is an input of a prediction; extra columns of any name
are not read unless kept, and a kept column may not have the name of a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

PER_LANGUAGE, MOST_ROWS = 250, 5_000
#: Parts of the input ranked by themselves before those of a language meet in one task.
HEAPS = 64
LANDMARKS, RIDGE, AT_ONCE = 160, 1e-2, 64
UNKNOWN = "und"
#: Where the 2-grams and 1-grams begin, after all 3-grams, and the end.
_TWO, _ONE = 1 << 24, (1 << 24) + (1 << 16)
SLOTS = _ONE + (1 << 8)


def grams(b: K.Block) -> Iterator[np.ndarray]:
    """For each row the sorted numbers of the n-grams that it holds."""
    low = K.LOWER[b.data].astype(np.int32)
    two = (low[:-1] << 8) | low[1:]
    three = (two[:-1] << 8) | low[2:]
    for lo, hi in zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), strict=True):
        yield np.unique(np.concatenate([three[lo : max(lo, hi - 2)], two[lo : max(lo, hi - 1)] + _TWO, low[lo:hi] + _ONE]))


class Model:
    """Languages, the landmarks' n-grams, and for each n-gram its weight for each language; learned from sets of n-grams."""

    def __init__(self, texts: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS):
        self.languages = sorted(set(labels))
        label = np.array([self.languages.index(one) for one in labels])
        rng = np.random.default_rng(3)
        # Landmarks by turns from each language.
        turn = np.empty(len(label), np.int64)
        for k in range(len(self.languages)):
            own = np.flatnonzero(label == k)
            turn[rng.permutation(own)] = np.arange(len(own))
        self.chosen = np.lexsort((label, turn))[:landmarks]
        self.slots = np.unique(np.concatenate([texts[i] for i in self.chosen]))
        marks = np.zeros((len(self.slots), len(self.chosen)), np.float32)
        for k, i in enumerate(self.chosen):
            marks[np.searchsorted(self.slots, texts[i]), k] = 1 / np.sqrt(max(1, len(texts[i])))
        place = _places(self.slots.tobytes())
        x = np.concatenate([_normal(texts[lo : lo + AT_ONCE], place, len(self.slots)) @ marks for lo in range(0, len(texts), AT_ONCE)]).astype(np.float64)
        value, vector = np.linalg.eigh(x[self.chosen])
        good = value > 1e-8 * value.max(initial=0)
        half = vector[:, good] / np.sqrt(value[good])
        z = np.c_[x @ half, np.ones(len(x))]
        y = np.where(label[:, None] == np.arange(len(self.languages))[None, :], 1.0, -1.0)
        weight = np.linalg.solve(z.T @ z + RIDGE * np.eye(z.shape[1]), z.T @ y)
        self.weight, self.constant = (marks @ (half @ weight[:-1])).astype(np.float32), weight[-1]

    def scores(self, b: K.Block) -> np.ndarray:
        place, held, out = _places(self.slots.tobytes()), [], []
        for one in grams(b):
            held.append(one)
            if len(held) == AT_ONCE:
                out.append(_normal(held, place, len(self.slots)) @ self.weight)
                held = []
        out.append(_normal(held, place, len(self.slots)) @ self.weight)
        return np.concatenate(out) + self.constant


def _normal(held: list[np.ndarray], place: np.ndarray, n: int) -> np.ndarray:
    """Presence of n known n-grams in each set, divided by the root of the set's size."""
    out = np.zeros((len(held), n + 1), np.float32)
    for row, one in enumerate(held):
        out[row, place[one]] = 1 / np.sqrt(max(1, len(one)))
    return out[:, :n]


@cache
def _places(slots: bytes) -> np.ndarray:
    """The column of each n-gram; the last for one that is not known."""
    own = np.frombuffer(slots, np.int32)
    place = np.full(SLOTS, len(own), np.int32)
    place[own] = np.arange(len(own))
    return place


def learn(rows: DataFrame, order: str = "doc_id") -> Model | None:
    """From text and lang of the rows; null if no row can be learned from."""
    fit = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # first the firsts of each heap of input partitions, so that no task reads those of all; which heap does not show
    by = (F.xxhash64(order), order, F.xxhash64("text"), "text")
    heaps = fit.select(*dict.fromkeys(("lang", "text", order)), (F.spark_partition_id() % HEAPS).alias("__heap"))
    heaps = heaps.withColumn("__n", F.row_number().over(Window.partitionBy("lang", "__heap").orderBy(*by))).filter(F.col("__n") <= PER_LANGUAGE)
    first = Window.partitionBy("lang").orderBy(*by)
    picked = heaps.select("lang", "text", F.row_number().over(first).alias("n")).filter(F.col("n") <= PER_LANGUAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.blocks(batch.column("text")):
                part = batch.slice(b.first, b.rows)
                yield pa.record_batch([part.column("lang"), pa.array([one.astype(np.int32).tobytes() for one in grams(b)], pa.binary())], names=["lang", "held"])

    sample = picked.orderBy("n", "lang").limit(MOST_ROWS).select("lang", "text").mapInArrow(run, "lang string, held binary").collect()
    return Model([np.frombuffer(r.held, np.int32) for r in sample], [r.lang for r in sample]) if sample else None


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score (0 to 1)."""
    sent = docs.select(*dict.fromkeys((*keep, "text")))
    types = {f.name: f.dataType.simpleString() for f in sent.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.blocks(batch.column("text"), 1 << 18):
                part = batch.slice(b.first, b.rows)
                letters = K.row_sums((b.data | 32) - np.uint8(97) < 26, b.offs) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = any(map(str.isalpha, part.column("text")[i].as_py() or ""))
                if model is None:
                    names, score = np.full(b.rows, UNKNOWN, object), np.zeros(b.rows)
                else:
                    found = model.scores(b)
                    best = found.argmax(axis=1)
                    names = np.where(letters, np.array(model.languages, object)[best], UNKNOWN)
                    score = np.where(letters, np.clip((found[np.arange(b.rows), best] + 1) / 2, 0, 1), 0.0)
                yield pa.record_batch([*(part.column(k) for k in keep), pa.array(names, pa.string()), pa.array(score.astype(np.float64))], names=[*keep, "lang_pred", "score"])

    named = ", ".join(f"`{k}` {types[k]}" for k in keep)
    return sent.mapInArrow(run, f"{named}, lang_pred string, score double")


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Every document with its predicted language; learned from four fifths of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = learn(docs.filter(fold != 0))
    out = identify(docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), model, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
