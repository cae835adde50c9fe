"""Substring dedup by content-defined chunking.

A gear hash rolls over the last ``WINDOW`` bytes; a chunk ends where its chosen bits are zero, but
not before ``LEAST`` bytes and after ``MOST`` at the latest.  Cuts follow the content, so an insertion
moves only the chunks around it.  Chunks are compared by digest over all texts; the first stays, by
(doc_id, hash of the text, place), and later ones are removed.

Null and empty texts have no chunks.  Fully equal rows share their place and are treated alike, so
the copies of such a row that come first all stay.  Extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .suffix_dedup import _packed
from .work import stash

WINDOW, LEAST, MOST, CUT_BITS = 32, 32, 1024, 5
#: The bits tested lie high among those that the whole window reaches.
_MASK = np.uint64(((1 << CUT_BITS) - 1) << (WINDOW - CUT_BITS))
_GEAR = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)


def gear(b: K.Block) -> np.ndarray:
    """Gear hash at each byte, over the last WINDOW bytes of its own text: sum of GEAR[byte] << age, by doubling."""
    h = _GEAR[b.data]
    place = np.arange(len(b.data)) - np.repeat(b.offs[:-1], np.diff(b.offs))
    age = 1
    while age < WINDOW:
        older = h[:-age] << np.uint64(age)
        older[place[age:] < age] = 0
        h[age:] += older
        age *= 2
    return h


def cuts(b: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each chunk in the block."""
    ends = np.flatnonzero((gear(b) & _MASK) == 0) + 1
    lo, hi = [], []
    at = np.searchsorted(ends, b.offs).tolist()
    ends = ends.tolist()
    for row, (start, stop) in enumerate(zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), strict=True)):
        for end in ends[at[row] : at[row + 1]]:
            while end - start > MOST and stop - start >= MOST + LEAST:
                lo.append(start)
                start += MOST
                hi.append(start)
            if end - start >= LEAST and stop - end >= LEAST:  # no short chunk at the end
                lo.append(start)
                hi.append(end)
                start = end
        while start < stop:
            lo.append(start)
            start = stop if stop - start < MOST + LEAST else start + MOST
            hi.append(start)
    return np.array(lo, np.int64), np.array(hi, np.int64)


def _chunks(docs: DataFrame) -> DataFrame:
    """h1, h2: digest; doc_id and place: mark (24 bits), first byte (29) and length (11)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            for b in K.blocks(batch.column("text")):
                lo, hi = cuts(b)
                data = memoryview(b.data)
                digest = b"".join(hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True))
                parts = np.frombuffer(digest, np.int64).reshape(-1, 2)
                row = np.searchsorted(b.offs, lo, "right") - 1
                rows = pa.array(b.first + row)
                place = (marks[b.first + row] << 40) | ((lo - b.offs[row]) << 11) | (hi - lo)
                yield pa.record_batch([pa.array(np.ascontiguousarray(parts[:, 0])), pa.array(np.ascontiguousarray(parts[:, 1])), batch.column("doc_id").take(rows), pa.array(place)], names=["h1", "h2", "doc_id", "place"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "h1 long, h2 long, doc_id long, place long")


def dedup_chunks(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_shared (chunks that stand elsewhere too), n_removed (of them, not the first), bytes_removed, and kept: the bytes left, or their SHA-256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").bitwiseAND(0x7FFFFF).alias("mark"), "text")
    seen = _chunks(docs)
    where = F.struct("doc_id", "place")
    twice = seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(where).alias("first")).filter("n > 1").select("h1", "h2", "first")
    met = seen.join(twice, ["h1", "h2"])
    n = F.col("place").bitwiseAND(2047).cast("int")
    ranges = met.groupBy(F.col("doc_id").alias("d"), F.shiftright("place", 40).cast("long").alias("m")).agg(F.collect_list(F.struct(F.shiftright("place", 11).bitwiseAND((1 << 29) - 1).cast("long").alias("lo"), n.alias("n"), where.eqNullSafe(F.col("first")).alias("first"))).alias("ranges"))
    joined = _packed(docs).join(stash(ranges), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, found in zip(batch.column("doc_id"), batch.column("packed"), batch.column("ranges"), strict=True):
                data = unpack.decompress(packed.as_py())
                spans = sorted({(r["lo"], r["n"], r["first"]) for r in found.as_py()}) if found.is_valid else []
                gone = [(lo, n) for lo, n, first in spans if not first]
                pieces, at = [], 0
                for lo, n in gone:
                    pieces.append(data[at:lo])
                    at = lo + n
                left = b"".join([*pieces, data[at:]])
                out.append((doc_id.as_py(), len(data), len(spans), len(gone), len(data) - len(left), hashlib.sha256(left).hexdigest() if digests else left))
            types = (*[pa.int64()] * 5, pa.string() if digests else pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_shared", "n_removed", "bytes_removed", "kept_sha256" if digests else "kept"])

    last = "kept_sha256 string" if digests else "kept binary"
    return joined.select("doc_id", "packed", "ranges").mapInArrow(run, f"doc_id long, n_bytes long, n_shared long, n_removed long, bytes_removed long, {last}")


def op1_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the chunks that it shares, those removed, and the digest of what is left."""
    return dedup_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
