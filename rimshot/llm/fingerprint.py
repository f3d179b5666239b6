"""Operator 1: document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a text is cut. Chunk lengths are normalised: up to a normal length
a boundary must satisfy a stricter condition, beyond it a looser one, with a least and a greatest length. As the
hash sees 32 bytes only, boundaries move along with shifted text. The fingerprint is the set of chunk digests,
each with its chunk's length as weight; the likeness of two is the weight they share over the lesser total.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.llm.neighbours import with_next
from rimshot.llm.registry import query, table
from rimshot.llm.worker import forget

LEAST, NORMAL, GREATEST = 16, 64, 256
#: The top bits of the gear hash that must be zero at a boundary: before and after the normal length.
STRICT_BITS, LOOSE_BITS = 7, 4


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
GEAR = (_mix(_SEEDS) >> np.uint64(32)).astype(np.uint32)
BYTE = _mix(_SEEDS ^ np.uint64(0xD6E8FEB86659FD93))
POWER = np.cumprod(np.full(GREATEST, 0x9FB21C651E98DF25, np.uint64)) | np.uint64(1)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of GEAR of the last 32 bytes, shifted by their distance, modulo 2**32."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if len(h) <= shift:
            break
        wide = h.copy()
        wide[shift:] += h[:-shift] << np.uint32(shift)
        h = wide
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Starts of the chunks, ascending."""
    n = len(data)
    h = gear_hash(data)
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS))) + 1   # a cut lies behind its byte
    strict = loose[h[loose - 1] < np.uint32(1 << (32 - STRICT_BITS))].tolist()
    loose = loose.tolist()
    starts, at = [], 0
    n_strict, n_loose = len(strict), len(loose)
    while at < n:
        starts.append(at)
        i = bisect_left(strict, at + LEAST)
        if i < n_strict and strict[i] < at + NORMAL:
            at = strict[i]
            continue
        i = bisect_left(loose, at + NORMAL)
        at = loose[i] if i < n_loose and loose[i] < at + GREATEST else at + GREATEST
    return starts


def fingerprint(text: str) -> np.ndarray:
    """Sorted distinct uint64 of the chunks: 48 bits of digest above 16 bits of length."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64)
    starts = np.array(boundaries(data))
    lengths = np.diff(starts, append=n)
    inside = np.arange(n) - np.repeat(starts, lengths)
    sums = np.add.reduceat(BYTE[data] * POWER[inside], starts)
    digest = _mix(sums + lengths.astype(np.uint64)) & np.uint64(0xFFFFFFFFFFFF0000)
    return np.unique(digest | lengths.astype(np.uint64))


def as_text(found: np.ndarray) -> str:
    """16 hexadecimal digits a chunk: 12 of its digest, 4 of its length; ascending."""
    return found.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment: weight of the shared chunks over the lesser total weight; 1 for two empty sets, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weight = np.uint64(0xFFFF)
    shared = np.intersect1d(a, b, assume_unique=True)
    return float((shared & weight).sum() / min((a & weight).sum(), (b & weight).sum()))


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDIT_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def _edit_rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in EDIT_SCHEMA.split(", ")]
    forget()
    out, held, known = [], 0, (None, None)
    for key, text, following in rows:
        text, following = text or "", following or ""
        own = known[1] if known[0] == text else fingerprint(text)
        known = following, fingerprint(following)
        new = edited(text, following)
        other = fingerprint(new)
        out.append((key, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own),
                    as_text(other), likeness(own, other), likeness(own, known[1])))
        held += len(text)
        if held > 8_000_000:
            yield pa.RecordBatch.from_arrays(_typed(out), names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays(_typed(out), names)


def _typed(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text, without a shuffle.

    Null texts count as empty and have the empty fingerprint; null ids and repeated rows are kept as they are;
    other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([as_text(fingerprint(t)) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness and that to the next document.

    The next document is the one with the next lower id (after the last, the first; a lone document is its own
    next one). Null texts count as empty; null ids come last; equal ids are ordered by text, descending.
    """
    return with_next(df, id_col, text_col, _edit_rows, EDIT_SCHEMA)


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))
