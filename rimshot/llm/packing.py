"""Operator 3: vector bin packing of token sequences by the dot-product heuristic.

An example takes from a sequence's budget in three dimensions: tokens, segments (one for each piece) and
loss-bearing tokens (prompt tokens bear none). The sequence that is open takes, of all examples in a bounded
window that fit in every dimension, the one with the largest dot product of its demand with the sequence's
remaining budget, both as shares of the limits. When nothing fits whole, the longest example is cut to fill the
rest. A sequence that cannot be filled (its segments or loss-bearing tokens are used up, or the task's rows end)
is dealt out to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.llm.pieces import Memo, pieces, slices
from rimshot.llm.registry import query, table
from rimshot.llm.worker import gathered, kept, small_batches

END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "loss_tokens long")
#: Sequence numbers of one task lie in a range of their own.
SEQUENCES_PER_TASK = 1 << 33


class VectorPacker:
    """Packs examples that arrive one by one; gives (example, start, length, loss, sequence, offset) when settled.

    An example is (key, n_tokens, n_prompt): its first ``n_prompt`` tokens bear no loss. ``window`` bounds how
    many examples wait at once, so memory does not depend on how many arrive.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, window: int = 256):
        if min(max_tokens, max_segments, max_loss, window) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.max_tokens, self.max_segments, self.max_loss, self.window = max_tokens, max_segments, max_loss, window
        self.waiting: list[list] = []   # [key, start, length, n_prompt]
        self.demand = np.zeros((window + 1, 3))
        self.open: list[tuple] = []     # pieces of the open sequence: (key, start, length, loss)
        self.free = self.limits.copy()
        self.sequence = 0

    @staticmethod
    def _loss(start: int, length: int, n_prompt: int) -> int:
        return min(length, max(0, start + length - n_prompt))

    def add(self, key, n_tokens: int, n_prompt: int = 0) -> Iterator[tuple]:
        start = 0
        step = min(self.max_tokens, self.max_loss)
        while n_tokens - start >= self.max_tokens:  # whole sequences of a long example need no partner
            if self._loss(start, self.max_tokens, n_prompt) <= self.max_loss:
                yield key, start, self.max_tokens, self._loss(start, self.max_tokens, n_prompt), self.sequence, 0
                start += self.max_tokens
            else:
                yield from self._deal([(key, start, step, self._loss(start, step, n_prompt))])
                start += step
                continue
            self.sequence += 1
        if n_tokens > start:
            self._wait(key, start, n_tokens - start, n_prompt)
            while len(self.waiting) >= self.window:
                yield from self._place()

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._place()
        if self.open:
            yield from self._close()

    def _wait(self, key, start: int, length: int, n_prompt: int) -> None:
        self.demand[len(self.waiting)] = (length, 1, self._loss(start, length, n_prompt))
        self.waiting.append([key, start, length, n_prompt])

    def _drop(self, i: int) -> None:
        last = len(self.waiting) - 1
        self.waiting[i] = self.waiting[last]
        self.demand[i] = self.demand[last]
        self.waiting.pop()

    def _take(self, key, start: int, length: int, loss: int) -> None:
        self.open.append((key, start, length, loss))
        self.free -= (length, 1, loss)

    def _place(self) -> Iterator[tuple]:
        n = len(self.waiting)
        demand = self.demand[:n]
        fits = (demand <= self.free).all(axis=1)
        if fits.any():
            score = np.where(fits, (demand / self.limits) @ (self.free / self.limits), -1.0)
            i = int(score.argmax())
            key, start, length, n_prompt = self.waiting[i]
            self._take(key, start, length, self._loss(start, length, n_prompt))
            self._drop(i)
        elif self.free.min() >= 1:
            i = int(demand[:, 0].argmax())  # none fits whole: the longest is cut
            key, start, length, n_prompt = self.waiting[i]
            room = min(int(self.free[0]), length)
            if self._loss(start, room, n_prompt) > self.free[2]:
                room = max(0, n_prompt - start) + int(self.free[2])
            self._take(key, start, room, self._loss(start, room, n_prompt))
            if room == length:
                self._drop(i)
            else:
                self.waiting[i] = [key, start + room, length - room, n_prompt]
                self.demand[i] = (length - room, 1, self._loss(start + room, length - room, n_prompt))
        if self.free.min() < 1:
            yield from self._close()

    def _close(self) -> Iterator[tuple]:
        held, self.open, self.free = self.open, [], self.limits.copy()
        yield from self._deal(held)

    def _deal(self, held: list[tuple]) -> Iterator[tuple]:
        """The pieces as one sequence if it is full, else as sequences whose lengths are powers of two."""
        left = sum(p[2] for p in held)
        queue = held[::-1]
        while left:
            size = self.max_tokens if left == self.max_tokens else 1 << (left.bit_length() - 1)
            offset = 0
            while offset < size:
                key, start, length, loss = queue.pop()
                take = min(length, size - offset)
                # what is cut off in front bears the loss that is over what the rest can bear
                rest = length - take
                ahead = max(0, loss - rest) if rest else loss
                yield key, start, take, ahead, self.sequence, offset
                if rest:
                    queue.append((key, start + take, rest, loss - ahead))
                offset += take
            left -= size
            self.sequence += 1


def _encoder(path: str) -> tuple:
    """The tokenizer, ids of pieces, and the strings that the tokenizer takes as one token wherever they stand."""
    tokenizer = _tokenizer(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, Memo(lambda found: _piece_ids(tokenizer, found)), added


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _piece_ids(tokenizer, found: list[str], row: int = 100) -> list[bytes]:
    """Ids of pieces (no white space but one space in front, or a line feed), encoded as lines of ``row`` pieces: a
    line feed before a sign or its one space is a token of its own."""
    feed = tokenizer.encode("\n", add_special_tokens=False).ids
    if len(feed) != 1:
        return [array("I", tokenizer.encode(p, add_special_tokens=False).ids).tobytes() for p in found]
    words = [p for p in found if p != "\n"]
    out: list[bytes] = []
    for i in range(0, len(words), 200 * row):
        part = words[i: i + 200 * row]
        lines = ["\n".join(part[k: k + row]) + "\n" for k in range(0, len(part), row)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        raw, ends = ids.tobytes(), (np.flatnonzero(ids == feed[0]) * 4).tolist()
        out += [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends)]
    if len(words) < len(found):
        out.insert(found.index("\n"), array("I", feed).tobytes())
    return out


def _pack_rows(batches: Iterator[pa.RecordBatch], path: str, limits: tuple[int, int, int], window: int,
               end_id: int) -> Iterator[pa.RecordBatch]:
    tokenizer, memo, added = kept(("tokenizer", path), lambda: _encoder(path))
    end = int(end_id).to_bytes(4, "little")
    packer = VectorPacker(*limits, window=window)
    first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows: list[tuple] = []

    def settled(found) -> None:
        for (doc, ids), start, length, loss, sequence, offset in found:
            crc = zlib.crc32(memoryview(ids)[4 * start: 4 * (start + length)])
            rows.append((doc, start, length, crc, len(ids) // 4, first + sequence, offset, loss))

    def written() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
        rows.clear()
        return made

    def encoded(texts: list[str]) -> list[bytes]:
        cut = [None if any(a in t for a in added) else pieces(t) for t in texts]
        ids = list(memo.ids([c or [] for c in cut]))
        for i, c in enumerate(cut):
            if c is None:  # must not be cut
                ids[i] = array("I", tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return ids

    for batch in gathered(batches, 1, 3_000_000):
        docs = batch.column(0).to_pylist()
        texts = [t or "" for t in batch.column(1).to_pylist()]
        prompts = [t or "" for t in batch.column(2).to_pylist()] if batch.num_columns > 2 else None
        done = 0
        for part in slices(texts, 3_000_000):
            answers = encoded(part)
            heads = encoded(prompts[done: done + len(part)]) if prompts else [b""] * len(part)
            for doc, head, body in zip(docs[done: done + len(part)], heads, answers):
                ids = head + body + end
                settled(packer.add((doc, ids), len(ids) // 4, len(head) // 4))
            done += len(part)
            if len(rows) >= 10_000:
                yield written()
    settled(packer.finish())
    if rows:
        yield written()


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         prompt_col: str | None = None, max_tokens: int = 2048, max_segments: int = 64,
         max_loss_tokens: int = 2048, window: int = 256, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens) of packed sequences.

    A document is the ids of its prompt (if ``prompt_col`` is given; they bear no loss), those of its text and
    ``end_id``. Null prompts and texts count as empty, so such a document has the end id alone. Null ids stay
    null, repeated rows are packed as often as they occur, an empty table gives no rows, other columns are not
    read. One narrow stage: every task packs its own rows, with at most ``window`` examples waiting; a retried
    task gives the same rows, since sequence numbers follow from the task's partition.
    """
    small_batches(df.sparkSession)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if prompt_col:
        columns.append(F.col(prompt_col).alias("prompt"))
    limits = (max_tokens, max_segments, max_loss_tokens)
    return df.select(*columns).mapInArrow(lambda b: _pack_rows(b, tokenizer_path, limits, window, end_id), SCHEMA)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
