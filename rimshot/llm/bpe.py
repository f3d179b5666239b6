"""Operator 10: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens of a batch stand in one doubly linked list of symbols. The queue has a bucket of list positions
for every merge rank; a bitmap of 64-bit words, with further levels above it that mark the words in use, finds
the lowest rank with a bucket by find-first-set. Taking a bucket merges its positions together; positions whose
pair has changed since they were put in are stale and skipped. Pre-tokens do not touch each other, so a batch of
short words and one very long pre-token cost the same for each merge. Where a merge may make a pair of a lower rank, a
pre-token has one merge at a time; the positions that it leaves waiting, if many, lie in a heap of that pre-token, so
none is copied again for each merge.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.llm.pieces import Memo, pieces, slices
from rimshot.llm.registry import query, table
from rimshot.llm.worker import gathered, kept, small_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Buckets of positions by rank under a hierarchical bitmap."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels = []
        n = n_ranks
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n <= 1:
                break

    def put(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        i = rank
        for words in self.levels:
            i, bit = i >> 6, i & 63
            full = words[i]
            words[i] = full | (1 << bit)
            if full:
                break

    def first(self) -> int | None:
        """The lowest rank with a bucket."""
        i = 0
        for words in reversed(self.levels):
            word = words[i]
            if not word:
                return None
            i = (i << 6) | ((word & -word).bit_length() - 1)
        return i

    def take(self, rank: int) -> np.ndarray:
        """Remove the bucket of ``rank``; its positions, ascending and distinct."""
        held = self.buckets.pop(rank)
        i = rank
        for words in self.levels:
            i, bit = i >> 6, i & 63
            words[i] &= ~(1 << bit)
            if words[i]:
                break
        return held[0] if len(held) == 1 else np.unique(np.concatenate(held))


class Waiting:
    """Positions of one rank that wait for an earlier merge of their pre-token, as a heap for each pre-token."""

    #: A pre-token with so many waiting positions gets a heap.
    MANY = 16

    def __init__(self):
        self.heaps: dict[int, list[int]] = {}

    def heads(self, live) -> list[int]:
        """The least live position of every pre-token, taken out of its heap."""
        out = []
        for w, heap in list(self.heaps.items()):
            while heap and not live(heap[0]):
                heapq.heappop(heap)
            if heap:
                out.append(heapq.heappop(heap))
            if not heap:
                del self.heaps[w]
        return out

    def keep(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Take in the positions (ascending) of pre-tokens that have many or a heap; the others are given back."""
        names, first, n = np.unique(word, return_index=True, return_counts=True)
        back = np.ones(len(at), bool)
        for w, a, k in zip(names.tolist(), first.tolist(), n.tolist()):
            heap = self.heaps.get(w)
            if heap is None and k < self.MANY:
                continue
            back[a: a + k] = False
            if heap is None:
                self.heaps[w] = at[a: a + k].tolist()  # ascending, so a heap as it is
            else:
                for x in at[a: a + k].tolist():
                    heapq.heappush(heap, x)
        return at[back]


class ByteBpe:
    """Byte-level BPE over a rank table (token bytes -> rank, which is also the id)."""

    #: Bytes that one batch of pre-tokens has at most (one longer pre-token is a batch of its own).
    BATCH_BYTES = 2_000_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.none = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, beside = {}, np.full(self.none + 1, self.none, np.int64)
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
                    beside[a] = min(beside[a], rank)
                    beside[b] = min(beside[b], rank)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        #: The lowest rank of a pair that has the token on one side.
        self.beside = beside

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens end to end, and how many each has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        starts = np.cumsum(lens) - lens
        starts = starts[lens > 0]
        # position n is the end of every list; its symbol -1 is in no pair
        symbol = np.append(self.byte_id[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts[1:] - 1] = n
        after[n] = n
        before[starts] = n
        before[n] = n
        word = np.repeat(np.arange(len(words)), lens)
        rank_of = np.append(self.pair_rank(symbol[:n], symbol[after[:n]]), self.none)
        queue = RankQueue(self.none)

        def put(positions: np.ndarray, ranks: np.ndarray) -> None:
            live = ranks < self.none
            if not live.all():
                positions, ranks = positions[live], ranks[live]
            if not len(positions):
                return
            order = np.lexsort((positions, ranks)) if len(positions) > 1 else slice(None)
            positions, ranks = positions[order], ranks[order]
            cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(ranks)]):
                queue.put(int(ranks[a]), positions[a:b])

        put(np.arange(n), rank_of[:n])
        alive = np.ones(n, bool)
        waiting: dict[int, Waiting] = {}
        while (rank := queue.first()) is not None:
            at = queue.take(rank)
            at = at[rank_of[at] == rank]  # others are stale
            held = waiting.get(rank)
            if held is not None:
                at = np.unique(np.append(at, np.array(held.heads(lambda x: rank_of[x] == rank), np.int64)))
            if not len(at):
                continue
            if self.beside[rank] <= rank:
                # the merged token may make a pair of a lower rank, which goes first: one merge a word at a time
                lead = np.append(True, word[at[1:]] != word[at[:-1]])
                if not lead.all():
                    rest = at[~lead]
                    if held is None and len(rest) >= Waiting.MANY:
                        held = waiting[rank] = Waiting()
                    if held is not None:
                        rest = held.keep(rest, word[rest])
                    if len(rest):
                        queue.put(rank, rest)
                    at = at[lead]
                if held is not None:
                    if held.heaps:
                        queue.put(rank, at[:0])  # the bucket stays marked
                    else:
                        del waiting[rank]
            elif len(at) > 1:
                # overlapping pairs (aaa): from the left, every other one of a chain
                chained = after[at[:-1]] == at[1:]
                if chained.any():
                    index = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.append(True, ~chained), index, 0))
                    at = at[(index - head) % 2 == 0]
            gone = after[at]
            following = after[gone]
            symbol[at] = rank
            after[at] = following
            before[following] = at
            alive[gone] = False
            rank_of[gone] = self.none
            left = before[at]
            left = left[left < n]
            changed = np.unique(np.concatenate((at, left))) if len(left) else at
            ranks = self.pair_rank(symbol[changed], symbol[after[changed]])
            rank_of[changed] = ranks
            put(changed, ranks)
        counts = np.bincount(word[alive], minlength=len(words))
        return symbol[:n][alive].astype("<u4"), counts

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; every pre-token is merged by the queue once."""
        split = [[x.encode("utf-8", "surrogatepass") for x in self.pattern.findall(t)] for t in texts]
        known = {}
        fresh = []
        for w in set().union(*split) if split else ():
            rank = self.ranks.get(w)
            if rank is None:
                fresh.append(w)
            else:
                known[w] = rank.to_bytes(4, "little")
        fresh.sort()
        while fresh:
            size = n = 0
            while n < len(fresh) and (n == 0 or size + len(fresh[n]) <= self.BATCH_BYTES):
                size += len(fresh[n])
                n += 1
            part, fresh = fresh[:n], fresh[n:]
            ids, counts = self.merge(part)
            raw, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
            known.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends))))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_pieces([text])[0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _encoder(path: str, pattern: str) -> tuple[ByteBpe, Memo]:
    bpe = ByteBpe.from_file(path, pattern)
    return bpe, Memo(bpe.encode_pieces)


def _rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str, digests: bool) -> Iterator[pa.RecordBatch]:
    bpe, memo = kept(("bpe", path, pattern), lambda: _encoder(path, pattern))
    token = np.empty(bpe.none, object)
    for i, t in bpe.tokens.items():
        token[i] = t
    for batch in gathered(batches, 1, 8_000_000):
        names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        ids_of: list[bytes] = []
        for part in slices(texts, 8_000_000):
            cut = [pieces(t) for t in part]
            ids_of += memo.ids([bpe.pattern.findall(t) if c is None else c for t, c in zip(part, cut)])
        ids = [np.frombuffer(x, "<u4") for x in ids_of]
        if digests:
            columns = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids_of], pa.string()),
                pa.array([hashlib.sha256(b"".join(token[x].tolist())).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([names, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        else:
            yield pa.RecordBatch.from_arrays([names, pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))],
                                             ["doc_id", "ids"])


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<long>) of every whole text.

    Null or empty texts have no ids; a null id stays null; repeated rows give repeated rows; other columns of
    ``df`` are not read. One narrow stage: no shuffle, a bounded memo of words in each task.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda b: _rows(b, path, pattern, False), "doc_id long, ids array<long>")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids and digests of the ids and of the bytes that decoding gives; rows as ``encode``."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda b: _rows(b, path, pattern, True), SCHEMA)


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)
