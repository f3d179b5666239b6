"""Operator 5: removal of repeated runs of lines, by a suffix array over line-ID sequences.

Every line that has a word gets an ID (the hash of its words). Only lines that occur again anywhere can be part of
a repeated run, so the sequences are the stretches of such lines in each document, and only stretches with enough
words stay; of equal stretches all but the first are later copies as a whole.

Prefix doubling ranks the suffixes of the remaining sequences by their first 1, 2, 4, ... lines: a new rank is the
place of the pair (rank of the suffix, rank of the suffix so many lines on) among all distinct pairs in order. The
ranks order the suffixes as far as runs have to be told apart. Suffixes that share their first l lines form an
interval of the suffix array with a longest common prefix of at least l; its name is the pair of ranks, for the
power of two below l, at the run's start and so that the second block ends with the run. A run of the least
length (``min_words``), or of a few lines more, is a later copy if its interval holds an earlier place.

The runs looked at from each start are those whose lines beyond the least length have fewer than ``min_words``
words. They cover every maximal repeated run: of the starts within it, the last that leaves enough words up to its
end has such a run to the end, and those before it overlap.

By words (``words=True``, as the query calls it) the unit is a word, wherever lines end, so a passage
within longer lines counts with all its words. A block is half of the least length of words, and its rank the hash of
its words; one doubling gives the rank of the least length, whose intervals tell the later copies. Only blocks
that are the least (by hash) of all blocks in some run of the least length are dealt out first: equal runs have equal
least blocks, so a run whose least block is nowhere else is not repeated, and most suffixes are never sent. Texts are
split and hashed a part of a batch at a time. Neighbouring
blocks whose first places in the corpus lie equally far apart in one document make a common run with that place: one
row (start, length) tells of all later copies in it. Only the other runs are named each, and of these those whose name
occurs once in a count by buckets are not sent. None is lost: the first place of a run has no earlier one, so no row
covers it, and it is named like the later ones that no row covers.
"""

from __future__ import annotations

import re

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.llm.registry import query, table
from rimshot.llm.sketch import SCHEMA, BucketCounts, bits_for, summed
from rimshot.llm.worker import forget, small_batches
from rimshot.operators.ordering import global_row_number
from rimshot.session import checkpoint_dir

MIN_WORDS = 50
#: A document is told by its id and the hash of its text; places are in the order of id, hash, line.
_DOC = ("doc_id", "h")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        ids, sizes = [], []
        for text in batch.column(2).to_pylist():
            words = [line.split() for line in text.split("\n")]
            ids.append([_signed(xxhash.xxh64_intdigest(" ".join(w))) for w in words if w])
            sizes.append([len(w) for w in words if w])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64())),
                                          pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "h", "ids", "sizes"])


_RUN = "doc_id long, h long, start int, run1 long, run2 long, ids array<long>, sizes array<int>, most int"


def _stretches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Stretches of neighbouring repeated lines with enough words; a row has a document's repeated lines."""
    for batch in batches:
        out = []
        for doc, h, lines in zip(*(batch.column(i).to_pylist() for i in range(3))):
            at = np.array([x["at"] for x in lines])
            ids = np.array([x["id"] for x in lines], np.int64)
            sizes = np.array([x["size"] for x in lines], np.int32)
            order = np.argsort(at)
            at, ids, sizes = at[order], ids[order], sizes[order]
            cuts = np.flatnonzero(np.diff(at) != 1) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                if sizes[a:b].sum() >= min_words:
                    d = xxhash.xxh128_intdigest(ids[a:b].tobytes())
                    most = max(n for _, n in lengths(sizes[a:b], min_words))
                    out.append((doc, h, int(at[a]), _signed(d >> 64), _signed(d & ((1 << 64) - 1)), ids[a:b], sizes[a:b], most))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             [f.split()[0] for f in _RUN.split(", ")])


def lengths(sizes: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(start, number of lines) of the runs that are looked at, in one sequence of line sizes."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in range(len(sizes)):
        least = int(np.searchsorted(total, total[i] + min_words))
        if least >= len(total):
            break
        end = least
        while end < len(total) and total[end] - total[least] < min_words:
            out.append((i, end - i))
            end += 1
    return out


def _names(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(lines, rank at the start, rank of the block that ends the run, place) of every run that is looked at."""
    for batch in batches:
        out = []
        for doc, h, start, sizes, ranks in zip(*(batch.column(i).to_pylist() for i in range(5))):
            for i, n in lengths(np.array(sizes), min_words):
                k = n.bit_length() - 1
                out.append((n, ranks[k][i], ranks[k][i + n - (1 << k)], doc, h, start + i))
        if out:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["lines", "a", "b", "doc_id", "h", "start"])


def _place() -> Column:
    """Places compare by id (null last), hash and line."""
    return F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("h"), F.col("start"))


def _ranked(runs: DataFrame, longest: int) -> DataFrame:
    """``runs`` (run1, run2, ids) with ``ranks``: for each power of two up to ``longest`` the rank of every suffix."""
    runs = runs.withColumn("ranks", F.array("ids"))
    step = 1
    while 2 * step <= longest:
        last = F.col("ranks")[F.size("ranks") - 1]
        suffixes = (runs.select("run1", "run2", last.alias("r"))
                    .select("run1", "run2", "r", F.posexplode("r").alias("at", "a"))
                    # a suffix that is too short to go on stands before all others that begin alike
                    .select("run1", "run2", "at", "a", F.coalesce(F.get("r", F.col("at") + step), F.lit(-(1 << 63))).alias("b")))
        pairs = global_row_number(suffixes.select("a", "b").distinct(), ["a", "b"], out="rank",
                                  num_partitions=int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        level = (suffixes.join(pairs, ["a", "b"]).groupBy("run1", "run2")
                 .agg(F.sort_array(F.collect_list(F.struct("at", "rank"))).alias("level"))
                 .select("run1", "run2", F.transform("level", lambda x: x["rank"]).alias("level")))
        runs = (runs.join(level, ["run1", "run2"])
                .withColumn("ranks", F.concat("ranks", F.array("level"))).drop("level").checkpoint())
        step *= 2
    return runs


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, gone): for each document of ``docs`` (doc_id, h, text) with later copies, an array of
    (start, lines) over its lines that have a word."""
    checkpoint_dir(docs.sparkSession)
    lines = (docs.select("doc_id", "h", "text").mapInArrow(_lines, "doc_id long, h long, ids array<long>, sizes array<int>")
             .dropDuplicates(["doc_id", "h"]).checkpoint())
    each = lines.select("doc_id", "h", F.posexplode(F.arrays_zip("ids", "sizes")).alias("at", "line")).select(
        "doc_id", "h", "at", F.col("line.ids").alias("id"), F.col("line.sizes").alias("size"))
    # written first, so that the join below deals both sides out itself and can split a line that very many share
    again = each.groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("id").checkpoint()
    held = (each.join(again, "id").groupBy("doc_id", "h")
            .agg(F.collect_list(F.struct("at", "id", "size")).alias("lines")))
    runs = held.mapInArrow(lambda b: _stretches(b, min_words), _RUN).checkpoint()
    firsts = runs.groupBy("run1", "run2").agg(F.min(_place()).alias("first")).checkpoint()
    placed = runs.join(firsts, ["run1", "run2"])
    copies = placed.filter(_place() != F.col("first")).select("doc_id", "h", "start", F.size("ids").alias("lines"))
    own = placed.filter(_place() == F.col("first")).drop("first").checkpoint()
    longest = own.select(F.max("most")).first()[0]  # lines of the longest run that is looked at
    if longest is None:
        found = copies
    else:
        names = (_ranked(own, longest).select("doc_id", "h", "start", "sizes", "ranks")
                 .mapInArrow(lambda b: _names(b, min_words), "lines int, a long, b long, doc_id long, h long, start int").checkpoint())
        interval = (names.groupBy("lines", "a", "b").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times"))
                    .filter("times > 1").drop("times").checkpoint())
        later = names.join(interval, ["lines", "a", "b"]).filter(_place() > F.col("first"))
        found = copies.unionByName(later.select("doc_id", "h", "start", "lines"))
    return found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "lines")).alias("gone"))


#: White space as ``str.split`` takes it, in UTF-8: a mask of the single bytes, and the longer ones by their first byte.
_SPACE = np.array([i < 128 and chr(i).isspace() for i in range(256)])
_SPACES: dict[int, list[bytes]] = {}
for _c in (chr(i) for i in range(128, 1 << 16) if chr(i).isspace()):
    _SPACES.setdefault(_c.encode()[0], []).append(_c.encode())


def _word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of ``texts``, one text after the other, and where each text's words begin and the last's end."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0]: ends[-1]] if held is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    space = _SPACE[data]
    for lead, longer in _SPACES.items():
        at = np.flatnonzero(data == lead)
        for c in longer if len(at) else ():
            here = at[np.all([data[at + k] == c[k] for k in range(1, len(c))], axis=0)]
            for k in range(len(c)):
                space[here + k] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = ends[(ends > 0) & (ends < len(data))]  # words do not go beyond a text
    first[inner], last[inner - 1] = ~space[inner], ~space[inner - 1]
    at = np.flatnonzero(first)
    return _xxh64(data, at, np.flatnonzero(last) + 1 - at), np.searchsorted(at, ends)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                  0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxh64(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxh64 of the words at ``at`` of ``size`` bytes: those below 32 bytes, which have one lane, all together."""
    eights = np.zeros(len(data) // 8 + 2, "<u8")
    eights.view(np.uint8)[: len(data)] = data

    def read(p: np.ndarray) -> np.ndarray:  # the 8 bytes from each place
        k, bits = p >> 3, (p & 7).astype(np.uint64) << np.uint64(3)
        return (eights[k] >> bits) | ((eights[k + 1] << np.uint64(1)) << (np.uint64(63) - bits))

    out = size.astype(np.uint64) + _P5
    for k in (8, 16, 24):
        i = np.flatnonzero(size >= k)
        out[i] = _rotated(out[i] ^ (_rotated(read(at[i] + k - 8) * _P2, 31) * _P1), 27) * _P1 + _P4
    p = at + (size & ~7)
    i = np.flatnonzero(size & 4)
    out[i] = _rotated(out[i] ^ ((read(p[i]) & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    p[i] += 4
    for k in range(3):
        i = np.flatnonzero((size & 3) > k)
        out[i] = _rotated(out[i] ^ (data[p[i] + k] * _P5), 11) * _P1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(data[at[i]: at[i] + size[i]])
    return out


def _polynomials(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all rows of ``size`` neighbouring words, from those of 1, 2, 4, ... words."""
    out, done, power, width, times = None, 0, ids, 1, 0x9E3779B97F4A7C15
    while True:
        if size & width:  # ``out`` has the last ``done`` words of the block, ``power`` those before them
            out = power if out is None else power[: len(power) - done] * np.uint64(pow(0x9E3779B97F4A7C15, done, 1 << 64)) + out[width:]
            done += width
        if 2 * width > size:
            break
        power = power[:-width] * np.uint64(times) + power[width:]
        width, times = 2 * width, times * times % (1 << 64)
    out = out.copy()
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(33))


def _blocks(text: str, min_words: int) -> np.ndarray:
    """Hashes of all blocks of half of ``min_words`` words, by their first word; none in a text without a run."""
    return _texts_blocks(pa.array([text], pa.string()), min_words)[2]


def _texts_blocks(texts: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_word_ids`` of the texts, and the hashes of all blocks in them, over the ends of texts too; none without a run."""
    ids, words = _word_ids(texts)
    return ids, words, _polynomials(ids, (min_words + 1) // 2) if len(ids) >= min_words else np.zeros(0, np.uint64)


#: Bits for a block's place in a part of a batch, below those of its hash.
_PLACE_BITS = 28


def _least(blocks: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For every run of ``min_words`` words the place of its least block by the first 36 bits, the first of equals, and
    whether the run lies in one text (``words``: where each text begins, and the last's end)."""
    if not len(blocks):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least, width, done = (blocks & ~mask) | np.arange(len(blocks), dtype=np.uint64), min_words - (min_words + 1) // 2 + 1, 1
    while done < width:
        step = min(done, width - done)
        least, done = np.minimum(least[:-step], least[step:]), done + step
    inside = np.arange(min_words, min_words + len(least)) <= np.repeat(words[1:], np.diff(words))[: len(least)]
    return (least & mask).astype(np.int64), inside


_PART_BYTES = 1 << 20


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``_PART_BYTES`` of text, or one text, for work on all texts of a part at once."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _PART_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


_MARKS = "doc_id long, h long, run1 long, run2 long, words int, marks array<long>, at array<int>"


def _marks(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Of every text with enough words the digest of its words, and its least blocks and their places in order."""
    forget()
    for batch in (part for whole in batches for part in _parts(whole, 2)):
        ids, words, blocks = _texts_blocks(batch.column(2), min_words)
        least, inside = _least(blocks, words, min_words)
        at = least[inside]
        at = at[np.diff(at, prepend=-1) != 0]  # places never go back
        rows = np.flatnonzero(np.diff(words) >= min_words)
        if not len(rows):
            continue
        digests = [xxhash.xxh128_intdigest(ids[a:b]) for a, b in zip(words[rows].tolist(), words[rows + 1].tolist())]
        ends = np.append(np.searchsorted(at, words[rows]), len(at))
        inner = at - np.repeat(words[rows], np.diff(ends))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array([_signed(d >> 64) for d in digests], pa.int64()),
             pa.array([_signed(d & ((1 << 64) - 1)) for d in digests], pa.int64()), pa.array(np.diff(words)[rows], pa.int32()),
             _lists(ends, pa.array(blocks[at].view(np.int64))), _lists(ends, pa.array(inner, pa.int32()))],
            [f.split()[0] for f in _MARKS.split(", ")])


def _chains(row: np.ndarray, at: np.ndarray, doc: np.ndarray, first: np.ndarray, later: np.ndarray, size: int,
            min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, words) of runs of the least length or more that also stand where their blocks' first places are.

    Block k begins at ``at[k]`` of text ``row[k]``, and stands first in document ``doc[k]`` at ``first[k]``, an earlier
    place if ``later[k]``. Neighbouring blocks that meet or overlap, with first places as far apart in one document, are
    one run.
    """
    step = np.diff(at)
    link = later[1:] & later[:-1] & (row[1:] == row[:-1]) & (doc[1:] == doc[:-1]) & (np.diff(first) == step) & (step <= size)
    cuts = np.flatnonzero(~link) + 1
    begins, ends = np.concatenate([[0], cuts])[: len(at)], np.concatenate([cuts, [len(at)]])[: len(at)] - 1
    words = at[ends] - at[begins] + size
    keep = later[begins] & (words >= min_words)
    return row[begins[keep]], at[begins[keep]], words[keep]


_NAMES = "doc_id long, h long, blocks array<long>, start array<int>, n array<int>, gone array<struct<start:int,lines:int>>"


def _word_names(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Of every document the runs that are later copies by the first places of their blocks (``gone``), and the
    stretches (first run, number) of other runs whose least block is repeated, with the stretches' blocks."""
    forget()
    size, seen = (min_words + 1) // 2, set()
    second = min_words - size
    for batch in (part for whole in batches for part in _parts(whole, 2)):
        new = []
        for k, place in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if place not in seen:  # repeated rows are one document
                seen.add(place)
                new.append(k)
        if not new:
            continue
        batch = batch.take(pa.array(new))
        _, words, blocks = _texts_blocks(batch.column(2), min_words)
        held = batch.column(3).flatten()
        start, doc, first = (held.field(i).fill_null(0).to_numpy() for i in range(3))
        later = held.field(1).is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(new)), np.diff(batch.column(3).offsets.to_numpy()))
        at = start + words[row]
        order = np.argsort(at)
        row, at, doc, first, later = row[order], at[order], doc[order], first[order].astype(np.int64), later[order]
        chained, begin, lines = _chains(row, at, doc, first, later, size, min_words)
        repeated = np.zeros(len(blocks), bool)
        repeated[at] = True
        least, mine = _least(blocks, words, min_words)
        mine &= repeated[least]
        gone = np.zeros(len(mine) + 1, np.int32)
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + lines - min_words + 1, -1)
        mine &= np.cumsum(gone[:-1]) == 0
        opens = mine.copy()
        opens[1:] &= ~mine[:-1]
        heads = words[:-1][words[:-1] < len(mine)]
        opens[heads] = mine[heads]  # stretches do not go beyond a text
        begins = np.flatnonzero(opens)
        n = np.diff(np.append(np.cumsum(mine)[begins] - 1, mine.sum())) if len(begins) else begins
        told = np.repeat(begins - np.cumsum(n + second) + n + second, n + second) + np.arange((n + second).sum())
        ends = np.searchsorted(begins, words)
        text = np.repeat(words[:-1], np.diff(ends))
        upto = np.concatenate([[0], np.cumsum(n + second)])
        runs = pa.StructArray.from_arrays([pa.array(begin - words[chained], pa.int32()), pa.array(lines, pa.int32())], ["start", "lines"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), _lists(upto[ends], pa.array(blocks[told].view(np.int64))),
             _lists(ends, pa.array(begins - text, pa.int32())), _lists(ends, pa.array(n, pa.int32())),
             _lists(np.searchsorted(chained, np.arange(len(new) + 1)), runs)],
            ["doc_id", "h", "blocks", "start", "n", "gone"])


def _runs_of(batch: pa.RecordBatch, second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every run in a batch of stretches: the hashes of its first and last block, its start, and the row it is in."""
    blocks, start, n = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3, 4))
    ends = batch.column(3).offsets.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(n + second) - n - second, n) + within
    return blocks[at], blocks[at + second], (np.repeat(start, n) + within).astype(np.int32), np.repeat(row, n)


def _buckets(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of 2**``bits`` buckets of the hashes ``h`` in ``keys``: at most 8 MB."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = BucketCounts(bits)
        for batch in batches:
            counts.add(batch.column(0).to_numpy().view(np.uint64))
        rows = list(counts.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                         ["block", "counts"])

    return np.packbits(summed(keys.select("h").mapInArrow(run, SCHEMA), bits, 1))


def _within(df: DataFrame, h: str, buckets: np.ndarray, bits: int, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose hash is in the buckets, or the others: what has no partner is spared the shuffle."""
    at, mask = df.columns.index(h), (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(at).to_numpy() & mask
            yield batch.filter(pa.array(((buckets[k >> 3] >> (7 - (k & 7))) & 1 == 1) == inside))

    return df.mapInArrow(run, df.schema)


def _marks_within(own: DataFrame, buckets: np.ndarray, bits: int) -> DataFrame:
    """(doc_id, h, mark, start): the blocks of ``own`` (doc_id, h, marks, at) whose hash is in the buckets."""
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, at = batch.column(2).flatten(), batch.column(3).flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            k = marks.to_numpy() & mask
            keep = np.flatnonzero((buckets[k >> 3] >> (7 - (k & 7))) & 1 == 1)
            for i in range(0, len(keep), 100_000):
                part = keep[i: i + 100_000]
                rows = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), marks.take(pa.array(part)),
                                                  at.take(pa.array(part))], ["doc_id", "h", "mark", "start"])

    return own.select("doc_id", "h", "marks", "at").mapInArrow(run, "doc_id long, h long, mark long, start int")


def _name_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of each run from those of its first and last block."""
    x = (a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _repeated_names(names: DataFrame, bits: int, second: int) -> DataFrame:
    """(a, b, doc_id, h, start): the runs in the stretches of ``names``, without those whose name occurs once. Names are
    counted in 2**``bits`` buckets over all documents, so some that occur once stay, and none that is repeated goes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = BucketCounts(bits)
        for batch in batches:
            a, b, _, _ = _runs_of(batch, second)
            counts.add(_name_hashes(a, b))
        rows = list(counts.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                         ["block", "counts"])

    buckets, mask = np.packbits(summed(names.mapInArrow(count, SCHEMA), bits, 2)), np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            a, b, start, row = _runs_of(batch, second)
            k = (_name_hashes(a, b) & mask).astype(np.int64)
            keep = np.flatnonzero((buckets[k >> 3] >> (7 - (k & 7))) & 1 == 1)
            for i in range(0, len(keep), 100_000):
                part = keep[i: i + 100_000]
                rows = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), batch.column(0).take(rows),
                                                  batch.column(1).take(rows), pa.array(start[part])],
                                                 ["a", "b", "doc_id", "h", "start"])

    return names.mapInArrow(run, "a long, b long, doc_id long, h long, start int")


def repeated_words(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, gone): for each document of ``docs`` (doc_id, h, text) with later copies, an array of
    (start, lines) over its words."""
    checkpoint_dir(docs.sparkSession)
    docs = docs.select("doc_id", "h", "text")
    marks = docs.mapInArrow(lambda b: _marks(b, min_words), _MARKS).withColumn("start", F.lit(0)).checkpoint()
    # the marks go with the place, so that the first text of equals, and one of repeated rows, is found as they are dealt
    # out; in two arrays, as one of structs takes far more room
    own = (marks.groupBy("run1", "run2").agg(F.min(F.struct(_place().alias("first"), "marks", "at")).alias("own"))
           .select("run1", "run2", "own.first.doc_id", "own.first.h", "own.first.start", "own.marks", "own.at").checkpoint())
    copies = (marks.select("run1", "run2", "doc_id", "h", "start", "words").join(own.select("run1", "run2", _place().alias("first")), ["run1", "run2"])
              .filter(_place() != F.col("first")).select("doc_id", "h", "start", F.col("words").alias("lines")))
    each = own.select("doc_id", "h", F.explode(F.arrays_zip("marks", "at")).alias("m")).select("doc_id", "h", F.col("m.marks").alias("mark"),
                                                                                             F.col("m.at").alias("start"))
    again = (each.groupBy("mark").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times"))
             .filter("times > 1").drop("times").checkpoint())
    block = F.struct("start", F.when(_place() != F.col("first"), F.xxhash64("first.doc_id", "first.h")).alias("doc"),
                     F.col("first.start").alias("first"))
    bits = bits_for(docs, 16, most=26)
    sent = _marks_within(own, _buckets(again.select(F.col("mark").alias("h")), bits), bits)
    held = (sent.join(again, "mark").groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_x"))
            .agg(F.collect_list(block).alias("held")).checkpoint())
    bits = bits_for(docs, 256, most=24)
    texts = _within(docs, "h", _buckets(held.select(F.col("_x").alias("h")), bits), bits)
    names = (texts.join(held, texts["doc_id"].eqNullSafe(F.col("_d")) & (texts["h"] == F.col("_x")))
             .select("doc_id", "h", "text", "held").mapInArrow(lambda b: _word_names(b, min_words), _NAMES).checkpoint())
    chained = names.select("doc_id", "h", F.explode("gone").alias("run")).select("doc_id", "h", "run.start", "run.lines")
    rest = _repeated_names(names, bits_for(docs, 16, most=26), min_words - (min_words + 1) // 2)
    interval = (rest.groupBy("a", "b").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times"))
                .filter("times > 1").drop("times").checkpoint())
    later = (rest.join(interval, ["a", "b"]).filter(_place() > F.col("first"))
             .select("doc_id", "h", "start", F.lit(min_words).alias("lines")))
    found = copies.unionByName(chained).unionByName(later)
    return found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "lines")).alias("gone"))


def _spans(gone: pa.ListArray) -> list[list[dict] | None]:
    """The runs to remove of each text, those that meet or overlap as one."""
    row = np.repeat(np.arange(len(gone)), pc.list_value_length(gone).fill_null(0).to_numpy(zero_copy_only=False))
    start, lines = (x.to_numpy().astype(np.int64) for x in gone.flatten().flatten())
    order = np.argsort((row << 32) + start)
    start, upto = ((row << 32) + x for x in (start, start + lines))
    start, upto = start[order], np.maximum.accumulate(upto[order])
    opens = np.flatnonzero(np.concatenate([[True], start[1:] > upto[:-1]])[: len(start)])
    out: list[list[dict] | None] = [None] * len(gone)
    for k, a, b in zip(row[opens].tolist(), start[opens].tolist(), upto[np.append(opens[1:], len(start)) - 1].tolist() if len(opens) else ()):
        out[k] = (out[k] or []) + [{"start": a & 0xFFFFFFFF, "lines": b - a}]
    return out


def _without_words(text: str, gone: list[dict]) -> tuple[str, list[int], int, int]:
    """The text without the words in ``gone``, and without lines that lose all their words; the numbers from 0 of
    such lines among all lines; lines with a word; words that went. Signs between words go with the word before them."""
    lines = text.split("\n")
    if not gone:
        return text, [], sum(1 for line in lines if line and not line.isspace()), 0
    sizes = np.array([len(line.split()) for line in lines])
    ends = np.cumsum(sizes)
    drop = np.zeros(ends[-1] + 1, np.int64)
    for g in gone:
        drop[g["start"]] += 1
        drop[g["start"] + g["lines"]] -= 1
    dropped = np.cumsum(drop) > 0
    lost = np.diff(np.concatenate([[0], np.cumsum(dropped)])[np.concatenate([[0], ends])])
    whole, part = (lost > 0) & (lost == sizes), np.flatnonzero((lost > 0) & (lost < sizes))
    for i in part.tolist():
        line, mine = lines[i], dropped[ends[i] - sizes[i]: ends[i]]
        # the rows of words that stay, with the signs before the first and up to the next word
        edges = np.flatnonzero(np.diff(np.concatenate([[True], mine, [True]]).view(np.int8))).tolist()
        found, at, starts = re.finditer(r"\S+", line), 0, []
        for k in edges:
            starts.append(next(islice(found, k - at, None)).start() if k < len(mine) else len(line))
            at = k + 1
        new = line[:len(line) - len(line.lstrip())] + "".join(line[a:b] for a, b in zip(starts[::2], starts[1::2]))
        lines[i] = new.rstrip() if mine[-1] else new
    out = np.flatnonzero(whole).tolist()
    kept = [line for line, went in zip(lines, whole.tolist()) if not went] if out else lines
    return "\n".join(kept), out, int((sizes > 0).sum()), int(dropped.sum())


def _without(text: str, gone: list[dict]) -> tuple[str, list[int], int]:
    """The text without the lines in ``gone``; their numbers from 0 among all lines; lines with a word."""
    lines = text.split("\n")
    filled = [i for i, line in enumerate(lines) if line.split()]
    drop = np.zeros(len(filled) + 1, np.int64)
    for g in gone or ():
        drop[g["start"]] += 1
        drop[g["start"] + g["lines"]] -= 1
    out = [i for i, d in zip(filled, np.cumsum(drop)) if d > 0]
    if not out:
        return text, out, len(filled)
    dropped = set(out)
    return "\n".join(line for i, line in enumerate(lines) if i not in dropped), out, len(filled)


def _joined(df: DataFrame, id_col: str, text_col: str, min_words: int, words: bool = False) -> tuple[DataFrame, str, str]:
    """``df`` with two columns more, of unused names: the id, and the runs to remove."""
    small_batches(df.sparkSession)
    taken = {c.lower() for c in df.columns}
    key, h, gone, d, x = (next(n + "_" * k for k in range(len(taken) + 1) if n + "_" * k not in taken)
                          for n in ("_key", "_h", "_gone", "_d", "_x"))
    rows = df.withColumn(key, F.col(id_col).cast("long")).withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    docs = rows.select(F.col(key).alias("doc_id"), F.col(h).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = (repeated_words if words else repeated_lines)(docs, min_words).select(F.col("doc_id").alias(d), F.col("h").alias(x), F.col("gone").alias(gone))
    if words:
        found, bits = found.checkpoint(), bits_for(docs, 256, most=24)
        buckets = _buckets(found.select(F.col(x).alias("h")), bits)
        rest = _within(rows, h, buckets, bits, False).withColumn(gone, F.lit(None).cast(found.schema[gone].dataType))
        rows = _within(rows, h, buckets, bits)
    out = rows.join(found, rows[key].eqNullSafe(F.col(d)) & (rows[h] == F.col(x)), "left")
    out = out.select(*[rows[c] for c in df.columns], rows[key], gone)
    return (out.unionByName(rest.select(*df.columns, key, gone)) if words else out), key, gone


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                drop_emptied: bool = True, words: bool = False) -> DataFrame:
    """``df`` with the later copies of repeated line runs taken out of its texts; all its columns stay.

    A run is a row of lines of a document, lines without words aside, that has at least ``min_words`` words in
    all; it is a later copy if the same lines, compared by their words, also stand at an earlier place, in the
    order of id (null last), hash of the text and line. Runs do not go beyond a document. Documents that had words
    and lose them all go, unless ``drop_emptied`` is false. Null and empty texts stay as they are. Repeated rows (equal id and
    text) count as one document, and stay as often as they occur.

    With ``words`` a run is a row of words instead, wherever lines begin and end: the later copies' words go, and with
    them the lines that have no other words.
    """
    joined, key, gone = _joined(df, id_col, text_col, min_words, words)
    at, n = df.columns.index(text_col), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, spans in zip(batch.column(at).to_pylist(), _spans(batch.column(n + 1))):
                if words:
                    new, out, filled, _ = _without_words(text or "", spans)
                else:
                    new, out, filled = _without(text or "", spans)
                texts.append(new if spans else text)
                keep.append(not (drop_emptied and out and len(out) == filled))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:n]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, df.schema)


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines with a word, how many of them are later copies as a whole, their numbers (from 0, among all
    lines, as first-last spans), the SHA-256 of the text that is left, and how many words are later copies."""
    joined, key, gone = _joined(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", MIN_WORDS, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _spans(batch.column(3))):
                new, dropped, filled, lost = _without_words(text or "", spans)
                cuts = [k for k in range(1, len(dropped)) if dropped[k] != dropped[k - 1] + 1]
                named = ",".join(f"{dropped[a]}-{dropped[b - 1]}" for a, b in zip([0, *cuts], [*cuts, len(dropped)]) if dropped)
                out.append((doc, filled, len(dropped), named, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), lost))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["doc_id", "n_lines", "n_deleted", "deleted", "clean_sha256",
                                                  "n_deleted_words"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_deleted long, deleted string, clean_sha256 string, "
                                  "n_deleted_words long")
