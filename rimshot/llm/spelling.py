"""Operator 12: spelling variants by a dictionary of trie-node pairs.

Words are sorted over all partitions, forwards and (for suffixes) reversed. A scan of a sorted partition numbers the
nodes of the trie: a word shares the nodes of its common prefix with the word before it, the others get the next
numbers. What a partition has in common with the one before it is handed on: the last word's nodes of each partition
come to the driver (one row a partition), which tells the next partition the numbers of the shared prefix. So every
prefix and every suffix has one number, without a lookup by text.

Leaving out position i of a word gives the pair (node of the prefix before i, node of the suffix behind i); a place
between two letters, with nothing left out, gives such a pair too. Two words differ by one replaced letter if they
share a pair of the first sort, by one inserted letter if a pair of the first sort of the longer is a pair of the second
sort of the shorter. A pair fixes all letters but one, so it has at most one word for each letter of the alphabet, and
one more. Leaving out any letter of a run of equal ones gives the same word: only the last of a run counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.llm.registry import query, table
from rimshot.llm.worker import forget, small_batches
from rimshot.session import checkpoint_dir

#: In Latin-1: letters stay, A-Z become a-z, all other characters part words. What Latin-1 lacks is written as "?".
_LETTERS = bytes(b if b >= 0xC0 else ord(chr(b).lower()) if b < 0x80 and chr(b).isalpha() else 0x20 for b in range(256))
_CHUNK = 1 << 20
MOST_COUNTS = 400_000  # different words that a task holds before it hands them on

COUNT_SCHEMA = "word string, n long"
NODE_SCHEMA = "word string, n long, nodes array<long>"
_PART_BITS = 40  # node numbers of one partition


def misspelt(run: bytes, id_sum: int, rate: int) -> bytes:
    """The run (Latin-1, lower case), without one letter if ``rate`` divides the checksum of ``<id>:<run>``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), id_sum)
    if h % rate:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def runs(text: str) -> Iterator[list[bytes]]:
    """The runs of letters of a whole text, some at a time."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + _CHUNK) if at + _CHUNK < len(data) else -1
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, rate: int = 199) -> DataFrame:
    """(word, n): results of at least ``least_chars`` letters and their occurrences over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                id_sum = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in runs(text.as_py() or ""):
                    for w, n in Counter(part).items():
                        if len(w) >= least_chars:
                            w = misspelt(w, id_sum, rate)
                            if len(w) >= least_chars:
                                total[w] += n
                if len(total) > MOST_COUNTS:
                    yield rows()
        yield rows()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, COUNT_SCHEMA).groupBy("word").agg(F.sum("n").alias("n"))


# --- numbering of trie nodes --------------------------------------------------------------------------------

def number_nodes(word: str, before: str, nodes: list[int], following: int) -> tuple[list[int], int]:
    """Numbers of the word's prefixes, from the empty one on, and the next free number; ``nodes`` are those of
    ``before``, the word ahead in the order."""
    shared = min(len(commonprefix((before, word))) + 1, len(nodes))
    fresh = len(word) + 1 - shared
    return nodes[:shared] + list(range(following, following + fresh)), following + fresh


def _scan(batches: Iterator[pa.RecordBatch], inherited: dict[int, list[int]]) -> Iterator[tuple]:
    """(partition, words, counts, nodes) of a sorted partition's batches. The first word takes numbers for all its
    prefixes, whether it inherits some or not, so that numbers do not depend on what is inherited."""
    before = None
    for batch in batches:
        words, numbers = batch.column(0).to_pylist(), []
        for w in words:
            if before is None:
                part = batch.column(2)[0].as_py()
                nodes, following = number_nodes(w, "", [], part << _PART_BITS)
                known = inherited.get(part, [])
                nodes = known + nodes[len(known):]
            else:
                nodes, following = number_nodes(w, before, nodes, following)
            before = w
            numbers.append(nodes)
        if words:
            yield part, words, batch.column(1), numbers


def with_nodes(words: DataFrame) -> DataFrame:
    """(word, n, nodes) of distinct words: the number of each prefix's node in the trie of all words.

    Numbers ascend in the order of the words (by code points), the last one of a word belongs to no other word.
    """
    ordered = (words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
               .withColumn("part", F.spark_partition_id()).checkpoint())

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for part, words, _, numbers in _scan(batches, {}):
            first = words[0] if first is None else first
            last = (part, first, words[-1], numbers[-1])
        if last:
            kinds = (pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(last, kinds)], ["part", "first", "last", "nodes"])

    # one row for each partition: what it shares with the next one
    inherited: dict[int, list[int]] = {}
    before, nodes = "", [0]
    for r in sorted(ordered.mapInArrow(edges, "part int, first string, last string, nodes array<long>").collect()):
        shared = min(len(commonprefix((before, r["first"]))) + 1, len(nodes))
        inherited[r["part"]] = nodes[:shared]
        # of the last word's nodes, those of a prefix that the first word has too may come from before
        common = min(len(commonprefix((r["first"], r["last"]))) + 1, shared)
        nodes = nodes[:common] + r["nodes"][common:]
        before = r["last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, counts, numbers in _scan(batches, inherited):
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), counts, pa.array(numbers, pa.list_(pa.int64()))],
                                             ["word", "n", "nodes"])

    return ordered.mapInArrow(run, NODE_SCHEMA)


# --- pairs ----------------------------------------------------------------------------------------------------

def dictionary(words: DataFrame) -> DataFrame:
    """(id, word, n, prefix, suffix): words with the node numbers of their prefixes and suffixes by length.

    ``id`` is the node of the whole word; ids ascend with the words.
    """
    forward = with_nodes(words).withColumnRenamed("nodes", "prefix")
    backward = (with_nodes(words.select(F.reverse("word").alias("word"), "n"))
                .select(F.reverse("word").alias("word"), F.col("nodes").alias("suffix")))
    return forward.join(backward, "word").select(F.element_at("prefix", -1).alias("id"), "word", "n", "prefix", "suffix").checkpoint()


def pairs(words: DataFrame) -> DataFrame:
    """(p, s, neg_n, id, skips, counts): the node pairs of each word.

    ``skips`` tells pairs that leave out a letter; ``counts`` those of them that leave out the last of a run.
    """
    size = F.length("word")

    def skip(i: Column) -> Column:
        here, behind = F.substring("word", i + 1, F.lit(1)), F.substring("word", i + 2, F.lit(1))
        return F.struct(F.get("prefix", i).alias("p"), F.get("suffix", size - 1 - i).alias("s"), F.lit(True).alias("skips"),
                        (here != behind).alias("counts"))

    def gap(i: Column) -> Column:
        return F.struct(F.get("prefix", i).alias("p"), F.get("suffix", size - i).alias("s"), F.lit(False).alias("skips"),
                        F.lit(False).alias("counts"))

    every = F.concat(F.transform(F.sequence(F.lit(0), size - 1), skip), F.transform(F.sequence(F.lit(0), size), gap))
    return words.select("id", (-F.col("n")).alias("neg_n"), F.explode(every).alias("e")).select("e.*", "neg_n", "id")


def nearest(words: DataFrame) -> DataFrame:
    """(id, n_near, best): for words with a near word, how many, and (minus n, id) of the most frequent one.

    A pair's members are at most one for each letter and one more (see above), so they are gathered in an array.
    Every two near words meet in exactly one pair.
    """
    member = F.struct("neg_n", "id", "skips", "counts")
    groups = (pairs(words).groupBy("p", "s").agg(F.sort_array(F.collect_list(member)).alias("all"))
              .filter(F.size("all") > 1).select(F.col("all"), F.explode("all").alias("m")))
    m = F.col("m")
    near = F.filter("all", lambda o: (o["skips"] & m["skips"] & (o["id"] != m["id"]))
                    | (~o["skips"] & m["counts"]) | (~m["skips"] & o["counts"]))
    first = F.get(F.col("near"), F.lit(0))
    return (groups.select(m["id"].alias("id"), near.alias("near")).filter(F.size("near") > 0)
            .select("id", F.size("near").cast("long").alias("size"), F.struct(first["neg_n"].alias("neg_n"), first["id"].alias("id")).alias("first"))
            .groupBy("id").agg(F.sum("size").alias("n_near"), F.min("first").alias("best")))


def variants(counts: DataFrame, least_n: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of (word, n) with at least ``least_n`` occurrences.

    A word's form is its most frequent near word (ties: the first by code points) if that occurs at least ``ratio``
    times as often. Each step to a form multiplies n by ``ratio``, so the way to the root is short: the length is
    bounded by the logarithm of the largest n, and each round below doubles the steps.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = dictionary(counts.filter(F.col("n") >= least_n).checkpoint())
    best = nearest(words)
    best_n = -F.col("best.neg_n")
    linked = (words.select("id", "word", "n").join(best, "id", "left")
              .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                      F.when(best_n >= ratio * F.col("n"), F.col("best.id")).alias("form_id")).checkpoint())
    most = linked.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.floor(math.log(most, ratio) + 1e-9))
    jump = linked.filter(F.col("form_id").isNotNull()).select("id", F.col("form_id").alias("to"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = jump.select(F.col("id").alias("to"), F.col("to").alias("further"))
        jump = jump.join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to")).checkpoint()
    names = linked.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = jump.join(linked.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return (linked.join(names, "form_id", "left").join(roots, "id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6,
                    least_n: int = 5, ratio: int = 5, rate: int = 199) -> DataFrame:
    """``variants`` of the words of all texts; about one in ``rate`` different words of a document loses a letter first.

    Null and empty texts have no words; a null id is written as nothing in the checksum; every row counts, repeated
    ones too; an empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    checkpoint_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    return variants(word_counts(docs, id_col, text_col, least_chars, rate), least_n, ratio)


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))
