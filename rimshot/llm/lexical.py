"""Operator 11: ranked lexical search over norm buckets of impact vectors.

The queries come in blocks of bounded size. For a block, one pass over the texts writes every document's sparse
vector, cut down to the terms of the block, to the checkpoint folder; document frequencies, the number of documents
and their total length are counted from it over all documents, and turn term counts into integer impacts.

Each task then orders the vectors of an Arrow batch by Euclidean length and cuts them into buckets. With a query's
threshold (its tenth best score so far):

- a bucket goes, with all shorter ones, if |query| * |longest vector of the bucket| is below the threshold
  (Cauchy-Schwarz);
- inside, the query's heaviest coordinates are added first; a document goes if that sum and the Cauchy-Schwarz bound
  of its other coordinates stay below the threshold;
- survivors are scored exactly, in 64-bit integers.

Bounds only exclude scores that are certainly below the threshold, so equal scores are all kept for the tie rule.
Thresholds start from the exact scores of the documents with the most query terms, over all partitions.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimshot.llm.registry import query, table
from rimshot.llm.worker import forget, small_batches
from rimshot.session import checkpoint_dir

#: Bytes below 0x80 that are no digit or letter part terms; A-Z count as a-z; all other bytes belong to terms.
_TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
_CHUNK = 1 << 20

#: Most (query, term) entries of a block of queries, unless a single query has more.
BLOCK_ENTRIES = 20_000
BUCKET = 1024  # vectors in a bucket at most
SHORTEST = 0.8  # of the longest vector's length, within a bucket
FOCUS = 6  # coordinates that are looked at first
SEED_SHARE = 0.02  # of the documents, those with the most query terms, give the first thresholds
SALTS = 32

SCHEMA = "item_id long, rank int, doc_id long, score long"
VECTOR_SCHEMA = "doc_id long, n long, cols array<int>, tfs array<long>"
BEST_SCHEMA = "item int, doc_id long, score long"


def term_counts(text: str) -> tuple[int, Counter]:
    """(number of terms, UTF-8 term -> occurrences) of a whole text, split piece by piece."""
    data = text.encode().translate(_TERM_BYTES)
    counts: Counter = Counter()
    n = at = 0
    while at < len(data):
        to = data.find(b" ", at + _CHUNK) if at + _CHUNK < len(data) else -1
        to = len(data) if to < 0 else to
        words = data[at:to].split()
        n += len(words)
        counts.update(words)
        at = to
    return n, counts


@dataclass
class Block:
    """Some queries: their ids, the columns of all their terms, and each query's columns."""

    ids: list = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    queries: list[list[int]] = field(default_factory=list)

    def add(self, item_id, terms: Iterable[bytes]) -> None:
        self.ids.append(item_id)
        self.queries.append([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in sorted(terms)])


def blocks(items: Iterable, most_entries: int = BLOCK_ENTRIES) -> Iterator[Block]:
    """Queries (id, text) with at least one term, dealt into blocks in the order in which they come."""
    block, held = Block(), 0
    for item_id, text in items:
        terms = term_counts(text or "")[1]
        if not terms:
            continue
        if block.ids and held + len(terms) > most_entries:
            yield block
            block, held = Block(), 0
        block.add(item_id, terms)
        held += len(terms)
    if block.ids:
        yield block


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, cols, tfs): the terms of each text, and occurrences of those in ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sizes, cols, tfs = [], [], []
            for text in batch.column(1):
                n, counts = term_counts(text.as_py() or "")
                known = counts.keys() & vocabulary.keys()
                pairs = sorted((vocabulary[t], counts[t]) for t in known)
                sizes.append(n)
                cols.append(np.array([c for c, _ in pairs], np.int32))
                tfs.append(np.array([x for _, x in pairs], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), _lists(cols, pa.int32()), _lists(tfs, pa.int64())],
                ["doc_id", "n", "cols", "tfs"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, VECTOR_SCHEMA)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Scorer:
    """Weights of the block's terms, its queries, and the best rows of each query met so far by a task."""

    queries: list[list[int]]
    weights: np.ndarray
    n_docs: int
    n_terms: int
    k: int
    floor: list[int]  # scores below it cannot be among a query's best k

    def __post_init__(self):
        self.plans = []
        for cols in self.queries:
            c = np.array(cols, np.int64)
            c = c[np.argsort(-self.weights[c], kind="stable")]
            c = c[self.weights[c] > 0]
            w = self.weights[c]
            squares = w.astype(float) ** 2
            self.plans.append((c, w, math.sqrt(squares.sum()), math.sqrt(squares[FOCUS:].sum())))
        self.lengths = np.array([p[2] for p in self.plans])
        self.best: list[list[tuple]] = [[] for _ in self.queries]
        self.least = np.array(self.floor, np.int64)

    def impacts(self, n: np.ndarray, ends: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        m = np.array([10 + (90 * int(x) * self.n_docs) // self.n_terms for x in n], np.int64)
        return (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, np.diff(ends)))

    def add(self, ids: list, n: np.ndarray, ends: np.ndarray, cols: np.ndarray, tfs: np.ndarray) -> None:
        """Score the rows of a batch: ``cols`` and ``tfs`` from ends[r] to ends[r + 1] belong to row r."""
        if not len(cols):
            return
        values = self.impacts(n, ends, tfs)
        row = np.repeat(np.arange(len(ids)), np.diff(ends))
        squares = np.bincount(row, values.astype(float) ** 2, len(ids))
        order = np.argsort(-squares, kind="stable")
        length = np.sqrt(squares[order])
        place = np.empty(len(ids), np.int64)  # of a row in the order of lengths
        place[order] = np.arange(len(ids))
        entry = np.argsort(place[row], kind="stable")
        row, cols, values = place[row][entry], cols[entry], values[entry]
        start = 0
        while start < len(ids) and length[start] > 0:
            stop = min(start + BUCKET, start + int(np.searchsorted(-length[start:], -SHORTEST * length[start], "right")))
            active = np.flatnonzero(self.lengths * length[start] * (1 + 1e-9) >= self.least)
            if not len(active):
                return  # of any query: later buckets hold shorter vectors
            a, b = np.searchsorted(row, [start, stop])
            self._bucket(active, row[a:b] - start, cols[a:b], values[a:b], squares[order[start:stop]], ids, order[start:stop])
            start = stop

    def _bucket(self, active, row, cols, values, squares, ids, names) -> None:
        by_col = np.argsort(cols, kind="stable")
        row, values = row[by_col], values[by_col]
        starts = np.searchsorted(cols[by_col], np.arange(len(self.weights) + 1))
        exact = np.empty(len(squares), np.int64)
        for q in active:
            c, w, _, rest_length = self.plans[q]
            least = self.least[q]
            exact[:] = 0
            rest = squares.copy()
            for t, x in zip(c[:FOCUS], w[:FOCUS]):
                a, b = starts[t], starts[t + 1]
                exact[row[a:b]] += x * values[a:b]
                rest[row[a:b]] -= values[a:b].astype(float) ** 2
            bound = (exact + rest_length * np.sqrt(np.maximum(rest, 0))) * (1 + 1e-9) + 1
            survivors = np.flatnonzero(bound >= least)
            if not len(survivors):
                continue
            for t, x in zip(c[FOCUS:], w[FOCUS:]):
                a, b = starts[t], starts[t + 1]
                exact[row[a:b]] += x * values[a:b]
            scores = exact[survivors]
            good = scores >= max(least, 1)
            if good.any():
                self._offer(q, scores[good], [ids[r] for r in names[survivors[good]]])

    def _offer(self, q: int, scores: np.ndarray, ids: list) -> None:
        rows = [(-int(s), d is None, d or 0) for s, d in zip(scores, ids)]
        self.best[q] = heapq.nsmallest(self.k, self.best[q] + rows)
        if len(self.best[q]) == self.k:
            self.least[q] = max(self.least[q], -self.best[q][-1][0])


def _best_rows(found: DataFrame, make: dict, floor: list[int]) -> DataFrame:
    """Each task's best k rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = Scorer(floor=floor, **make)
        for batch in batches:
            lists, tfs = batch.column(2), batch.column(3)
            ends = lists.offsets.to_numpy()
            scorer.add(batch.column(0).to_pylist(), batch.column(1).to_numpy(), ends - ends[0],
                       lists.flatten().to_numpy(), tfs.flatten().to_numpy())
        rows = [(q, None if none else d, -s) for q, best in enumerate(scorer.best) for s, none, d in best]
        q, d, s = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())],
                                         ["item", "doc_id", "score"])

    return found.mapInArrow(run, BEST_SCHEMA)


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item, first within salted parts of it, then among what these leave."""
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*by)))
             .filter(F.col("rank") <= k).drop("rank", "_salt"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: Block, k: int, id_col: str, text_col: str) -> DataFrame | None:
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/lexical-{uuid.uuid4().hex}"
    vectors(docs, block.vocabulary, id_col, text_col).write.parquet(path)
    found = spark.read.schema(VECTOR_SCHEMA).parquet(path)
    n_docs, n_terms, cut = found.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)),
        F.percentile_approx(F.size("cols"), 1 - SEED_SHARE, 1000)).first()
    if not n_docs:
        return None
    weights = np.zeros(len(block.vocabulary), np.int64)
    # no more rows than the block has terms
    for r in found.select(F.explode("cols").alias("col")).groupBy("col").count().collect():
        weights[r["col"]] = term_weight(n_docs, r["count"])
    make = {"queries": block.queries, "weights": weights, "n_docs": n_docs, "n_terms": n_terms, "k": k}
    none = [1] * len(block.ids)
    # one number for each query of the block
    seeds = _top(_best_rows(found.filter(F.size("cols") >= max(cut, 1)), make, none), k)
    floor = list(none)
    for r in seeds.filter(F.col("rank") == k).select("item", "score").collect():
        floor[r["item"]] = r["score"]
    best = _top(_best_rows(found.filter(F.size("cols") > 0), make, floor), k)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0.

    Equal scores rank by ascending doc_id, null ids last. Null and empty texts have no terms: such documents count
    for nothing, such items give no rows. Every row of ``docs`` is a document of its own, repeated ids too; repeated
    (id, text) rows of ``items`` are one item, rows of one id with different texts are ranked each for itself.
    Without documents or items the result is empty. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    queries = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).distinct().orderBy("i", "t")
    result = None
    for block in blocks(((r["i"], r["t"]) for r in queries.toLocalIterator()), block_entries):
        rows = _search_block(docs, block, k, id_col, text_col)
        if rows is not None:
            result = rows if result is None else result.unionByName(rows)
    return spark.createDataFrame([], SCHEMA) if result is None else result


ORACLE = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
tf as (select doc_id, term, count(*) as tf from words group by all),
doc as (select doc_id, sum(tf)::bigint as n from tf group by all),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from doc),
weight as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, total group by term, n_docs),
item as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
scored as (
  select item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::bigint as score
  from item join tf using (term) join weight using (term) join doc using (doc_id), total
  group by item_id, doc_id),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
  from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


@query("op11_lexical_search", ORACLE)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
