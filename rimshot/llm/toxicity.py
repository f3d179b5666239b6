"""Operator 8: toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and the first four letters of its longer words, valued by log(1 + count). Grade 0
is a text labelled clean. Texts labelled toxic are graded 1 to 3 by thirds of how often they use the features that
set the labelled classes apart. The model has one weight for each feature, shared by all grades, and ordered
thresholds: P(grade <= k) = sigmoid(threshold_k - weights * features). Its output is the expected grade, the
severity; a text is rejected from a cut on that is calibrated on held-out labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rimshot.llm.registry import query, table
from rimshot.llm.worker import forget, small_batches

_WORD = re.compile(r"\w+")
PREFIX = 4
GRADES = 3  # of toxic texts
MOST_FEATURES = 4096
SKETCH = 6  # least feature numbers that tell copies
SCHEMA = "doc_id long, severity double, p_toxic double, grade int, rejected boolean"


def _keys(word: str) -> tuple[int, ...]:
    own = xxh64_intdigest(word)
    return (own, xxh64_intdigest("^" + word[:PREFIX])) if len(word) > PREFIX else (own,)


def features(text: str) -> Counter:
    """64-bit feature -> count, of the whole text."""
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for k in _keys(word):
            found[k] += n
    return found


@dataclass
class Severity:
    """Fitted model: feature -> column, weights, ascending thresholds, the cut of the expected grade."""

    columns: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def at_most(self, values: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0, 1, ... (columns) of rows of weights * features."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - values[:, None], -40, 40)))

    def expected(self, values: np.ndarray) -> np.ndarray:
        return (1 - self.at_most(values)).sum(axis=1)

    def value(self, text: str, memo: dict[str, tuple[int, ...]]) -> float:
        """weights * features; ``memo`` holds the model's columns of words met before."""
        counts: dict[int, int] = {}
        for word, n in Counter(_WORD.findall(text.lower())).items():
            hit = memo.get(word)
            if hit is None:
                hit = memo[word] = tuple(c for c in map(self.columns.get, _keys(word)) if c is not None)
                if len(memo) > 150_000:
                    memo.clear()
            for c in hit:
                counts[c] = counts.get(c, 0) + n
        return float(sum(self.weights[c] * np.log1p(n) for c, n in sorted(counts.items())))


def select_features(ids: np.ndarray, rows: np.ndarray, toxic: np.ndarray, most: int = MOST_FEATURES,
                    least_z: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Features whose share of rows differs between the classes, by the root of the log-likelihood ratio statistic
    of ``least_z`` or more, and whether each marks toxic rows. The ``most`` clearest stay; ties go by number."""
    # a class at a time: places of all entries in the features would take several times the entries' memory
    sign = toxic[rows]
    some = [np.unique(ids[sign], return_counts=True), np.unique(ids[~sign], return_counts=True)]
    keys = np.union1d(some[0][0], some[1][0])
    with_toxic, with_clean = np.zeros(len(keys)), np.zeros(len(keys))
    for seen, (own, n) in zip((with_toxic, with_clean), some):
        seen[np.searchsorted(keys, own)] = n
    n_toxic, n_clean = toxic.sum(), (~toxic).sum()
    share = (with_toxic + with_clean) / (n_toxic + n_clean)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))

    g = (part(with_toxic, n_toxic * share) + part(n_toxic - with_toxic, n_toxic * (1 - share))
         + part(with_clean, n_clean * share) + part(n_clean - with_clean, n_clean * (1 - share)))
    z = np.sqrt(2 * np.maximum(g, 0)) * np.where(with_toxic * n_clean > with_clean * n_toxic, 1, -1)
    chosen = np.flatnonzero(np.abs(z) >= least_z)
    chosen = chosen[np.lexsort((keys[chosen], -np.abs(z[chosen])))][:most]
    return keys[chosen], z[chosen] > 0


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_grades: int, steps: int = 300,
                rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model (Adam on all rows)."""
    k = n_grades - 1
    theta = np.concatenate([np.zeros(x.shape[1]), [1.0], np.zeros(k - 1)])  # gaps between thresholds as exponents
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for step in range(1, steps + 1):
        w, first, gaps = theta[: x.shape[1]], theta[x.shape[1]], np.exp(theta[x.shape[1] + 1:])
        t = first + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x @ w
        below = 1 / (1 + np.exp(-np.clip(t[None, :] - z[:, None], -40, 40)))
        cum = np.hstack([np.zeros((len(z), 1)), below, np.ones((len(z), 1))])
        slope = np.hstack([np.zeros((len(z), 1)), below * (1 - below), np.zeros((len(z), 1))])
        row = np.arange(len(z))
        p = np.maximum(cum[row, grade + 1] - cum[row, grade], 1e-9)
        up, low = slope[row, grade + 1] / p, slope[row, grade] / p
        scale = weight / total
        dz = (up - low) * scale
        dt = np.zeros(k)
        np.add.at(dt, np.minimum(grade, k - 1), np.where(grade < k, -up * scale, 0))
        np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, low * scale, 0))
        g = np.concatenate([x.T @ dz + ridge * w, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w, first, gaps = theta[: x.shape[1]], theta[x.shape[1]], np.exp(theta[x.shape[1] + 1:])
    return w, first + np.concatenate([[0.0], np.cumsum(gaps)])


def best_cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The cut (score >= cut is toxic) with the best balanced accuracy; among equals the middle of the widest gap."""
    order = np.sort(np.unique(score))
    cuts = np.concatenate([[order[0]], (order[1:] + order[:-1]) / 2, [order[-1] + 1e-6]])
    gaps = np.concatenate([[0.0], np.diff(order), [0.0]])
    a, b = np.sort(score[toxic]), np.sort(score[~toxic])
    balanced = (len(a) - np.searchsorted(a, cuts)) / max(1, len(a)) + np.searchsorted(b, cuts) / max(1, len(b))
    good = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    return float(cuts[good[np.argmax(gaps[good])]])


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> pa.Table | None:
    """(id, toxic, feature bytes, count bytes) of at most ``sample`` documents of each label, by least hash of the id."""
    spark = docs.sparkSession
    small_batches(spark)
    known = (labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("toxic"))
             .dropna().groupBy("i").agg(F.max("toxic").alias("toxic")))
    picked = []
    for toxic in (True, False):
        of = known.filter((F.col("toxic") > 0) if toxic else (F.col("toxic") <= 0))
        picked += [(r["i"], toxic) for r in of.orderBy(F.xxhash64("i"), "i").limit(sample).collect()]
    if not picked:
        return None
    chosen = spark.createDataFrame(picked, "i long, toxic boolean")
    rows = (docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "i").select("i", "toxic", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids, counts = [], []
            for text in batch.column(2).to_pylist():
                found = sorted(features(text).items())
                ids.append(np.array([k for k, _ in found], np.uint64).tobytes())
                counts.append(np.array([n for _, n in found], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()),
                                              pa.array(counts, pa.binary())], ["i", "toxic", "ids", "counts"])

    # copies would make the words of one text look like signs of its label: of texts with the same label and the
    # same least features one stays; ids may be repeated, so the rows are cut to the sample again
    one = (rows.mapInArrow(run, "i long, toxic boolean, ids binary, counts binary")
           .groupBy("toxic", F.substring("ids", 1, 8 * SKETCH).alias("least"))
           .agg(F.min(F.struct("i", "ids", "counts")).alias("r")))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("r.i"), "r")
    got = (one.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
           .select("r.i", "toxic", "r.ids", "r.counts").toArrow())  # as it is: rows of objects would take several times its memory
    return got.sort_by([("i", "ascending"), ("toxic", "ascending"), ("ids", "ascending")])


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers that the values of a binary column hold, one after another."""
    return np.concatenate([np.frombuffer(b"".join(v.as_buffer() for v in c), kind) for c in column.chunks])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        sample: int = 4000) -> Severity | None:
    """Fit on at most ``sample`` labelled rows of each label; every fourth calibrates the cut.

    A document with several labels is toxic if one says so; labels with nulls do not count. None if a label is
    missing or nothing sets the classes apart.
    """
    rows = _labelled(docs, labels, id_col, text_col, sample)
    if rows is None or not rows.num_rows:
        return None
    toxic = rows["toxic"].to_numpy()
    if toxic.all() or not toxic.any():
        return None
    sizes = np.concatenate([pc.binary_length(c).to_numpy() for c in rows["ids"].chunks]) // 8
    ids, counts = _numbers(rows["ids"], np.uint64), _numbers(rows["counts"], np.uint32)
    del rows
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    held = np.zeros(len(sizes), bool)
    for flag in (True, False):
        held[np.flatnonzero(toxic == flag)[3::4]] = True
    train = ~held
    known = train[row]
    number = np.cumsum(train) - 1
    chosen, marks = select_features(ids[known], number[row[known]], toxic[train])
    if not len(chosen):
        return None
    order = np.argsort(chosen)
    chosen, marks = chosen[order], marks[order]
    at = np.minimum(np.searchsorted(chosen, ids), len(chosen) - 1)
    hit = chosen[at] == ids
    row, counts, at = row[hit], counts[hit], at[hit]
    x = np.zeros((len(sizes), len(chosen)), np.float32)
    x[row, at] = np.log1p(counts)
    # thirds of the marking features' occurrences among the toxic rows are their grades
    use = np.bincount(row, counts * marks[at], len(sizes))
    bounds = np.quantile(use[toxic & train], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(toxic, 1 + (use[:, None] > bounds[None, :]).sum(axis=1), 0)
    weight = np.where(toxic, 0.5 / (toxic & train).sum(), 0.5 / (~toxic & train).sum())
    w, t = fit_ordinal(x[train].astype(np.float64), grade[train], weight[train], GRADES + 1)
    model = Severity(dict(zip(chosen.tolist(), range(len(chosen)))), w, t, 0.5)
    test = held if toxic[held].any() and not toxic[held].all() else train
    model.cut = best_cut(model.expected(x[test] @ w), toxic[test])
    return model


def score(docs: DataFrame, model: Severity | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, grade, rejected) of every whole text.

    ``grade`` is the likeliest grade. Null and empty texts are judged as texts without features; null ids and
    repeated rows are kept; without a model (no labels) nothing is toxic.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        memo: dict = {}
        for batch in batches:
            n = batch.num_rows
            severity, toxic, grade, rejected = np.zeros(n), np.zeros(n), np.zeros(n, np.int32), np.zeros(n, bool)
            if model is not None and n:
                values = np.array([model.value(t or "", memo) for t in batch.column(1).to_pylist()])
                below = model.at_most(values)
                severity, toxic = np.round((1 - below).sum(axis=1), 6), np.round(1 - below[:, 0], 6)
                share = np.diff(np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))]), axis=1)
                grade, rejected = share.argmax(axis=1).astype(np.int32), model.expected(values) >= model.cut
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(toxic), pa.array(grade),
                                              pa.array(rejected)], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Severity | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        memo: dict = {}
        for batch in batches:
            values = np.array([model.value(t or "", memo) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(model.expected(values) < model.cut)) if batch.num_rows else batch

    return docs.mapInArrow(run, docs.schema)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
