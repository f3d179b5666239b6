"""Operator 4: similarity join of shingle sets by PartEnum signatures, and its connected components.

Two sets with a Jaccard coefficient of at least t differ in at most h = (|A| + |B|) (1 - t) / (1 + t) elements.
The domain of shingles is cut into n partitions, with n set by a band of sizes, so that a set has non-empty
partitions in plenty. The h differences spoil at most h of them. In the order of the partitions, the first one
that is not spoilt and not empty is among the first h + 1 non-empty ones of either set, so sets that enumerate
their first h + 1 non-empty partitions, each with the elements in it as a signature, share a signature. A set
whose larger partners fall into the next band enumerates partitions there too.

Shingles that very many texts share would make large groups of equal signatures. They are left out of the
signatures: what is left of two similar sets differs no more than the sets do. A set of which too little is left
for h + 1 non-empty partitions enumerates signatures of all its shingles as well.

Sets with equal signatures are candidates. In rounds, each group of equal signatures gets a leader (first the
set that meets most others, then any), and every set of another component is compared to one of its groups'
leaders, the one that it shares most signatures with. When a round joins little more, all pairs of different components that
share a signature and were not compared yet are looked at, within blocks of a group. Exact bounds (sizes, and the
difference of parity bitmaps) thin out all candidates before their texts meet and the sets are compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql import Window

from rimshot.llm.components import connected_components
from rimshot.llm.registry import query, table
from rimshot.llm.worker import forget, small_batches
from rimshot.llm.shingles import mix, shingle_set
from rimshot.llm.sketch import BucketCounts, bits_for, summed
from rimshot.session import checkpoint_dir

PERCENT = 80
LEAST_BITS = 6          # partitions of the smallest band, as a power of two
FREQUENT = 4            # a frequent shingle's counter is so many times the mean
FREQUENT_LEAST = 32
NARROW = 128            # bytes that a bitmap has at most while pairs are sought
BLOCK = 1024            # sets of a group that are compared in one task
MOST_TURNS = 12         # rounds of comparing to leaders, ended before if fewer than one in
FEW_JOINED = 3          # so many comparisons joins two components; what is left is compared exactly


# --- one set ------------------------------------------------------------------------------------------------

def most_different(size: int, percent: int = PERCENT) -> int:
    """Elements in which a set of ``size`` and a set similar to it can differ at most."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


def bands(size: int, percent: int = PERCENT) -> list[int]:
    """The set's band, as the number of bits of its partitions, and the next if a similar larger set is there."""
    def band(n: int) -> int:
        return max(LEAST_BITS, (2 * n // 3).bit_length() - 1)

    own, above = band(size), band(size * 100 // percent)
    return [own] if own == above else [own, above]


def _partition_signatures(s: np.ndarray, bits: int, most: int, salt: int) -> np.ndarray:
    """Signatures of the first ``most`` non-empty partitions: the top bits of a (sorted) hash are its partition."""
    part = s >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    end = starts[most] if len(starts) > most else len(s)
    starts = starts[:most]
    return mix(np.add.reduceat(mix(s[:end]), starts) ^ mix((part[starts] << np.uint64(8)) + np.uint64(2 * bits + salt)))


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a sorted set of hashes; ``frequent`` tells frequent ones by their low bits."""
    if not len(s):
        return np.empty(0, np.uint64)
    most = most_different(len(s), percent)
    rare = s[~frequent[(s & np.uint64(len(frequent) - 1)).astype(np.int64)]]
    out = []
    for bits in bands(len(s), percent):
        if len(rare):
            out.append(_partition_signatures(rare, bits, most + 1, 0))
        if len(out) == 0 or len(out[-1]) <= most or not len(rare):
            full = _partition_signatures(s, bits, most + 1, 1)
            out.append(full)
            if len(full) <= most:  # even the whole set may have no unspoilt partition
                out.append(mix(np.array([0x5EED0000 + bits], np.uint64)))
    return np.concatenate(out)


def content_id(s: np.ndarray) -> int:
    """64-bit digest of a set, as a signed number."""
    d = xxhash.xxh64_intdigest(s.tobytes())
    return d - (1 << 64) if d >= 1 << 63 else d


# --- passes over the texts ----------------------------------------------------------------------------------

def _ids_and_counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    forget()
    counts = BucketCounts(bits)
    seen: set[int] = set()  # copies within the task count once
    names = ["doc_id", "n", "c", "block", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        sizes, ids, held, n_held = [], [], [], 0
        for text in batch.column(1).to_pylist():
            s = shingle_set(text)
            sizes.append(len(s))
            ids.append(content_id(s))
            if ids[-1] in seen:
                continue
            seen.add(ids[-1])
            held.append(s)
            n_held += len(s)
            if n_held > 1_000_000:
                counts.add(np.concatenate(held))
                held, n_held = [], 0
        if held:
            counts.add(np.concatenate(held))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, kinds[1]), pa.array(ids, kinds[2]),
                                          pa.nulls(n, kinds[3]), pa.nulls(n, kinds[4])], names)
    for block, raw in counts.rows():
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, kinds[2]),
                                          pa.array([block], kinds[3]), pa.array([raw], kinds[4])], names)


def _signature_rows(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    frequent = np.unpackbits(frequent).astype(bool)
    seen: set[int] = set()  # copies within the task give their signatures once
    for batch in batches:
        ids, sigs, held = [], [], 0

        def rows() -> pa.RecordBatch:
            flat = np.concatenate(sigs).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in sigs])), pa.array(flat)], ["c", "sig"])

        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingle_set(text)
            c = content_id(s)
            if doc is None or not len(s) or c in seen:
                continue
            seen.add(c)
            ids.append(c)
            sigs.append(signatures(s, frequent, percent))
            held += len(sigs[-1])
            if held > 500_000:
                yield rows()
                ids, sigs, held = [], [], 0
        if ids:
            yield rows()


_TEXTS = "doc_id long, c long, size long, bitmap binary, text string"


def _candidate_rows(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts whose id may be wanted, with what tells candidates apart; copies within the task once."""
    wanted = np.unpackbits(wanted).astype(bool)
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        docs = batch.column(0)
        keep = wanted[(mix(docs.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64(len(wanted) - 1)).astype(np.int64)]
        keep &= docs.is_valid().to_numpy(zero_copy_only=False)
        some = batch.filter(pa.array(keep))
        out = []
        for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
            s = shingle_set(text)
            c = content_id(s)
            if (doc, c) not in seen:
                seen.add((doc, c))
                out.append((doc, c, len(s), parity(s), text))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)],
                                             [f.split()[0] for f in _TEXTS.split(", ")])


def _id_counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    counts = BucketCounts(bits)
    for batch in batches:
        counts.add(mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)))
    for block, raw in counts.rows():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([raw], pa.binary())], ["block", "counts"])


# --- candidates and links -----------------------------------------------------------------------------------

def parity(s: np.ndarray) -> bytes:
    """Bitmap of a set: every element flips one of 2**k bits, more than four times as many bits as elements. Two
    sets differ in at least as many elements as their bitmaps differ in bits."""
    e = mix(s)
    width = max(64, 1 << (4 * len(s)).bit_length())
    odd = np.bincount((e & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bitmap: bytes, width: int) -> np.ndarray:
    """The bitmap of the same set with ``width`` bytes: bit i of the wider one is bit i modulo the lesser width."""
    m = np.frombuffer(bitmap, np.uint8)
    return np.bitwise_xor.reduce(m.reshape(-1, width), axis=0)


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [folded(m, min(NARROW, len(m))).tobytes() for m in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["c", "size", "bitmap"])


def _plausible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sizes, bitmaps) that the bounds allow."""
    for batch in batches:
        a, b = [], []
        for x, y, n, m, p, q in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if 100 * min(n, m) < percent * max(n, m):
                continue
            width = min(len(p), len(q))
            different = int(np.bitwise_count(folded(p, width) ^ folded(q, width)).sum(dtype=np.int64))
            if different * (100 + percent) <= (n + m) * (100 - percent):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, texts) whose sets are similar. Sorted joins keep a text's pairs together, so few sets are held."""
    held: dict[int, np.ndarray] = {}

    def of(c: int, text: str) -> np.ndarray:
        if c not in held:
            if len(held) >= 32:
                held.pop(next(iter(held)))
            held[c] = shingle_set(text)
        return held[c]

    for batch in batches:
        a, b = [], []
        for x, y, p, q in zip(*(batch.column(i).to_pylist() for i in range(4))):
            s, t = of(x, p), of(y, q)
            i = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * i >= percent * (len(s) + len(t) - i):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _similar(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; ``known`` has (c, size, bitmap, text). Bitmaps and then texts are
    joined to one side of the pairs after the other; a set with very many partners is a skewed key of an equi-join."""
    def on(frame: DataFrame, side: str, *columns: str) -> DataFrame:
        own = known.select(F.col("c").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        return frame.join(own, side)

    maps = on(on(pairs, "b", "size", "bitmap"), "a", "size", "bitmap").select("a", "b", "size_a", "size_b", "bitmap_a", "bitmap_b")
    near = maps.mapInArrow(lambda x: _plausible(x, percent), "a long, b long")
    texts = on(on(near, "b", "text"), "a", "text").select("a", "b", "text_a", "text_b")
    return texts.mapInArrow(lambda x: _compared(x, percent), "a long, b long")


def _left_over(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of different components within sorted runs of one (sig, p, q), as far as exact bounds allow them."""
    last, held = None, []

    def pairs(rows: list[tuple]) -> tuple[list[int], list[int]]:
        # rows: (c, component, block, size, bitmap); of two blocks only pairs across them
        size = np.array([r[3] for r in rows])
        comp = np.array([r[1] for r in rows])
        block = np.array([r[2] for r in rows])
        c = np.array([r[0] for r in rows])
        width = min(NARROW, min(len(r[4]) for r in rows))
        maps = np.stack([folded(r[4], width) for r in rows])
        across = len(set(block.tolist())) > 1
        a, b = [], []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            ok = (comp[j] != comp[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))
            if across:
                ok &= block[j] != block[i]
            j = j[ok]
            if len(j):
                different = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
                j = j[different * (100 + percent) <= (size[j] + size[i]) * (100 - percent)]
                a += [int(min(c[i], x)) for x in c[j]]
                b += [int(max(c[i], x)) for x in c[j]]
        return a, b

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b = pairs(rows) if len(rows) > 1 else ([], [])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for sig, p, q, *row in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if last != (sig, p, q):
                yield from out(held)
                last, held = (sig, p, q), []
            held.append(tuple(row))
    yield from out(held)


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (sig, c, component, size, bitmap) dealt to pairs of blocks (p, q): every pair of rows of a signature
    meets, in tasks of at most two blocks."""
    n = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (rows.join(n, "sig").withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return dealt.select("sig", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                        "c", "component", "block", "size", "bitmap")


def _known_texts(docs: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, size, bitmap, text) of every set in ``groups``, once, as a table in the checkpoint folder.

    A bitmap of the wanted ids, of at most 64 MB whatever the data, spares most other texts the shuffle.
    """
    asked = groups.select("c").distinct().join(nodes, "c").checkpoint()
    bits = min(29, max(16, (16 * asked.count()).bit_length()))
    wanted = np.packbits(summed(asked.select("rep").mapInArrow(lambda b: _id_counts(b, bits), "block int, counts binary"), bits, 1))
    rows = (docs.mapInArrow(lambda b: _candidate_rows(b, wanted), _TEXTS)
            .join(asked.select("c", F.col("rep").alias("doc_id")), ["c", "doc_id"])
            .dropDuplicates(["c", "doc_id"]).drop("doc_id"))
    path = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/texts-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def with_content(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with a column ``name`` more: the id of each text's set of shingles."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([content_id(shingle_set(t)) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    content: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see the module for the method.

    With ``content`` two columns more: ``c``, the id of the row's set (as in ``with_content``), and ``component``, which
    names its group of linked sets (null without shingles or id); groups that share a doc_id have names of their own.

    ``component_id`` is the smallest doc_id that links lead to, the row's own included. Null texts and texts
    without words have no shingles and no links. Rows with a null id have no component and link nothing. Rows of
    one id with different texts are judged each by its text; repeated rows each give a row.
    Shingles and sets are told apart by 64-bit hashes.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    sketch = bits_for(docs)
    first = docs.mapInArrow(lambda b: _ids_and_counts(b, sketch), "doc_id long, n long, c long, block int, counts binary").checkpoint()
    rows = first.filter(F.col("block").isNull()).select("doc_id", "n", "c")
    linked = rows.filter("n > 0 and doc_id is not null")
    total = linked.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT_LEAST, FREQUENT * total >> sketch)
    frequent = np.packbits(summed(first.filter(F.col("block").isNotNull()), sketch, least))
    nodes = linked.groupBy("c").agg(F.min("doc_id").alias("rep"))

    sigs = docs.mapInArrow(lambda b: _signature_rows(b, frequent, percent), "c long, sig long")
    same = Window.partitionBy("sig").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = (sigs.select("sig", "c", F.min("c").over(same).alias("low"), F.max("c").over(same).alias("high"))
              .filter("low < high").select("sig", "c").distinct().checkpoint())
    known = _known_texts(docs, groups, nodes)

    of = spark.createDataFrame([], "node long, component long")

    def component(frame: DataFrame) -> DataFrame:
        return (frame.join(of.withColumnRenamed("node", "c"), "c", "left")
                .withColumn("component", F.coalesce("component", "c")))

    def joined(edges: DataFrame) -> DataFrame:
        """``of`` after links between sets, given as pairs of their ids."""
        up = edges
        for side in ("a", "b"):
            up = component(up.withColumnRenamed(side, "c")).drop("c").withColumnRenamed("component", side)
        top = connected_components(up)
        moved = of.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select(
            "node", F.coalesce("top", "component").alias("component"))
        return moved.unionByName(top.join(of, "node", "left_anti")).checkpoint()

    def unsettled() -> DataFrame:
        """The groups that hold several components, with them."""
        placed = component(groups)
        several = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("sig")
        return placed.join(several, "sig")

    tested = None
    for turn in range(MOST_TURNS):
        open_rows = unsettled().checkpoint() if turn else groups.withColumn("component", F.col("c"))
        if turn:
            rank = F.struct(F.xxhash64("c", F.lit(turn)).alias("r"), F.col("c"))
            ranked = open_rows
        else:  # the set that meets most others comes first: in a group of copies the one that the others vary
            sizes = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
            degree = groups.join(sizes, "sig").groupBy("c").agg(F.sum("n").alias("degree"))
            rank = F.struct("degree", "c")
            ranked = open_rows.join(degree, "c")
        leaders = ranked.groupBy("sig").agg(F.max_by(F.struct("c", "component"), rank).alias("leader"))
        shared = (open_rows.join(leaders, "sig").filter(F.col("component") != F.col("leader.component"))
                  .groupBy(F.col("c"), F.col("leader.c").alias("leader")).agg(F.count(F.lit(1)).alias("n")))
        pairs = shared.select(F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b"), "c", "n", "leader")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = (pairs.groupBy("c").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader"))
                 .select(F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b")).distinct().checkpoint())
        edges = _similar(pairs, known, percent).checkpoint()
        tested = pairs if tested is None else tested.unionByName(pairs)
        n_edges = edges.count()
        if n_edges:
            of = joined(edges)
        if FEW_JOINED * n_edges < pairs.count():
            break

    left = unsettled().checkpoint()
    if not left.isEmpty():
        narrow = known.select("c", "size", "bitmap").mapInArrow(_narrowed, "c long, size long, bitmap binary")
        dealt = _blocked(left.join(narrow, "c"))
        met = (dealt.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q")
               .mapInArrow(lambda b: _left_over(b, percent), "a long, b long").distinct())
        edges = _similar(met.join(tested, ["a", "b"], "left_anti"), known, percent).checkpoint()
        if not edges.isEmpty():
            of = joined(edges)

    named = component(nodes)
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = named.join(least_id, "component").select("c", "component_id", *(["component"] if content else []))
    linked_row = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return (rows.join(found, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        *(["c", F.when(linked_row, F.col("component")).alias("component")] if content else [])))


ORACLE = r"""
with recursive t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from t),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [words]
      else list_distinct(list_transform(range(1, len(words) - 3), lambda i: words[i : i + 4])) end as shingles from w),
n as (select doc_id, len(shingles) as n_shingles from s),
e as (select doc_id, unnest(shingles) as shingle from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
links as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b
          where 100 * i >= 80 * (x.n_shingles + y.n_shingles - i)),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join links l on l.a = r.b)
select n.doc_id, n.n_shingles::bigint as n_shingles, min(reach.b) as component_id
from n join reach on reach.a = n.doc_id group by all
"""


@query("op4_ngram_jaccard", ORACLE)
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
