"""Operator 9: secret scan, by patterns and by a character convolutional network over every candidate.

One pass over the texts finds the pattern findings and all candidates (long tokens with a digit, and their
surroundings) and writes them, a row for each document, to the checkpoint folder. Candidates inside a pattern
finding are the labelled positives, all others the negatives. The network (numpy in tasks) is trained on all candidates
but a fourth, chosen by the hash of their contexts, in shards: in each epoch every shard goes on from the common
weights, and the mean of what the shards come to is the next common weights. All of the fourth that it was not trained
on calibrate it, and its threshold is the largest that keeps the wanted recall there. To the driver come only sums, one
for each weight. A second pass, over the candidates alone, scores them all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.llm.registry import query, table
from rimshot.llm.worker import forget, small_batches
from rimshot.operators.selection import at_ranks
from rimshot.session import checkpoint_dir

KINDS = ("assign", "access", "hex", "cnn")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run that is shorter fails whole, so the least length can stand here
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_DIGIT = re.compile(r"[0-9]")
_KEYS = ("passw", "secret", "token", "api")

#: Code points before the candidate, and from its start on, that the network sees.
BEFORE, AFTER = 20, 44

FOUND_SCHEMA = ("doc_id long, base array<struct<kind:int,start:long,end:long>>, "
                "candidates array<struct<start:long,end:long,context:string,label:int>>")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern findings by start, then kind."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        found += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, context, label) of every long token with a digit; label 1 if it touches a pattern finding."""
    if not _DIGIT.search(text):
        return []
    out = []
    for m in _CANDIDATE.finditer(text):
        if _DIGIT.search(m[0]):
            a, b = m.span()
            label = int(any(s < b and a < e for _, s, e in base))
            out.append((a, b, text[max(0, a - BEFORE): a].rjust(BEFORE, "\0") + text[a: a + AFTER], label))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("context", pa.string()), ("label", pa.int32())]))
    for batch in batches:
        bases, cands = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            bases.append([dict(zip(("kind", "start", "end"), s)) for s in base])
            cands.append([dict(zip(("start", "end", "context", "label"), c)) for c in candidates(text or "", base)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, _SPANS), pa.array(cands, cand)],
                                         ["doc_id", "base", "candidates"])


# --- the network --------------------------------------------------------------------------------------------

N_SYMBOLS = 96  # printable ASCII, one for padding and one for all else
_LOOKUP = np.full(128, 95, np.int64)
_LOOKUP[32:126] = np.arange(94)
_LOOKUP[0] = 94


def symbols(contexts: list[str]) -> np.ndarray:
    """Symbol numbers (rows of BEFORE + AFTER) of contexts; shorter ones are padded."""
    width = BEFORE + AFTER
    flat = "".join(c[:width].ljust(width, "\0") for c in contexts)
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _LOOKUP[np.minimum(points, 127)], 95).reshape(-1, width)


class CharCnn:
    """Embedding, one convolution with a rectifier, the greatest and mean response of each filter, one output."""

    def __init__(self, seed: int = 7, dim: int = 8, filters: int = 24, span: int = 5):
        rng = np.random.default_rng(seed)
        self.span = span
        self.p = {
            "embed": rng.normal(0, 0.3, (N_SYMBOLS, dim)),
            "conv": rng.normal(0, (span * dim) ** -0.5, (span * dim, filters)),
            "shift": np.zeros(filters),
            "out": rng.normal(0, filters ** -0.5, 2 * filters),
            "bias": np.zeros(1),
        }
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple:
        p, n, w = self.p, len(x), x.shape[1] - self.span + 1
        e = p["embed"][x]
        cols = np.concatenate([e[:, k: k + w] for k in range(self.span)], axis=2)
        a = np.maximum(cols @ p["conv"] + p["shift"], 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        return pooled @ p["out"] + p["bias"][0], pooled, a, top, cols, w, n

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i: i + 512])[0] for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.empty(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.offset, -50, 50)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the logistic loss, classes weighted to equal sums."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        state = self.begin()
        for _ in range(epochs):
            self.epoch(state, x, y, weight, rng.permutation(len(x)), batch, rate)

    def begin(self) -> dict:
        """Adam's state before the first step."""
        return {"step": 0.0, "mean": {k: np.zeros_like(v) for k, v in self.p.items()},
                "square": {k: np.zeros_like(v) for k, v in self.p.items()}}

    def epoch(self, state: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray, batch: int = 64,
              rate: float = 0.01) -> None:
        """Adam over the rows once, in this order."""
        m, v2 = state["mean"], state["square"]
        for i in range(0, len(x), batch):
            state["step"] += 1
            for k, g in self._gradient(x[order[i: i + batch]], y[order[i: i + batch]], weight[order[i: i + batch]]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** state["step"])) / (np.sqrt(v2[k] / (1 - 0.999 ** state["step"])) + 1e-8)

    def packed(self, state: dict) -> np.ndarray:
        """The weights and Adam's state (squares by their roots) as one row of numbers."""
        parts = [*self.p.values(), *state["mean"].values(), *[np.sqrt(v) for v in state["square"].values()]]
        return np.concatenate([*[v.ravel() for v in parts], [state["step"]]])

    def unpack(self, flat: np.ndarray) -> dict:
        """Take the weights of a packed row; Adam's state in it."""
        sizes = [v.size for v in self.p.values()]
        parts = iter(np.split(flat[:-1], np.cumsum(sizes * 3)[:-1]))
        taken = [{k: next(parts).reshape(v.shape) for k, v in self.p.items()} for _ in range(3)]
        self.p = taken[0]
        return {"step": float(flat[-1]), "mean": taken[1], "square": {k: v * v for k, v in taken[2].items()}}

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z, pooled, a, top, cols, w, n = self.forward(x)
        dz = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        filters = p["conv"].shape[1]
        dpool = dz[:, None] * p["out"]
        da = np.repeat(dpool[:, None, filters:] / w, w, axis=1)
        np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dpool[:, None, :filters], 1)
        da *= a > 0
        dcols = da @ p["conv"].T
        dim = p["embed"].shape[1]
        de = np.zeros((n, x.shape[1], dim))
        for k in range(self.span):
            de[:, k: k + w] += dcols[:, :, k * dim: (k + 1) * dim]
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, x.ravel(), de.reshape(-1, dim))
        return {"embed": embed, "conv": np.tensordot(cols, da, ((0, 1), (0, 1))), "shift": da.sum((0, 1)),
                "out": pooled.T @ dz, "bias": np.array([dz.sum()])}

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Logistic scaling of the logits; the threshold is the largest with the wanted recall, 0.5 at most.

        Both classes count alike in the scaling, so that 0.5 does not depend on how many of each there are.
        """
        z = self.logits(x)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        target = np.where(y == 1, HIGH, 1 - HIGH)

        def sums(scale: float, offset: float) -> tuple:
            q = 1 / (1 + np.exp(-np.clip(scale * z + offset, -50, 50)))
            r = weight * q * (1 - q) + 1e-12
            return (weight * (q - target) * z).sum(), (weight * (q - target)).sum(), (r * z * z).sum(), (r * z).sum(), r.sum()

        self.scale, self.offset = scaling(sums)
        good = np.sort(self.probability(x)[y == 1])
        if len(good):
            self.threshold = float(min(0.5, good[int(np.floor((1 - recall) * len(good)))]))


HIGH = 1 - 1e-3  # targets short of 0 and 1 keep the scale finite when the classes are apart


def scaling(sums: Callable[[float, float], tuple]) -> tuple[float, float]:
    """(scale, offset) of least weighted log loss, by Newton steps with a ridge; ``sums`` gives at (scale, offset) the
    gradient (2) and the curvature (3) over all rows."""
    scale, offset = 1.0, 0.0
    for _ in range(30):
        gz, g, hzz, hz, h = sums(scale, offset)
        move = np.clip(np.linalg.solve(np.array([[hzz + 1e-4, hz], [hz, h + 1e-6]]), np.array([gz + 1e-4 * (scale - 1), g])), -1, 1)
        scale, offset = scale - move[0], offset - move[1]
        if np.abs(move).max() < 1e-10:
            break
    # rounded, so that the order in which rows are summed does not show
    return round(float(max(scale, 1e-3)), 9), round(float(offset), 9)


SHARD = 8192  # candidates that one task goes through, one batch after another, in an epoch
LEAST = 64  # candidates of each label that every shard sees, if there are as many
EPOCHS = 12


def fit(found: DataFrame, recall: float = 0.98) -> CharCnn | None:
    """Train on all candidates but those whose context falls, by its hash, into one fourth; all of that fourth
    calibrate. If either part lacks a label, all candidates train and calibrate. None if a label has no candidate.

    Shards are dealt by hash and sorted, and the means of the shards are taken over decimals, so any order and
    partitioning of the rows gives the same network. Candidates of a label that is rare for the number of shards go to
    several shards each, with their weight divided.
    """
    checkpoint_dir(found.sparkSession)
    c = found.select("doc_id", F.explode("candidates").alias("c")).select(
        F.xxhash64("doc_id", "c.start", "c.context").alias("h"), "c.context", "c.label",
        (F.pmod(F.xxhash64("c.context"), F.lit(4)) == 0).alias("held")).checkpoint()
    n = {(r["held"], r["label"]): r["count"] for r in c.groupBy("held", "label").count().collect()}
    if any(not n.get((False, y), 0) + n.get((True, y), 0) for y in (0, 1)):
        return None
    learned, tested = c, c
    if len(n) == 4:
        learned, tested = c.filter(~F.col("held")), c.filter("held")
    each = [n.get((False, y), 0) + (n.get((True, y), 0) if len(n) < 4 else 0) for y in (0, 1)]
    net = _trained(learned, each)
    _calibrated(net, tested, recall)
    return net


def _trained(c: DataFrame, each: list[int]) -> CharCnn:
    """The network trained on all rows of ``c`` (h, context, label), of which there are ``each`` with label 0 and 1."""
    total = sum(each)
    shards = -(-total // SHARD)
    copies = [min(shards, -(-LEAST * shards // k)) for k in each]
    weight = [0.5 * total / k / of for k, of in zip(each, copies)]
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1))
    rows = (c.select("h", "context", "label", turn.alias("turn"))
            .select(F.pmod(F.pmod("h", F.lit(shards)) + F.col("turn"), F.lit(shards)).alias("shard"), "h", "context", "label")
            .repartition(shards, "shard").checkpoint())
    net = CharCnn()
    now = net.packed(net.begin())
    for epoch in range(EPOCHS):
        run = _shard_epoch(now, epoch, weight)
        came = rows.groupBy("shard").applyInArrow(run, "n long, flat array<double>")
        # sums of decimals do not depend on their order
        exact = F.sum((F.col("value") * F.col("n")).cast("decimal(38,18)"))
        mean = (came.select("n", F.posexplode("flat").alias("i", "value")).groupBy("i")
                .agg((exact.cast("double") / F.sum("n")).alias("value")).collect())  # a row for each weight
        now = np.zeros_like(now)
        for r in mean:
            now[r["i"]] = r["value"]
    net.unpack(now)
    return net


def _shard_epoch(flat: np.ndarray, epoch: int, weight: list[float]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("context", "ascending"), ("label", "ascending")])
        net = CharCnn()
        state = net.unpack(flat)
        x, y = symbols(table.column("context").to_pylist()), table.column("label").to_numpy()
        order = np.random.default_rng((11, epoch, table.column("shard")[0].as_py())).permutation(len(y))
        net.epoch(state, x, y, np.where(y == 1, weight[1], weight[0]), order)
        return pa.table({"n": pa.array([len(y)], pa.int64()), "flat": pa.array([net.packed(state).tolist()], pa.list_(pa.float64()))})

    return run


def _calibrated(net: CharCnn, c: DataFrame, recall: float) -> None:
    """``CharCnn.calibrate`` over all rows of ``c`` (context, label): logits are taken in tasks and stored."""
    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = net.logits(symbols(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column(1)], ["z", "label"])

    scored = c.select("context", "label").mapInArrow(logits, "z double, label int").checkpoint()
    n = {r["label"]: r["count"] for r in scored.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, 0.5 / n[1]).otherwise(0.5 / n[0])
    target = F.when(F.col("label") == 1, HIGH).otherwise(1 - HIGH)

    def sums(scale: float, offset: float) -> tuple:
        q = F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(float(scale)) * F.col("z") + F.lit(float(offset))))))
        row = scored.select("z", (weight * (q - target)).alias("g"), (weight * q * (1 - q) + 1e-12).alias("r"))
        return tuple(row.agg(F.sum(F.col("g") * F.col("z")), F.sum("g"), F.sum(F.col("r") * F.col("z") * F.col("z")),
                             F.sum(F.col("r") * F.col("z")), F.sum("r")).first())

    net.scale, net.offset = scaling(sums)
    rank = min(n[1] - 1, int(np.floor((1 - recall) * n[1])))
    wanted = scored.sparkSession.createDataFrame([(1, "least", rank)], "label int, name string, rank long")
    values = scored.filter("label = 1").groupBy("label", "z").agg(F.count(F.lit(1)).alias("n"))
    least = at_ranks(values, ["label"], "z", "n", wanted).first()["z"]
    net.threshold = float(min(0.5, 1 / (1 + np.exp(-np.clip(net.scale * least + net.offset, -50, 50)))))


def _all_spans(bases: list[list[tuple]], cands: list[list[tuple]], net: CharCnn | None) -> list[list[tuple]]:
    """For each text the pattern findings and the other candidates that the network takes for secrets, in order."""
    spans = [list(b) for b in bases]
    of = [(i, c) for i, cs in enumerate(cands) for c in cs if not c[3]]
    if net is not None and of:
        good = net.probability(symbols([c[2] for _, c in of])) >= net.threshold
        for (i, c), hit in zip(of, good):
            if hit:
                spans[i].append((3, c[0], c[1]))
    return [sorted(s, key=lambda f: (f[1], f[0])) for s in spans]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         recall: float = 0.98) -> tuple[DataFrame, CharCnn | None]:
    """Pattern findings and candidates of every row (written to the checkpoint folder), and the network fitted on them."""
    checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(_found, FOUND_SCHEMA).checkpoint()
    return found, fit(found, recall)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         recall: float = 0.98) -> DataFrame:
    """(doc_id, base, spans): pattern findings, and all findings, as (kind, start, end), kinds numbered as in KINDS.

    Null texts count as empty and have no findings; a null id stays null; repeated rows each give a row; without
    any labelled finding (an empty table too) the network adds none. Offsets are code points of the whole text.
    """
    found, net = find(df, id_col, text_col, recall)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = [[tuple(s.values()) for s in row] for row in batch.column(1).to_pylist()]
            cands = [[tuple(c.values()) for c in row] for row in batch.column(2).to_pylist()]
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in row] for row in _all_spans(bases, cands, net)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS)],
                                             ["doc_id", "base", "spans"])

    kind = "array<struct<kind:int,start:long,end:long>>"
    return found.mapInArrow(score, f"doc_id long, base {kind}, spans {kind}")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
           recall: float = 0.98) -> DataFrame:
    """``df``, with all its columns and rows, in whose texts ``mark`` stands for every finding (overlapping ones
    count as one). Texts without a finding, null ones too, stay as they are."""
    _, net = find(df, id_col, text_col, recall)
    at = df.columns.index(text_col)

    def replaced(text: str, spans: list[tuple]) -> str:
        out, done = [], 0
        merged: list[list[int]] = []
        for _, start, end in spans:
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        for start, end in merged:
            out += [text[done:start], mark]
            done = end
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            bases = [base_spans(t or "") for t in texts]
            spans = _all_spans(bases, [candidates(t or "", b) for t, b in zip(texts, bases)], net)
            new = [replaced(t, s) if s else t for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i)
                                              for i in range(batch.num_columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digest_rows(found: DataFrame) -> DataFrame:
    """The counts and digests of ``scan``'s rows."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_rows(scan(table(spark, sf_dir, "documents")))
