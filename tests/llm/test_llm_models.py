"""Trained operators: toxicity (op8) and secret scan (op9)."""

import hashlib
import random
import re

import numpy as np

from rimshot.llm import secrets, toxicity


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    truth = x @ np.array([4.0, -2.0, 0.0]) + rng.logistic(0, 0.3, 400)
    grade = np.searchsorted([0.0, 1.0, 2.0], truth)
    w, t = toxicity.fit_ordinal(x, grade, np.full(400, 1 / 400), 4, steps=800)
    assert (np.diff(t) > 0).all()
    assert w[0] > 3 and w[1] < -1 and abs(w[2]) < 1
    model = toxicity.Severity({}, w, t, 0.5)
    assert np.corrcoef(model.expected(x @ w), grade)[0, 1] > 0.85

    def loss(weights):
        below = 1 / (1 + np.exp(-(t[None] - (x @ weights)[:, None])))
        cum = np.hstack([np.zeros((400, 1)), below, np.ones((400, 1))])
        return -np.log(cum[np.arange(400), grade + 1] - cum[np.arange(400), grade]).mean() + 0.5e-4 * weights @ weights

    for k in range(3):  # a minimum
        step = np.eye(3)[k] * 0.05
        assert loss(w) <= min(loss(w + step), loss(w - step)) + 1e-4


def corpus(rng, n):
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 150))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Nastyone,", "vilest", "zorkling" + rng.choice(clean), "zorkl" + rng.choice(clean)]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(random.Random(2), 800)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels[:500] + [(3, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    rest = labels[500:]
    assert np.mean([got[i].rejected == bool(y) for i, y in rest]) > 0.97
    assert all(0 <= got[i].severity <= toxicity.GRADES and 0 <= got[i].p_toxic <= 1 for i, _ in rest)
    few = [got[i].severity for i, y in rest if y]
    many = dict(docs)
    use = [len(re.findall(r"(?i)nasty|vilest|zork", many[i])) for i, y in rest if y]
    assert np.corrcoef(few, use)[0, 1] > 0.8  # severity follows the use of toxic words
    kept = {r.doc_id for r in toxicity.accepted(df, model).collect()}
    assert kept == {i for i in got if not got[i].rejected}


def test_toxicity_on_the_table(spark):
    from tests.conftest import SF_CHECK

    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.collect()
    even = spark.createDataFrame([r for r in rows if r.doc_id % 2 == 0], labels.schema)
    scores = {r.doc_id: r.rejected for r in toxicity.score(docs, toxicity.fit(docs, even)).collect()}
    clean = [scores[r.doc_id] for r in rows if r.doc_id % 2 and not r.toxic]
    toxic = [scores[r.doc_id] for r in rows if r.doc_id % 2 and r.toxic]
    assert np.mean(clean) < 0.02 and np.mean(toxic) > 0.4  # few rows here: words of other languages stay unknown


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "x", None), (1, None, 0.5)], "doc_id long, text string, severity double")
    labels = "doc_id long, toxic int"
    assert toxicity.fit(docs, spark.createDataFrame([], labels)) is None
    assert toxicity.fit(docs, spark.createDataFrame([(1, 1)], labels)) is None
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], labels)) is None
    assert [r.rejected for r in toxicity.score(docs, None).collect()] == [False] * 3
    assert toxicity.accepted(docs, None).count() == 3
    full, known = corpus(random.Random(3), 200)
    model = toxicity.fit(spark.createDataFrame(full, "doc_id long, text string"), spark.createDataFrame(known, labels))
    assert toxicity.score(docs, model).count() == 3 and toxicity.accepted(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def plain_spans(text):
    """The three patterns as stated, each match checked after it is found."""
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password")
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    assert key in names
    found = [(0, m) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(1, m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(2, m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], s[0]))


def test_base_spans():
    rng = random.Random(4)
    parts = ["password", "PassWord", "api_key", "APIKEY", "ſecret", "toKen", "=", ": ", "\"", "'", " ", "abc", "AKIA", "Z9" * 9, "0a" * 12,
             "f" * 23, "x", "\n", "é🙂", "secret: token: hunter2x", "hunter22", "."]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secrets.base_spans(t) == plain_spans(t), t


def test_cnn_gradient():
    rng = np.random.default_rng(5)
    net = secrets.CharCnn(dim=3, filters=4)
    x = rng.integers(0, secrets.N_SYMBOLS, (6, 20))
    y = np.array([0, 1, 0, 1, 1, 0])
    weight = rng.random(6)

    def loss():
        z = net.forward(x)[0]
        return (weight * (np.logaddexp(0, z) - y * z)).mean()

    gradient = net._gradient(x, y, weight)
    for name, g in gradient.items():
        for at in list(np.ndindex(*g.shape))[:: max(1, g.size // 12)]:
            old = net.p[name][at]
            net.p[name][at] = old + 1e-5
            up = loss()
            net.p[name][at] = old - 1e-5
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def finding(rng):
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([20, 32, 40])))
    return rng.choice([f"password={hexa[:18]}", f'token = "{hexa}"', "AKIA" + "".join(rng.choice("ABCXYZ0123456789") for _ in range(16))])


def other(rng):
    return rng.choice([f"mail{rng.randrange(99)}.example.com", f"{rng.randrange(10 ** 15, 10 ** 16)}", f"{rng.randrange(100, 255)}.{rng.randrange(100, 255)}.{rng.randrange(255)}.7",
                       f"chapter-{rng.randrange(999)}-of-the-book"])


def test_network_on_held_out_candidates():
    rng = random.Random(6)
    rows = [f"some words {finding(rng) if k % 2 else other(rng)} and more" for k in range(1200)]
    found = [c for t in rows for c in secrets.candidates(t, secrets.base_spans(t))]
    x, y = secrets.symbols([c[2] for c in found]), np.array([c[3] for c in found])
    net = secrets.CharCnn()
    net.train(x[:600], y[:600])
    net.calibrate(x[600:800], y[600:800], recall=0.98)
    said = net.probability(x[800:]) >= net.threshold
    assert said[y[800:] == 1].mean() >= 0.97 and said[y[800:] == 0].mean() <= 0.02


def test_scan_and_redact(spark):
    rng = random.Random(7)
    texts = [f"words {finding(rng)} end" if k % 3 == 0 else f"words {other(rng)} end" for k in range(300)]
    docs = [(i, t, "s") for i, t in enumerate(texts)] + [(500, None, "s"), (501, "", "s"), (None, texts[0], "s"), (0, texts[0], "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    rows = secrets.digest_rows(secrets.scan(df)).collect()
    assert len(rows) == len(docs)
    text_of = {i: t for i, t, _ in docs}
    for r in rows:
        base = plain_spans(text_of[r.doc_id] or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in range(3)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    new = {r.doc_id: r.text for r in secrets.redact(df).collect() if r.doc_id is not None}
    assert new[500] is None and new[501] == ""
    for i, t in enumerate(texts):
        if i % 3 == 0:
            assert "[SECRET]" in new[i] and not plain_spans(new[i])
    assert np.mean([new[i] == t for i, t in enumerate(texts) if i % 3]) > 0.97
    schema = "doc_id long, text string"
    assert secrets.scan(spark.createDataFrame([], schema)).count() == 0
    assert secrets.redact(spark.createDataFrame([(1, "nothing here 123456789012")], schema)).first().text == "nothing here 123456789012"


def test_network_learns_from_all_candidates(spark, monkeypatch):
    rng = random.Random(8)
    texts = [f"words {finding(rng)} end" if k % 2 else f"words {other(rng)}-{k:06d} end" for k in range(9400)]
    cands = [(i, *c) for i, t in enumerate(texts) for c in secrets.candidates(t, secrets.base_spans(t))]
    rows = [(i, [], [{"start": a, "end": b, "context": context, "label": label}]) for i, a, b, context, label in cands]
    found = spark.createDataFrame(rows, secrets.FOUND_SCHEMA)
    of = [sum(c[-1] == y for c in cands) for y in (0, 1)]
    assert min(of) > 4000
    seen = {"learned": [0, 0], "tested": [0, 0]}
    trained, calibrated = secrets._trained, secrets._calibrated

    def counted(which, df):
        for r in df.groupBy("label").count().collect():
            seen[which][r["label"]] += r["count"]

    monkeypatch.setattr(secrets, "EPOCHS", 3)
    monkeypatch.setattr(secrets, "_trained", lambda c, each: (counted("learned", c), trained(c, each))[1])
    monkeypatch.setattr(secrets, "_calibrated", lambda net, c, recall: (counted("tested", c), calibrated(net, c, recall))[1])
    net = secrets.fit(found)
    assert [a + b for a, b in zip(seen["learned"], seen["tested"])] == of
    x, y = secrets.symbols([c[3] for c in cands]), np.array([c[4] for c in cands])
    said = net.probability(x) >= net.threshold
    assert said[y == 1].mean() >= 0.97 and said[y == 0].mean() <= 0.02


def test_network_does_not_depend_on_partitions_and_shards_agree(spark, monkeypatch):
    rng = random.Random(9)
    texts = [f"words {finding(rng)} end" if k % 40 == 0 else f"words {other(rng)}-{k:06d} end" for k in range(1500)]
    cands = [(i, *c) for i, t in enumerate(texts) for c in secrets.candidates(t, secrets.base_spans(t))]
    rows = [(i, [], [{"start": a, "end": b, "context": context, "label": label}]) for i, a, b, context, label in cands]
    found = spark.createDataFrame(rows, secrets.FOUND_SCHEMA)
    monkeypatch.setattr(secrets, "SHARD", 256)
    a, b = secrets.fit(found.repartition(1)), secrets.fit(found.repartition(7))
    assert (a.threshold, a.scale, a.offset) == (b.threshold, b.scale, b.offset)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    x, y = secrets.symbols([c[3] for c in cands]), np.array([c[4] for c in cands])
    said = a.probability(x) >= a.threshold
    assert said[y == 1].mean() >= 0.9 and said[y == 0].mean() <= 0.03


def test_choosing_features_needs_little_memory_beside_the_entries():
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = np.repeat(np.arange(4000, dtype=np.int32), 100)
    ids = rng.integers(1, 30_000, len(rows)).astype(np.uint64)
    toxic = np.arange(4000) % 2 == 0
    ids[np.arange(0, len(ids), 200)] = 7  # a word of toxic rows
    tracemalloc.start()
    chosen, marks = toxicity.select_features(ids, rows, toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 7 in chosen.tolist() and marks[chosen.tolist().index(7)]
    assert peak < 3 * ids.nbytes
