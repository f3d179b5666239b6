"""Lexical search (op11) against SQL and plain Python; spelling variants (op12) against a search of all edits."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from rimshot.llm import lexical, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [None, "", " \n", "one", "ÄÖ straße ÉÉ", "a_b-c d.e\x00f\x7fg", "٣ 中文 🙂x🙂", "word " * 3000, "x" * 5000, "One one ONE"]


def ranked(docs, items, k=10):
    """The contract in plain Python: {(item position, rank): (doc_id, score)}."""
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    df = Counter(t for _, c, _ in found for t in c)
    big_n, big_l = len(found), sum(n for _, _, n in found)
    out = {}
    for item_id, text in items:
        scores = []
        for i, c, n in found:
            m = 100 - 90 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for r, (s, none, i) in enumerate(sorted(scores)[:k], 1):
            out[item_id, r] = (None if none else i, -s)
    return out


def texts_of(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(int(rng.paretovariate(1.2) * 8) + 1)) for _ in range(n)]


@pytest.mark.parametrize("bucket, focus", [(1024, 6), (7, 1), (30, 2)])
def test_search_equals_plain_ranking(spark, monkeypatch, bucket, focus):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "FOCUS", focus)
    rng = random.Random(bucket)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(500)]
    docs = [(i, t) for i, t in enumerate(texts_of(rng, 300, words) + ODD)]
    docs += [(1000 + i, docs[3][1]) for i in range(15)] + [(3, docs[3][1]), (None, docs[7][1])]
    items = [(i, t) for i, t in enumerate([docs[3][1], *texts_of(rng, 20, words), *ODD, "nothing like it"])]
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, n int, cols string, score string").repartition(5)
    got = lexical.search(df, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int"), block_entries=60)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert {(r.item_id, r.rank): (r.doc_id, r.score) for r in got.collect()} == ranked(docs, items)


def test_bounds_prune_without_loss():
    """Most documents are excluded by their bounds once thresholds are known, and the best ones are the same."""
    import numpy as np

    rng = np.random.default_rng(5)
    n, v = 4000, 300
    rows = [np.unique(rng.integers(0, v, rng.integers(1, 40))) for _ in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tfs = rng.integers(1, 4, ends[-1])
    make = {"queries": [sorted(set(map(int, rng.integers(0, v, 8)))) for _ in range(20)], "weights": rng.integers(500, 9000, v),
            "n_docs": n, "n_terms": int(tfs.sum()), "k": 10}
    size = np.array([tfs[a:b].sum() for a, b in zip(ends, ends[1:])])
    first = lexical.Scorer(floor=[1] * 20, **make)
    first.add(list(range(n)), size, ends, np.concatenate(rows), tfs)
    offered = []
    again = lexical.Scorer(floor=[-b[-1][0] for b in first.best], **make)
    offer = again._offer
    again._offer = lambda q, s, ids: (offered.append(len(ids)), offer(q, s, ids))
    again.add(list(range(n)), size, ends, np.concatenate(rows), tfs)
    assert again.best == first.best
    assert sum(offered) < 0.02 * n * 20


def test_search_of_empty_tables(spark):
    none, items = "doc_id long, text string", "item_id long, text string"
    assert lexical.search(spark.createDataFrame([], none), spark.createDataFrame([(1, "a")], items)).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a")], none), spark.createDataFrame([], items)).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None), (2, "")], none), spark.createDataFrame([(1, "a")], items)).collect() == []


# --- spelling variants ----------------------------------------------------------------------------------------

def counted(docs, least_chars=6, rate=199):
    counts = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % rate == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars}


def all_edits(counts, least_n=5, ratio=5):
    counts = {w: n for w, n in counts.items() if n >= least_n}
    letters = sorted(set("".join(counts)))
    rows = {}
    for w, n in counts.items():
        near = {w[:i] + w[i + 1:] for i in range(len(w))}
        near |= {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        near = [x for x in near if x in counts and x != w]
        best = min(near, key=lambda x: (-counts[x], x)) if near else None
        rows[w] = (best if best and counts[best] >= ratio * n else None, n, len(near))

    def root(w):
        while rows[w][0]:
            w = rows[w][0]
        return w

    return sorted((w, f, root(w), n, m, counts[f] if f else None) for w, (f, n, m) in rows.items())


def test_variants_equal_all_edits(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(6, 9))): rng.choice([5, 5, 6, 30, 200, 1000]) for _ in range(700)}
    words |= {"x" * k: 5 ** k for k in range(1, 11)} | {"z" * 300: 6, "z" * 299: 40, "rare": 4, "ÿÿÿÿÿÿ": 9}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(6)).collect()
    assert sorted(map(tuple, got)) == all_edits(words)
    assert {r.word: r.root for r in got}["x"] == "x" * 10


def test_node_numbers_are_one_for_each_prefix(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 10))) for _ in range(600)} | {"a" * 60, "a" * 59 + "b"})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # borders within long common prefixes
    try:
        found = spelling.with_nodes(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    number = defaultdict(set)
    for r in found:
        assert len(r.nodes) == len(r.word) + 1
        for i, node in enumerate(r.nodes):
            number[r.word[:i]].add(node)
    assert len(found) == len(words) and all(len(s) == 1 for s in number.values())
    assert len({n for s in number.values() for n in s}) == len(number)
    assert [r.word for r in sorted(found, key=lambda r: r.nodes[-1])] == words


def test_spellings_of_documents(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeéß×") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice([w, w, w.upper(), w + "-", w + "中"]) for w in rng.choices(stems, k=rng.randint(0, 120)))) for i in range(200)]
    docs += [(None, docs[0][1]), (5, docs[5][1]), (300, None), (301, ""), (302, "ab1cd2" * 500), (303, "y" * 3000)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = spelling.group_spellings(df, rate=7).collect()
    assert sorted(map(tuple, got)) == all_edits(counted(docs, rate=7)) and any(r.form for r in got)
    assert spelling.group_spellings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_all_edits(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, spelling.op12_spelling_variants(spark, folder).collect())) == all_edits(counted(docs))
