"""Similarity join (op4), components and line dedup (op5) against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from rimshot.llm import jaccard, linededup
from rimshot.llm.components import connected_components
from rimshot.llm.shingles import shingle_set, word_hashes


def test_word_hashes_follow_the_words():
    a = word_hashes("The  quick\tFOX\x0bÄx the")
    assert len(a) == 5 and a[0] == a[4]
    assert word_hashes("é")[0] != word_hashes("É")[0]  # only A-Z are lower-cased
    assert word_hashes("a b").shape == (1,)       # other white space is part of a word
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1 and len(shingle_set(None)) == 0
    assert shingle_set("a b")[0] != shingle_set("b a")[0]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9, 1.0])
def test_similar_sets_always_share_a_signature(share):
    """Random pairs at or just above the limit, with any set of shingles taken as frequent."""
    rng = np.random.default_rng(int(share * 10))
    frequent = rng.random(1 << 12) < share
    for trial in range(1500):
        size = int(rng.integers(1, 40)) if trial % 3 else int(rng.integers(40, 1500))
        s = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        h = len(s) // 5
        gone = int(rng.integers(0, h + 1))
        new = int(rng.integers(0, h + 1))
        other = np.unique(np.concatenate((rng.permutation(s)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
        i = len(np.intersect1d(s, other))
        if 100 * i >= 80 * (len(s) + len(other) - i):
            assert np.intersect1d(jaccard.signatures(s, frequent), jaccard.signatures(other, frequent)).size


def brute(docs):
    sets = {}
    for key, text in docs:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets[key] = {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1:]:
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 90))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at: at + rng.randint(0, 2)] = [rng.choice(vocabulary)]
        if rng.random() < 0.3:  # a passage that many share, which is most of the text
            w = passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 14))]
        docs.append((i * 7 % n, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return docs


@pytest.mark.parametrize("seed, least, block", [(1, 32, 1024), (2, 2, 4), (3, 1, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, least, block):
    """Low limits take many shingles as frequent and cut groups into blocks."""
    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", least)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus(random.Random(seed), 150) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One TWO"), (905, "two one")]
    got = jaccard.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)
    assert len(got) == len(docs)


def test_component_edges(spark):
    schema = "doc_id long, text string, c string, n long"
    assert jaccard.link_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 1), (4, "a b c d e f", None, None), (9, None, "y", 2)]
    got = sorted(map(tuple, jaccard.link_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 4), (5, 2, 4), (4, 2, 4), (9, 0, 9)], key=str)


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    top = {}
    for a, b in edges:
        if a != b:
            top.setdefault(a, a), top.setdefault(b, b)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in top}
    assert len(got) == len(top)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def later_copies(docs, least):
    """Places of all lines (among those with a word) that lie in a run with an earlier copy, run by run."""
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    lines = [[tuple(x.split()) for x in (t or "").split("\n") if x.split()] for _, t in docs]
    places = defaultdict(list)
    for rank, i in enumerate(order):
        for a in range(len(lines[i])):
            total = 0
            for b in range(a, len(lines[i])):
                total += len(lines[i][b])
                if total >= least:
                    places[tuple(lines[i][a: b + 1])].append((rank, a, i))
    out = defaultdict(set)
    for run, found in places.items():
        first = min(found)
        for p in found:
            if p != first:
                out[p[2]] |= set(range(p[1], p[1] + len(run)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["a b", "c d e", "f", "g h i j", "k l", "m n o p q", "", " \t"]
    docs = [(i, "\n".join(rng.choice(lines + [f"u{rng.randrange(30)} x"]) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    docs[7], docs[9] = (7, docs[3][1]), (9, docs[3][1] + "\nzz")
    got = {r.doc_id: r for r in linededup.dedup_lines(
        spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, _gone string"), min_words=8, drop_emptied=False).collect()}
    gone = later_copies(docs, 8)
    assert gone
    for n, (i, text) in enumerate(docs):
        every = text.split("\n")
        filled = [k for k, x in enumerate(every) if x.split()]
        drop = {filled[k] for k in gone[n]}
        assert got[i].text == "\n".join(x for k, x in enumerate(every) if k not in drop)
        assert got[i]._gone == "k"


def test_line_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert linededup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None), (1, ""), (1, ""), (2, "short line")]
    assert sorted(map(tuple, linededup.dedup_lines(spark.createDataFrame(rows, schema)).collect()), key=str) == sorted(rows, key=str)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long + "\nown end"), (2, "own start\n" + long), (2, "own start\n" + long), (3, long), (None, long)]
    got = sorted(map(tuple, linededup.dedup_lines(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, long + "\nown end"), (2, "own start"), (2, "own start")], key=str)  # copies as a whole go


@pytest.mark.parametrize("seed", [1, 2])
def test_word_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    least, shared = 9, [[f"p{k}w{i}" for i in range(rng.randint(7, 14))] for k in range(6)]
    docs = []
    for i in range(40):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(shared) if rng.random() < 0.7 else [f"u{rng.randrange(2000)}" for _ in range(rng.randint(1, 9))]
        docs.append((i, "".join(w + rng.choice([" ", " ", " ", "  ", "\n"]) for w in words)))
    docs[7], docs[9] = (7, docs[3][1]), (9, docs[3][1].replace("\n", " ") + "zz")
    df = spark.createDataFrame([*docs, docs[5]], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, min_words=least, drop_emptied=False, words=True).collect()}
    seen, changed = set(), 0
    for i, text in docs:
        words = text.split()
        gone = set()
        for a in range(len(words) - least + 1):
            run = tuple(words[a: a + least])
            if run in seen:
                gone |= set(range(a, a + least))
            seen.add(run)
        changed += bool(gone)
        assert got[i].split() == [w for k, w in enumerate(words) if k not in gone]
        if not gone:
            assert got[i] == text
    assert changed > 5


def test_word_dedup_within_longer_lines(spark):
    passage = " ".join(f"w{i}" for i in range(54))
    rows = [(39, f"first text {passage} ends here\nlast line"), (900, f"other start of {passage} other end\nown line"), (901, passage),
            (None, None), (902, ""), (903, "x " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert passage in kept[900]  # whole lines only
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(df, words=True).collect()}
    assert kept == {39: rows[0][1], 900: "other start of other end\nown line", None: None, 902: "", 903: "x " * 20}
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), words=True).count() == 0
