"""Chunk fingerprints (op1) against a byte-by-byte version."""

import hashlib
import random

import numpy as np

from rimshot.llm import fingerprint as fp


def slow_boundaries(data):
    starts, at = [], 0
    hashes = []
    for i in range(len(data)):
        hashes.append(sum(int(fp.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF)
    while at < len(data):
        starts.append(at)
        end = at + fp.GREATEST
        for cut in range(at + fp.LEAST, at + fp.GREATEST):
            if cut > len(data):
                break
            h = hashes[cut - 1]
            if h >> (32 - (fp.STRICT_BITS if cut < at + fp.NORMAL else fp.LOOSE_BITS)) == 0:
                end = cut
                break
        at = end
    return starts


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def test_boundaries_and_weights():
    rng = random.Random(1)
    for n in (0, 1, 5, 300, 900):
        t = words(rng, n)
        data = np.frombuffer(t.encode(), np.uint8)
        assert fp.boundaries(data) == slow_boundaries(data)
        found = fp.fingerprint(t)
        assert (fp.from_text(fp.as_text(found)) == found).all()
        assert (found & np.uint64(0xFFFF)).sum() <= max(len(data), 0)


def test_likeness_survives_a_shift():
    rng = random.Random(2)
    t = words(rng, 2000)
    assert fp.likeness(fp.fingerprint(t), fp.fingerprint("some words before " + t)) > 0.95
    assert fp.likeness(fp.fingerprint(t), fp.fingerprint(t[: len(t) // 2])) > 0.9  # containment
    assert fp.likeness(fp.fingerprint(t), fp.fingerprint(words(rng, 2000))) < 0.02
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("")) == 1 and fp.likeness(fp.fingerprint(""), fp.fingerprint("a")) == 0


def test_edit_rows_equal_brute_force(spark):
    rng = random.Random(3)
    docs = [(i * 3 + 1, words(rng, rng.randint(0, 200))) for i in range(60)]
    docs += [(500, None), (501, ""), (502, "é🙂x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "t").selectExpr("doc_id", "t as text", "1 as fingerprint")
    got = {r.doc_id: r for r in fp.edit_fingerprints(df).collect()}
    order = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == fp.as_text(fp.fingerprint(text)) and r.edited_fingerprint == fp.as_text(fp.fingerprint(new))
        assert r.near_edited == fp.likeness(fp.fingerprint(text), fp.fingerprint(new))
        assert r.near_next == fp.likeness(fp.fingerprint(text), fp.fingerprint(after))


def test_edges(spark):
    schema = "doc_id long, text string"
    assert fp.edit_fingerprints(spark.createDataFrame([], schema)).count() == 0
    alone = fp.edit_fingerprints(spark.createDataFrame([(1, "abcd")], schema)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    many = fp.edit_fingerprints(spark.createDataFrame([(None, None), (None, "z"), (2, "x"), (2, "x"), (2, "y")], schema)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in many) == [("2", 1), ("2", 1), ("2", 1), ("None", 0), ("None", 1)]
    assert fp.fingerprints(spark.createDataFrame([(None, None), (1, "a")], schema)).count() == 2
