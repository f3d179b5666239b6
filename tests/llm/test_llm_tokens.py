"""BPE (op10), pieces and packing (op3) against the tokenizer libraries and by their invariants."""

import base64
import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rimshot.llm import bpe, packing
from rimshot.llm.pieces import Memo, pieces

SIGNS = "abAB  \n\t'sé中文🙂ñ \x1c12.,!\r_²"
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS if k % 2 else "ab c.d'e\n") for _ in range(rng.randint(0, 40))) for k in range(n)]


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe.from_file(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(coder, reference):
    for t in texts(1500, 3) + ["a" * 3000, "ab" * 2000, "the" * 700, "aaaaabaaa" * 77, "中" * 300, "<|endoftext|>"]:
        ids = coder.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_long_pre_tokens_stay_linear(coder, reference):
    """Positions that wait for an earlier merge of a long pre-token are not gone through again for each merge."""
    rng = random.Random(5)
    texts = ["ab" * 4000, "a" * 5001, "abcabcab" * 700 + "x" * 333, "".join(rng.choice("abn") for _ in range(4000)),
             "".join(rng.choice("etaoin") for _ in range(4000)), "the" * 900 + "\u00e9" * 500]
    for raw, text in zip(coder.encode_pieces(texts), texts):
        assert np.frombuffer(raw, "<u4").tolist() == reference.encode_ordinary(text)
    short = time.perf_counter()
    coder.encode("ab" * 10_000)
    short, long = time.perf_counter() - short, time.perf_counter()
    coder.encode("ab" * 80_000)
    assert time.perf_counter() - long < 24 * short  # eight times the bytes


def test_bpe_with_merges_that_make_lower_ranks():
    # "ab" has a higher rank than "abc", which it takes part in: the new pair goes before other "ab"
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"cab", b"abcab"]
    ranks = {t: i for i, t in enumerate(tokens)}
    own = bpe.ByteBpe(ranks, r"\S+")
    enc = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert own.encode(t) == enc.encode_ordinary(t)


def test_rank_queue_finds_the_first_rank():
    q = bpe.RankQueue(100_000)
    rng = random.Random(2)
    held = set()
    for _ in range(2000):
        r = rng.randrange(100_000)
        if held and rng.random() < 0.4:
            assert q.first() == min(held)
            q.take(min(held))
            held.remove(min(held))
        q.put(r, np.array([1]))
        held.add(r)
    while held:
        assert q.first() == min(held)
        q.take(min(held))
        held.remove(min(held))
    assert q.first() is None


def test_pieces_can_be_encoded_one_by_one(coder, reference):
    tokenizer = packing._tokenizer(JSON)
    memo = Memo(lambda found: packing._piece_ids(tokenizer, found), limit=500)
    for t in texts(2500, 5):
        cut = pieces(t)
        if cut is not None:
            assert "".join(cut) == t
            assert np.frombuffer(next(iter(memo.ids([cut]))), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(b"".join(coder.encode_pieces(cut)), "<u4").tolist() == reference.encode_ordinary(t)


def test_op10_rows(spark, reference):
    rows = [(1, "hello world", 1), (None, None, 2), (2, "", 3), (2, "", 3), (3, "x" * 50_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect(), key=str)
    assert len(got) == 5
    for r in got:
        t = {1: "hello world", 3: "x" * 50_000}.get(r.doc_id, "")
        ids = reference.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode(df.filter("doc_id = 1"), RANKS, public_tokenizers.PATTERN).first().ids == reference.encode_ordinary("hello world")


@pytest.mark.parametrize("limits", [(2048, 64, 2048), (64, 3, 20), (100, 4, 100), (8, 1, 8)])
def test_vector_packer_keeps_all_limits(limits):
    rng = random.Random(4)
    sizes = [rng.randint(1, 300) for _ in range(400)]
    prompts = [rng.randint(0, n) if rng.random() < 0.5 else 0 for n in sizes]
    packer = packing.VectorPacker(*limits, window=16)
    out = [x for i, (n, p) in enumerate(zip(sizes, prompts)) for x in packer.add(i, n, p)] + list(packer.finish())
    covered, sequences = defaultdict(list), defaultdict(list)
    for key, start, length, loss, sequence, offset in out:
        assert length > 0 and loss == packer._loss(start, length, prompts[key])
        covered[key].append((start, length))
        sequences[sequence].append((offset, length, loss))
    for key, n in enumerate(sizes):
        end = 0
        for start, length in sorted(covered[key]):
            assert start == end
            end += length
        assert end == n
    for parts in sequences.values():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end <= limits[0] and len(parts) <= limits[1] and sum(p[2] for p in parts) <= limits[2]
        assert end == limits[0] or end & (end - 1) == 0  # nothing to pad


def test_op3_rows(spark):
    tokenizer = packing._tokenizer(JSON)
    source = {1: "hello world, this is a text.\nAnd a line", 2: None, 3: "", None: "no id", 4: "word " * 6000, 5: " odd  space\t"}
    df = spark.createDataFrame(list(source.items()), "doc_id long, text string")
    rows = packing.pack(df, JSON).collect()
    sequences = defaultdict(list)
    for doc, text in source.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(ids) and all(r.doc_tokens == len(ids) for r in parts)
        at = 0
        for r in parts:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at: at + r.length], "<u4").tobytes())
            at += r.length
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(df.limit(0), JSON).count() == 0


def test_op3_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "the answer", "a question?"), (2, "only text", None)], "doc_id long, text string, p string")
    tokenizer = packing._tokenizer(JSON)
    rows = packing.pack(df, JSON, prompt_col="p").collect()
    for doc, body in ((1, "the answer"), (2, "only text")):
        n = len(tokenizer.encode(body, add_special_tokens=False).ids) + 1
        assert sum(r.loss_tokens for r in rows if r.doc_id == doc) == n


def test_packing_encodes_special_strings_like_the_plain_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b\n\nc", "one <|endoftext two", "plain text"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON).collect()
    for i, text in enumerate(texts):
        ids = plain.encode(text, add_special_tokens=False).ids + [1]
        pieces_of = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in pieces_of] == [sum(r.length for r in pieces_of[:k]) for k in range(len(pieces_of))]
        assert sum(r.length for r in pieces_of) == len(ids)
        for r in pieces_of:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start: r.start + r.length], "<u4").tobytes())
