"""Packing and byte-level BPE against the libraries and against the rules."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tapeworks.llm import bpe, packing
from tapeworks.llm.queries import BYTE_RANKS, WORD_TOKENIZER

ODD = ["", None, "a  b", "  lead", " x", "x \n y", "\n\n  bar", "foo \nbar", "foo\n bar", "a　b c", "x\x1c y z\x1fq", "don't we've 123 45", "a" * 5000, "\t\t \t x", "x   ",
       "é" * 300 + " ß", "ab\x00c ퟿", "🙂🙂 x 🙂", "   ", "1 2  3   4", "Σας ΣΑΣ x ΟΔΟΣ,", "<|endoftext|> a", "a<|endoftext|>b", "e\u0301 x\u0301,", "İstanbul", "x\u0085y", "one two three " * 9000, "²³ ½ x² Ⅷ"]


def test_bpe_is_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(BYTE_RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int, ids string")
    for r in bpe.encode_documents(df, BYTE_RANKS, P.PATTERN).collect():
        t = ODD[r["doc_id"]] or ""
        assert r["ids"] == lib.encode_ordinary(t)
        assert bytes(r["decoded"]) == t.encode()
    for r in bpe.round_trip(df, BYTE_RANKS, P.PATTERN).collect():
        ids = lib.encode_ordinary(ODD[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((ODD[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), BYTE_RANKS, P.PATTERN).count() == 0


def test_codec_takes_other_patterns():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(BYTE_RANKS, "rb"))}
    for pattern in (r"\w{1,3}|\W+", r"[a-z]+|[^a-z]"):
        lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        c = bpe.Codec(BYTE_RANKS, pattern)
        for t in ODD:
            assert c.encode(t or "") == lib.encode_ordinary(t or ""), (pattern, t)


def test_codec_forgets_within_its_bound():
    c = bpe.Codec(BYTE_RANKS, P.PATTERN, most=50)
    for t in ODD * 2:
        assert next(c.parts([t or ""]))[2] == (t or "").encode()


def whole(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_are_the_library(spark):
    tok = Tokenizer.from_file(WORD_TOKENIZER)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(ODD)], "doc_id long, text string, piece int, length int")
    got = packing.pieces(df, "doc_id", "text", WORD_TOKENIZER, with_ids=True).collect()
    for i, t in enumerate(ODD):
        ids = whole(tok, t)
        parts = sorted((r["piece"], r) for r in got if r["id"] == i)
        assert [p for p, _ in parts] == list(range(len(parts)))
        assert all(r["length"] == 2048 for _, r in parts[:-1])
        raw = b"".join(bytes(r["ids"]) for _, r in parts)
        assert raw == b"".join(x.to_bytes(4, "little") for x in ids)
        assert all(r["start"] == 2048 * p and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for p, r in parts)


def assert_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    """Item by item, from the longest: the fullest sequence that holds it."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    g = random.Random(6)
    for _ in range(60):
        lengths = [g.choice([g.randint(1, 64), g.randint(1, 10), 64, 33]) for _ in range(g.randint(1, 300))]
        rows = []
        for n, rank, items, first, per, off in packing.plan(dict(Counter(lengths)), 64):
            rows += [{"length": n, "sequence_id": first + i // per, "offset": off + i % per * n} for i in range(items)]
        assert sorted(r["length"] for r in rows) == sorted(lengths)
        assert assert_packed(rows, 64) == best_fit(lengths, 64)


def test_packing_places_every_piece(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, WORD_TOKENIZER).collect()
    tok = Tokenizer.from_file(WORD_TOKENIZER)
    want = {r["doc_id"]: len(whole(tok, r["text"])) for r in docs.select("doc_id", "text").collect()}
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want
    assert assert_packed(rows, 2048) == best_fit([r["length"] for r in rows], 2048)
    assert packing.pack_documents(docs.limit(0), WORD_TOKENIZER).count() == 0
