"""Source divergence, token counts and token alignment against brute force and the libraries."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeworks.llm import alignment, divergence, packing, pretokens, queries, tokencount
from tapeworks.llm.bpe import byte_chars

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, value string, block long, id string"
MARKS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", ".", ",", "'s", "'", "1", "2", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\x1c", "\x85", " ", "　", "中", "🙂", "́", "x" * 5, "▁", "\x00", "�", " word", " the", "ing", "ﬁ", "Ａ"]


def odd_texts(n=3000):
    g = random.Random(3)
    return ["".join(g.choices(MARKS, k=g.randrange(12))) for _ in range(n)] + [None, "", " ", "  ", "a ", " a", "a\n b", "long " * 40_000, "x" * 30_000, "<|endoftext|>" * 3]


def odd_docs(spark, texts):
    """Repeated ids and rows, null ids, and columns whose names clash with those of results and of tables on the way."""
    rows = [(None if i % 97 == 0 else i // 2, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", 0, 1, "x", 2, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:20], DOC), rows + rows[:20]


# -- source divergence


def audit(rows, least=3, top=200):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = (x or "" for x in (lang, source, text))
        groups.add((lang, source))
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)))
        n[lang, source].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(n[lang, s]) for s in sources}, share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = audit(docs.select("lang", "source", "text").collect())
    assert sorted(tuple(r) for r in queries.op11_source_divergence(spark, sf_dir).collect()) == want


def test_divergence_in_small_tiles_and_odd_documents(spark):
    df, rows = odd_docs(spark, odd_texts(600))
    rows = [(r[2], r[3], r[1]) for r in rows]
    want = audit(rows, top=7)
    got = sorted(tuple(r) for r in divergence.audit(df, top_terms=7, chunk_terms=5, block=2).collect())
    assert got == want and len({r[1] for r in got if r[2] == "pair"}) > 3
    assert divergence.audit(df.limit(0)).count() == 0
    # languages with no kept term, and sources without any
    few = [("x", "a", "A b a"), ("x", "a", "a c"), ("x", "b", "A é"), ("x", "b", "1 2"), ("y", "q", ""), ("y", "r", None), ("z", "one", "k k k"), ("z", "one", "k"), ("z", "one", "K"), ("z", "two", "")]
    assert sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(few, "lang string, source string, text string")).collect()) == audit(few)


def test_divergence_tasks_pass_sums_on(spark, sf_dir, monkeypatch):
    sums = divergence.Sums()
    for i in range(50):
        sums.add("en", f"s{i % 3}", f"Word{'x' * (i % 7)} same é".encode())
    rows = [r for b in sums.batches() for r in b.to_pylist()]
    assert sums.entries() == 0 and {r["term"]: sum(r["n"]) for r in rows}["same"] == 50
    assert all(len(r["source"]) == len(r["n"]) == len(r["df"]) for r in rows)


def test_shares_are_exact_for_large_counts(spark):
    g = random.Random(2)
    rows = [(n, n + rest, v) for n in (0, 1, 10**6, 8 * 10**9, 10**10, 10**13) for rest, v in ((0, 1), (g.randrange(10**12), g.randrange(1, 10**9)))]
    df = spark.createDataFrame(rows, "n long, total long, v long").withColumn("p", divergence.share(F.col("n"), F.col("total"), F.col("v")))
    for r in df.collect():
        want = 1 + 10**9 * (r["n"] + 1) // (r["total"] + r["v"])
        assert r["p"] == want == divergence.shares(np.array([r["n"]]), r["total"] + r["v"])[0]


# -- token counts


def test_op12(spark, sf_dir):
    lib = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op12_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)


def test_token_counts_are_the_library(spark, monkeypatch):
    lib = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    df, rows = odd_docs(spark, odd_texts())
    want = Counter((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter(tuple(r) for r in tokencount.count_tokens(df, queries.BYTE_TOKENIZER).collect()) == want
    assert tokencount.count_tokens(df.limit(0), queries.BYTE_TOKENIZER).count() == 0
    with pytest.raises(Exception, match="byte-level"):
        pretokens.Pretokens(queries.WORD_TOKENIZER)


def test_blocks_close_and_pack():
    cut, block, texts = pretokens.Pretokens(queries.BYTE_TOKENIZER), tokencount.Block(), ["one two, two", "", "two <b> one", "é" * 70]
    for i, t in enumerate(texts):
        block.rows.append((i, 0, 0, *block.frequencies(cut.segments(t)[0], cut)))
    words, rows = block.closed()
    assert words == sorted(words)
    for t, (_, _, _, places, freqs) in zip(texts, rows, strict=True):
        at = np.cumsum(tokencount.unpack_numbers(places))
        assert dict(zip([words[i] for i in at], tokencount.unpack_numbers(freqs).tolist(), strict=True)) == Counter(cut.pretokens(t))
    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert (tokencount.unpack_numbers(tokencount.pack_numbers(x)) == x).all()
    assert not block.full()


def every_character(step):
    cps = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for form in ("A{0}b {0}É", "1{0}́ {0}{0} x"):
        for at in range(0, len(cps), step):
            yield [form.format(c) for c in cps[at : at + step]]


def test_pre_tokens_of_every_character_are_the_library():
    lib, cut = Tokenizer.from_file(queries.BYTE_TOKENIZER), pretokens.Pretokens(queries.BYTE_TOKENIZER)
    known: dict[str, list[str]] = {}
    for texts in every_character(20_000):
        for t, e in zip(texts, lib.pre_tokenizer.pre_tokenize_str("\n\n".join(texts)) and texts, strict=True):
            known[t] = [t[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(e)]
            assert list(cut.pretokens(t)) == known[t], t
        known.clear()


def test_packing_ids_of_every_character_are_the_library():
    lib, words = Tokenizer.from_file(queries.WORD_TOKENIZER), packing.WordIds(queries.WORD_TOKENIZER)
    for texts in every_character(20_000):
        raw = packing.token_bytes(texts, words, 0)
        for t, r, e in zip(texts, raw, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert r == packing.pack_ids([*e.ids, 0]), t


# -- token alignment


def brute_alignment(texts):
    ta = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    ta.encode_special_tokens = True
    sb = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_TOKENIZER)
    back = {c: i for i, c in enumerate(byte_chars())}
    piece_a = {i: bytes(back[c] for c in k) for k, i in ta.get_vocab(with_added_tokens=False).items()}
    piece_b = lambda i: bytes([int(p[1:-1], 16)]) if (p := sb.id_to_piece(i)) and sb.is_byte(i) else p.replace("▁", " ").encode()
    found, counts = [], Counter()
    for t in texts:
        a, b = (ta.encode(" " + t, add_special_tokens=False).ids, sb.encode(t)) if t else ([], [])
        raw_a, raw_b = [piece_a[i] for i in a], [piece_b(i) for i in b]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_i, to_j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
            links.append((a[to_i - 1], b[to_j - 1]))
            i, j = to_i, to_j
        counts.update(links)
        found.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, b), k in counts.items():
        best[b] = max(best[b], k)
    return [(0,) * 6 + ("",) if f is None else (f[0], f[1], len(f[2]), len(f[2]), sum(counts[x] == best[x[1]] for x in f[2]), sum(counts[x] for x in f[2]), f[3]) for f in found]


def test_op13(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_token_alignment(spark, sf_dir).collect()}
    assert got == dict(zip([r["doc_id"] for r in docs], brute_alignment([r["text"] for r in docs]), strict=True))


def test_alignment_is_brute_force_on_odd_documents(spark, monkeypatch):
    texts = [t for t in odd_texts(2000) if len(t or "") < 100] + ["a▁b", "long " * 2000, "x" * 3000]
    df, rows = odd_docs(spark, texts)
    want = Counter((r[0], *w) for r, w in zip(rows, brute_alignment([r[1] for r in rows]), strict=True))
    assert Counter(tuple(r) for r in alignment.align(df, queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER).collect()) == want
    assert alignment.align(df.limit(0), queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER).count() == 0


def test_shards_sum_split_runs_and_are_found_again(spark, tmp_path, monkeypatch):
    """Shards of few keys: runs that go on over batches and shards, and lookups over all of them; also from a store that is copied first."""
    g = np.random.default_rng(5)
    keys = g.integers(0, 400, 5000) << 32 | g.integers(0, 7, 5000)
    want_k, want_n = np.unique(keys, return_counts=True)
    df = spark.createDataFrame([(int(k), 1) for k in keys], "key long, n long")
    fs, root = alignment.open_folder(str(tmp_path / "s"))
    fs.create_dir(root)
    rows = alignment.write_shards(df, str(tmp_path / "s"), 6, shard=300).collect()
    shards = sorted((r["name"], r["lo"], r["hi"]) for r in rows if r["name"])
    assert len(shards) >= 6
    read = alignment.Shards(str(tmp_path / "s"), sorted(shards, key=lambda s: s[1]))
    assert (read.counts(want_k) == want_n).all() and (read.counts(want_k[5:9]) == want_n[5:9]).all()
    best = defaultdict(int)
    for r in rows:
        if r["b"] is not None:
            best[r["b"]] = max(best[r["b"]], r["best"])
    assert best == {b: int(want_n[(want_k & 0xFFFFFFFF) == b].max()) for b in range(7)}
    read.local = False
    read.open.clear()
    assert (read.counts(want_k) == want_n).all()


def test_codec_forgets_within_its_bound():
    texts = [t for t in odd_texts(300) if t and len(t) < 100]
    small, large = (alignment.Pair(queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER, most) for most in (100, 1 << 30))
    for t in texts:
        assert repr(list(small.documents([t]))) == repr(list(large.documents([t])))
