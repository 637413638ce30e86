"""The registered queries on whole small tables against plain Python."""

import base64
import hashlib
import itertools
import zlib
from collections import defaultdict

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tapeworks.llm import queries
from tests.llm.test_dedup import components, plain_fingerprint
from tests.llm.test_filters import slow_spans
from tests.llm.test_tokens import assert_packed


def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_op1(spark, sf_dir):
    got = {r["page_id"]: r for r in queries.op1_url_filter(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(pages)
    for p in pages:
        rest = p["url"].partition("://")[2]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["distrust"] > r["trust"] else "allow")


def test_op3(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = queries.op3_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        names = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in slow_spans(docs[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r["spans"].split(","))  | {""}


def test_op4(spark, sf_dir):
    docs, by = documents(spark, sf_dir), defaultdict(list)
    for r in queries.op4_kd_sharding(spark, sf_dir).collect():
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by[r["shard"]].append(r)
    assert sum(map(len, by.values())) == len(docs)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())


def test_op6(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = queries.op6_toxicity(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_op8(spark, sf_dir):
    rows = queries.op8_best_fit_packing(spark, sf_dir).collect()
    assert_packed(rows, 2048)
    assert {r["doc_id"] for r in rows} == set(documents(spark, sf_dir))


def test_op9(spark, sf_dir):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(queries.BYTE_RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, sf_dir)
    got = queries.op9_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = lib.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_op10(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[i]) for i in ids]
    at = components(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    want = {i: (f"{f:016x}", ids[a]) for i, f, a in zip(ids, fps, at, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash_dedup(spark, sf_dir).collect()} == want


def test_pipeline_near_copies_equal_brute_force(spark, sf_dir):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = documents(spark, sf_dir)
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    links = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    at = components(len(ids), links)
    want = {ids[i] for i in range(len(ids)) if at[i] == i}
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert got == want
