"""Methods against plain versions: the tree's splits, the network's passes and gradients; odd rows in every operator on documents."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tapeworks.llm import bpe, packing, secrets, sharding, simhash, toxicity
from tapeworks.llm.queries import BYTE_RANKS, WORD_TOKENIZER
from tests.llm.test_dedup import plain_fingerprint


def widest(units, whole):
    span = lambda of, d: max(u[d] for u in of) - min(u[d] for u in of)
    return max(sharding.DIMS, key=lambda d: (span(units, d) / (span(whole, d) or 1.0), -sharding.DIMS.index(d)))


def check_split(units, whole, first, k):
    """Along the widest dimension all units but the border's few lie on their side, and the left has its part of the bytes."""
    if k == 1:
        assert {u["shard"] for u in units} <= {first}
        return
    dim = widest(units, whole)
    goal = sum(u["bytes"] for u in units) * (k // 2) / k
    left, right = [u for u in units if u["shard"] < first + k // 2], [u for u in units if u["shard"] >= first + k // 2]
    assert abs(sum(u["bytes"] for u in left) - goal) <= max(u["bytes"] for u in units)
    ordered = sorted(units, key=lambda u: u[dim])
    total, at = 0.0, 0
    while at < len(ordered) and total + ordered[at]["bytes"] <= goal:
        total, at = total + ordered[at]["bytes"], at + 1
    median = ordered[min(at, len(ordered) - 1)][dim]
    wrong = [u for u in left if u[dim] > median] + [u for u in right if u[dim] < median]
    assert len(wrong) <= 64, (dim, len(wrong))
    check_split(left, whole, first, k // 2)
    check_split(right, whole, first + k // 2, k - k // 2)


@pytest.mark.parametrize("shards", [2, 5])
def test_tree_splits_at_weighted_medians_of_the_widest_dimension(spark, shards):
    g = random.Random(shards)
    rows = [(i, float(g.choice([1, 5, 50, 400])), float(g.randrange(10**6)), g.random() * 0.3, g.random() ** 3, float(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "uid long, bytes double, size double, lang double, source double, first double")
    got = [r.asDict() for r in sharding.assign(df, shards).collect()]
    assert sorted(r["uid"] for r in got) == list(range(1500))
    check_split(got, got, 0, shards)


def plain_logit(net, words):
    """One window, word by word, as the formulas say."""
    p, h = net.p, toxicity.HIDDEN
    xs = net.inputs(words)
    sides = {}
    for side, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
        s, states = np.zeros(h), {}
        for t in order:
            x, u = xs[t] @ p["W" + side] + p["c" + side], s @ p["U" + side]
            z, r = (1 / (1 + np.exp(-(x[i * h : i * h + h] + u[i * h : i * h + h]))) for i in (0, 1))
            n = np.tanh(x[2 * h :] + r * u[2 * h :])
            s = (1 - z) * n + z * s
            states[t] = s
        sides[side] = states
    both = np.array([np.concatenate([sides["f"][t], sides["b"][t]]) for t in range(len(xs))])
    weight = np.exp(both @ p["att"])
    return float((weight[:, None] * both).sum(0) / weight.sum() @ p["out"] + p["bias"][0])


def network(seed=1):
    net = toxicity.Network(["one", "two", "three"], seed)
    g = np.random.default_rng(seed)
    for k in net.p:
        net.p[k] = net.p[k] + g.standard_normal(net.p[k].shape) * 0.2
    return net


def test_forward_pass_is_the_formula_and_scoring_takes_the_largest_window():
    net, g = network(), random.Random(4)
    text = [g.choice(["one", "two", "three", "other", "wörter", "x"]) for _ in range(71)]
    windows = [text[a : a + toxicity.WINDOW] for a in toxicity.starts(len(text))]
    assert [len(w) for w in windows] == [toxicity.WINDOW] * len(windows) and windows[-1][-1] == text[-1]
    x = np.stack([net.inputs(w) for w in windows], 1)
    got = net.pooled(x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"])
    want = [plain_logit(net, w) for w in windows]
    assert np.allclose(got, want, atol=1e-9)
    a, b = net.scale
    assert toxicity.Scorer(net).scores([" ".join(text)])[0] == pytest.approx(1 / (1 + np.exp(-(a * max(want) + b))), abs=1e-5)
    # a scorer that must forget its words scores the same
    texts = [" ".join(g.choice(text) + str(g.randrange(40)) for _ in range(50)) for _ in range(30)]
    assert np.allclose(sum((toxicity.Scorer(net, 45).scores([t]) for t in texts), []), toxicity.Scorer(net).scores(texts), atol=1e-6)


def test_gradients_equal_differences():
    net, g = network(2), np.random.default_rng(3)
    x = g.standard_normal((6, 4, toxicity.WORD + toxicity.CHAR + toxicity.STEM))
    y, weight = np.array([0.0, 1.0, 1.0, 0.0]), np.array([1.0, 2.0, 1.0, 0.5])

    def loss(x):
        q = net.pooled(x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"])
        return float((weight * (np.log1p(np.exp(q)) - y * q)).sum() / weight.sum())

    grad, dx = net.gradient(x, y, weight)
    e = 1e-6
    for name, d in grad.items():
        flat, own = net.p[name].reshape(-1), d.reshape(-1)
        for i in g.choice(len(flat), min(12, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + e
            up = loss(x)
            flat[i] = old - e
            down = loss(x)
            flat[i] = old
            assert own[i] == pytest.approx((up - down) / (2 * e), abs=1e-7), (name, i)
    for at in ((0, 0, 0), (5, 3, 7), (2, 1, 19)):
        moved = [x.copy(), x.copy()]
        moved[0][at] += e
        moved[1][at] -= e
        assert dx[at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / (2 * e), abs=1e-7)


def test_odd_rows_in_every_operator_on_documents(spark):
    """Null and repeated ids, repeated rows, ties, and columns that clash with those of the results."""
    texts = [None, "", "a token = abcdefgh here", "some words, and more words", "some words, and more words", "x" * 3000, "many words " * 3000]
    rows = [(None if i % 3 == 0 else i // 2, t, 1, "s", 2, 3, "f", 4, "h", True, 5) for i, t in enumerate(texts)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, spans string, n_tokens int, length int, fp string, node long, token string, chunk boolean, score int")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(BYTE_RANKS, "rb"))}
    lib, words = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(WORD_TOKENIZER)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.round_trip(df, BYTE_RANKS, P.PATTERN).collect())
    ids = lambda t: lib.encode_ordinary(t or "")
    assert got == Counter((r[0], len(ids(r[1])), hashlib.sha256(",".join(map(str, ids(r[1]))).encode()).hexdigest()) for r in rows)
    packed = packing.pack_documents(df, WORD_TOKENIZER).collect()
    assert sum(r["length"] for r in packed) == sum(len(words.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in rows)
    net = toxicity.Network([], 1)
    scored = toxicity.score(df, net)
    assert scored.columns == ["doc_id", "score"] and Counter(r["doc_id"] for r in scored.collect()) == Counter(r[0] for r in rows)
    carried = toxicity.score(df, net, carry=True)
    assert sorted(carried.columns) == sorted(df.columns) and dict(carried.dtypes)["score"] == "double"
    found = secrets.digest(secrets.scan(df, secrets.learn(df))).collect()
    assert Counter((r["doc_id"], r["n_assign"]) for r in found) == Counter((r[0], int("token" in (r[1] or ""))) for r in rows)
    near = simhash.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in near) == Counter((r[0], plain_fingerprint(r[1])) for r in rows)
