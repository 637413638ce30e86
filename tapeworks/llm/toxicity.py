"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words go through in overlapping windows, all of them, each half over the next; words of more than 60 bytes as
consecutive pieces. A word's inputs are its own vector (for the training words that are frequent enough; one shared
vector for the rest), the mean of its character trigrams' vectors and the sum of its beginnings'. Two recurrent passes,
one each way, give a state per word; attention pools a window's states into one logit. A document's score is a logistic
function of its largest logit, fitted on training documents that the network has not seen, with all their windows.

Training takes a bounded, hash-ordered sample of labelled documents, each whole (``most`` of label 1, twice as many of
label 0, ``most_bytes`` in all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.common import bounded, give_back, in_worker, no_cycle_search, slices

WINDOW, STEP = 32, 16
PIECE = 60
WORD, CHAR, STEM, HIDDEN = 8, 8, 4, 8
GRAMS, STEMS = 4096, 1 << 15
VOCAB = 6000
#: Bytes of a longer word's beginnings that are inputs.
BEGINNINGS = (4, 5, 6, 7)
DECAY = 0.05
EDGES = ".,;:!?|\"'()[]#$%&*<>-_"


def normal(word: str) -> str:
    return word.strip(EDGES).lower()


def positions(text: str | None) -> list[str]:
    """The text's words; one of more than PIECE bytes is cut, between characters, into pieces of at most so many."""
    out = []
    for w in (text or "").split():
        if len(w) <= PIECE // 4 or len(raw := w.encode("utf-8", "surrogatepass")) <= PIECE:
            out.append(w)
            continue
        at = 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append(raw[at:end].decode("utf-8", "surrogatepass"))
            at = end
    return out


def starts(n: int) -> range | list[int]:
    """Where the windows over n words begin: every STEP words, the last one ending with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STEP), n - WINDOW]


def gram_mean(words: list[str], table: np.ndarray) -> np.ndarray:
    """The mean vector of each word's byte trigrams, with a mark at both ends."""
    if not words:
        return np.zeros((0, table.shape[1]), table.dtype)
    rows, n = gram_rows(words)
    return np.add.reduceat(table[rows], np.cumsum(n) - n, axis=0) / n[:, None]


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' trigram numbers one after the other, and how many each has."""
    raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03\x03" for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    size = np.array([len(r) for r in raw])
    code = (flat[:-2] * np.uint32(0x9E3779B1) ^ flat[1:-1] * np.uint32(0x85EBCA6B) ^ flat[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(20)
    first = np.cumsum(size) - size
    keep = np.ones(len(flat), bool)
    keep[first + size - 1] = keep[first + size - 2] = False
    return code[keep[: len(code)]].astype(np.int32), size - 2


def stem_rows(words: list[str]) -> np.ndarray:
    """(n, len(BEGINNINGS)): the row of each word's beginnings of so many bytes; 0 where the word is no longer."""
    raw = [w.encode("utf-8", "replace") for w in words]
    size, most = np.array([len(r) for r in raw]), BEGINNINGS[-1]
    flat = np.frombuffer(b"".join([r[:most].ljust(most) for r in raw]), np.uint8).reshape(-1, most).astype(np.uint32)
    h, out = np.zeros(len(raw), np.uint32), np.zeros((len(raw), len(BEGINNINGS)), np.int64)
    for i in range(most):
        h = (h ^ flat[:, i]) * np.uint32(0x01000193) ^ h >> np.uint32(15)
        if i + 1 in BEGINNINGS:
            row = 1 + (h * np.uint32(0x85EBCA6B) >> np.uint32(8)) % np.uint32(STEMS - 1)
            out[:, BEGINNINGS.index(i + 1)] = np.where(size > i + 1, row, 0)
    return out


def add_rows(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(at, values[:, k], len(out))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights p, forward and backward passes over a batch of windows of equal length."""

    def __init__(self, vocab: list[str], seed: int = 3):
        g, d, h = np.random.default_rng(seed), WORD + CHAR + STEM, HIDDEN
        self.vocab = {w: i for i, w in enumerate(vocab, 1)}  # 0: all other words
        w = lambda *s: g.standard_normal(s) / np.sqrt(s[0])
        self.p = {"word": g.standard_normal((len(vocab) + 1, WORD)) * 0.1, "gram": g.standard_normal((GRAMS, CHAR)) * 0.1, "stem": np.zeros((STEMS, STEM)), "att": w(2 * h), "out": w(2 * h), "bias": np.zeros(1)}
        for side in "fb":
            self.p |= {"W" + side: w(d, 3 * h), "U" + side: w(h, 3 * h), "c" + side: np.zeros(3 * h)}
        self.scale = np.array([1.0, 0.0])  # of a document's largest logit

    def inputs(self, words: list[str]) -> np.ndarray:
        ids = np.array([self.vocab.get(w, 0) for w in words], np.int64)
        return np.concatenate([self.p["word"][ids], gram_mean(words, self.p["gram"]), self.p["stem"][stem_rows(words)].sum(1)], 1)

    def states(self, x: np.ndarray, side: str, keep: dict | None = None) -> np.ndarray:
        """(T, B, H) from projected inputs (T, B, 3H), in the order of the pass."""
        h, U = HIDDEN, self.p["U" + side].astype(x.dtype)
        s, out = np.zeros((x.shape[1], h), x.dtype), np.empty((x.shape[0], x.shape[1], h), x.dtype)
        for t in range(x.shape[0]):
            u = s @ U
            zr = sigmoid(x[t, :, : 2 * h] + u[:, : 2 * h])
            n = np.tanh(x[t, :, 2 * h :] + zr[:, h:] * u[:, 2 * h :])
            if keep is not None:
                keep.setdefault(side, []).append((s, u, zr, n))
            s = n + zr[:, :h] * (s - n)
            out[t] = s
        return out

    def pooled(self, xf: np.ndarray, xb: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits (B) of windows from the two passes' projected inputs (T, B, 3H), both in text order."""
        s = np.concatenate([self.states(xf, "f", keep), self.states(xb[::-1], "b", keep)[::-1]], 2)
        a = s @ self.p["att"].astype(s.dtype)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        v = (a[:, :, None] * s).sum(0)
        if keep is not None:
            keep |= {"s": s, "a": a, "v": v}
        return v @ self.p["out"].astype(s.dtype) + self.p["bias"].astype(s.dtype)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted logistic loss over windows x (T, B, D), and that for x."""
        p, h, keep = self.p, HIDDEN, {}
        logit = self.pooled(x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"], keep)
        dl = (sigmoid(logit) - y) * weight / weight.sum()
        s, a, v = keep["s"], keep["a"], keep["v"]
        g = {"out": v.T @ dl, "bias": np.array([dl.sum()])}
        dv = dl[:, None] * p["out"]
        da = (s * dv).sum(2)
        da = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tb,tbh->h", da, s)
        ds = a[:, :, None] * dv + da[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for side, d in (("f", ds[:, :, :h]), ("b", ds[::-1, :, h:])):
            U, dU, back = p["U" + side], np.zeros_like(p["U" + side]), np.zeros_like(d[0])
            dp = np.empty((*d.shape[:2], 3 * h))
            for t in range(d.shape[0] - 1, -1, -1):
                s0, u, zr, n = keep[side][t]
                z, r, e = zr[:, :h], zr[:, h:], d[t] + back
                dn = e * (1 - z) * (1 - n * n)
                dz, dr = e * (s0 - n) * z * (1 - z), dn * u[:, 2 * h :] * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], 1)
                dp[t] = np.concatenate([dz, dr, dn], 1)
                dU += s0.T @ du
                back = e * z + du @ U.T
            if side == "b":
                dp = dp[::-1]
            g["U" + side], g["c" + side] = dU, dp.sum((0, 1))
            g["W" + side] = np.einsum("tbd,tbh->dh", x, dp)
            dx += dp @ p["W" + side].T
        return g, dx

    def fit(self, words: list[str], at: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, state: dict, seed: int) -> None:
        """Adam over shuffled batches of windows ``at`` (n, WINDOW), places in ``words``; word and trigram vectors get their share of the input's gradient."""
        order, g = np.arange(len(at)), np.random.default_rng(seed)
        need, at = np.unique(at, return_inverse=True)
        at = at.reshape(len(order), -1)
        words = [words[i] for i in need]
        ids, stems = np.array([self.vocab.get(w, 0) for w in words], np.int64), stem_rows(words)
        flat, many = gram_rows(words)
        first = np.cumsum(many) - many
        for _ in range(epochs):
            g.shuffle(order)
            for b0 in range(0, len(order), 256):
                b = order[b0 : b0 + 256]
                used, inv = np.unique(at[b].T, return_inverse=True)
                n = many[used]
                rows = flat[np.repeat(first[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                mean = np.add.reduceat(self.p["gram"][rows], np.cumsum(n) - n, axis=0) / n[:, None]
                x = np.concatenate([self.p["word"][ids[used]], mean, self.p["stem"][stems[used]].sum(1)], 1)[inv.reshape(at.shape[1], len(b))]
                grad, dx = self.gradient(x, y[b], weight[b])
                each = np.zeros((len(used), dx.shape[2]))
                add_rows(each, inv.ravel(), dx.reshape(-1, dx.shape[2]))
                grad |= {k: np.zeros_like(self.p[k]) for k in ("word", "gram", "stem")}
                add_rows(grad["word"], ids[used], each[:, :WORD])
                add_rows(grad["gram"], rows, np.repeat(each[:, WORD : WORD + CHAR] / n[:, None], n, axis=0))
                add_rows(grad["stem"], stems[used].ravel(), np.repeat(each[:, WORD + CHAR :], len(BEGINNINGS), axis=0))
                grad["stem"][0] = 0
                state["n"] = state.get("n", 0) + 1
                for k, v in grad.items():
                    m, q = state.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
                    m += 0.1 * (v - m)
                    q += 0.01 * (v * v - q)
                    if k in ("word", "gram", "stem"):
                        self.p[k] *= 1 - rate * DECAY
                    self.p[k] -= rate * m / (1 - 0.9 ** state["n"]) / (np.sqrt(q / (1 - 0.99 ** state["n"])) + 1e-8)


def evidence(toxic: np.ndarray, clean: np.ndarray, toxics: int, cleans: int) -> np.ndarray:
    """How much a feature speaks for label 1: its log ratio of document frequencies, nearer to 0 by 1.5 standard errors."""
    ratio = np.log((toxic + 0.5) / (toxics + 1)) - np.log((clean + 0.5) / (cleans + 1))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - 1.5 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))


def train(docs: list[tuple[str | None, int]], seed: int = 3) -> Network:
    """A network from the whole text and the label of each training document.

    Word and trigram vectors begin with their evidence in one component, so that some tens of documents of label 1 are
    of use. First the windows with most evidence, then those of largest logit carry their document's label; of the other
    documents, such windows and some more are examples of label 0.
    """
    label = np.array([y for _, y in docs], float)
    if not docs or label.min() == label.max():
        net = Network([], seed)
        net.scale = np.array([0.0, 0.0 if not docs else (4.0 if label[0] else -4.0)])
        return net
    # a fourth of the documents, of both labels, only fits the scale: what the network knows by heart doesn't count there
    aside = np.zeros(len(docs), bool)
    for v in (0.0, 1.0):
        aside[np.flatnonzero(label == v)[3::4]] = True
    row: dict[str, int] = {"": 0}
    # a text's words are numbers from here on: lists of millions of strings would be the driver's largest part
    ids = [np.array([row.setdefault(normal(w), len(row)) for w in positions(t)], np.int32) for t, _ in docs]
    ids = [np.concatenate([p, np.zeros(WINDOW - len(p), np.int32)]) if len(p) < WINDOW else p for p in ids]
    words = list(row)
    flat_grams, many = gram_rows(words)
    first = np.cumsum(many) - many
    stems = stem_rows(words)
    df, gf, sf = (np.zeros((2, n)) for n in (len(words), GRAMS, STEMS))
    for p, y, out in zip(ids, label, aside, strict=True):
        if not out:
            used = np.unique(p)
            df[int(y), used] += 1
            n = many[used]
            sf[int(y), np.unique(stems[used])] += 1
            gf[int(y), np.unique(flat_grams[np.repeat(first[used] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
    both, (cleans, toxics) = df.sum(0), ((label[~aside] == v).sum() for v in (0, 1))
    both[0] = 0
    often = np.argsort(-both, kind="stable")[:VOCAB]
    vocab = [words[i] for i in often if both[i] >= 3]
    net, state = Network(vocab, seed), {}
    sf[:, 0] = 0
    of_word, of_gram, of_stem = (evidence(f[1], f[0], toxics, cleans) for f in (df, gf, sf))
    net.p["word"][1:, 0] = of_word[often[: len(vocab)]]
    net.p["gram"][:, 0] = of_gram
    net.p["stem"][:, 0] = of_stem
    known = np.array([w in net.vocab for w in words])
    speaks = np.where(known, of_word, 0) + np.add.reduceat(of_gram[flat_grams], first) / many + of_stem[stems].sum(1)
    at = [np.asarray(starts(len(p))) for p in ids]
    base = np.cumsum([0, *map(len, ids)])
    owner = np.repeat(np.arange(len(docs)), [len(a) for a in at])
    flat = np.concatenate(ids)
    places = np.concatenate([a + b for a, b in zip(at, base, strict=False)])
    y = label[owner]

    def logits() -> np.ndarray:
        scorer = Scorer(net, len(words))
        scorer.learn_normal(words)
        return scorer.logits(flat, places)

    def fit(some: np.ndarray, epochs: int, rate: float, seed: int) -> None:
        weight = np.where(y[some] > 0, max(1.0, (y[some] == 0).sum() / max(1, (y[some] > 0).sum())), 1.0)
        few = max(1, int(12 * 256 / max(1, len(some))))  # small samples need more passes for as many steps
        net.fit(words, flat[places[some][:, None] + np.arange(WINDOW)], y[some], weight, epochs * few, rate, state, seed)

    g = np.random.default_rng(seed)
    z = np.concatenate([[0], np.cumsum(np.maximum(speaks, 0)[flat])])
    z = z[places + WINDOW] - z[places]
    for phase in (0, 1, 2):
        if phase:
            z = logits()
        top = np.lexsort((-z, owner))
        nth = np.arange(len(top)) - np.searchsorted(owner[top], owner[top])
        hard = top[~aside[owner[top]] & (nth < 2) & ((y[top] == 0) | (nth == 0) | (z[top] > 0))]
        easy = g.permutation(np.flatnonzero((y == 0) & ~aside[owner]))[: len(hard) // 2]
        fit(np.union1d(hard, easy), 2, (0.01, 0.005, 0.005)[phase], seed + phase)
    most = np.full(len(docs), -np.inf)
    np.maximum.at(most, owner, logits())
    if len(set(label[aside])) == 2:
        most, label = most[aside], label[aside]
    a, b = 0.0, float(np.log(label.mean() / (1 - label.mean())))
    for _ in range(200):  # two parameters, by Newton's method with a small ridge
        q = sigmoid(np.clip(a * most + b, -30, 30))
        r, s = q - label, q * (1 - q)
        grad = np.array([(r * most).sum() + 1e-2 * a, r.sum()])
        hess = np.array([[(s * most * most).sum() + 1e-2, (s * most).sum()], [(s * most).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    net.scale = np.array([max(a, 0.0), b])
    return net


class Scorer:
    """Scores texts; projected inputs of words seen before are kept, within a bound."""

    def __init__(self, net: Network, most: int = 80_000):
        self.net, self.most = net, most
        self.row: dict[str, int] = {}
        self.table = {s: np.empty((most, 3 * HIDDEN), np.float32) for s in "fb"}
        self.W = {s: (net.p["W" + s], net.p["c" + s]) for s in "fb"}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > self.most:
            self.row.clear()
            new = list(words)
            if len(new) > self.most:
                self.most = len(new)
                self.table = {s: np.empty((self.most, 3 * HIDDEN), np.float32) for s in "fb"}
        n = len(self.row)
        self.learn_normal([normal(w) for w in new], n)
        self.row.update(zip(new, range(n, n + len(new)), strict=True))

    def learn_normal(self, words: list[str], n: int = 0) -> None:
        for at in range(0, len(words), 20_000):
            x = self.net.inputs(words[at : at + 20_000])
            for s, (W, c) in self.W.items():
                self.table[s][n + at : n + at + len(x)] = x @ W + c

    def logits(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the windows that begin ``at`` places of ``flat``, rows of the table."""
        out = []
        for b in range(0, len(at), 1024):
            rows = flat[at[b : b + 1024][None] + np.arange(WINDOW)[:, None]]
            out.append(self.net.pooled(self.table["f"][rows], self.table["b"][rows]))
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[str | None]) -> list[float]:
        parts = [positions(t) or [""] for t in texts]
        with no_cycle_search():
            self.learn(set().union(*parts, ("",)))
        get = self.row.__getitem__
        ids = [np.fromiter(map(get, p), np.int32, len(p)) for p in parts]
        flat, owner, base, short = [], [], 0, get("")
        for k, p in enumerate(ids):
            if len(p) < WINDOW:
                p = np.concatenate([p, np.full(WINDOW - len(p), short, np.int32)])
            at = np.asarray(starts(len(p)))
            flat.append(p)
            owner.append((np.full(len(at), k), at + base))
            base += len(p)
        flat, (who, at) = np.concatenate(flat), (np.concatenate(x) for x in zip(*owner, strict=True))
        most = np.full(len(texts), -np.inf)
        np.maximum.at(most, who, self.logits(flat, at))
        a, c = self.net.scale
        return sigmoid(np.clip(a * most + c, -30, 30)).tolist()


def held_out(id_col: str, of: int = 5):
    """Whether a document is kept from training: crc32 of its id as text leaves 0 modulo ``of``; null ids do not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 1200, most_bytes: int = 16 << 20) -> Network:
    """Train on at most ``most`` documents of label 1 and twice as many of label 0, none of them held out, the first by a hash.

    They are read whole, but all together have ``most_bytes`` at most: a document that doesn't fit any more is passed
    over. Documents with both labels count as toxic; of rows that repeat an id, one trains.
    """
    labelled = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    picked = None
    for y, n in ((1, most), (0, 2 * most)):
        part = labelled.filter(F.col("y") == y).orderBy(order, id_col).limit(n)
        picked = part if picked is None else picked.union(part)
    ids, text = F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    # at most 3 x most labels are broadcast, and as many sizes come to the driver
    sizes = docs.select(ids, text).join(F.broadcast(picked.withColumnRenamed(id_col, "id")), "id").groupBy("id").agg(F.max("y").alias("y"), F.max(F.octet_length("text")).alias("n"))
    fits, room = [], most_bytes
    for r in sizes.withColumn("order", F.xxhash64(F.col("id").cast("string"))).orderBy("order", "id").collect():
        if r["n"] <= room:
            room -= r["n"]
            fits.append((r["id"], r["y"]))
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(fits, f"id {kind}, y int")
    found = bounded(docs).select(ids, text).join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    rows = found.withColumn("order", F.xxhash64(F.col("id").cast("string"))).orderBy("order", "id").collect()
    net = train([(r["text"], r["y"]) for r in rows])
    del rows
    give_back()
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, score_col: str = "score") -> DataFrame:
    """(id, score), or with ``carry`` all columns of ``docs`` and score; with ``carry``, a column of docs of that name gives way.

    Null and empty texts are one window of blanks. Only the text is an input.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in slices(batches, 300):
            s = pa.array(scorer.scores(b.column(b.schema.get_field_index(text_col)).to_pylist()), pa.float64())
            kept = [i for i, n in enumerate(b.schema.names) if n != score_col]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), s], names=[*(b.schema.names[i] for i in kept), score_col]) if carry else pa.RecordBatch.from_arrays([b.column(0), s], names=[id_col, score_col])

    if carry:
        fields = [f for f in docs.schema.fields if f.name != score_col]
        return bounded(docs).mapInArrow(in_worker(run), T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))
    kind = docs.schema[id_col].dataType.simpleString()
    return bounded(docs).select(id_col, text_col).mapInArrow(in_worker(run), f"`{id_col}` {kind}, `{score_col}` double")
