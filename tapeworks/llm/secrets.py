"""Secret scans with inferred grammars.

Fixed patterns find the base spans. Beside them, a probabilistic automaton per credential format is inferred from
labelled examples (made-up ones of public formats, and values of the documents' own base spans): a prefix tree of the
examples, whose states are merged where their next-symbol frequencies are statistically compatible (Hoeffding bound,
checked down the tree). The background is an automaton too: its states are the last two symbols, its transitions come
from the symbols of all documents' tokens outside base spans. Every maximal token of at least 16 symbols that touches no
base span is scored by its log-likelihood under the best format against the background. All of these are distributions
over strings, so a token of the background exceeds odds of t under one format with a chance of 1 / t at most; the limit on the
odds is the operator's one parameter, and no margin is fitted. Tokens beyond it are spans of kind ``format``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import bounded, discard, in_worker, materialize, slices

#: Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
END = "\x00"

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
SYMBOLS = UPPER + LOWER + DIGIT + "+/_=-"
#: Number of the symbols and the end (0); the number of each byte, 0 for others; the number of each symbol's small letter.
WIDTH = len(SYMBOLS) + 1
CODE = np.zeros(256, np.int64)
CODE[[ord(c) for c in SYMBOLS]] = range(1, WIDTH)
LOWERED = np.array([0, *(CODE[ord(c.lower())] for c in SYMBOLS)])
#: What every symbol's count in a state of a format is raised by.
RAISE = 0.05
#: Public credential formats: a fixed prefix, the symbols that follow and their number.
FORMATS = {
    "access_key": ("AKIA", UPPER + DIGIT, 16),
    "session_key": ("ASIA", UPPER + DIGIT, 16),
    "repository_token": ("ghp_", UPPER + LOWER + DIGIT, 36),
    "payment_key": ("sk_live_", UPPER + LOWER + DIGIT, 24),
    "chat_token": ("xoxb-", DIGIT + "-" + UPPER + LOWER, 40),
    "map_key": ("AIza", UPPER + LOWER + DIGIT + "-_", 35),
    "hex_key": ("", "abcdef" + DIGIT, 40),
    "base64_key": ("", UPPER + LOWER + DIGIT + "+/", 40),
}


def examples(per_format: int = 120, seed: int = 5) -> dict[str, list[str]]:
    """Labelled credentials of the public formats, made up from a fixed seed."""
    g = random.Random(seed)
    return {k: [p + "".join(g.choices(a, k=n)) for _ in range(per_format)] for k, (p, a, n) in FORMATS.items()}


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.total, self.next = [], []  # per state: visits, {symbol: [state, count]}
        self._state()
        for s in strings:
            at = 0
            self.total[0] += 1
            for ch in s + END:
                edge = self.next[at].setdefault(ch, [None, 0])
                edge[1] += 1
                if ch == END:
                    break
                if edge[0] is None:
                    edge[0] = self._state()
                at = edge[0]
                self.total[at] += 1
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], [e[0] for c, e in sorted(self.next[0].items()) if c != END]
        while blue:
            q = blue.pop(0)
            for r in red:
                if self._compatible(r, q):
                    self._merge(red, r, q)
                    break
            else:
                red.append(q)
            seen = set(red)
            blue = sorted({e[0] for r in red for c, e in self.next[r].items() if c != END and e[0] not in seen}, key=lambda s: -self.total[s])
        self._tables(red)

    def _state(self) -> int:
        self.total.append(0)
        self.next.append({})
        return len(self.total) - 1

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            bound = self.slack * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for ch in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(ch, (None, 0)), self.next[b].get(ch, (None, 0))
                if abs(x[1] / n - y[1] / m) > bound:
                    return False
                if x[0] is not None and y[0] is not None and x[0] != y[0]:
                    stack.append((x[0], y[0]))
        return True

    def _merge(self, red: list[int], r: int, q: int) -> None:
        for s in red:
            for e in self.next[s].values():
                if e[0] == q:
                    e[0] = r
        stack = [(r, q)]
        while stack:  # fold the tree below q into r
            a, b = stack.pop()
            self.total[a] += self.total[b]
            for ch, (to, n) in self.next[b].items():
                if ch not in self.next[a]:
                    self.next[a][ch] = [to, n]
                    continue
                e = self.next[a][ch]
                e[1] += n
                if to is not None and e[0] is not None and e[0] != to:
                    stack.append((e[0], to))

    def _tables(self, states: list[int]) -> None:
        """Transitions and log-probabilities over the symbols and the end; a symbol not seen in a state keeps it.

        Each state's probabilities sum to 1: counts are raised by RAISE for every symbol.
        """
        number = {s: i for i, s in enumerate(states)}
        self.go = np.tile(np.arange(len(states))[:, None], (1, WIDTH))
        count = np.full((len(states), WIDTH), RAISE)
        for s, i in number.items():
            for ch, (to, c) in self.next[s].items():
                count[i, CODE[ord(ch)]] += c
                if to in number:
                    self.go[i, CODE[ord(ch)]] = number[to]
        self.cost = np.log(count / count.sum(1, keepdims=True))


class Background:
    """Ordinary tokens: each symbol depends on the two before it.

    ``count`` holds, for every two symbols and the next one (0: none, before the start or at the end), how often they
    follow each other. Longer contexts fall back on shorter ones in proportion to how many symbols have followed
    them. A token may also be written in capitals, be a number or repeat one symbol, each with a chance of 1 in 1000.
    """

    def __init__(self, count: np.ndarray):
        lower = np.full((1, WIDTH), 1 / WIDTH)
        three = count.reshape(WIDTH, WIDTH, WIDTH).astype(float)
        for level in (three.sum((0, 1))[None], three.sum(0), three.reshape(-1, WIDTH)):
            kinds = np.maximum((level > 0).sum(1, keepdims=True), 1)
            lower = np.tile(lower, (len(level) // len(lower), 1))  # a context's fallback is that of its last symbols
            lower = (level + kinds * lower) / (level.sum(1, keepdims=True) + kinds)
        self.cost = np.log(lower)
        self.go = (np.arange(WIDTH * WIDTH) % WIDTH)[:, None] * WIDTH + np.arange(WIDTH)

    @classmethod
    def of(cls, tokens: list[str]) -> Background:
        return cls(follow_counts(" ".join(tokens).encode("utf-8", "replace")))

    def likelihood(self, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = walk(self, codes, length)
        live = np.arange(codes.shape[1])[None] < length[:, None]
        low = (codes == LOWERED[codes]) | ~live
        capitals = walk(self, LOWERED[codes], length) - math.log(1000)
        out = np.where(low.all(1), out, np.logaddexp(out, capitals))
        digits = (np.isin(codes, CODE[[ord(c) for c in DIGIT]]) | ~live).all(1)
        out = np.where(digits, np.logaddexp(out, length * math.log(0.09) + math.log(1e-4)), out)
        same = ((codes == codes[:, :1]) | ~live).all(1)
        return np.where(same, np.logaddexp(out, length * math.log(0.9) - math.log(1e4 * WIDTH)), out)


def follow_counts(raw: bytes) -> np.ndarray:
    """How often each symbol follows each two others in tokens of these bytes; other bytes end a token."""
    code = CODE[np.frombuffer(b" " + raw + b" ", np.uint8)]
    one = code[:-1]
    two = np.where(one == 0, 0, np.concatenate([[0], code[:-2]]))
    now = code[1:]
    some = (now > 0) | (one > 0)
    return np.bincount(((two * WIDTH + one) * WIDTH + now)[some], minlength=WIDTH**3)


def walk(automaton: Automaton | Background, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Log-likelihood of padded strings (n, width) with their ends."""
    at, sums = np.zeros(len(codes), np.int64), np.zeros(len(codes))
    for k in range(codes.shape[1]):
        live = k < length
        sums += np.where(live, automaton.cost[at, codes[:, k]], 0)
        at = np.where(live, automaton.go[at, codes[:, k]], at)
    return sums + automaton.cost[at, 0]


class Grammars:
    """The formats' automata, the background, and the odds at which a token is a credential."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str] | Background, odds: float = 1e6):
        self.formats = [Automaton(v) for v in labelled.values() if v]
        self.background = ordinary if isinstance(ordinary, Background) else Background.of(ordinary or ["the"])
        self.odds = odds

    def credential(self, tokens: list[str]) -> np.ndarray:
        """Whether each token is likelier under a format than as an ordinary token, by the odds and more."""
        return self.advantage(tokens) > math.log(self.odds)

    def advantage(self, tokens: list[str]) -> np.ndarray:
        """Logarithm of the odds of the best format against the background; the formats share the chance equally."""
        out = np.zeros(len(tokens))
        order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
        at = 0
        while at < len(order):
            # the whole token counts; tokens are padded to the longest of a group of like lengths
            most = max(1, 1 << 20 >> len(tokens[order[at]]).bit_length())
            some = order[at : at + min(4096, most)]
            some = [i for i in some if len(tokens[i]) <= 2 * len(tokens[some[0]])]
            at += len(some)
            length = np.array([len(tokens[i]) for i in some])
            codes = np.zeros((len(some), int(length[-1])), np.int64)
            for r, i in enumerate(some):
                codes[r, : length[r]] = CODE[np.frombuffer(tokens[i].encode(), np.uint8)]
            best = np.max([walk(a, codes, length) for a in self.formats], 0) - math.log(len(self.formats))
            out[some] = best - self.background.likelihood(codes, length)
        return out


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the value), by start, then kind as listed."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if re.search("[:=]", text) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, v) for s, k, e, v in sorted(found)]


def all_spans(texts: list[str], grammars: Grammars) -> list[list[tuple[int, str, int, int]]]:
    base = [base_spans(t) for t in texts]
    tokens, where = [], []
    for k, t in enumerate(texts):
        for m in CANDIDATE.finditer(t):
            if not any(s < m.end() and m.start() < e for s, _, e, _ in base[k]):
                tokens.append(m.group())
                where.append((k, m.start(), m.end()))
    added: list[list] = [[] for _ in texts]
    for (k, s, e), yes in zip(where, grammars.credential(tokens).tolist(), strict=True):
        if yes:
            added[k].append((s, "format", e, s))
    rank = {k: i for i, k in enumerate(KINDS)}
    return [sorted(b + a, key=lambda x: (x[0], rank[x[1]])) if a else b for a, b in zip(added, base, strict=True)]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 150, few: int = 20) -> Grammars:
    """Grammars for ``docs``: public formats, the documents' own labelled values, and the background of all their tokens.

    Of each kind of base span, at most ``most`` different values of 16 to 200 symbols are examples, the first by a hash;
    fewer than ``few`` make no automaton. The background counts every token of every text outside base spans: a task
    gives its counts, of bounded number, and they are summed in Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH**3, np.int64)
        values: dict[str, set[tuple[int, str]]] = {k: set() for k in KINDS[:3]}
        for b in slices(batches, 100):
            kept = []
            for t in b.column(0).to_pylist():
                at = 0
                for s, kind, e, v in base_spans(t):
                    value = t[v:e]
                    if 16 <= len(value) <= 200 and CANDIDATE.fullmatch(value):
                        values[kind].add((xxhash.xxh64_intdigest(value.encode(), 9) >> 1, value))
                    if s >= at:
                        kept.append(t[at:s])
                    at = max(at, e)
                kept.append(t[at:])
            total += follow_counts(" ".join(kept).encode("utf-8", "replace"))
            for k, found in values.items():
                if len(found) > 10 * most:
                    values[k] = set(sorted(found)[:most])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at), pa.array(total[at]), pa.nulls(len(at), pa.string())], names=["kind", "at", "n", "value"])
        rows = [(k, h, v) for k, found in values.items() for h, v in sorted(found)[:most]]
        if rows:
            k, h, v = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(h, pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(v)], names=["kind", "at", "n", "value"])

    texts = bounded(docs).select(text_col).filter(F.col(text_col).isNotNull())
    seen = materialize(texts.mapInArrow(in_worker(run), "kind string, at bigint, n bigint, value string"), "secrets-seen")
    sums = seen.filter("kind is null").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most WIDTH ** 3 rows
    count = np.zeros(WIDTH**3, np.int64)
    count[sums["at"].to_numpy()] = sums["n"].to_numpy()
    labelled = examples()
    for kind in KINDS[:3]:
        rows = seen.filter(F.col("kind") == kind).select("at", "value").distinct().orderBy("at", "value").limit(most).collect()
        if len(rows) >= few:
            labelled[kind] = [r["value"] for r in rows]
    discard(seen)
    return Grammars(labelled, Background(count))


def scan(docs: DataFrame, grammars: Grammars, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans: array of (kind, start, end, value)) for every row; offsets in code points, end exclusive.

    ``value`` is where the secret itself starts. Null texts count as empty. Repeated ids stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(grammars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))
        for b in slices(batches, 100):
            found = all_spans([t or "" for t in b.column(1).to_pylist()], sent.value)
            rows = [[{"kind": k, "start": s, "end": e, "value": v} for s, k, e, v in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded(docs).select(id_col, text_col).mapInArrow(in_worker(run), f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:bigint>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, sha256 of the base spans and all spans as text, from ``scan``'s result."""
    text = lambda only: F.array_join(F.transform(only, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, grammars: Grammars, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret's value replaced by ``mark``; null texts and all other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(grammars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            out = []
            for t, spans in zip(texts, all_spans([t or "" for t in texts], sent.value), strict=True):
                for s, e in reversed(union([(v, e) for _, _, e, v in spans])):
                    t = t[:s] + mark + t[e:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return bounded(docs).mapInArrow(in_worker(run), docs.schema)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def sha256_of(spans: list[tuple[int, str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e, _ in spans if k != "format").encode()).hexdigest()
