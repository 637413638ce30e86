"""SimHash and embedding near-duplicates against brute force."""

import itertools
import random

import numpy as np
import xxhash

from tapeworks.llm import common, simhash, subspace

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string"


def plain_fingerprint(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, links):
    at = list(range(n))
    for _ in range(n):
        old = list(at)
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
        if at == old:
            break
    return at


def texts(g):
    words = ["alpha", "Beta", "gamma", "delta", "Épée", "über", "x", "yy", "zzz", "word"]
    base = [" ".join(g.choices(words, k=g.choice([1, 2, 3, 40, 400]))) for _ in range(40)]
    out = list(base)
    for t in base:
        parts = t.split()
        for _ in range(2):
            parts[g.randrange(len(parts))] = g.choice(words)
            out.append(" ".join(parts))
    return out + base[:10] + ["", None, " \t\n", "a", "A", "long " * 30000]


def test_simhash_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(random.Random(1)))]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], DOC)
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = components(len(rows), links)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (fps[i], want[i]) for i, _ in rows}


def test_hot_anchor_ties_the_same_components(spark):
    g = random.Random(2)
    centre = g.getrandbits(64)
    cloud = {centre ^ sum(1 << b for b in g.sample(range(64), g.randrange(5))) for _ in range(400)}
    fps = sorted(cloud | {g.getrandbits(64) for _ in range(50)})
    links = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = components(len(fps), links)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    for hot in (0, 3, 64):
        found = common.connected_components(simhash.links(prints, hot=hot)).collect()
        at = {r["node"]: r["component"] for r in found}
        assert [at.get(i, i) for i in range(len(fps))] == want


def test_copies_for_anchors_and_points_are_not_broadcast(spark, monkeypatch):
    """They are many times the fingerprints; Spark, which takes them for as large, broadcast them up to a million fingerprints."""
    plans = []
    write = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: plans.append(df) or write(df, name))
    prints = write(spark.range(3000).selectExpr("xxhash64(id) as fp", "id as node"), "prints")
    plans.append(simhash.links(prints))
    met, tied = (df._jdf.queryExecution().executedPlan().toString() for df in plans)
    assert "SortMergeJoin [anchor#" in met and "BroadcastHashJoin [anchor#" not in met
    assert "SortMergeJoin [p#" in tied and "BroadcastHashJoin [p#" not in tied


def test_anchors_meet_for_every_pair_within_two_bits():
    g = random.Random(3)
    for _ in range(200):
        x = g.getrandbits(64)
        y = x ^ sum(1 << b for b in g.sample(range(64), g.randrange(3)))
        pair = np.array([x, y], np.uint64).view(np.int64)
        row, at, home = simhash.anchors(pair)
        assert home.sum() == 2
        assert set(at[home & (row == 0)]) <= set(at[row == 1])
        assert set(at[home & (row == 1)]) <= set(at[row == 0])


def test_simhash_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "q"), (7, "r s t"), (7, "r s t")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == [("5", "5"), ("7", "7"), ("7", "7"), ("None", "5"), ("None", "None")]


def test_ids_may_be_strings_and_rows_repeat(spark):
    copies = ["the cat sat on the mat by the door", "a quite different text of several words", "the cat sat on the mat by the door"]
    df = spark.createDataFrame([(f"d{i}", t, 1) for i, t in enumerate(copies)] * 2, "doc_id string, text string, node int")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {("d0", "d0"), ("d1", "d1"), ("d2", "d0")}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == ["d0", "d0", "d1", "d1"]


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(300, 300)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 200)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(g, n=150, dim=64):
    base = g.standard_normal((n, dim))
    near = base[:60] + g.standard_normal((60, dim)) * 0.25 * g.random((60, 1))
    cloud = base[0] + g.standard_normal((60, dim)) * 0.2
    out = np.concatenate([base, near, cloud, base[:5], base[:3] * 3]).astype(np.float32)
    return [v.tolist() for v in out] + [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * 3, [float("inf")] * dim]


def test_subspace_join_equals_brute_force(spark):
    rows = vectors(np.random.default_rng(4))
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, n_links string")
    ok = [i for i, v in enumerate(rows) if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([rows[i] for i in ok], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    cos = m @ m.T
    links = [(ok[a], ok[b]) for a, b in itertools.combinations(range(len(ok)), 2) if cos[a, b] >= 0.95]
    assert len(links) > 100
    n = [sum(i in p for p in links) for i in range(len(rows))]
    at = components(len(rows), links)
    for conf in ({}, {"blocks": 4, "cell_bits": 2}, {"tile": 16}):
        got = sorted(tuple(r) for r in subspace.near_vectors(df, 64, **conf).collect())
        assert got == [(i, n[i], at[i], i == at[i]) for i in range(len(rows))]


def test_subspace_cells_meet_every_near_pair_and_few_others(monkeypatch):
    """With four random blocks of 3,000 vectors less than half of all ordered pairs are held against each other; it was three times all."""
    g = np.random.default_rng(7)
    base = g.standard_normal((2000, 64))
    step = g.standard_normal((1000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    step -= (step * base[:1000]).sum(1, keepdims=True) * base[:1000]
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    cos = g.uniform(0.95, 0.96, (1000, 1))
    near = cos * base[:1000] + np.sqrt(1 - cos**2) * step
    z = subspace.rotated(np.concatenate([base, near]), subspace.rotation(64))
    share = subspace.reached(0.1**0.5, 64) / 4
    conf = {"bits": 8, "width": 16, "share": share, "half": np.float32(share / 2 * (1 << subspace.SQUARES))}
    done, at_most = [], subspace.Tile.at_most
    monkeypatch.setattr(subspace.Tile, "at_most", lambda self, a, b, plus, most: done.append(len(a) * b.shape[1] * (plus is None)) or at_most(self, a, b, plus, most))
    met = set()
    for k in range(4):
        tile = subspace.Tile(k, np.arange(3000), z[:, 16 * k : 16 * k + 16], conf)
        for h, p in tile.hits(z[:, 16 * k : 16 * k + 16]):
            met |= {(min(x), max(x)) for x in zip(tile.ids[h].tolist(), p.tolist(), strict=True)}
    assert {(i, 2000 + i) for i in range(1000)} <= met
    assert sum(done) < 0.5 * 3000**2


def test_subspace_of_tiny_and_huge_vectors(spark):
    v = np.random.default_rng(6).standard_normal(64)
    rows = [(0, (v * 1e-200).tolist()), (1, (v * 1e200).tolist()), (2, v.tolist()), (3, (-v * 1e-160).tolist())]
    got = sorted(tuple(r) for r in subspace.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 64).collect())
    assert got == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True)]


def test_subspace_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert subspace.near_vectors(df, 64).count() == 0


def test_keep_one_catches_near_copies_and_leaves_the_rest(spark):
    g = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    base = [g.choices(words, k=g.choice([60, 200, 600])) for _ in range(150)]
    rows, near = [], set()
    for t in base:
        rows.append(" ".join(t))
    for t in base[:100]:
        for share in (0.0, 0.005, 0.012):
            u = list(t)
            for _ in range(int(len(u) * share)):
                u[g.randrange(len(u))] = g.choice(words)
            near.add(len(rows))
            rows.append(" ".join(u))
    ids = list(range(len(rows)))
    df = spark.createDataFrame([(i, rows[i], "en", "s", 0, "x", "y") for i in ids] + [(9000, None, "", "", 0, "", ""), (9001, "", "", "", 0, "", "")], DOC)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = {r["doc_id"] for r in kept.collect()}
    assert set(range(150)) <= got and 9000 in got and 9001 not in got
    assert len(got & near) <= 0.05 * len(near)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_sketches_are_exact_for_small_sets():
    a, b = "a b c d e f g h", "a b c d e f g x"
    s = [simhash.sketch(t, 5, 256) for t in (a, b)]
    assert simhash.similarity(*s, 256) == 3 / 5
    assert simhash.similarity([], [], 256) == 1.0 and simhash.similarity([1], [], 256) == 0.0


def test_bitmap_keeps_what_is_asked_and_little_else(spark):
    rows = spark.range(-2000, 20000).selectExpr("id", "cast(id as string) as text")
    asked = spark.range(-2000, 20000, 7).select("id")
    got = {r["id"] for r in simhash.probably_in(rows, asked).collect()}
    want = {r["id"] for r in asked.collect()}
    assert want <= got and len(got) < len(want) + 100
    few = {r["id"] for r in simhash.probably_in(rows, asked, bits=64).collect()}
    assert want <= few
    assert simhash.probably_in(rows, asked.limit(0)).count() == 0


def kept_of(spark, rows):
    return {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}


def exact_kept(rows, k=5):
    sets = [frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if (w := t.split()) else frozenset() for t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return {i for i, c in enumerate(components(len(rows), links)) if i == c}


def test_keep_one_finds_copies_in_a_crowd_of_one_repeated_line(spark):
    g = random.Random(11)
    line = [f"b{i}" for i in range(11)] * 40
    tails = [[f"w{g.randrange(10**6)}" for _ in range(60)] for _ in range(150)]
    near = [t[:59] + ["other"] for t in tails[:100]]
    rows = [" ".join(line + t) for t in tails + tails[:100] + near]
    assert kept_of(spark, rows) == set(range(150))


def test_keep_one_joins_a_group_of_near_copies_without_meeting_all_pairs(spark, monkeypatch):
    """A chain of edits: neighbours are similar, the ends are not; two such groups tied by one text between them."""
    g = random.Random(13)
    rows = []
    for _ in range(2):
        t = [f"w{g.randrange(10**7)}" for _ in range(100)]
        for _ in range(120):
            t = list(t)
            t[g.randrange(len(t))] = f"w{g.randrange(10**7)}"
            rows.append(" ".join(t))
    a, b = rows[10].split(), rows[150].split()
    rows += [" ".join(a + b[:20]), " ".join(a[:95]), " ".join(a + b)]
    sizes = {}
    write = simhash.materialize

    def counted(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    assert kept_of(spark, rows) == exact_kept(rows)
    assert sizes["simhash-met"] + sizes["simhash-candidates"] < 12 * len(rows)


def test_keep_one_broadcasts_no_table_by_shingle(spark, monkeypatch):
    """As Parquet such tables are small; a broadcast of them took a hundred megabytes."""
    plans = []
    write = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    g = random.Random(14)
    rows = [" ".join(f"w{g.randrange(400)}" for _ in range(30)) for _ in range(20)]
    rows += [r + " other" for r in rows[:8]]
    assert kept_of(spark, rows) == exact_kept(rows)
    assert {"simhash-tokens", "simhash-star", "simhash-fits", "simhash-met", "simhash-equal"} <= {name for name, _ in plans}
    for name, plan in plans:
        assert "BroadcastHashJoin [token" not in plan and "BroadcastHashJoin [whole" not in plan, name


def test_keep_one_finds_every_shape_just_above_the_limit(spark):
    g = random.Random(12)
    rows, n = [], 0

    def new(m):
        nonlocal n
        n += m
        return [f"w{i}" for i in range(n - m, n)]

    for size in (40, 148, 400, 904):  # words; shingles are 4 less
        most = (size - 4) // 9  # of the shingles may be replaced, a fourth of them added
        for _ in range(12):
            for above in (0, 1):
                t = new(size)
                at = g.randrange(4, size - most - 4)
                rows += [t, t[:at] + new(most - 4 + above) + t[at + most - 4 + above :]]
                t = new(size)
                rows += [t, t + new((size - 4) // 4 + above)]
            t = new(size)
            u = list(t)
            for i in range(4, 4 + 5 * (most // 5), 5):
                u[i] = new(1)[0]
            rows += [t, u]
    rows = [" ".join(t) for t in rows]
    want = exact_kept(rows)
    assert len(want) == len(rows) - 4 * 12 * 3
    assert kept_of(spark, rows) == want
