"""The pipeline against its parts, stage by stage."""

import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tapeworks.llm import packing, secrets, simhash, toxicity
from tapeworks.llm.common import materialize
from tapeworks.llm.queries import WORD_TOKENIZER
from tests.llm.test_dedup import components, plain_fingerprint


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes), name
    net = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score(docs, net).filter("score < 0.5").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= clean and 0 < len(ids) < docs.count()
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len(set(texts))
    assert not any(k != "format" for t in texts for _, k, _, _ in secrets.base_spans(t.replace("[secret]", "")))
    out = corpus_pipeline.run(spark, sf_dir)
    want = packing.pack_documents(kept, WORD_TOKENIZER)
    key = ("doc_id", "piece", "length", "ids_crc32")
    assert sorted(out.select(*key).collect()) == sorted(want.select(*key).collect())


def test_stages_on_odd_documents(spark, sf_dir):
    """Nulls in every column, repeated ids and rows, ties, empty and long texts, clashing columns; and an empty table."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    line = "several quite ordinary words that make one line of prose without end "
    rows = [(None, None, None, None, None), (900001, None, "en", "s", 0), (900002, "", "en", None, 0), (900003, "", None, "s", None), (900004, line * 3000, "en", "s", 1), (900005, line, "de", "s", 1), (900005, line, "de", "s", 1)]
    rows += [(900006, "x token = abcdefghijkl y", "en", "s", 24), (900006, "another text of that id, with words enough to be told apart", "en", "s", 2)]
    docs = real.unionByName(spark.createDataFrame(rows, real.schema)).withColumns({"score": F.lit(0.9), "node": F.lit("x"), "spans": F.lit(True), "length": F.lit(1)})
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, sf_dir), "odd")
        assert dict(kept.dtypes) == dict(docs.dtypes), name
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert None in ids and 900001 in ids and 900004 in ids
    assert ids.count(900002) + ids.count(900003) == 0  # empty texts are equal: the smallest id of them stays
    assert kept.filter("doc_id = 900006 and text like 'x%'").first()["text"] == "x token = [secret] y"
    packed = corpus_pipeline.pack_sequences(spark, kept, sf_dir)
    assert packed.select("doc_id").distinct().count() == len(set(ids))
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
        assert none.count() == 0


def test_near_dedup_where_ids_repeat(spark):
    """Different texts of one id are documents of their own; rows equal in id and text stay or go together; rows without an id stay."""
    a, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "gamma"))
    rows = [(1, a, "x"), (2, a, "x"), (2, c, "x"), (3, c + " more", "x"), (2, c, "y"), (None, a, "x"), (None, a, "x"), (4, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in simhash.keep_one(df).collect()))
    assert got == sorted([(0, a), (0, a), (1, a), (2, c), (2, c), (4, "")])
    unique = spark.createDataFrame([(1, a, "x"), (2, c, "x"), (3, a, "x")], "doc_id long, text string, node string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(unique).collect()) == [1, 2]


def test_near_dedup_meets_texts_by_simhash(spark, monkeypatch):
    """What is held against each other first are the fingerprints at most two bits apart, all of them."""
    g = random.Random(17)
    rows = []
    for _ in range(40):
        t = [f"w{g.randrange(10**6)}" for _ in range(g.choice((60, 300, 900)))]
        for i in range(4):
            rows.append(" ".join(t))
            t[g.randrange(len(t))] = f"new{i}"
    fps = [plain_fingerprint(t) for t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert len([1 for a, b in links if fps[a] != fps[b]]) > 20
    met = []
    write = simhash.materialize

    def told(df, name):
        out = write(df, name)
        if name == "simhash-candidates":
            met.extend((r["a"], r["b"]) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "materialize", told)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert components(len(rows), met) == components(len(rows), links)
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in met)
    assert set(range(0, len(rows), 4)) <= kept and len(kept) < len(rows)
