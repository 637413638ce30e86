"""One query per operator, each over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import alignment, bpe, divergence, kdsearch, linkgraph, packing, revisit, secrets, sharding, simhash, subspace, tokencount, toxicity

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 512
RULES = [
    linkgraph.Rule("block", "net", "/"),
    linkgraph.Rule("allow", "example.net", "/en/"),
    linkgraph.Rule("block", "example.com", "/de/"),
    linkgraph.Rule("allow", "org", "/fr/"),
]
DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op2_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = kdsearch.whole_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIMENSIONS)
    return kdsearch.top_k(vecs.filter(F.col("id") % 100 == 0), vecs, DIMENSIONS)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.learn(docs)))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_subspace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_vectors(table(spark, sf_dir, "embeddings"), DIMENSIONS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, net)
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def captures(pages: DataFrame) -> DataFrame:
    """Captures made of all pages: the page number is the time, the url is cut to its section, and a page fetched with a
    query or a fragment is a revisit. Of every fourth page the section has a query, whose parameters stand in another
    order for revisits. Two in three captures carry a validator: a tag, outdated for full responses in ``/de``, or a date."""
    site = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", r"^[^?#]*", 0), r"(?:\.html|/)$", ""), r"/[0-9]+$", "")
    again = F.coalesce(F.col("url").rlike("[?#]"), F.lit(False))
    query = F.when(F.col("page_id") % 4 == 0, F.when(again, "?page=2&ref=x").otherwise("?ref=x&page=2")).otherwise("")
    tag = F.when(~again & site.contains("/de"), F.concat(F.lit("old-"), F.md5(site))).otherwise(F.md5(site))
    date = F.concat(F.lit("m"), F.when(again, 0).otherwise(F.col("page_id") % 2).cast("string"))
    headers = F.map_filter(
        F.create_map(
            F.lit("etag"), F.when(F.col("page_id") % 3 == 1, tag), F.lit("last-modified"), F.when(F.col("page_id") % 3 == 0, date),
            F.lit("date"), F.col("page_id").cast("string"), F.lit("server"), F.when(again, "cache").otherwise("origin"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return pages.select(
        F.col("page_id").alias("id"), F.concat(site, query).alias("url"), F.col("page_id").alias("ts"), F.when(again, 304).otherwise(200).alias("status"),
        headers.alias("headers"), F.when(~again, F.md5("html")).alias("payload"),
    )


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisit.resolve(captures(table(spark, sf_dir, "pages")))
    return done.select(
        F.col("id").alias("page_id"), "url", "outcome", "source_id", "payload",
        F.col("headers")["server"].alias("server"), F.col("headers")["date"].alias("date"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencount.count_tokens(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_kd_search, op3_secret_scan, op4_kd_sharding, op5_subspace_dedup, op6_toxicity, op7_revisits,
        op8_best_fit_packing, op9_byte_bpe, op10_simhash_dedup, op11_source_divergence, op12_token_counts, op13_token_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_kd_search": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as vec
            from embeddings
            where vec_id is not null and len(embedding) = 64
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                   cast(list_sum(list_transform(range(1, 65), lambda i: q.vec[i] * c.vec[i])) as bigint) as score
            from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""",
    "op5_subspace_dedup": """
        with recursive v as (
            select vec_id, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link as (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
            where list_cosine_similarity(a.vec, b.vec) >= 0.95
        ), reach(a, b) as (
            select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a
        )
        select e.vec_id, (select count(*) from link where a = e.vec_id) as n_links,
               least(e.vec_id, coalesce((select min(b) from reach where a = e.vec_id), e.vec_id)) as component_id,
               e.vec_id = least(e.vec_id, coalesce((select min(b) from reach where a = e.vec_id), e.vec_id)) as kept
        from embeddings e""",
    "op7_revisits": """
        with p as (
            select page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*'), '(\\.html|/)$', ''), '/[0-9]+$', '') as site,
                   coalesce(regexp_matches(url, '[?#]'), false) as again, html from pages
        ), c as (
            select page_id, again,
                   site || case when page_id % 4 = 0 then case when again then '?page=2&ref=x' else '?ref=x&page=2' end else '' end as url,
                   regexp_replace(lower(regexp_extract(site, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '') || regexp_extract(site, '^[^:/?#]+://[^/?#]*(.*)$', 1)
                       || case when page_id % 4 = 0 then '?page=2&ref=x' else '' end as key,
                   case when page_id % 3 = 1 then case when not again and contains(site, '/de') then 'old-' || md5(site) else md5(site) end end as tag,
                   case when page_id % 3 = 0 then 'm' || cast(case when again then 0 else page_id % 2 end as varchar) end as modified,
                   case when not again then md5(html) end as payload
            from p
        ), k as (select *, coalesce(key, '') as k from c
        ), j as (
            select a.*, f.page_id as source_id, f.payload as full_payload,
                   case when a.tag is not null and f.tag is not null then a.tag = f.tag
                        when a.modified is not null and f.modified is not null then a.modified = f.modified else true end as agree
            from k a asof left join (select * from k where not again) f on a.k = f.k and a.page_id > f.page_id
        )
        select page_id, url,
               case when not again then 'full' when source_id is null then 'orphan' when agree then 'resolved' else 'mismatch' end as outcome,
               case when again then source_id end as source_id,
               case when again and source_id is not null and agree then full_payload else payload end as payload,
               case when again and not (source_id is not null and agree) then 'cache' else 'origin' end as server,
               cast(page_id as varchar) as date
        from j""",
    "op11_source_divergence": r"""
        with d as (
            select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
        ), w as (
            select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
        ), g as (select distinct lang, source from d
        ), kept as (select lang, term, count(*) as in_lang from w group by lang, term having count(distinct id) >= 3
        ), own as (
            select w.lang, w.source, w.term, count(*) as n from w join kept k on w.lang = k.lang and w.term = k.term group by all
        ), every as (
            select g.lang, g.source, k.term, k.in_lang, coalesce(o.n, 0) as n
            from g join kept k on g.lang = k.lang left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term
        ), sized as (
            select *, sum(n) over (partition by lang, source) as total, count(*) over (partition by lang, source) as v,
                   sum(in_lang) over (partition by lang, source) as lang_total
            from every
        ), p as (
            select lang, source, term, n, 1 + (1000000000::hugeint * (n + 1)) // (total + v) as p, 1 + (1000000000::hugeint * (in_lang + 1)) // (lang_total + v) as q
            from sized
        ), pair as (
            select a.lang, a.source, b.source as item, coalesce((
                select sum(((x.p - y.p) * (x.p - y.p)) // y.p) from p x join p y on x.term = y.term and x.lang = y.lang
                where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
            from g a join g b on a.lang = b.lang and a.source <> b.source
        ), term as (
            select lang, source, term as item, ((p - q) * (p - q)) // q as value from p where n > 0 and p > q
        ), ranked as (
            select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pair
            union all
            select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from term
            qualify rank <= 200
        )
        select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked""",
}
