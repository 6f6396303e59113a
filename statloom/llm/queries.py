"""One query per operator over its whole table, each with the SQL of the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm import chat, decontamination, embedding_dedup, filter_audit, language_id, mixing, neighbours, ngram_join, periodic_runs, secrets, surrogates, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


OP1_SQL = """
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as part
  from items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as u(i) where len(w) > 0
), places as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as part
  from words, (select distinct n from windows) as lengths, unnest(range(1, len(w) - n + 2)) as u(i)
), found as (select doc_id, i, n, item_id from places join windows using (n, part)
), hit as (select doc_id, count(distinct j) as n_hit from found, unnest(range(i, i + n)) as u(j) group by 1
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item_id::varchar as item from found) group by 1
)
select doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join named using (doc_id)
"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.search(documents, table(spark, folder, "benchmark")))


@query("op2_surrogates")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace(documents, secret=b"surrogates of the registered query").select("doc_id", "n_entities", F.to_json("kinds").alias("kinds"), "text")


OP3_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') as s
  from words, unnest(range(1, greatest(len(w) - 3, 0) + 2)) as u(i) where len(w) > 0
), sizes as (select doc_id, count(*) as n from shingles group by 1
), links as (
  select a.doc_id as x, b.doc_id as y from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes p on p.doc_id = a.doc_id join sizes q on q.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x
), least_of as (select x, min(y) as y from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(y, doc_id)) as component_id
from words left join sizes using (doc_id) left join least_of on x = doc_id
"""


@query("op3_ngram_join", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.component_table(table(spark, folder, "documents"))


@query("op4_mix")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), weights=[5.0, 2.0, 1.0], most=3.0, share=1.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op6_count_tokens")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_identify_language")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(documents, public_tokenizers.path("piece_bpe_32k.model"))
    found = language_id.predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


OP8_SQL = """
with data as (select page_id, coalesce(html, '') as html from pages
), digests as (select page_id, octet_length(encode(html)) as n, sha1(html) as h from data
), firsts as (select h, min(page_id) as first_id from digests group by 1
), bits as (
  select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (
    (((('0x' || substr(h, 1 + (5 * k) // 4, 2) || case when (5 * k) // 4 = 39 then '0' else '' end)::ubigint) >> (8 - 5 - (5 * k) % 4)) & 31) + 1)::bigint, 1), '' order by k) as b32
  from (select distinct h from digests), unnest(range(32)) as u(k) group by 1
)
select page_id, n::bigint as payload_bytes, b32 as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from digests join firsts using (h) join bits using (h)
"""


@query("op8_write_warc", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


OP10_SQL = """
with recursive data as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
), fine as (
  select vec_id, v, sqrt(list_dot_product(v, v)) as norm from data
  where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as x, b.vec_id as y from fine a join fine b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x
), least_of as (select x, min(y) as y from reach group by 1
), counts as (select x, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(y, vec_id)) as component_id, vec_id <= coalesce(y, vec_id) as kept
from data left join counts on counts.x = vec_id left join least_of on least_of.x = vec_id
"""


@query("op10_embedding_links", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.link_table(table(spark, folder, "embeddings"), threshold=0.95)


@query("op5_render_chats")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(table(spark, folder, "conversations"))


@query("op7_scan_secrets")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan_with_own_findings(documents, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"), "secrets", F.sha2("text", 256).alias("masked_sha256"))


OP11_SQL = """
with recursive texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), firsts as (select coalesce(text, '') as t, min(doc_id) as first_id from documents group by 1
), facts as (
  select doc_id, part,
    (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
    + (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) then 4 else 0 end)
    + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > first_id then 16 else 0 end) as mask
  from texts join firsts using (t)
), marked as (
  select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels group by 1
), masks as (
  select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from facts left join marked using (doc_id) group by 1, 2
), orders as (
  select ''::varchar as o, 0 as before union all select o || l, before from orders, unnest(['A','B','C','D','E']) as u(l) where not contains(o, l)
), steps as (
  select o as filter_order, s::integer as step, 1 << (ascii(o[s]) - 65) as bit,
         (select coalesce(sum(1 << (ascii(o[k]) - 65)), 0) from unnest(range(1, s)) as v(k))::integer as before
  from orders, unnest(range(1, 6)) as u(s) where length(o) = 5
), counted as (
  select m.part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & (before | bit) = 0), 0) as kept,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0) as removed,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0) as redundant,
    coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
    coalesce(sum(g) filter (mask & bit <> 0 and mask & before = 0), 0) as good_lost,
    coalesce(sum(x) filter (mask & bit <> 0 and mask & before = 0), 0) as toxic_lost
  from masks m, steps group by 1, 2, 3, 4
)
select part, filter_order, step, chr(65 + log2(bit)::integer) as filter, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       sum(removed) over (partition by part, bit)::bigint as shapley
from counted
"""


@query("op11_audit_filters", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    ids, failing = filter_audit.failing_ids(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return filter_audit.audit(ids, failing)


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.collapse(table(spark, folder, "documents"), plant=True).drop("n_words")


@query("op13_nearest_neighbours")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    return neighbours.search(neighbours.build(embeddings), embeddings.where("vec_id % 20 = 0"), k=20)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
