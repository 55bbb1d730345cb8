"""The registered queries of this package and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.llm import bpe, chat, decontaminate, divergence, exact_dedup, lm, near_dedup, quality, secrets, suffixes, trie, url_filter, warc
from aislemetrics.llm.common import LOWER, UPPER, crc_mod, table
from aislemetrics.session import scratch_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]
ACCEPT = 0.7  # least score of a predicted label 1

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(texts(spark, sf_dir))
    size = F.size("spans").cast("long")
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), size.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def bpe_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a frame with doc_id and text."""
    out = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(texts(spark, sf_dir))


def op3_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, ALLOW, BLOCK).select("page_id", "host", "path", "rule", "verdict", "figure", "p_allow")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.found(texts(spark, sf_dir))
    counts = [secrets.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base, spans = secrets.written(F.col("base")), secrets.written(F.col("spans"))
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.threads(table(spark, sf_dir, "conversations"))


def op6_log_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(texts(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(texts(spark, sf_dir))


OP7_SQL = f"""
with low as (select doc_id, {LOWERED} as body from documents),
best as (select body, max(doc_id) as keep_id, count(*) as group_size from low group by body)
select low.doc_id, keep_id, group_size, low.doc_id = keep_id as kept, sha256(low.body) as text_sha256
from low join best on low.body = best.body"""


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(texts(spark, sf_dir), size=3, percent=85)


OP8_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) end) as s from words),
grams as (select doc_id, hash(unnest(s)) as g from sets),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as n from grams a join grams b on a.g = b.g and a.doc_id > b.doc_id group by all),
links as (
  select x, y from common join sets p on p.doc_id = x join sets q on q.doc_id = y
  where 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
walk as (
  select x as a, y as b from links union all select y, x from links),
closure as (
  select a, b from walk union select c.a, w.b from closure c join walk w on c.b = w.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(min(c.b), s.doc_id)) as component_id,
  s.doc_id = least(s.doc_id, coalesce(min(c.b), s.doc_id)) as kept
from sets s left join closure c on c.a = s.doc_id group by s.doc_id, s.s"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("id"), 4) != 2)
    score = quality.quality_score(spark, model)
    out = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.marked(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = rf"""
with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
uses as (select doc, lang, source, unnest(terms) as term from docs),
vocabulary as (select lang, term, count(*) as lang_n from uses group by all having count(distinct doc) >= 10),
counts as (
  select lang, source, term, count(*) as n, any_value(lang_n) as lang_n from uses join vocabulary using (lang, term) group by lang, source, term),
widths as (select lang, count(*) as v, sum(lang_n) as total from vocabulary group by lang),
groups as (
  select lang, source, coalesce(any_value(v), 0) as v, any_value(w.total) as lang_total, coalesce(sum(n), 0) as total
  from (select distinct lang, source from docs) left join widths w using (lang) left join counts using (lang, source) group by lang, source),
cells as (
  select g.lang, g.source, w.term, coalesce(c.n, 0) as n,
    1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) as p,
    1 + 1000000000::hugeint * (w.lang_n + 2) // (g.lang_total + 2 * g.v) as q
  from groups g join vocabulary w using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = w.term),
apart as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
rows as (
  select lang, source, 'pair' as part, item, value from pairs union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from cells where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from rows)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


CRC32_OF_C = """xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(c::varchar, '')]),
    lambda v, b: list_reduce(list_prepend(xor(v, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda w, z: xor(w >> 1, 3988292384 * (w & 1)))), 4294967295)"""

OP12_SQL = rf"""
with told as (
  select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations where conv_id is not null),
turns as (
  select c, role, body, row_number() over (partition by c order by turn nulls first, sha256(concat(strlen(role), ':', role, body))) as i from told),
cuts as (select c, c - c % 20 as b, {CRC32_OF_C} % 4 as h from (select distinct c from told)),
plans as (
  select cuts.*, least(h, coalesce(n, 0)) as k from cuts left join (select c, count(*) as n from turns group by c) s on s.c = cuts.b),
rebuilt as (
  select p.c, i as d, role, body from plans p join turns t on t.c = p.b and t.i <= p.h union all
  select p.c, i - h + k, role, body from plans p join turns t on t.c = p.c and t.i > p.h),
spots as (
  select c, d, body, sha256(string_agg(concat(strlen(role), ':', role, strlen(body), ':', body), '') over (partition by c order by d)) as path
  from rebuilt union all select c, 0, '', '' from plans),
nodes as (
  select d, path, min(c) as conv_id, count(*) as n, len(regexp_extract_all(any_value(body), '[^\x20\x09-\x0D]+')) as words
  from spots group by d, path),
walks as (
  select c, d, conv_id, n, words, lag(conv_id) over (partition by c order by d) as up, d = max(d) over (partition by c) as ends
  from spots join nodes using (d, path)),
pairs as (select distinct a.d, a.conv_id, b.d as bd, b.conv_id as bc, b.n, b.words from walks a join walks b on a.c = b.c and b.d >= a.d),
inner_nodes as (select distinct d, conv_id from pairs where bd = d + 1),
below as (
  select p.d, p.conv_id, count(*) filter (bd = p.d + 1) as n_children, count(*) filter (i.d is null) as n_leaves, sum((n - 1) * words) as saved
  from pairs p left join inner_nodes i on i.d = p.bd and i.conv_id = p.bc group by 1, 2),
ended as (select d, conv_id, sha256(string_agg(c::varchar, ',' order by c)) as ids from walks where ends group by d, conv_id)
select w.conv_id, cast(w.d as bigint) as depth, w.up as parent_conv_id, w.n as n_convs, n_children, n_leaves, cast(saved as bigint) as saved_tokens,
  coalesce(ids, sha256('')) as ends_sha256
from walks w join below on below.d = w.d and below.conv_id = w.conv_id left join ended e on e.d = w.d and e.conv_id = w.conv_id
where w.c = w.conv_id"""


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    back = warc.read(warc.write(pages, scratch_path(spark, "warc")))
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


OP13_SQL = """
with told as (select row_number() over () as i, page_id, coalesce(html, '') as body from pages),
payloads as (select i, page_id, strlen(body) as n, sha256(body) as digest from told),
placed as (
  select *, row_number() over same as place, count(*) over (partition by digest) as copies, first_value(page_id) over same as first_id
  from payloads window same as (partition by digest order by page_id nulls last, i))
select page_id, n as payload_bytes, digest as payload_digest, if(n < 100 or place = 1, 'response', 'revisit') as record_type,
  if(n < 100 or place = 1, null, first_id) as refers_to
from placed"""


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_bpe_round_trip, op3_url_language_model, op4_secret_scan, op5_quotation_linking, op6_log_bloom_lm,
    op7_exact_dedup, op8_minhash_near_dedup, op9_quality_classifier, op10_template_decontamination, op11_source_divergence, op12_conversation_trie,
    op13_warc_archive,
)}
ORACLE_SQL = {
    "op7_exact_dedup": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_conversation_trie": OP12_SQL,
    "op13_warc_archive": OP13_SQL,
}
