"""The operators of this subpackage as queries over whole tables, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, line_dedup, media, ngram_join, packing, phrases, pii, suffix_dedup, toxicity, url_filter, warc, whitening
from .common import spread, table, workspace

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Domains on the block list; a url on one of them or on a subdomain is blocked.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")), RANKS, PATTERN, capacity=1024, end_id=0, with_ids=False, tokenizer_path=TOKENIZER)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(spread(table(spark, sf_dir, "documents")), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in BLOCKED], "key string")
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), listed, RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images: each vector is drawn as a texture, and for one in ten an edited copy is made, which must be found.

    A row for each image: vec_id, edit (null for the vector's own image), n_corners, class_id and copy_id
    (smallest vec_id among linked images and among equal ones) and n_links.
    """
    key = F.col("vec_id")
    dealt = F.crc32(key.cast("string").cast("binary"))
    edit = F.when(dealt % 10 == 0, F.element_at(F.array(*map(F.lit, media.EDITS)), (F.floor(dealt / 10) % len(media.EDITS) + 1).cast("int")))
    both = F.array_compact(F.array(F.lit(""), edit))
    images = spread(table(spark, sf_dir, "embeddings")).select(key, "embedding", F.posexplode(both).alias("no", "edit"))
    found = media.find_copies(images.withColumn("image_id", 2 * key + F.col("no")), "image_id", media.drawn(F.col("embedding"), F.col("edit")))
    of = lambda c: F.floor(F.col(c) / 2).cast("long")
    told = found.select(of("image_id").alias("vec_id"), (F.col("image_id") % 2 == 1).alias("is_edit"), of("class_id").alias("class_id"), of("copy_id").alias("copy_id"), "n_corners", "n_links")
    return told.select("vec_id", F.when(F.col("is_edit"), edit).alias("edit"), "class_id", "copy_id", "n_corners", "n_links")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spread(table(spark, sf_dir, "documents")), RANKS, PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.span_report(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "warc")
    warc.write_archives(warc.to_chunks(table(spark, sf_dir, "pages"), min_revisit=100), path)
    back = warc.read_archives(spark, path)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as long: null beyond its range, where the operator's decimal still holds it."""
    told = whitening.report(table(spark, sf_dir, "embeddings"), k=4, scale=256)
    return told.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.span_report(spread(docs), pii.fit(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_ann": op5_ann,
    "op6_url_filters": op6_url_filters,
    "op7_media": op7_media,
    "op8_bpe": op8_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
    "op11_phrases": op11_phrases,
    "op12_whitening": op12_whitening,
    "op13_pii": op13_pii,
    "pipeline": pipeline,
}

_EDGE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_HOST = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_LOWER})"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def line_dedup_sql(docs: str) -> str:
    """Rows (doc_id, n_lines, n_dropped, kept) of the line stage over the relation ``docs``."""
    return f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from {docs}
), keyed as (
  select doc_id, line, pos, translate(trim(line, {_EDGE}), {_LOWER}) as key from lines
), frequent as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
), marked as (
  select k.doc_id, k.line, k.pos, f.key is not null and k.doc_id <> f.keeper as gone
  from keyed k left join frequent f on k.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept
from marked group by doc_id
"""


def _rules_sql() -> str:
    whens = []
    for rule in sorted(RULES, key=len, reverse=True):
        host, path = url_filter.parse_rule(rule)
        whens.append(f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{rule}'")
    return "case " + " ".join(whens) + " end"


_LISTED = " or ".join(f"host = '{k}' or ends_with(host, '.{k}')" for k in BLOCKED)
_VERDICTS = " ".join(f"when rule = '{k}' then '{v}'" for k, v in RULES.items())

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": f"select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from ({line_dedup_sql('documents')})",
    "op6_url_filters": f"""
with parts as (select page_id, {_HOST} as host, {_PATH} as path from pages),
ruled as (select *, {_rules_sql()} as rule from parts)
select page_id, host, path, rule, case {_VERDICTS} when {_LISTED} then 'block' else 'allow' end as verdict from ruled
""",
    "op10_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.first is null or f.first = d.page_id then 'response' else 'revisit' end as record_type,
       case when f.first <> d.page_id then f.first end as refers_to
from d left join f on d.payload_digest = f.payload_digest
""",
    "op11_phrases": f"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), worded as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
grams as (
  select lang, 1 as m, unnest(w) as phrase from worded
  union all
  select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from worded
  union all
  select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from worded
), f as (select lang, m, phrase, count(*)::bigint as a from grams group by all having count(*) >= 10),
inside as (
  select lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as phrase, a from f where m = 3
), longest as (select lang, phrase, max(a) as within from inside group by all),
kept as (
  select f.* from f left join longest g on f.lang = g.lang and f.phrase = g.phrase
  where m > 1 and coalesce(100 * g.within, 0) < 50 * f.a
), cuts as (
  select *, unnest(range(1, m)) as k, string_split(phrase, ' ') as w from kept
), scored as (
  select c.lang, c.phrase, c.a, c.k, x.a as l, y.a as r, ((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase collate "binary") as rank from best
)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score from ranked r join totals t on t.lang = r.lang where rank <= 2000
""",
}
