"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, html_extract, licenses, line_dedup, media, ngram_join, packing, quality, suffix_lm, toxicity
from .common import crc_mod, materialize, read


def op1_line_dedup(spark, sf_dir):
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__ld_lines").alias("n_lines"), F.col("__ld_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_lm_scoring(spark, sf_dir):
    out = suffix_lm.score_documents(read(spark, sf_dir, "documents"))
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 1 * (F.col("train_words") + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


def op4_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.fit_and_score(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op7_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_media(spark, sf_dir):
    return media.text_media(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    feats = materialize(quality.features(read(spark, sf_dir, "documents").select("doc_id", "text")), "quality")
    out = quality.verdict(feats, quality.fit(feats))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_html_extraction(spark, sf_dir):
    return html_extract.extract_main_text(read(spark, sf_dir, "pages"))


def llm_license_base(spark, sf_dir):
    """The base columns of op5, for SQL."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def llm_media_payload(spark, sf_dir):
    """The columns of op8 that SQL can express."""
    return op8_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def llm_quality_base(spark, sf_dir):
    """The base columns of op9, for SQL."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries():
    base = (llm_license_base, llm_media_payload, llm_quality_base)
    return {f.__name__: f for f in (*base, op1_line_dedup, op2_ngram_jaccard_join, op3_lm_scoring, op4_packing, op5_license_scan, op6_toxicity, op7_bpe, op8_media, op9_quality_rules, op10_html_extraction)}


#: Normalised key, and all words of the base scans, in SQL.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), keyed as (select *, {_LOWER.format(f"trim(line, {_WS})")} as key from lines),
dups as (select key, max(doc_id) as keep from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.doc_id, k.line, k.pos, d.key is not null and k.doc_id <> d.keep as gone from keyed k left join dups d on d.key = k.key)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


LICENSE_SQL = f"""
with words as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), places as (
  select doc_id, len(w) as n_words, unnest(generate_series(0, len(w) - 1)) as i, w from words where len(w) > 0
), found as (
  select doc_id, i, case
    when w[i + 1] = 'gnu' and w[i + 2] = 'general' and w[i + 3] = 'public' and w[i + 4] = 'license' then 'gpl'
    when w[i + 1] = 'apache' and w[i + 2] = 'license' then 'apache'
    when w[i + 1] = 'cc' and w[i + 2] = 'by' then 'cc-by'
    when w[i + 1] = 'mit' and w[i + 2] = 'license' then 'mit' end as label
  from places where w[i + 1] in ('gnu', 'apache', 'cc', 'mit')
), per as (
  select doc_id, count(*) as n, min(i) as lo, max(i) as hi, string_agg(distinct label, ',' order by label) as labels from found where label is not null group by doc_id
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(p.n, 0) as n_base, cast(p.lo as bigint) as first_word, cast(p.hi as bigint) as last_word, coalesce(p.labels, '') as base_labels
from words w left join per p on p.doc_id = w.doc_id
"""

MEDIA_SQL = """
with sized as (select doc_id, coalesce(text, '') as t, octet_length(encode(coalesce(text, ''))) as n from documents)
select doc_id, cast(n as bigint) as n_bytes, cast(greatest(1, (n + 191) // 192) * 192 as bigint) as payload_bytes,
  sha256(t || repeat(' ', cast(greatest(1, (n + 191) // 192) * 192 - n as bigint))) as payload_sha256
from sized
"""

QUALITY_SQL = f"""
with words as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as x
  from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from words where len(w) > 8)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as n from windows) where n > 1
), repeated as (
  select doc_id, cast(sum(least(8, coalesce(nxt - i, 8))) as bigint) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twice) group by doc_id
), lines as (
  select doc_id, count(*) - count(distinct x) as dup
  from (select doc_id, unnest(string_split(t, chr(10))) as x from words) where length(trim(x, {_WS})) > 0 group by doc_id
), counted as (
  select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(length(array_to_string(w.w, '')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, coalesce(l.dup, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from words w left join lines l on l.doc_id = w.doc_id left join repeated r on r.doc_id = w.doc_id
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted
"""


def oracle_sql():
    return {"op1_line_dedup": OP1_SQL, "llm_license_base": LICENSE_SQL, "llm_media_payload": MEDIA_SQL, "llm_quality_base": QUALITY_SQL}
