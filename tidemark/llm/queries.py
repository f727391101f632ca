"""The registered queries of this subpackage, with production parameters."""
from __future__ import annotations

from . import bpe, decontaminate, fingerprint, html, jaccard, langid, paragraphs, pii, suffixdup, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_langid(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark, sf_dir):
    return fingerprint.near_report(table(spark, sf_dir, "documents"))


def op3_paragraphs(spark, sf_dir):
    return paragraphs.report(table(spark, sf_dir, "documents"))


def op4_suffixdup(spark, sf_dir):
    return suffixdup.report(table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_html(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op9_jaccard(spark, sf_dir):
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_langid, op2_fingerprints, op3_paragraphs, op4_suffixdup, op5_bpe, op6_warc, op7_html, op8_pii, op9_jaccard, op10_decontaminate)}


def oracle_sql() -> dict:
    return {"op6_warc": OP6}


OP6 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
g as (select payload_digest, max(page_id) as holder, count(*) as n from d where payload_bytes >= 1000 group by 1 having max(page_id) is not null)
select page_id, payload_bytes, payload_digest,
  case when n > 1 and holder is distinct from page_id then 'revisit' else 'response' end as record_type,
  case when n > 1 and holder is distinct from page_id then holder end as refers_to,
  true as has_request, 1::int as n_metadata
from d left join g using (payload_digest)
"""
