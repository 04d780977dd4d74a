"""The corpus queries: each operator over its whole table, with production parameters."""

import public_tokenizers

from . import exact_dedup, lm_score, lz_fingerprint, mixing, near_dedup, sharding, sp_codec, token_output, toxicity, window_dedup


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_sharding(spark, sf_dir):
    return sharding.shard_documents(_documents(spark, sf_dir))


def op5_lz_fingerprint(spark, sf_dir):
    return lz_fingerprint.fingerprint_documents(_documents(spark, sf_dir))


def op6_mixing(spark, sf_dir):
    return mixing.mix_documents(_documents(spark, sf_dir))


def op7_token_output(spark, sf_dir):
    return token_output.token_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_lm_score(spark, sf_dir):
    return lm_score.lm_scores(_documents(spark, sf_dir))


def op9_window_dedup(spark, sf_dir):
    return window_dedup.repeated_windows(_documents(spark, sf_dir))


def op10_sentencepiece(spark, sf_dir):
    return sp_codec.codec_digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


OP2_SQL = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), g as (select t, max(doc_id) as keep_id, count(*) as group_size from t group by t)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.t) as text_sha256 from t join g on t.t = g.t
"""


def queries():
    return {f.__name__: f for f in (op1_near_dedup, op2_exact_dedup, op3_toxicity, op4_sharding, op5_lz_fingerprint, op6_mixing, op7_token_output, op8_lm_score, op9_window_dedup, op10_sentencepiece)}


def oracle_sql():
    return {"op2_exact_dedup": OP2_SQL}
