"""The registered queries of this subpackage, with production parameters over their whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from derivia.llm.audit import oracle as audit_oracle
from derivia.llm.common import fresh_path, table
from derivia.llm.perspectives import oracle as perspectives_oracle
from derivia.llm.pii import oracle as pii_oracle
from derivia.llm.rollup import oracle as rollup_oracle
from derivia.llm.rules import oracle as rules_oracle
from derivia.llm.search import oracle as search_oracle


#: Weights of the domains after mixing: less of what is toxic or of low quality than there is.
MIX = {"clean": 0.88, "toxic": 0.06, "low": 0.06}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc_zstd(spark, sf_dir):
    from derivia.llm.warc import read_archives, write_archives

    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op2_risk_controlled_rules(spark, sf_dir):
    from derivia.llm.rules import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_soft_mixing(spark, sf_dir):
    from derivia.llm.mixing import label_domains, mixed

    return mixed(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX, tokenizer=tokenizer_path())


def op4_perspective_rotation(spark, sf_dir):
    from derivia.llm.perspectives import rotated

    return rotated(table(spark, sf_dir, "conversations"))


def op5_hilbert_curves(spark, sf_dir):
    from derivia.llm.hilbert import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_ngram_jaccard(spark, sf_dir):
    from derivia.llm.jaccard import groups_of

    return groups_of(table(spark, sf_dir, "documents"))


def op7_weak_label_quality(spark, sf_dir):
    from derivia.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"))


def op8_viterbi_language_id(spark, sf_dir):
    from derivia.llm.langid import held_out_languages

    return held_out_languages(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark, sf_dir):
    from derivia.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 1024)


def op10_delta_rollup(spark, sf_dir):
    from derivia.llm.rollup import document_rollup

    return document_rollup(table(spark, sf_dir, "documents"), {"byte_bpe_50k-1": tokenizer_path(), "piece_bpe_32k-1": tokenizer_path("piece_bpe_32k.model")}, fresh_path(spark, "rollup"))


def op11_order_replay_audit(spark, sf_dir):
    from derivia.llm.audit import interaction_audit

    return interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_weak_supervision_pii(spark, sf_dir):
    from derivia.llm.pii import personal

    return personal(table(spark, sf_dir, "documents"))


def pii_base_patterns(spark, sf_dir):
    """op12's columns that SQL can tell."""
    from derivia.llm.pii import base_only

    return base_only(table(spark, sf_dir, "documents"))


def op13_impact_ordered_search(spark, sf_dir):
    from derivia.llm.search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def rollup_words_bytes(spark, sf_dir):
    """op10's deliveries with counts that SQL can tell."""
    from derivia.llm.rollup import word_rollup

    return word_rollup(table(spark, sf_dir, "documents"), fresh_path(spark, "rollup"))


ORACLE: dict[str, str] = {
    "op1_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS lead FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN strlen(html) >= 1000 AND page_id < lead THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(html) >= 1000 AND page_id < lead THEN lead END AS refers_to,
               CAST(NULL AS VARCHAR) AS error
        FROM g""",
    "op2_risk_controlled_rules": rules_oracle(),
    "op4_perspective_rotation": perspectives_oracle(),
    "op11_order_replay_audit": audit_oracle(),
    "op13_impact_ordered_search": search_oracle(),
    "pii_base_patterns": pii_oracle(),
    "rollup_words_bytes": rollup_oracle(),
}


def queries():
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pii_base_patterns": pii_base_patterns, "rollup_words_bytes": rollup_words_bytes, "pipeline": corpus_pipeline.run}


def oracle_sql():
    return dict(ORACLE)
