"""The queries opN_* of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, decontam, exact, flac, html_text, langid, periodic, pieces, quality, records, secrets, simhash, toxicity
from .common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_records(spark, sf_dir):
    return records.digest(spark, table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return langid.digest(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"))


def op3_html_text(spark, sf_dir):
    return html_text.digest(table(spark, sf_dir, "pages"))


def op4_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.digest(spark, table(spark, sf_dir, "documents"))


def op9_flac_media(spark, sf_dir):
    return flac.digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark, sf_dir):
    return periodic.digest(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark, sf_dir):
    return centroids.digest(spark, table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark, sf_dir):
    return exact.digest(spark, table(spark, sf_dir, "documents"))


def queries():
    named = (
        op1_toxicity, op2_sentencepiece, op3_html_text, op4_secret_scan, op5_benchmark_decontamination,
        op6_token_records, op7_language_id, op8_simhash_near_dedup, op9_flac_media, op10_quality_classifier,
        op11_periodic_runs, op12_centroid_clusters, op13_exact_dedup,
    )
    return {f.__name__: f for f in named}


def oracle_sql():
    return {"op4_secret_scan": secrets.ORACLE_SQL, "op12_centroid_clusters": centroids.ORACLE_SQL, "op13_exact_dedup": exact.ORACLE_SQL}
