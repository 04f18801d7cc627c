"""Queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from . import exact_dedup, licenses, line_dedup, manifest, media, mixing, near_dedup, oracles, quality, repeats, secrets, sentencepiece_bpe, spelling, toxicity
from .common import table


def op3_suffix_array_dedup(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents"), texts=False)


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark, sf_dir):
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_license_scan(spark, sf_dir):
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op2_media_columns(spark, sf_dir):
    return media.media_features(media.stored_media(table(spark, sf_dir, "documents")))


def op7_mixing(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets.found_secrets(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), most=600_000)


def op10_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), k=3, percent=85).drop("md5", "stays")


def op11_spelling_forms(spark, sf_dir):
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.lower_cased_third())


def op13_line_dedup(spark, sf_dir):
    return line_dedup.without_common_lines(table(spark, sf_dir, "documents"), texts=False)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_media_columns": op2_media_columns,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_near_dedup": op10_near_dedup,
    "op11_spelling_forms": op11_spelling_forms,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_line_dedup": op13_line_dedup,
}

SQL = {
    "op1_license_scan": licenses.sql(),
    "op7_mixing": mixing.SQL,
    "op11_spelling_forms": oracles.spelling(),
    "op12_merkle_manifest": oracles.manifest(),
    "op13_line_dedup": line_dedup.SQL,
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g ON d.text = g.text""",
}
