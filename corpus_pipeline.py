"""Corpus pipeline over ``documents``: quality, exact dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import public_tokenizers

from flarespan.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece_bpe
from flarespan.llm.common import stored, table


def keep_quality(spark, docs, sf_dir):
    """Documents that the ordinal quality classifier does not reject."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def dedup_exact(spark, docs, sf_dir):
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def dedup_near(spark, docs, sf_dir):
    """Of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def mix(spark, docs, sf_dir):
    """Documents by the target weights of domain, language and source."""
    return mixing.mixed_documents(docs)


def encode(spark, docs, sf_dir):
    """Tokens of each whole text, and the text decoded from them again."""
    return sentencepiece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", keep_quality), ("exact dedup", dedup_exact), ("near dedup", dedup_near), ("mixing", mix), ("encoding", encode)]

#: The classifier and the signatures can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``, each stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
