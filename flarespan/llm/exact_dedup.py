"""Exact dedup by content-defined chunk recipes.

1. Each text is cut where a rolling hash of its last 32 bytes says so; cuts depend on content only.
2. Each chunk is known by a 64-bit key, its length and a digest.  Distinct chunks are verified: a
   key whose chunks differ in length or digest gets one identifier for each different content.
3. A document's recipe is the ordered list of its chunks' verified identifiers.  Documents are
   equal exactly when their recipes are, so only recipes are compared and long texts never move.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, map_texts, sized, stored, unused

#: Chunk sizes in bytes: no cut before LEAST, a forced one at MOST; expected size about LEAST + 2 ** BITS.
LEAST, BITS, MOST = 512, 11, 16_384


def gear_table() -> np.ndarray:
    """256 fixed random 32-bit numbers, made by rule."""
    return np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), "<u4").copy()


def cuts(data: bytes, gear: np.ndarray) -> list[int]:
    """Chunk ends; the last is len(data).  An empty text is one empty chunk."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = gear[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # doubling: after these, h covers the last 32 bytes
        new = h.copy()
        new[step:] += h[:-step] << np.uint32(step)
        h = new
    marks = (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist()
    ends, at = [], 0
    for m in [*marks, n]:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST and m < n:
            at = m
            ends.append(at)
    if not ends or ends[-1] < n:
        ends.append(n)
    return ends


def chunk_rows(raw: list[bytes]) -> dict:
    gear = gear_table()
    row, pos, size, digest, sha = [], [], [], [], []
    for i, data in enumerate(raw):
        whole = hashlib.sha256(data).hexdigest()
        at, view = 0, memoryview(data)
        for k, end in enumerate(cuts(data, gear)):
            row.append(i)
            pos.append(k)
            size.append(end - at)
            digest.append(hashlib.sha256(view[at:end]).digest())
            sha.append(whole if k == 0 else None)
            at = end
    return {"_row": row, "pos": pos, "size": size, "digest": digest, "text_sha256": sha}


def chunked(docs: DataFrame) -> DataFrame:
    """One row for each chunk: doc_id, row_id (of the input row), pos, size, chunk_key, digest, text_sha256 (first chunk only)."""
    rows = docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id())
    out = map_texts(rows, chunk_rows, {"pos": "int", "size": "int", "digest": "binary", "text_sha256": "string"}, ("doc_id", "row_id"))
    return out.withColumn("chunk_key", F.xxhash64("digest"))


def verified(chunks: DataFrame) -> DataFrame:
    """Chunk rows with ``chunk_id``, equal exactly for equal contents.

    The 64-bit key stands for the content where all chunks of that key agree in length and digest
    (counted after duplicates are aggregated away); where contents collide, the digest is added.
    """
    contents = chunks.groupBy("chunk_key", "size", "digest").agg(F.count(F.lit(1)).alias("copies")).groupBy("chunk_key").agg(F.count(F.lit(1)).alias("contents"))
    crowded = stored(contents.where("contents > 1"), "crowded")  # all but empty, so no shuffle by the keys of common chunks
    told = F.when(F.col("contents").isNull(), F.hex("chunk_key")).otherwise(F.concat(F.hex("chunk_key"), F.lit("."), F.hex("digest")))
    return chunks.join(sized(crowded), "chunk_key", "left").withColumn("chunk_id", told)


def recipes(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, row_id, text_sha256, n_chunks, recipe (the ordered chunk identifiers)."""
    parts = verified(stored(chunked(docs), "chunks")).select("doc_id", "row_id", "text_sha256", F.struct("pos", "chunk_id").alias("part"))
    whole = parts.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"), F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("doc_id", "row_id", "text_sha256", F.size("parts").cast("long").alias("n_chunks"), F.col("parts.chunk_id").alias("recipe"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, row_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Null and empty texts are equal.  Of equal texts the largest doc_id stays; a row with a null
    doc_id stays only where its group has no other.  Repeated rows (same doc_id and text) each
    count in ``group_size`` and share their fate.
    """
    each = stored(recipes(docs), "recipes")
    stay = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("row_id")).alias("nth"))).alias("stay")
    groups = stored(each.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), stay), "groups")
    return hot_join(each, groups, "recipe", "group_size").select(
        "doc_id", "row_id", F.col("stay.doc_id").alias("keep_id"), "group_size", F.coalesce(F.col("doc_id") == F.col("stay.doc_id"), F.col("row_id") == -F.col("stay.nth")).alias("kept"), "text_sha256", "n_chunks"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names; of repeated rows (same doc_id and text), one.

    A row is known by its doc_id and the digest of its text.  Texts are moved only where the rows
    that go are too many to broadcast.
    """
    key, sha, nth = unused(docs, "_id", "_sha", "_nth")
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    groups = exact_groups(docs).select(known.alias(key), F.col("text_sha256").alias(sha), "kept")
    fate = stored(groups.groupBy(key, sha).agg(F.max("kept").alias("kept"), F.count_if("kept").alias("times")), "fate")
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    rows = docs.withColumns({key: known, sha: digest}).join(sized(fate.where("NOT kept").select(key, sha)), [key, sha], "left_anti")
    twice = stored(fate.where("times > 1").select(key, sha), "twice")
    once = rows.join(sized(twice), [key, sha], "left_anti").select(*docs.columns)
    first = rows.join(sized(twice), [key, sha], "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key, sha).orderBy(F.lit(1)))).where(F.col(nth) == 1)
    return once.unionByName(first.select(*docs.columns))
