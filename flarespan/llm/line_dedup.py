"""Line dedup: lines that many documents share stay in one of them only.

1. Texts are cut at newlines; a line's key is the line without ASCII white space at both ends and
   with A-Z lower-cased.  Lines with a key of at least ``least_chars`` code points become rows of
   (document, position, 128 bits of the key's SHA-256); the lines themselves never move.
2. Rows become distinct pairs of key and doc_id first, then counts of documents for each key, so a
   line that a third of all documents holds is counted from partial sums.
3. Lines whose key is in at least ``least_docs`` documents are dropped, but for the largest doc_id
   that holds it.  Each document's dropped positions meet its text again, which is put together from
   the other lines.

Defined results: a null text is one empty line, as an empty one is.  Rows with the same doc_id are
one document when documents are counted; rows with a null doc_id are one document too, which keeps
its lines only where no other holds them.  Equal rows have equal results, a row each.  A long text
is cut in place, only byte positions of its lines are held beside it.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, hot_join, slices, small_batches, stored

#: What counts as white space at the ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else; the cheap form where the text is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, text_key (SHA-256 of the text), pos, line_key of each line that is long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("text_key"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    each = each.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.char_length("line") >= least_chars)
    return each.select("doc_id", "text_key", "pos", F.unhex(F.substring(F.sha2(ascii_lower(F.col("line")), 256), 1, 32)).alias("line_key"))


def common_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """line_key, docs, keep_id of the keys in at least ``least_docs`` documents."""
    pair = lines.groupBy("line_key", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    return pair.groupBy("line_key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keep_id")).where(F.col("docs") >= least_docs)


def dropped_positions(lines: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, text_key, drops (positions, in order) of the documents that lose lines; give it stored tables."""
    gone = hot_join(lines, common, "line_key", "docs").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def assembled(data: bytes, drops: np.ndarray) -> tuple[list, int]:
    """Pieces of ``data`` that together are its lines but those at ``drops``, and the number of lines."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    stays = np.ones(len(ends), bool)
    stays[drops] = False
    kept = np.flatnonzero(stays)
    if not len(kept):
        return [], len(ends)
    breaks = np.flatnonzero(np.diff(kept) > 1)
    first, last = kept[np.append(0, breaks + 1)], kept[np.append(breaks, len(kept) - 1)]
    view, out = memoryview(data), []
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if k:
            out.append(b"\n")
        out.append(view[ends[a - 1] + 1 if a else 0 : ends[b]])
    return out, len(ends)


def reassembled(rows: DataFrame, texts: bool) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and text) of rows with _raw and drops."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", *(["text"] if texts else [])]

    def task(batches):
        for batch in batches:
            raw, drops, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("_raw", "drops", "doc_id"))
            for lo, hi in slices(raw):
                n, gone, sha, text = [], [], [], []
                for k in range(lo, hi):
                    at = drops[k].values.to_numpy(zero_copy_only=False)
                    pieces, lines = assembled(raw[k].as_py(), at)
                    digest = hashlib.sha256()
                    for piece in pieces:
                        digest.update(piece)
                    n.append(lines)
                    gone.append(len(at))
                    sha.append(digest.hexdigest())
                    if texts:
                        text.append(b"".join(pieces).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), *([pa.array(text, pa.string())] if texts else [])], names)
            del batch, raw, drops, ids
            give_back()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(task, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string{', text string' if texts else ''}")


def without_common_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, texts: bool = True) -> DataFrame:
    """One row for each input row: doc_id, n_lines (before dropping), n_dropped, kept_sha256, and the kept ``text`` where ``texts`` is set.

    Every text is shuffled once to meet its dropped positions, at any size of the input; beside it only
    keys and positions move.
    """
    if least_docs < 2 or least_chars < 1:
        raise ValueError("least_docs must be 2 or more and least_chars 1 or more")
    lines = stored(line_rows(docs, least_chars), "lines")
    common = stored(common_lines(lines, least_docs), "common")
    drops = stored(dropped_positions(lines, common).withColumnRenamed("doc_id", "_id"), "drops")
    forget(lines, common)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.cast("binary").alias("_raw"), F.unhex(F.sha2(text, 256)).alias("_key"))
    both = rows.join(drops.hint("shuffle_hash"), (rows["_key"] == drops["text_key"]) & rows["doc_id"].eqNullSafe(drops["_id"]), "left")
    return reassembled(both.select("doc_id", "_raw", F.coalesce("drops", F.array().cast("array<int>")).alias("drops")), texts)


SQL = r"""
WITH l AS (SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
c AS (SELECT line_key, max(doc_id) AS keep_id FROM k WHERE length(line_key) >= 40 GROUP BY 1 HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '-')) >= 5),
j AS (SELECT k.*, c.line_key IS NOT NULL AND k.doc_id IS DISTINCT FROM keep_id AS gone FROM k LEFT JOIN c ON k.line_key = c.line_key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r"""
