"""Spelling variants of frequent words, without making pairs.

1. Texts give words and their counts, added up in each task first.
2. Words that occur often enough are the vocabulary.  Each gets a *rank*, a number that orders words
   by falling count and then by code points, so "the most frequent of these" is the least rank.
3. Two words that differ by one replaced code point share the word with a hole at that place: a
   (position, prefix, suffix) group.  A group keeps its size and its first two ranks: from these each
   member knows how many near words it has there and the best of them, which is the first or, for the first
   itself, the second.
4. Two words that differ by an inserted or deleted code point: the longer without that point is the
   shorter.  Distinct deletions of every word meet the vocabulary under the same key; the shorter word sees the number of
   deletions and their first rank, each deletion sees the shorter word's rank.
5. What the groups say of a word is added (numbers) and compared (ranks); no pair of words ever is a row.

A group is known by a polynomial of its code points modulo the prime 2^127 - 1 with a fixed random
base, so a word of any length makes as many rows of fixed size as it has code points and nothing
grows with the square of its length.  Two given keys are confused with a probability below 1e-30.

Defined results: a null or empty text has no words, a table without words no rows.  Repeated rows
count each.  A null doc_id is an empty one where words are spoilt.  Long texts are read in pieces
cut between words.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, give_back, small_batches, stored

#: Bytes of text that are cut into words at a time, and distinct words held before they are passed on.
PIECE, MOST_WORDS = 1 << 20, 200_000
#: Words of the vocabulary in a part of it.
PART_WORDS = 20_000
PRIME = (1 << 127) - 1
BASE, HOLE = (int.from_bytes(hashlib.sha256(s).digest()[:16], "little") % PRIME for s in (b"base of the words", b"place of the hole"))
#: Ends a piece: an ASCII character that is in no word.
BREAK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def pieces(text: bytes):
    """The text in pieces of about PIECE bytes that end between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        found = BREAK.search(text, end) if end < len(text) else None
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def words_of(text: bytes, doc_id: str, least: int, spoil: int, into: Counter) -> None:
    """Add the words of a text to ``into``: runs of letters, A-Z lower-cased; one in ``spoil`` loses a code point, as the CRC-32 of doc_id and run says (none where it is 0)."""
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    start = zlib.crc32(f"{doc_id}:".encode())
    for piece in pieces(text):
        for word, n in Counter(run.findall(piece.lower().decode("utf-8", "replace"))).items():
            if spoil:
                h = zlib.crc32(word.encode(), start)
                if h % spoil == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                    if len(word) < least:
                        continue
            into[word] += n


def word_counts(docs: DataFrame, least: int = 7, spoil: int = 31) -> DataFrame:
    """(word, n) of all words of at least ``least`` code points."""

    def task(batches):
        total: Counter = Counter()

        def passed_on():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            raw, ids = batch.column(batch.schema.get_field_index("_raw")), batch.column(batch.schema.get_field_index("_id")).to_pylist()
            for k, doc_id in enumerate(ids):
                words_of(raw[k].as_py(), doc_id, least, spoil, total)
                if len(total) > MOST_WORDS:
                    yield passed_on()
            del batch, raw
        yield passed_on()
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_raw"))
    return rows.mapInArrow(task, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def ranked_words(counts: DataFrame) -> DataFrame:
    """word, n, rank: unique numbers by falling count, then by code points (as UTF-8 bytes); give it a stored table."""
    order = [F.desc("n"), F.asc("word")]
    return counts.repartitionByRange(max(1, -(-counts.count() // PART_WORDS)), *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())


_POWERS = [1]


def group_keys(word: str) -> tuple[list[int], list[int], int]:
    """Keys of the word with a hole at each place, of its distinct deletions, and of itself."""
    c = list(map(ord, word))
    n = len(c)
    while len(_POWERS) < n + 1:
        _POWERS.append(_POWERS[-1] * BASE % PRIME)
    before, upto = 1, []  # the leading 1 tells lengths apart
    for x in c:
        upto.append(before)
        before = (before * BASE + x) % PRIME
    whole, holes, shorter = before, [], []
    for i, x in enumerate(c):
        power = _POWERS[n - 1 - i]
        holes.append((whole - x * power + (i + 1) * HOLE) % PRIME)
        if i == 0 or x != c[i - 1]:
            after = upto[i + 1] if i + 1 < n else whole
            shorter.append((whole + (upto[i] - after) * power) % PRIME)
    return holes, shorter, whole


def group_rows(vocabulary: DataFrame, least: int) -> DataFrame:
    """hi, lo (the key), kind (0: hole, 1: deletion, 2: the word itself), rank."""

    def made(words, ranks):
        keys, kinds, owner = [], [], []
        for word, rank in zip(words, ranks, strict=True):
            holes, shorter, whole = group_keys(word)
            if len(word) == least:
                shorter = []
            keys += [*holes, *shorter, whole]
            kinds += [0] * len(holes) + [1] * len(shorter) + [2]
            owner += [rank] * (len(holes) + len(shorter) + 1)
        raw = np.frombuffer(b"".join(struct.pack("<QQ", k >> 64, k & 0xFFFFFFFFFFFFFFFF) for k in keys), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy()), pa.array(kinds, pa.int8()), pa.array(owner, pa.int64())], ["hi", "lo", "kind", "rank"])

    def task(batches):
        for batch in batches:
            words, ranks = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 2048):
                yield made(words.slice(lo, 2048).to_pylist(), ranks.slice(lo, 2048).to_pylist())
            _POWERS[64:] = []
            give_back()

    return vocabulary.select("word", "rank").mapInArrow(task, "hi bigint, lo bigint, kind tinyint, rank bigint")


def near_words(groups: DataFrame) -> DataFrame:
    """rank, n_near, best (the least rank of a near word), of the words that have near words."""
    group = Window.partitionBy("hi", "lo")
    whole = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank, kind = F.col("rank"), F.col("kind")
    each = groups.select(
        "rank", "kind", F.count(F.lit(1)).over(whole).alias("size"), F.first("rank").over(whole).alias("first"), F.nth_value("rank", 2).over(whole).alias("second"),
        F.max(F.when(kind == 2, rank)).over(whole).alias("own"), F.min(F.when(kind == 1, rank)).over(whole).alias("longer"), F.count_if(kind == 1).over(whole).alias("n_longer"),
    ).where("size > 1")
    near = F.when(kind == 0, F.col("size") - 1).when(kind == 2, F.col("n_longer")).otherwise(F.when(F.col("own").isNotNull(), 1).otherwise(0))
    best = F.when(kind == 0, F.when(F.col("first") == rank, F.col("second")).otherwise(F.col("first"))).when(kind == 2, F.col("longer")).otherwise(F.col("own"))
    return each.select("rank", near.alias("near"), best.alias("best")).where("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(rank, root) of the words with a form, from stored (rank, form): jumps that double until none is left.

    A form is at least several times as frequent as its word, so chains are as short as a logarithm.
    """
    now = links.select("rank", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(on, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("rank", "root")
        now = now.select("rank", "root")


def spelling_forms(docs: DataFrame, least: int = 7, least_n: int = 2, times: int = 10, spoil: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary.

    ``form`` is the most frequent word that differs by one code point, if it occurs at least ``times``
    as often; ``root`` is what following forms ends in.
    """
    counts = stored(word_counts(docs, least, spoil).where(F.col("n") >= least_n), "counts")
    vocabulary = stored(ranked_words(counts), "vocabulary")
    near = stored(near_words(group_rows(vocabulary, least)), "near")
    forget(counts)
    some = vocabulary.join(near, "rank", "left")
    there = vocabulary.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    some = some.join(there, "best", "left")
    good = F.col("form_n") >= times * F.col("n")
    some = stored(some.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(good, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "forms")
    ends = roots(some.where("best IS NOT NULL").select("rank", F.col("best").alias("form")))
    names = vocabulary.select(F.col("rank").alias("root"), F.col("word").alias("_root"))
    out = some.join(ends.join(names, "root").select("rank", "_root"), "rank", "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
