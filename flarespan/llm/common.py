"""Shared plumbing: texts to Arrow batches, hashed words, shared storage.

Defined results used by all operators of this subpackage: a null text counts as empty; a null
``doc_id`` is kept as null; a table without rows gives a result without rows; repeated rows are
each treated as a document of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import string
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time; a longer single text is one slice.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to a Python worker, where the session keeps Spark's own default.
BATCH_BYTES, ARROW_BYTES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_ARROW = {
    "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where that is unset, a local session takes one of its own; a cluster has none to take."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flarespan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/flarespan/" in f}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: A table is broadcast only if it was counted and has at most so many slim rows; a larger one is shuffled.
MOST_BROADCAST = 200_000
#: Keys with the most rows that are joined by broadcast, so that no task gets all rows of one.
HOT = 1_000


def sized(df: DataFrame) -> DataFrame:
    """Mark for broadcast what is small enough, by counting; give it a stored table."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def hot_join(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """Inner join with a ``table`` of one row for each ``key``; give it stored tables.

    The HOT keys with the largest ``weight`` (their number of rows) are broadcast, a bounded table;
    all other keys are joined by shuffle.
    """
    names = [key] if isinstance(key, str) else key
    hot = stored(table.orderBy(F.desc(weight), *names).limit(HOT), "hot")
    rest = rows.join(F.broadcast(hot.select(*names)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def slices(raw: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary column of about SLICE_BYTES each."""
    n = len(raw)
    if not n:
        return
    ends = np.cumsum(pa.compute.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield at, to
        at = to


def small_batches(spark: SparkSession) -> None:
    """Lower the size of Arrow batches to BATCH_BYTES unless the session has set its own."""
    if spark.conf.get(ARROW_BYTES) == f"{64 << 20}b":
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: workers are used again, by other operators too, and their executor has little to spare."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names with as many underscores before them as it takes to clash with no column of ``df`` (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_texts(df: DataFrame, fn: Callable, out: dict[str, str], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Apply ``fn(list of bytes) -> dict of columns`` slice by slice; the ``keep`` columns ride along.

    ``fn`` may be a factory marked with ``factory = True``; it is then called once in each task, so
    that models and caches are built there once.  ``fn`` may return a key ``"_row"`` with the
    position of each output row's input row; without it there is one output row for each input row.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{c}` {t}" for c, t in out.items()])
    names = [*keep, *out]
    arrow = [_ARROW[t] for t in out.values()]

    def task(batches):
        run = fn() if getattr(fn, "factory", False) else fn
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("_raw"))
            for lo, hi in slices(raw):
                got = run(raw.slice(lo, hi - lo).to_pylist())
                kept = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep]
                if "_row" in got:
                    rows = pa.array(got["_row"], pa.int64())
                    kept = [k.take(rows) for k in kept]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(got[c], t) for c, t in zip(out, arrow, strict=True))], names)
            del batch, raw
            give_back()

    small_batches(df.sparkSession)
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_raw"))
    return source.mapInArrow(task, ddl)


def word_hash(word: str | bytes) -> int:
    """64 bits that stand for a word."""
    raw = word.encode("utf-8", "replace") if isinstance(word, str) else word
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def place_hash(word: str, seed: int = 0) -> int:
    """A cheaper hash for places of a model, where collisions are part of the method."""
    return zlib.crc32(word.encode("utf-8", "replace"), seed) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


class WordTable(dict):
    """Word to a row of hashes made by ``forms(word) -> tuple of hashes``.

    Between documents it forgets everything once it has ``most`` words, so memory stays bounded.
    """

    def __init__(self, forms: Callable, width: int, most: int = 150_000) -> None:
        super().__init__()
        self.forms, self.most = forms, most
        self.rows = np.zeros((4096, width), np.uint64)

    def __missing__(self, word):
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.forms(word)
        self[word] = at
        return at

    def hashes(self, words: list) -> np.ndarray:
        """One row of hashes for each word."""
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[at]


_EDGES = string.punctuation + "¡¿«»„“”‘’…–—"


def bare(word: str) -> str:
    """Lower case without punctuation at the ends."""
    return word.strip(_EDGES).lower()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, *offsets: int) -> np.ndarray:
    """Hash of the words at these offsets from each position; fewer than needed give none."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(offsets) * 7919 + offsets[-1], np.uint64)
    with np.errstate(over="ignore"):
        for o in offsets:
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[o : o + n]
    return mix(out)


def bounded_labelled(docs: DataFrame, labels: DataFrame, rating, most: int, where=None) -> DataFrame:
    """Rows of at most ``most`` labelled doc_ids with their rating, chosen by a hash of doc_id.

    Labels are bounded before the join, so the broadcast side has at most ``most`` rows.  Labels
    that are null, and repeated labels of a doc_id beyond the smallest, are left out.
    """
    few = labels.where(F.col("doc_id").isNotNull())
    if where is not None:
        few = few.where(where)
    few = few.select("doc_id", rating.alias("_rating")).where("_rating IS NOT NULL").groupBy("doc_id").agg(F.min("_rating").alias("_rating"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def bounded_features(rows: DataFrame, places: str, most: int) -> DataFrame:
    """One row of each doc_id, and of these, in the order of a hash of doc_id, as many as have ``most`` places in all.

    Of several texts of a doc_id the one with the smallest hash of its places is taken.  ``rows`` has
    a bounded number of doc_ids, so the one window sees few rows, and of these only ids and sizes.
    """
    rest = [c for c in rows.columns if c != "doc_id"]
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.xxhash64(places)).alias("_one")).select("doc_id", "_one.*")
    one = stored(one, "labelled")
    upto = F.sum(F.size(places)).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = one.select("doc_id", upto.alias("_upto")).where(F.col("_upto") <= most).select("doc_id")
    return one.join(F.broadcast(few), "doc_id")


def lists_of(column: pa.Array, kind) -> list[np.ndarray]:
    """Each list of an Arrow list column as a numpy array, without Python numbers between."""
    flat, ends = column.values.to_numpy(zero_copy_only=False).astype(kind), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
