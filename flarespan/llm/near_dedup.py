"""MinHash near-dedup: universal hash minima, banding, signature and exact verification, star components.

1. Equal word sequences collapse to one class (aggregated, so a huge group is one row).
2. Classes meet in band buckets.  In each bucket all are compared with one leader, the
   member that meets the most others, so a bucket of n gives n - 1 pairs.
3. Pairs pass the signature estimate, then their full shingle sets are compared exactly.
4. Components by alternating large-star and small-star.
5. Buckets that still hold several components are searched for links across components, in blocks
   of bounded size, on full sets inside the task.

A null or empty text, or one without words, is linked with nothing.  Rows with a null doc_id take no
part in links.  Long texts are read whole.  Where a doc_id repeats with other texts, each text is
compared on its own; repeated rows (same doc_id and text) share their fate.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, forget, hot_join, map_texts, mix, ngrams, sized, stored, unused, word_hash

#: The chance that two documents at the threshold meet in no band is at most this.
MISS = 2e-6
#: The estimate may fall short of the threshold by this before a pair is given up (over five deviations).
SLACK = 0.2
BLOCK = 512
BLOCK_BYTES = 16 << 20
#: Up to this many pairs of a block are compared one by one, more by matrix products; both are exact.
FEW = 64
#: Cells of a 0/1 matrix of rows and shingles.
CELLS = 1 << 21
MOST_MINIMA = 128


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows in a band for which MISS holds within MOST_MINIMA minima."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-p)))
        if bands * rows <= MOST_MINIMA:
            return bands, rows
    raise ValueError("threshold too low")


def shingles(text: bytes, words: WordTable, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the whole sequence as one."""
    seq = text.lower().split()  # bytes: A-Z only, split at space and 9-13
    if not seq:
        return np.empty(0, np.uint64)
    h = words.hashes(seq)[:, 0]
    return np.unique(ngrams(h, *range(min(k, len(h)))))


def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n multiply-add hashes mod 2 ** 64, made by rule; their high bits are universal."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def signature(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(sh), 2048):
        part = sh[lo : lo + 2048]
        np.minimum(best, (a[:, None] * part[None] + b[:, None]).min(1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def word_table() -> WordTable:
    return WordTable(lambda w: (word_hash(w),), 1)


def sequence(text: bytes) -> bytes:
    """Digest of the word sequence."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """doc_id, md5 (of the text), n_shingles, copy (digest of the word sequence, null without words), sig, bands."""
    bands, rows = banding(threshold)

    def make():
        words, (a, b) = word_table(), family(bands * rows)
        base = np.arange(bands, dtype=np.uint64)

        def run(raw):
            out = {"md5": [], "n_shingles": [], "copy": [], "sig": [], "bands": []}
            for x in raw:
                out["md5"].append(hashlib.md5(x).digest())
                sh = shingles(x, words, k)
                out["n_shingles"].append(len(sh))
                if not len(sh):
                    for c in ("copy", "sig", "bands"):
                        out[c].append(None)
                    continue
                sig = signature(sh, a, b)
                key = base
                for col in sig.reshape(bands, rows).T:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + col)
                out["copy"].append(sequence(x))
                out["sig"].append(sig.tobytes())
                out["bands"].append(key.view(np.int64).tolist())
            return out

        return run

    make.factory = True
    return map_texts(docs, make, {"md5": "binary", "n_shingles": "long", "copy": "binary", "sig": "binary", "bands": "array<long>"})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b).  Each round is a few shuffles of the edges; rounds are logarithmic in the nodes."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        old, now = now, stored(small, "edges")
        forget(old)
        last, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def agreeing(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least this share of places."""
    sig = sigs.select("node", "sig")
    both = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "sb"}), "b").select("a", "b", "sa", "sb")

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(1) >= least))

    return both.mapInArrow(task, pairs.select("a", "b").schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on full sets."""
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "sb"}), "b").select("a", "b", "sa", "sb")

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [[np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(c)] for c in (2, 3)]
            keep = [alike(x, y, percent) for x, y in zip(*sets, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(task, pairs.select("a", "b").schema)


def forest(left: np.ndarray, right: np.ndarray, hits: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs (left[i], right[j]) in ``hits``, those that join two classes of ``root`` not yet joined."""
    out = []
    for i, x in enumerate(left):
        to = right[hits[i]]
        to = to[root[to] != root[x]]
        for y in to[np.unique(root[to], return_index=True)[1]]:
            out.append((x, y))
            root[root == root[y]] = root[x]
    return out


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` with sets ``right``: products of 0/1 matrices, some shingles at a time."""
    names, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = n[at] > 1
    at, owner = (np.cumsum(n > 1) - 1)[at[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    width = max(64, CELLS // len(sets))
    inner = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int((n > 1).sum()), width):
        part = slice(*np.searchsorted(at, (lo, lo + width)))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[part], at[part] - lo] = 1
        inner += (x[left] @ x[right].T).astype(np.int64)
    return inner


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(y):
        return False
    at = np.searchsorted(y, x)
    inner = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * inner >= percent * (len(x) + len(y) - inner)


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket, compared on full sets; enough of them to join what belongs together.

    ``members``: bucket, node, component, bytes.  A bucket is cut into blocks of about BLOCK rows and
    BLOCK_BYTES of sets, and each task compares two blocks, so memory is bounded whatever the size
    of a bucket.  No pairs leave a task but links that join components, fewer than its rows.
    Buckets with the same members are searched once.
    """
    h = F.xxhash64("node")
    sizes = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mixed_bits"), (F.min("component") != F.max("component")).alias("mixed")
    ).where("mixed")
    sizes = sizes.groupBy("n", "bytes", "total", "mixed_bits").agg(F.min("bucket").alias("bucket"))
    sizes = sizes.select("bucket", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    sizes = stored(sizes, "sizes")
    rows = hot_join(members, sizes, "bucket", "blocks").withColumn("block", F.pmod(h, "blocks").cast("int")).join(sets, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("bucket", "node", "component", "set", "block", other).select("bucket", "node", "component", "set", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def search(key, table):
        import pyarrow as pa

        found = []
        ids, component, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        if component.min() != component.max():
            texts = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("set")]
            size = np.array([len(x) for x in texts])
            left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
            if len(left) * len(right) <= FEW:
                hits = np.array([[component[i] != component[j] and alike(texts[i], texts[j], percent) for j in right] for i in left])
            else:
                inner = intersections(texts, left, right)
                hits = 100 * inner >= percent * (size[left][:, None] + size[right][None] - inner)
            found = [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in forest(left, right, hits, component.copy())]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("bucket", "lo", "hi").applyInArrow(search, "a bigint, b bigint")


def classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows; classes of equal word sequences (node, copy, rep: smallest doc_id, n: rows); and (node, component) of linked classes."""
    threshold = percent / 100
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sigs = stored(signatures(slim, k, threshold), "signatures")
    known = sigs.where("copy IS NOT NULL AND doc_id IS NOT NULL")
    copies = stored(known.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()), "copies")
    first = copies.select("node", "copy", F.col("rep").alias("doc_id"))
    reps = known.join(first, ["copy", "doc_id"]).dropDuplicates(["node"])
    meet = stored(reps.select("node", F.posexplode("bands").alias("band", "bucket")), "meet")
    shared = stored(meet.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = stored(hot_join(meet, shared, "bucket", "n"), "members")
    forget(meet, shared)

    # the leader of a bucket is the member that meets the most others over all its buckets
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    lead = members.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("node")).alias("neg"))).alias("x"), F.max("n").alias("size"))
    lead = stored(lead.select("bucket", (-F.col("x.neg")).alias("leader"), "size"), "lead")
    pairs = hot_join(members, lead, "bucket", "size").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    need = stored(first.join(members.select("node").distinct(), "node"), "need")
    few = stored(known.join(sized(need), ["copy", "doc_id"]).dropDuplicates(["node"]).select("node", "sig"), "few")
    pairs = stored(agreeing(pairs, few, threshold - SLACK), "pairs")

    def make():
        words = word_table()
        return lambda raw: {"copy": [sequence(x) for x in raw], "set": [shingles(x, words, k).tobytes() for x in raw]}

    make.factory = True
    texts = slim.join(sized(need.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = map_texts(texts, make, {"copy": "binary", "set": "binary"}).join(sized(need), ["copy", "doc_id"])
    sets = stored(sets.dropDuplicates(["node"]).select("node", "set"), "sets")
    edges = stored(confirmed(pairs, sets, percent), "links")
    found = stored(components(edges), "components")

    placed = members.join(found, "node", "left").join(sets.select("node", F.octet_length("set").alias("bytes")), "node")
    placed = stored(placed.select("bucket", "node", F.coalesce("component", "node").alias("component"), "bytes"), "placed")
    links = stored(across(placed, sets, percent), "links")
    if not links.isEmpty():
        tree = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        old, found = found, stored(components(tree.unionByName(links.select("a", "b"))), "components")
        forget(old)
    forget(members, lead, need, few, pairs, sets, edges, placed, links)
    # of each component, the class with the smallest doc_id (and of these the first)
    best = copies.join(found, "node").groupBy("component").agg(F.min(F.struct("rep", "copy")).alias("best"))
    return sigs, copies, stored(found.join(best, "component").select("node", F.col("best.rep").alias("least"), F.col("best.copy").alias("best")), "found")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each input row: doc_id, md5 (of the text), n_shingles, component_id, kept (doc_id = component_id), stays (its text is the one that stays)."""
    sigs, copies, found = classes(docs, k, percent)
    placed = copies.join(found, "node", "left").select("copy", "n", F.coalesce("least", "rep").alias("component_id"), F.coalesce("best", "copy").alias("best"))
    placed = stored(placed, "placed")
    rows = sigs.select("doc_id", "md5", "n_shingles", "copy")
    linked = hot_join(rows.where("copy IS NOT NULL AND doc_id IS NOT NULL"), placed, "copy", "n")
    kept = F.col("doc_id") == F.col("component_id")
    linked = linked.select("doc_id", "md5", "n_shingles", "component_id", kept.alias("kept"), (kept & (F.col("copy") == F.col("best"))).alias("stays"))
    alone = rows.where("copy IS NULL OR doc_id IS NULL").select("doc_id", "md5", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("stays"))
    return linked.unionByName(alone)


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns, whatever their names; rows with a null doc_id stay.

    A row is known by its doc_id and the digest of its text.  Texts are moved only where the rows
    that go are too many to broadcast.
    """
    key, md5 = unused(docs, "_id", "_md5")
    gone = stored(near_groups(docs, k, percent).where("NOT stays").select(F.col("doc_id").alias(key), F.col("md5").alias(md5)).distinct(), "gone")
    digest = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    rows = docs.withColumns({key: docs["doc_id"].cast("bigint"), md5: digest})
    return rows.join(sized(gone), [key, md5], "left_anti").select(*docs.columns)
