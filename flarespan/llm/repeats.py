"""Removal of long repeated strings with a logarithmic family of sparse suffix arrays.

Every string of ``length`` symbols has an anchor: the place in it where a string of ``gram`` symbols
has the smallest hash (leftmost on ties).  Equal strings have equal anchors, so only the suffixes at
anchors are indexed, about one in a hundred bytes.  Neighbouring strings with the same anchor are one
run and one entry of the array (head: first bytes of the suffix, which give its order; gram:
fingerprint of its first symbols; body: fingerprint of the whole run; lo, hi: smallest and largest
occurrence, which differ where there are two).

* Batches of texts come in one after the other; their number grows with the logarithm of the input.
  Each gets its suffix array, range-partitioned and sorted by suffix, in which neighbours are
  compared.  It is then merge-scanned against each existing level: both are brought into one suffix
  order, where entries of equal suffixes are neighbours, and those with a partner on the other side
  are hits.  Levels of equal size are replaced by the merged array of that scan, so each entry is
  rewritten a logarithmic number of times.  Only hits go on.
* A run that occurs twice is repeated in whole.  Other runs that share a suffix are cut into blocks
  of ``width`` strings by the anchor's place in the string, so equal strings lie in equal blocks.
  ``core`` is the fingerprint of the symbols that all strings of a block have in common, ``all``
  that of every symbol: a core that occurs once has no repeated string, an ``all`` that occurs twice
  under its core is repeated in whole, and only what is left is compared string by string, under its
  core (128 bits in all).
* The bytes covered by repeated strings are removed in one pass over the texts that have any.

The same index over words finds the passages of more than 50 words that other rows have too.

Results depend on the text alone, so texts are known by a 128-bit key and copies need no ids; ties
and repeated rows are copies.  Null and empty texts, and texts shorter than a string, lose nothing.
Long texts are read in pieces of bounded size; a run that is cut at a piece's end is two runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, give_back, hot_join, map_texts, mix, sized, slices, stored

#: Starts of strings that are handled at a time, and bytes of text cut into words at a time.
PIECE = 1 << 20
#: Symbols of short texts that are read as one.
JOINT = 1 << 15
#: Entries from which on there is a second batch; each doubling adds one.
FIRST_BATCH = 1 << 20
KEY, ENTRY = ["k1", "k2"], ["head", "gram", "body"]


#: A random value for each byte, made by rule; and the bytes that part words.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
WHITE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


class Rolling:
    """Fingerprints of any substring from prefix sums of random symbol values, modulo 2 ** 64."""

    BASE = 0xD1342543DE82EF95

    def __init__(self) -> None:
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(1 << 16, 1 << n.bit_length())
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (self.BASE, self.inverse))

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self.powers(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def prints(self, sums: np.ndarray, lo, hi) -> np.ndarray:
        return mix((sums[hi] - sums[lo]) * self.down[lo])


class Unit:
    """What strings are made of: their length, that of grams, and the width of blocks."""

    anywhere = True  # a string that comes again in its own text is repeated

    def __init__(self, length: int, gram: int, width: int, piece: int = PIECE) -> None:
        self.length, self.gram, self.width, self.span, self.piece = length, gram, width, length - gram + 1, piece

    def reader(self):
        """Text to symbols, made once in each task."""
        return lambda raw: np.frombuffer(raw, np.uint8)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return BYTE_VALUES[symbols]

    def heads(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first bytes of the suffixes as numbers in their order."""
        out = np.zeros(len(at), np.int64)
        for k in range(7):
            out = out << 8 | symbols[at + k]
        return out

    def occurrence(self):
        return F.xxhash64("k1", "k2", "first") if self.anywhere else F.col("k1")


class Words(Unit):
    anywhere = False

    def reader(self):
        roll = Rolling()

        def read(raw: bytes) -> np.ndarray:
            """Fingerprints of the words."""
            out, at = [np.empty(0, np.uint64)], 0
            while at < len(raw):  # a piece ends at white space, a longer word is not cut
                end = min(at + PIECE, len(raw))
                while end < len(raw) and not WHITE[raw[end]]:
                    end += 1
                data = np.frombuffer(raw, np.uint8, end - at, at)
                edges = np.flatnonzero(np.diff(np.r_[True, WHITE[data], True]))
                out.append(roll.prints(roll.sums(BYTE_VALUES[data]), edges[::2], edges[1::2]))
                at = end
            return np.concatenate(out)

        return read

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return symbols

    def heads(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (symbols[at] >> np.uint64(8)).astype(np.int64)


#: Strings of 400 bytes; passages of 51 words.
BYTES, PASSAGES = Unit(400, 200, 16), Words(51, 26, 4)


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` fingerprints the place of the smallest, leftmost on ties."""
    n = len(grams)
    blocks = -(-n // w)
    high = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    high[:n] = grams
    high = (high >> np.uint64(10)).reshape(blocks, w) << np.uint64(10)
    local = np.arange(w, dtype=np.uint64)
    after = np.minimum.accumulate((high | local)[:, ::-1], axis=1)[:, ::-1].ravel()  # window's part in its first block
    before = np.minimum.accumulate(high | (local + np.uint64(w)), axis=1).ravel()  # and in the next
    at = np.arange(n - w + 1)
    best = np.where(at % w == 0, after[at], np.minimum(after[at], before[at + w - 1]))
    return at - at % w + (best & np.uint64(1023)).astype(np.int64)


def runs(symbols: np.ndarray, unit: Unit, roll: Rolling):
    """Pieces (start, sums, first, last, anchor) of the runs of a text; places count from the piece's start."""
    starts = len(symbols) - unit.length + 1
    for s in range(0, starts, unit.piece):
        part = symbols[s : min(s + unit.piece, starts) + unit.length - 1]
        sums, n = roll.sums(unit.values(part)), len(part)
        at = anchors(roll.prints(sums, slice(0, n - unit.gram + 1), slice(unit.gram, n + 1)), unit.span)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        yield s, sums, first, np.r_[first[1:], len(at)] - 1, at[first]


def joint_runs(texts: list[np.ndarray], unit: Unit, roll: Rolling):
    """The runs of several texts, read as one so that short texts cost little: symbols, sums, number of the text, its start, first, last, anchor.

    Places count from the start of the first text; strings that reach into the next text are left out.
    """
    symbols, sizes = np.concatenate(texts), np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    sums, n = roll.sums(unit.values(symbols)), len(symbols)
    at = anchors(roll.prints(sums, slice(0, n - unit.gram + 1), slice(unit.gram, n + 1)), unit.span)
    starts = ends - sizes
    new = np.r_[True, at[1:] != at[:-1]]
    new[starts] = True
    beyond = (ends - unit.length + 1)[:-1]  # the first string of each text but the last that reaches into the next
    new[beyond] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    text = np.searchsorted(ends, first, "right")
    whole = first <= ends[text] - unit.length
    first, last, text = first[whole], last[whole], text[whole]
    return symbols, sums, text, starts[text], first, last, at[first]


def text_key(data: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), "<i8").tolist())


class Seen(set):
    """Keys of texts that a task has had; forgets them when full, so a text may come again."""

    def new(self, key) -> bool:
        if len(self) > 200_000:
            self.clear()
        before = len(self)
        self.add(key)
        return len(self) > before


def entries(docs: DataFrame, unit: Unit) -> DataFrame:
    """k1, k2 (text key), head, gram, body, first, last, anchor of every run of every text; a task passes on a copy once."""

    def make():
        roll, seen, read = Rolling(), Seen(), unit.reader()

        def run(raw):
            out, short, keys, size = {c: [] for c in kinds}, [], [], 0

            def add(k1, k2, symbols, sums, start, s, first, last, at):
                """``start`` is that of the text in ``symbols``, ``s`` that of ``symbols`` from which the places count."""
                body = mix(roll.prints(sums, first, last + unit.length) ^ (at - first).astype(np.uint64) ^ (last - first).astype(np.uint64) << np.uint64(20))
                gram = roll.prints(sums, at, at + unit.gram).view(np.int64)
                for c, v in zip(out, (k1, k2, unit.heads(symbols, at + s), gram, body.view(np.int64), first + s - start, last + s - start, at + s - start), strict=True):
                    out[c].append(v)

            def add_short():
                symbols, sums, text, start, first, last, at = joint_runs(short, unit, roll)
                k1, k2 = np.array(keys, np.int64).T[:, text]
                add(k1, k2, symbols, sums, start, 0, first, last, at)
                short.clear()
                keys.clear()

            for x in raw:
                if len(x) < unit.length or not seen.new(key := text_key(x)):
                    continue
                symbols = read(x)
                if len(symbols) < unit.length:
                    continue
                if len(symbols) > JOINT:
                    for s, sums, first, last, at in runs(symbols, unit, roll):
                        add(np.full(len(first), key[0]), np.full(len(first), key[1]), symbols, sums, 0, s, first, last, at)
                    continue
                if size + len(symbols) > JOINT:
                    add_short()
                    size = 0
                short.append(symbols)
                keys.append(key)
                size += len(symbols)
            if short:
                add_short()
            out = {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}
            return {"_row": np.zeros(len(out["k1"]), np.int64)} | out

        return run

    kinds = {"k1": "long", "k2": "long", "head": "long", "gram": "long", "body": "long", "first": "int", "last": "int", "anchor": "int"}
    make.factory = True
    return map_texts(docs.select("text"), make, kinds, ())


def one_each(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ENTRY).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("side").alias("side"), F.max("side_hi").alias("side_hi"), F.sum("n").alias("n"))


def sided(rows: DataFrame, side: int) -> DataFrame:
    return rows.select(*ENTRY, "lo", "hi", F.lit(side).alias("side"), F.lit(side).alias("side_hi"), "n")


def scanned(rows: DataFrame) -> DataFrame:
    """ENTRY, lo, hi, n (rows) in suffix order, and what their suffix has: different ``bodies``, both sides, two occurrences (``again``).

    One range partitioning by suffix serves the order, the union of equal runs and the scan.
    """
    suffix = Window.partitionBy("head", "gram")
    return one_each(rows.repartitionByRange("head", "gram")).sortWithinPartitions(*ENTRY).select(
        *ENTRY, "lo", "hi", "n", (F.min("body").over(suffix) != F.max("body").over(suffix)).alias("bodies"),
        (F.min("side").over(suffix) != F.max("side_hi").over(suffix)).alias("both"), (F.min("lo").over(suffix) != F.max("hi").over(suffix)).alias("again"),
    )


class Family:
    """Levels of 1, 2, 4, .. batches; ``hits`` are the entries that repeat or whose suffix others share."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}
        self.hits: list[DataFrame] = []

    def add(self, rows: DataFrame, last: bool = False) -> None:
        """Index a batch of entries with ``occ``, their occurrence; after the ``last`` batch no levels are merged any more."""
        rows = rows.select(*ENTRY, F.col("occ").alias("lo"), F.col("occ").alias("hi"), F.lit(1).cast("long").alias("n"))
        new, size = stored(scanned(one_each(sided(rows, 1))), "level"), 1
        self._hit(new.where("again"))
        joining = True
        for k, old in sorted(self.levels.items()):
            joining = joining and k == size and not last
            both = scanned(sided(old, 0).unionByName(sided(new, 1)))
            if not joining:
                self._hit(both.where("both"))
                continue
            both = stored(both, "level")
            self._hit(both.where("both"))
            forget(self.levels.pop(k), new)
            new, size = both, 2 * size
        self.levels[size if not last else 0] = new

    def _hit(self, found: DataFrame) -> None:
        self.hits.append(stored(found.select(*ENTRY, "lo", "hi", "n", "bodies"), "hits"))

    def found(self) -> DataFrame:
        """ENTRY, lo, hi, n, mixed (other runs share the suffix), twice (the run repeats)."""
        out = self.hits[0]
        for h in self.hits[1:]:
            out = out.unionByName(h)
        out = out.groupBy(*ENTRY).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"), F.max("bodies").alias("mixed"))
        return out.withColumn("twice", F.col("lo") != F.col("hi"))


def word_count(raw: bytes) -> int:
    """Places where a word begins."""
    white = WHITE[np.frombuffer(raw, np.uint8)]
    return int(np.count_nonzero(white[:-1] & ~white[1:])) + int(len(white) and not white[0])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_bytes, n_words and ``sha`` (SHA-256) of each text."""

    def run(raw):
        keys = [text_key(x) for x in raw]
        words = [word_count(x) for x in raw]
        return {"k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "n_bytes": [len(x) for x in raw], "n_words": words, "sha": [hashlib.sha256(x).hexdigest() for x in raw]}

    return map_texts(docs.select("doc_id", "text"), run, {"k1": "long", "k2": "long", "n_bytes": "long", "n_words": "long", "sha": "string"})


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """k1, k2, raw of the texts with these (stored) keys, once each; a task passes on a copy of a text once."""

    def make():
        seen = Seen()

        def run(raw):
            out = {"k1": [], "k2": [], "raw": [], "_row": []}
            for i, x in enumerate(raw):
                if seen.new(key := text_key(x)):
                    for c, v in zip(out, (*key, x, i), strict=True):
                        out[c].append(v)
            return out

        return run

    make.factory = True
    found = map_texts(docs.select("text"), make, {"k1": "long", "k2": "long", "raw": "binary"}, ())
    return stored(found.join(sized(keys), KEY, "left_semi").dropDuplicates(KEY), "texts")


def fingerprints(texts: DataFrame, lists: DataFrame, unit: Unit, make, ddl: str) -> DataFrame:
    """Rows that ``make(unit, sums, roll, *arrays of the listed structs)`` gives for each text, under its list_id.

    The listed structs have ``first`` and ``last`` among their places, which count from the start of
    the text; so do the places (int) that come back.
    """
    fields = [f.name for f in lists.schema["listed"].dataType.elementType]
    places = [k for k, c in enumerate(fields) if c in ("first", "last", "anchor")]
    rows = texts.join(lists, KEY).select("list_id", "raw", *(F.col(f"listed.{c}").alias(c) for c in fields))
    names = ["list_id", *(c.split()[0] for c in ddl.split(", "))]
    ints = [c.endswith(" int") for c in ddl.split(", ")]

    def task(batches):
        roll, read = Rolling(), unit.reader()
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                cols = [[] for _ in names]
                for i in range(lo, hi):
                    symbols = read(batch.column(1)[i].as_py())
                    listed = [batch.column(2 + k)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(fields))]
                    first, last = listed[fields.index("first")], listed[fields.index("last")]
                    piece = first // unit.piece
                    for p in np.unique(piece):
                        at = np.flatnonzero(piece == p)
                        s = int(first[at].min())
                        sums = roll.sums(unit.values(symbols[s : int(last[at].max()) + unit.length]))
                        got = make(unit, sums, roll, *(x[at] - s if k in places else x[at] for k, x in enumerate(listed)))
                        got = [(x + s).astype(np.int32) if place else x for x, place in zip(got, ints, strict=True)]
                        for c, v in zip(cols, (np.full(len(got[0]), batch.column(0)[i].as_py()), *got), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)
            del batch
            give_back()

    return rows.mapInArrow(task, f"list_id bigint, {ddl}")


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of each row, one after the other."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def blocks_of(unit, sums, roll, first, last, anchor, occ_lo, occ_hi):
    """core, all, occ_lo, occ_hi, lo, hi (first and last start) of the blocks of each run."""
    low, high = (anchor - last) // unit.width, (anchor - first) // unit.width
    sizes = high - low + 1
    block, at, f, t, a, b = ranges(low, sizes), *(np.repeat(x, sizes) for x in (anchor, first, last, occ_lo, occ_hi))
    lo, hi = np.maximum(f, at - block * unit.width - unit.width + 1), np.minimum(t, at - block * unit.width)
    # strings of a block start up to width - 1 symbols apart; at the ends of a text some of what they share is not there
    core_lo, core_hi = at - block * unit.width, at + unit.length - block * unit.width - unit.width + 1
    core = mix(roll.prints(sums, core_lo, core_hi) ^ roll.prints(sums, at, at + unit.gram) ^ block.astype(np.uint64))
    whole = mix(roll.prints(sums, lo, hi + unit.length) ^ (at - lo).astype(np.uint64) ^ (hi - lo).astype(np.uint64) << np.uint64(20))
    return core.view(np.int64), whole.view(np.int64), a, b, lo, hi


def strings_of(unit, sums, roll, core, occ_lo, occ_hi, first, last):
    """core, string (fingerprint), occ_lo, occ_hi, at of every string of the listed blocks."""
    sizes = last - first + 1
    at = ranges(first, sizes)
    return np.repeat(core, sizes), roll.prints(sums, at, at + unit.length).view(np.int64), np.repeat(occ_lo, sizes), np.repeat(occ_hi, sizes), at


def repeated(texts: DataFrame, each: DataFrame, unit: Unit) -> DataFrame:
    """k1, k2, spans of the repeated strings of runs that share a suffix; ``each`` has one place of each different run, with the run's occurrences."""
    lists = each.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last", "anchor", "occ_lo", "occ_hi")).alias("listed"))
    lists = stored(lists.withColumn("list_id", F.monotonically_increasing_id()), "lists")
    apart = F.min("occ_lo") != F.max("occ_hi")
    if unit.anywhere:  # strings of one run, too, are different occurrences
        apart = apart | (F.count(F.lit(1)) > 1)
    blocks = stored(fingerprints(texts, lists, unit, blocks_of, "core bigint, all bigint, occ_lo bigint, occ_hi bigint, lo int, hi int"), "blocks")
    kinds = blocks.groupBy("core", "all").agg(apart.alias("again"), F.min("occ_lo").alias("occ_lo"), F.max("occ_hi").alias("occ_hi"), F.first(F.struct("list_id", "lo", "hi")).alias("place"))
    kinds = stored(kinds, "kinds")
    whole = blocks.join(kinds.where("again").select("core", "all"), ["core", "all"], "left_semi").select("list_id", "lo", "hi")
    open_cores = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
    left = kinds.join(open_cores, "core", "left_semi").select("core", "occ_lo", "occ_hi", "place.*")
    left = left.groupBy("list_id").agg(F.collect_list(F.struct("core", "occ_lo", "occ_hi", F.col("lo").alias("first"), F.col("hi").alias("last"))).alias("listed"))
    every = fingerprints(texts, left.join(lists.select("list_id", *KEY), "list_id"), unit, strings_of, "core bigint, string bigint, occ_lo bigint, occ_hi bigint, at int")
    every = stored(every, "strings")
    twice = every.groupBy("core", "string").agg(apart.alias("again")).where("again").select("core", "string")
    single = every.join(twice, ["core", "string"], "left_semi").select("list_id", F.col("at").alias("lo"), F.col("at").alias("hi"))
    spans = whole.unionByName(single).groupBy("list_id").agg(F.collect_list(F.struct(F.col("lo").alias("first"), F.col("hi").alias("last"))).alias("spans"))
    out = stored(spans.join(lists.select("list_id", *KEY), "list_id").select(*KEY, "spans"), "spans")
    forget(lists, blocks, kinds, every)
    return out


def index(docs: DataFrame, unit: Unit, batches: int | None = None) -> DataFrame:
    """The runs (of ``entries``) that repeat or share a suffix, with ``mixed``, ``twice``, occ_lo and occ_hi, by a family of suffix arrays."""
    found = stored(entries(docs, unit).withColumn("occ", unit.occurrence()), "entries")
    batches = batches or 1 + int(np.log2(1 + found.count() / FIRST_BATCH))
    family = Family()
    for k in range(batches):
        family.add(found.where(F.pmod(F.xxhash64("k1"), F.lit(batches)) == k), last=k + 1 == batches)
    flags = stored(family.found().withColumnsRenamed({"lo": "occ_lo", "hi": "occ_hi"}), "flags")
    rows = stored(hot_join(found.drop("occ"), flags, ENTRY, "n"), "runs")
    forget(found, flags, *family.hits, *family.levels.values())
    return rows


def covered(texts: DataFrame, rows: DataFrame, unit: Unit) -> DataFrame:
    """k1, k2, spans: list of (first, last) starts of repeated strings, for the texts that have any."""
    places = [*KEY, "first", "last", "anchor", "occ_lo", "occ_hi"]
    many = rows.where("mixed AND twice").groupBy(*ENTRY).agg(F.first(F.struct(*places)).alias("place")).select("place.*")
    single = repeated(texts, rows.where("mixed AND NOT twice").select(*places).unionByName(many), unit)
    whole = rows.where("twice").groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return stored(whole.unionByName(single).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def joined_spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs."""
    order = np.argsort(first, kind="stable")
    lo, hi = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + length)
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]


def cut(texts: DataFrame, spans: DataFrame, unit: Unit, keep: bool) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept_sha256 of the texts that lose bytes, and ``kept`` if ``keep``."""
    rows = texts.join(spans, KEY).select(*KEY, "raw", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))
    names = [*KEY, "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])]

    def task(batches):
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                gone, count, sha, kept = [], [], [], []
                for i in range(b - a):
                    x = part.column(2)[i].as_py()
                    lo, hi = joined_spans(part.column(3)[i].values.to_numpy(), part.column(4)[i].values.to_numpy(), unit.length)
                    rest = b"".join([x[s:e] for s, e in zip(np.r_[0, hi].tolist(), np.r_[lo, len(x)].tolist(), strict=True)])
                    gone.append(len(x) - len(rest))
                    count.append(len(lo))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                more = [pa.array(kept, pa.binary())] if keep else []
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), *more], names)
            del batch, part
            give_back()

    return stored(rows.mapInArrow(task, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep), "cut")


def words_in(spans, length: int):
    """Words covered by spans of (first, last) starts of strings."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["reach"], x["last"] + length).alias("reach"), (s["n"] + F.greatest(F.lit(0), x["last"] + length - F.greatest(s["reach"], x["first"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["n"])


def without_repeats(docs: DataFrame, texts: bool = True, unit: Unit = BYTES, passage: Unit = PASSAGES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words of each input row, and ``kept`` (the remaining bytes) if ``texts``.

    ``passage_words``: words in passages of more than 50 words that other rows have too.
    """
    base = stored(keyed(docs), "keyed")
    rows, words = index(docs, unit), index(docs, passage, batches=1)
    keys = base.select(*KEY) if texts else rows.select(*KEY).unionByName(words.select(*KEY))
    raw = texts_of(docs, stored(keys.distinct(), "keys"))
    removed = cut(raw, covered(raw, rows, unit), unit, texts)
    passages = covered(raw, words, passage).select(*KEY, words_in(F.col("spans"), passage.length).alias("passage_words"))
    each = base.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.first("n_bytes").alias("n_bytes"), F.first("n_words").alias("n_words")).join(removed, KEY, "left").join(passages, KEY, "left")
    if texts:
        each = each.join(raw, KEY, "left")
    zero, one, none = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit("").cast("binary")
    copy = (F.col("rows") > 1) & (F.col("n_bytes") >= unit.length)  # copies repeat each other in whole
    alike = (F.col("rows") > 1) & (F.col("n_words") >= passage.length)
    more = [F.when(copy, none).otherwise(F.coalesce("kept", "raw")).alias("kept")] if texts else []
    each = each.select(
        *KEY, "rows", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"), F.when(copy, one).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(none, 256)).otherwise(F.col("kept_sha256")).alias("cut_sha"), F.when(alike, F.col("n_words")).otherwise(F.coalesce("passage_words", zero)).alias("passage_words"), *more,
    )
    each = stored(each, "each")
    out = hot_join(base, each, KEY, "rows")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce("cut_sha", "sha").alias("kept_sha256"), "passage_words", *(["kept"] if texts else []))
