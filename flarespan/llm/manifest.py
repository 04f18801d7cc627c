"""Merkle manifest of a dataset, with a proof for each document.

A leaf is the digest of a document's fields.  The leaves of a language, by doc_id, make a tree whose
nodes join ARITY children; the roots of the languages' trees, by language, make the top tree.

The method is a monoid of sparse forests.  A *fragment* holds nodes keyed by (tree, level, index).
Merging two fragments joins their nodes; as soon as all children of a run are there - how many a run
has is known from the number of the tree's leaves - they are replaced by their parent, and a tree
that is down to one node becomes a leaf of the top tree.  Merging is associative and has an empty
fragment, and the fragment of any range of leaves has at most 2 * (ARITY - 1) nodes for each level.

1. Leaves are hashed in the JVM; from there only digests move.  They are dealt by range of (language,
   doc_id) into parts of about PART_ROWS, numbered by position, and each part makes its fragment.
2. ``treeReduce`` merges the fragments to the root.
3. All fragments but a part's own, merged, hold exactly the siblings that its proofs need from
   outside.  These contexts are found going up and down a tree of FAN parts to a group.
4. Each part proves its own leaves with its context, and folds the digest of the text as it is found
   now (or as tampered with) up to a root that is compared with the known one.

Defined results: each null field counts as "-", so a null text is not an empty one.  Null languages
come first, within a language null doc_ids; rows with the same doc_id are ordered by leaf, and equal
rows are leaves each.  A table without rows has no rows.  Long texts are hashed in the JVM and never
sent to Python.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, sized, stored
from .line_dedup import ascii_lower

#: Children of a node, rows of a part, parts that are merged at a time on the way to the contexts.
ARITY, PART_ROWS, FAN = 8, 16_384, 64
#: The tree of the languages' roots.
TOP = -1
#: Fixed order of the fields of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(**changed: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def joined(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level of a tree."""
    return -(-leaves // ARITY**level)


def run_of(leaves: int, level: int, run: int) -> range:
    """Indexes of the children of node ``run`` of the level above."""
    return range(ARITY * run, min(ARITY * (run + 1), width(leaves, level)))


def settled(nodes: dict, sizes: dict, touched: Iterable[tuple]) -> dict:
    """Replace complete runs by their parents, beginning with the runs of ``touched`` nodes; changes ``nodes``."""
    todo = list({(t, level, i // ARITY) for t, level, i in touched})
    while todo:
        tree, level, run = todo.pop()
        if width(sizes[tree], level) == 1:
            if tree != TOP and (tree, level, 0) in nodes:
                nodes[TOP, 0, tree] = nodes.pop((tree, level, 0))
                todo.append((TOP, 0, tree // ARITY))
            continue
        keys = [(tree, level, i) for i in run_of(sizes[tree], level, run)]
        if all(k in nodes for k in keys):
            nodes[tree, level + 1, run] = joined([nodes.pop(k) for k in keys])
            todo.append((tree, level + 1, run // ARITY))
    return nodes


def merged(a: tuple[dict, dict], b: tuple[dict, dict]) -> tuple[dict, dict]:
    """The monoid: two fragments (nodes, leaves of each tree with open nodes) as one."""
    few, many = sorted((a, b), key=lambda f: len(f[0]))
    sizes = {**a[1], **b[1]}
    nodes = settled({**many[0], **few[0]}, sizes, few[0])
    return nodes, {t: sizes[t] for t in {k[0] for k in nodes} | {TOP} if t in sizes}


NOTHING: tuple[dict, dict] = ({}, {})


def written(fragment: tuple[dict, dict]) -> str:
    return json.dumps([[[*k, v] for k, v in sorted(fragment[0].items())], sorted(fragment[1].items())])


def read(text: str) -> tuple[dict, dict]:
    nodes, sizes = json.loads(text)
    return {(t, level, i): v for t, level, i, v in nodes}, dict(map(tuple, sizes))


def part_leaves(table: pa.Table, trees: int) -> tuple[dict, dict]:
    """Leaves of a part by key, and the sizes of their trees."""
    tree, at, size = (table.column(c).to_pylist() for c in ("tree", "index", "leaves"))
    leaf = table.column("leaf").to_pylist()
    return {(t, 0, i): x.hex() for t, i, x in zip(tree, at, leaf, strict=True)}, {**dict(zip(tree, size, strict=True)), TOP: trees}


def dealt(slim: DataFrame, rows: int) -> DataFrame:
    """The leaves with ``part``, ``at`` (their place in all), by range of language and doc_id."""
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("nth")]
    parts = slim.repartitionByRange(max(1, -(-rows // PART_ROWS)), *order).sortWithinPartitions(*order)
    return parts.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop("nth")


def numbered(parts: DataFrame) -> DataFrame:
    """The leaves with ``tree`` (the language's rank), ``leaves`` (of the tree) and ``index`` in it.

    Only totals of each (part, language) are ordered in a window; a part is a range, so there are few
    more of these than parts and languages.
    """
    totals = stored(parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "totals")
    langs = totals.groupBy("lang").agg(F.sum("n").alias("leaves")).select(F.col("lang").alias("_lang"), "leaves", (F.row_number().over(Window.orderBy(F.asc_nulls_first("lang"))) - 1).alias("tree"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    places = places.join(langs, places["lang"].eqNullSafe(langs["_lang"])).select("_lang", F.col("part").alias("_part"), "tree", "leaves", (F.col("before") - F.col("first")).alias("shift"))
    places = stored(places, "places")
    out = parts.join(sized(places), (parts["part"] == places["_part"]) & parts["lang"].eqNullSafe(places["_lang"]))
    return out.select("part", "doc_id", "leaf", "forged", "tree", "leaves", (F.col("at") + F.col("shift")).alias("index"))


def contexts(fragments: DataFrame) -> DataFrame:
    """(slot, context): all fragments but the slot's own, merged; ``fragments`` is (slot, fragment), stored.

    Groups of FAN are merged going up until one is left; going down, each child gets its parent's
    context and its brothers' fragments, from running merges on both sides.
    """
    group = F.floor(F.col("slot") / FAN).cast("long").alias("slot")

    def up(key, table):
        total = NOTHING
        for text in table.column("fragment").to_pylist():
            total = merged(total, read(text))
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "fragment": [written(total)]})

    def down(table):
        rows = sorted(zip(table.column("slot").to_pylist(), table.column("fragment").to_pylist(), table.column("context").to_pylist(), strict=True))
        own = [read(f) for _, f, _ in rows]
        after = [NOTHING]
        for f in reversed(own[1:]):
            after.append(merged(f, after[-1]))
        left, out = read(rows[0][2]), []
        for f, right in zip(own, reversed(after), strict=True):
            out.append(written(merged(left, right)))
            left = merged(left, f)
        return pa.table({"slot": pa.array([s for s, _, _ in rows], pa.int64()), "context": out})

    levels = [fragments]
    while levels[-1].agg(F.max("slot")).first()[0] >= FAN:
        above = levels[-1].select(group, "fragment", F.col("slot").alias("child"))
        levels.append(stored(above.groupBy("slot").applyInArrow(up, "slot bigint, fragment string"), "fragments"))
    out = None
    for level in reversed(levels):
        rows = level.withColumn("above", F.floor(F.col("slot") / FAN).cast("long"))
        if out is None:
            rows = rows.withColumn("context", F.lit(written(NOTHING)))
        else:
            rows = rows.join(out.select(F.col("slot").alias("above"), "context"), "above")
        out = rows.groupBy("above").applyInArrow(down, "slot bigint, context string")
    return out


def climbed(nodes: dict, sizes: dict) -> dict:
    """``nodes`` and all their ancestors, children kept; the siblings must be there."""
    every, todo = dict(nodes), sorted(nodes)
    while todo:
        above = []
        for tree, level, run in sorted({(t, level, i // ARITY) for t, level, i in todo}):
            if tree not in sizes or (width(sizes[tree], level) == 1 and tree == TOP):
                continue
            keys = [(tree, level, i) for i in run_of(sizes[tree], level, run)]
            if any(k not in every for k in keys):
                continue
            up = (TOP, 0, tree) if width(sizes[tree], level) == 1 else (tree, level + 1, run)
            if up not in every:
                every[up] = every[keys[0]] if up[0] == TOP and tree != TOP else joined([every[k] for k in keys])
                above.append(up)
        todo = above
    return every


def paths(every: dict, sizes: dict):
    """A function from a node to its (siblings to the left, to the right, parent), and one to all its siblings up to the root; both remember."""
    steps: dict = {}
    tails: dict = {}

    def step(key):
        if key not in steps:
            tree, level, i = key
            if width(sizes[tree], level) == 1:
                steps[key] = None if tree == TOP else ("", "", (TOP, 0, tree), False)
            else:
                run = run_of(sizes[tree], level, i // ARITY)
                left, right = ("".join(every[tree, level, j] for j in run if (j < i) == side and j != i) for side in (True, False))
                steps[key] = left, right, (tree, level + 1, i // ARITY), True
        return steps[key]

    def tail(key):
        if key not in tails:
            s = step(key)
            tails[key] = "" if s is None else s[0] + s[1] + tail(s[2])
        return tails[key]

    return step, tail


def folded(digest: str, key: tuple, step) -> str:
    """The root that a leaf of this digest leads to, with the siblings that are known."""
    while (s := step(key)) is not None:
        left, right, key, hashed = s
        if hashed:
            digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row for each input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` is the text as it is found now (the column ``text`` where it is not given): its leaf is
    folded with the siblings of the manifest, and ``verified`` says whether that gives the root.
    """
    leaf = leaf_of()
    forged = F.lit(None).cast("binary") if tampered is None else leaf_of(text=tampered)
    slim = stored(docs.select("lang", "doc_id", leaf.alias("leaf"), forged.alias("forged")).withColumn("nth", F.monotonically_increasing_id()), "leaves")
    parts = stored(dealt(slim, slim.count()), "parts")
    leaves = stored(numbered(parts), "numbered")
    forget(slim, parts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    trees = leaves.agg(F.max("tree")).first()[0]
    if trees is None:
        return docs.sparkSession.createDataFrame([], ddl)
    trees += 1

    def fragment(key, table):
        nodes, sizes = part_leaves(table, trees)
        own = settled(nodes, sizes, list(nodes))
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "fragment": [written((own, {t: n for t, n in sizes.items() if t == TOP or any(k[0] == t for k in own)}))]})

    fragments = stored(leaves.groupBy("part").applyInArrow(fragment, "slot bigint, fragment string"), "fragments")
    nodes, _ = fragments.rdd.map(lambda r: read(r.fragment)).treeReduce(merged)
    ((_, root),) = nodes.items()
    around = stored(contexts(fragments), "contexts")

    def prove(mine, its):
        own, sizes = part_leaves(mine, trees)
        outside, more = read(its.column("context")[0].as_py())
        sizes = {**more, **sizes}
        every = climbed({**outside, **own}, sizes)
        step, tail = paths(every, sizes)
        keys = list(zip(mine.column("tree").to_pylist(), [0] * mine.num_rows, mine.column("index").to_pylist(), strict=True))
        now = [x.hex() if x else None for x in mine.column("forged").to_pylist()]
        found = [folded(x or own[k], k, step) for k, x in zip(keys, now, strict=True)]
        return pa.table(
            {
                "doc_id": mine.column("doc_id"), "leaf": [own[k] for k in keys], "subroot": [every[TOP, 0, k[0]] for k in keys], "root": [root] * len(keys),
                "proof_sha256": [hashlib.sha256(tail(k).encode()).hexdigest() for k in keys], "folded_root": found, "verified": [x == root for x in found],
            }
        )

    sides = leaves.groupBy("part").cogroup(around.withColumn("part", F.col("slot").cast("int")).groupBy("part"))
    return sides.applyInArrow(prove, ddl)


def lower_cased_third() -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of the doc_id, else the text; nulls stay."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
