"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes, in DataFrame operations only.

A tree domain - language - source has an integer weight at each node.  The total budget goes down
level by level: each parent's budget is split among its children by weight, no child gets more
than its subtree holds (its tokens times the largest number of epochs), and what a child cannot
take goes to its siblings first.  A parent's budget is itself limited by its subtree, so a shortage
reaches the parent's siblings only when the whole subtree is exhausted.

Each leaf's budget is met by whole epochs and the token prefix of one more epoch, in an order
seeded by (seed, epoch, doc_id).  The prefix is found from sums over slices of that order, so the
rows of one leaf are never sorted in one task; only the slice where the budget ends is.

Null levels are a node of their own, the empty name; null texts have no tokens; null ids share one
place in the order.  A negative weight counts as 0; nodes without a weight have ``default_weight``.
A node of weight 0 gets nothing, and its tokens do not count for what its parents can take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stored, unused

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order that name a slice: 16 ** 3 slices for each leaf.
SLICE_DIGITS = 3


def counted(docs: DataFrame, domain: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Slim rows without texts: doc_id, the levels, n_tokens (words)."""
    return docs.select(
        "doc_id", F.coalesce(domain, F.lit("")).alias("domain"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS[1:]],
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), *extra,
    )


def weight_of(level: str, weights: dict[str, int], default: int) -> Column:
    known = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(level)], F.lit(default)) if weights else F.lit(default)
    return F.greatest(known, F.lit(0)).cast("long")


def split_budget(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Children (parent levels, level, w, cap, budget of the parent), w above 0, with their own ``share`` of it.

    In the order of cap / w a child is full exactly while its cap is at most its part of what is
    left; all after it share the rest by weight, rounded down.
    """
    keys = parent or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy(F.expr("cap / w"), level)
    rows = children.withColumns({
        "taken": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("full", F.expr("cap * w_left <= (budget - taken) * w"))
    group = Window.partitionBy(*keys)
    rows = rows.withColumns({
        "full_cap": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group),
        "open_w": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(group),
    })
    share = F.expr("CASE WHEN full THEN cap ELSE greatest(0, (budget - full_cap) * w) div open_w END")
    return rows.withColumn("share", share)


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], default_weight: int, max_epochs: int) -> DataFrame:
    """Leaves (levels, tokens) with ``budget``; leaves below a node of weight 0 get 0.  The number of rows is that of the tree's nodes.

    ``budget`` may use all_tokens, the tokens of all leaves.
    """
    each = leaves.withColumns({f"w_{c}": weight_of(c, weights.get(c, {}), default_weight) for c in LEVELS})
    total = each.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    nodes, parent = None, []
    open_leaves = each.where(" AND ".join(f"w_{c} > 0" for c in LEVELS))
    for level in LEVELS:
        path = [*parent, level]
        caps = open_leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("cap"), F.max(f"w_{level}").alias("w"))
        if nodes is None:
            room = caps.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("room")).crossJoin(total).select(F.least(budget.cast("long"), F.col("room")).alias("budget"))
            above = caps.crossJoin(F.broadcast(room))  # one row
        else:
            above = caps.join(nodes, parent)
        nodes = split_budget(above, parent, level).select(*path, F.col("share").alias("budget"))
        parent = path
    return leaves.join(nodes, list(LEVELS), "left").na.fill(0, ["budget"])


def in_order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))


def mixed(slim: DataFrame, budget: Column, weights: dict[str, dict[str, int]], *, default_weight: int = 1, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """Rows of ``counted`` with leaf_budget and ``copies``: how often the document is taken, 0 if not.

    ``budget`` may use the column ``all_tokens``.
    """
    slim = stored(slim, "slim")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, budget, weights, default_weight, max_epochs)
    plan = stored(plan.where("tokens > 0").selectExpr(*LEVELS, "budget AS leaf_budget", "budget div tokens AS epochs", "budget % tokens AS rest"), "plan")
    place = in_order(seed, F.col("epochs"))
    rows = slim.join(plan, list(LEVELS), "left").na.fill(0, ["leaf_budget", "epochs", "rest"]).withColumn("place", place).withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
    sums = rows.where("rest > 0").groupBy(*LEVELS, "slice", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("tokens").over(upto)).where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("slice", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
    ends = stored(ends.select(*LEVELS, F.col("end.slice").alias("end_slice"), F.col("end.before").alias("before")), "ends")
    rows = rows.join(ends, list(LEVELS), "left")
    whole = rows.where("NOT coalesce(slice = end_slice, false)").withColumn("more", F.expr("CASE WHEN rest > 0 AND (end_slice IS NULL OR slice < end_slice) THEN 1 ELSE 0 END"))
    run = Window.partitionBy(*LEVELS).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("slice = end_slice").withColumn("more", (F.col("before") + F.sum("n_tokens").over(run) <= F.col("rest")).cast("int"))
    kept = [c for c in slim.columns if c not in ("doc_id", *LEVELS, "n_tokens")]
    return whole.unionByName(last).select("doc_id", *LEVELS, "n_tokens", "leaf_budget", (F.col("epochs") + F.col("more")).alias("copies"), *kept)


#: Target weights for the ``documents`` table.
CORPUS_WEIGHTS = {"domain": {"bulk": 2, "web": 3, "curated": 5}, "lang": {"en": 6, "de": 2, "fr": 2}}


def corpus_domain() -> Column:
    """src0 is bulk, src1 to src9 web, all others curated."""
    return F.when(F.col("source") == "src0", "bulk").when(F.col("source").rlike("^src[1-9]$"), "web").otherwise("curated")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Half of all tokens, by CORPUS_WEIGHTS, at most two epochs of a leaf."""
    return mixed(counted(docs, corpus_domain()), F.expr("all_tokens div 2"), CORPUS_WEIGHTS)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The chosen rows of ``docs`` with all their columns, whatever their names, as often as they are taken.

    A row is known by its doc_id and its tokens; rows alike in both are each taken as often as the first.
    """
    key, tokens, copies, nth = unused(docs, "_id", "_tokens", "_copies", "_nth")
    known, words = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    taken = mix_documents(docs).groupBy(known.alias(key), F.col("n_tokens").alias(tokens)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    out = docs.withColumns({key: known, tokens: words}).join(sized(stored(taken, "taken")), [key, tokens])
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


SQL = r"""
WITH slim AS (
    SELECT doc_id, CASE WHEN source = 'src0' THEN 'bulk' WHEN regexp_matches(source, '^src[1-9]$') THEN 'web' ELSE 'curated' END AS domain,
           coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
    FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM slim GROUP BY ALL),
d0 AS (SELECT domain, (2 * sum(tokens))::BIGINT AS cap, CASE domain WHEN 'bulk' THEN 2 WHEN 'web' THEN 3 ELSE 5 END AS w,
              (SELECT sum(tokens) // 2 FROM leaves)::BIGINT AS budget FROM leaves GROUP BY ALL),
d1 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS f FROM d0),
d2 AS (SELECT domain, CASE WHEN f THEN cap ELSE greatest(0, budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ()) * w // sum(CASE WHEN f THEN 0 ELSE w END) OVER () END AS budget FROM d1),
l0 AS (SELECT domain, lang, (2 * sum(tokens))::BIGINT AS cap, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w,
              any_value(budget)::BIGINT AS budget FROM leaves JOIN d2 USING (domain) GROUP BY domain, lang),
l1 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS f FROM l0),
l2 AS (SELECT domain, lang, CASE WHEN f THEN cap ELSE greatest(0, budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER p) * w // sum(CASE WHEN f THEN 0 ELSE w END) OVER p END AS budget
       FROM l1 WINDOW p AS (PARTITION BY domain)),
s0 AS (SELECT domain, lang, source, tokens, 2 * tokens AS cap, 1 AS w, budget::BIGINT AS budget FROM leaves JOIN l2 USING (domain, lang)),
s1 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS f FROM s0),
s2 AS (SELECT domain, lang, source, tokens, (CASE WHEN f THEN cap ELSE greatest(0, budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER p) * w // sum(CASE WHEN f THEN 0 ELSE w END) OVER p END)::BIGINT AS leaf_budget
       FROM s1 WINDOW p AS (PARTITION BY domain, lang)),
r AS (SELECT slim.*, coalesce(leaf_budget, 0) AS leaf_budget, coalesce(leaf_budget // tokens, 0) AS epochs, coalesce(leaf_budget % tokens, 0) AS rest
      FROM slim LEFT JOIN s2 ON tokens > 0 AND slim.domain = s2.domain AND slim.lang = s2.lang AND slim.source = s2.source)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget,
       (epochs + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || epochs || ':' || coalesce(doc_id::VARCHAR, '-')), doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM r"""
