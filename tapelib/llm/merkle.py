"""Merkle manifest of a dataset: one tree over the rows of each group, and one over the groups' roots.

Slot pivot: conditional aggregates spread the children of each parent into ``FANOUT`` columns.  The columns in one string give
the parent's hash; all but the own one are the siblings that a proof needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapelib.llm.store import stored

#: Consecutive nodes below one parent.
FANOUT = 8

#: Names of the slot columns.
SLOTS = [f"slot{i}" for i in range(FANOUT)]


def fields_hash(columns: list[Column]) -> Column:
    """SHA-256 over the columns in order: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the row's number from 0 within its ``grp`` in ``order``, and ``n``, the rows of ``grp``.

    ``copies`` tells how often a row counts; it gets the first of its numbers.  Rows are dealt by ranges of (grp, order), so
    that a large group is many ranges; only one row per range and group is summed up over a whole group.
    """
    parts = stored(rows.repartitionByRange("grp", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    group = Window.partitionBy("grp")
    counts = parts.groupBy("grp", "part").agg(F.sum("copies").alias("c"))
    counts = counts.select("grp", "part", (F.sum("c").over(group.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(group).alias("n"))
    within = Window.partitionBy("grp", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("pos", F.sum("copies").over(within) - F.col("copies")).join(counts, ["grp", "part"])
    return placed.withColumn("pos", F.col("pos") + F.col("before")).drop("part", "before")


def _pivot(nodes: DataFrame) -> DataFrame:
    """One row per parent of nodes ``grp, pos, n, node`` (a struct that begins with ``digest``): its children in slot columns."""
    slots = [F.max(F.when(F.col("pos") % FANOUT == i, F.col("node"))).alias(s) for i, s in enumerate(SLOTS)]
    return nodes.groupBy("grp", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.expr(f"(max(n) + {FANOUT - 1}) div {FANOUT}").alias("n"), *slots)


def _joined(slots: list[str]) -> Column:
    return F.concat(F.lit(""), *[F.coalesce(F.col(f"{s}.digest"), F.lit("")) for s in slots])


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pivots of each level, lowest first, and the roots found at each level (groups of which one node is left)."""
    levels, roots = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.filter("n = 1").select("grp", "pos", "node"))
        if most <= 1:
            return levels, roots
        most = -(-most // FANOUT)
        levels.append(stored(_pivot(nodes.filter("n > 1")), "merkle-level"))
        nodes = levels[-1].select("grp", "pos", "n", F.struct(F.sha2(_joined(SLOTS), 256).alias("digest")).alias("node"))


def _descend(levels: list[DataFrame], roots: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every lowest node as ``grp, pos, node, subroot, path``.  ``above`` has ``grp, subroot, path`` for each group; a path lists the
    siblings before and after the node, level by level upwards."""
    paths = None
    for k in reversed(range(len(roots))):
        here = roots[k].join(above, "grp").select("grp", "pos", "node", "subroot", "path")
        if paths is not None:
            parents = levels[k].drop("n").join(paths.select("grp", "pos", "subroot", "path"), ["grp", "pos"])
            child = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col(s).alias("node"), _joined(SLOTS[:i]).alias("before"), _joined(SLOTS[i + 1:]).alias("after")) for i, s in enumerate(SLOTS)]))
            below = parents.select("grp", "pos", "subroot", "path", child.alias("c")).filter("c.node IS NOT NULL")
            here = here.unionByName(below.select("grp", (F.col("pos") * FANOUT + F.col("c.slot")).alias("pos"), "c.node", "subroot", F.concat(F.array(F.struct("c.before", "c.after")), "path").alias("path")))
        paths = stored(here, "merkle-paths") if k else here
    return paths


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]), 256))


def manifest(rows: DataFrame, group: str, order: str, columns: list[str], altered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``rows``: ``id`` (the ``order`` column), ``leaf, subroot, root, path, altered_leaf``.

    Leaves are hashes of ``columns`` in order.  Within a group they ascend by ``order`` (null first), rows of the same order by
    leaf; every ``FANOUT`` consecutive nodes become one until one is left.  Groups ascend bytewise, null first.  ``altered``
    replaces columns by expressions over the row's own; ``altered_leaf`` is the hash with them, for proofs of changed rows.

    Null values are marked in the hash; empty and very long texts are hashed whole; equal rows are leaves of their own; other
    columns are not looked at; an empty table gives an empty result.

    Plan: each text is read and hashed once.  Levels shrink by ``FANOUT``; a join per level hands paths down, the last one to an
    eighth of the rows, whose children are spread out only after it.
    """
    plain = fields_hash([F.col(c) for c in columns])
    changed = fields_hash([(altered or {}).get(c, F.col(c)) for c in columns])
    leaves = rows.select(F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("grp"), F.col(order).alias("id"), plain.alias("digest"), (changed if altered else plain).alias("altered"))
    leaves = stored(leaves.groupBy("grp", "id", "digest", "altered").agg(F.count(F.lit(1)).alias("copies")), "merkle-leaves")
    placed = numbered(leaves, ["id", "digest"]).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    nodes = stored(placed.select("grp", (F.col("pos") + F.col("copy")).alias("pos"), "n", F.struct("digest", "id", "altered").alias("node")), "merkle-leaves-placed")
    levels, roots = _climb(nodes)

    subroots = roots[0].select("grp", "node.digest")
    for found in roots[1:]:
        subroots = subroots.unionByName(found.select("grp", "node.digest"))
    tops = stored(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", F.lit(1).cast("long").alias("copies")), "merkle-subroots")
    tops = numbered(tops, ["name"]).select("grp", "pos", "n", F.struct("digest", "name").alias("node"))
    top_levels, top_roots = _climb(stored(tops, "merkle-tops"))
    no_path = F.expr("cast(array() AS array<struct<before: string, after: string>>)")
    root = top_roots[-1].select("grp", F.col("node.digest").alias("subroot"), no_path.alias("path"))
    above = _descend(top_levels, top_roots, root).select(F.col("node.name").alias("grp"), F.col("node.digest").alias("digest"), F.struct(F.col("node.digest").alias("subroot"), F.col("subroot").alias("root")).alias("subroot"), "path")
    found = _descend(levels, roots, stored(above.drop("digest"), "merkle-above"))
    return found.select("node.id", F.col("node.digest").alias("leaf"), "subroot.subroot", "subroot.root", "path", F.col("node.altered").alias("altered_leaf"))


def proof_hash(path: Column) -> Column:
    """SHA-256 over all siblings of a path, left to right, level by level upwards."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)
