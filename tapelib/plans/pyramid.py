"""A min/max pyramid over long series: first later row beyond a level, and extremes of a range of rows.

Level 0 holds blocks of ``fan`` rows, level k blocks of ``fan`` blocks of level k - 1 with their extremes.  A search climbs from
its first row until some block holds a match and then descends to it, one join a level, so it takes O(log n) rounds however far
it leads, and a search carries one block of ``fan`` entries at a time."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .longseries import materialize

FAN = 64


class Pyramid:
    """``fields`` maps names to (column, "max" or "min").  ``idx`` numbers the rows of a key; gaps are allowed."""

    def __init__(self, rows: DataFrame, keys: list[str], fields: dict[str, tuple[str, str]], idx: str = "idx", fan: int = FAN):
        self.keys, self.fan, self.names = list(keys), fan, list(fields)
        level = materialize(rows.select(*keys, F.col(idx).cast("long").alias("_p"), *[F.col(c).alias(n) for n, (c, _) in fields.items()]), "pyramid-rows")
        self.kinds = {n: level.schema[n].dataType.simpleString() for n in fields}
        self.pick = {n: {"max": (F.max, F.greatest, F.array_max), "min": (F.min, F.least, F.array_min)}[kind] for n, (_, kind) in fields.items()}
        top = level.agg(F.max("_p")).first()[0]
        self.height, built = 0, None
        while True:
            nodes = level.groupBy(*keys, F.floor(F.col("_p") / fan).alias("_blk")).agg(F.array_sort(F.collect_list(F.struct("_p", *self.names))).alias("_node"), *[self.pick[n][0](n).alias(n) for n in self.names])
            nodes = materialize(nodes.withColumn("_lvl", F.lit(self.height)), "pyramid-level")
            built = nodes.select(*keys, "_lvl", "_blk", "_node") if built is None else built.unionByName(nodes.select(*keys, "_lvl", "_blk", "_node"))
            self.height += 1
            if top is None or top // fan ** self.height == 0:
                break
            level = nodes.select(*keys, F.col("_blk").alias("_p"), *self.names)
        self.nodes = built

    def first(self, queries: DataFrame, start: Column, test: Callable[[Column], Column], name: str, until: Column | None = None) -> DataFrame:
        """Adds ``name``: the first row number at or after ``start``, not after ``until``, whose fields meet ``test``; null if none.

        ``test`` gets a struct of the fields and may read the query's columns.  On the fields of a block it must hold whenever
        it holds for one of the block's rows, as it does for bounds on one side and their disjunctions.  Where it can hold
        for a block without holding for a row (a conjunction), the search goes on behind that block."""
        d = queries.withColumn("_lvl", F.lit(0)).withColumn("_pos", start.cast("long")).withColumn("_end", (until if until is not None else F.lit(None)).cast("long"))
        d = d.withColumn(name, F.lit(None).cast("long"))
        done, waiting = None, d.filter(F.col("_pos").isNotNull())
        out = d.filter(F.col("_pos").isNull())
        while True:
            j = waiting.withColumn("_blk", F.floor(F.col("_pos") / self.fan)).join(self.nodes, [*self.keys, "_lvl", "_blk"], "left")
            at = F.get(F.filter("_node", lambda x: (x["_p"] >= F.col("_pos")) & F.coalesce(test(x), F.lit(False))), F.lit(0))["_p"]
            j = j.withColumn("_at", at).drop("_node")
            low = F.coalesce("_at", F.col("_pos"))  # nothing before it is left
            late = F.col("_end").isNotNull() & (low * F.expr(f"cast(power({self.fan}, _lvl) AS bigint)") > F.col("_end"))
            hit = F.col("_at").isNotNull() & (F.col("_lvl") == 0) & ~late
            over = hit | late | (F.col("_at").isNull() & (F.col("_lvl") == self.height - 1))
            j = j.withColumn("_over", over).withColumn(name, F.when(hit, F.col("_at")))
            down = F.col("_at").isNotNull()
            j = j.withColumn("_pos", F.when(down, F.col("_at") * self.fan).otherwise(F.col("_blk") + 1)).withColumn("_lvl", F.when(down, F.col("_lvl") - 1).otherwise(F.col("_lvl") + 1))
            j = materialize(j.drop("_blk", "_at"), "pyramid-search")
            done = j.filter("_over") if done is None else done.unionByName(j.filter("_over"))
            waiting = j.filter("NOT _over").drop("_over")
            if waiting.isEmpty():
                break
        return done.drop("_over").unionByName(out).select(*queries.columns, name)

    def extremes(self, queries: DataFrame, start: Column, stop: Column, names: dict[str, str]) -> DataFrame:
        """Adds the extremes of the rows from ``start`` up to, not including, ``stop``: ``names`` maps a field to its column."""
        d = queries.withColumn("_from", start.cast("long")).withColumn("_to", stop.cast("long"))
        for n, out in names.items():
            d = d.withColumn(out, F.lit(None).cast(self.kinds[n]))
        for level in range(self.height):
            nodes = self.nodes.filter(F.col("_lvl") == level).drop("_lvl")
            some = F.col("_from") < F.col("_to")
            first, last = F.floor(F.col("_from") / self.fan), F.floor(F.col("_to") / self.fan)
            d = d.withColumn("_l", F.when(some, first)).withColumn("_r", F.when(some & (last > first) & (F.col("_to") % self.fan > 0), last))
            for side in ("_l", "_r"):
                d = d.join(nodes.withColumnRenamed("_blk", side), [*self.keys, side], "left")
                inside = F.filter("_node", lambda x: (x["_p"] >= F.col("_from")) & (x["_p"] < F.col("_to")))
                d = d.withColumn("_node", inside)
                for n, out in names.items():
                    _, two, many = self.pick[n]
                    d = d.withColumn(out, two(F.col(out), many(F.col(f"_node.{n}"))))
                d = d.drop("_node")
            # whole blocks between the two are left to the next level
            d = d.withColumn("_from", F.when(some, first + 1)).withColumn("_to", F.when(some, last)).drop("_l", "_r")
        return d.select(*queries.columns, *names.values())
