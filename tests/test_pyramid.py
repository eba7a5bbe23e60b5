"""Searches and extremes of the pyramid against a scan, over several levels and with gaps in the numbering."""

import random

from pyspark.sql import functions as F

from tapelib.plans.pyramid import Pyramid


def series(n, seed):
    rnd = random.Random(seed)
    out, px = [], 100.0
    for i in range(n):
        px += rnd.gauss(0, 1)
        out.append((i, px + rnd.random() * 2, px - rnd.random() * 2))
    return out


def test_first_and_extremes_equal_a_scan(spark):
    rows, queries, rnd = {"a": series(700, 1), "b": series(65, 2), "c": [r for r in series(900, 3) if r[0] % 7]}, [], random.Random(4)
    for key, mine in rows.items():
        for _ in range(60):
            start = rnd.randrange(0, mine[-1][0] + 5)
            queries.append((key, len(queries), start, rnd.gauss(100, 25), rnd.gauss(100, 25), rnd.choice([None, start + rnd.randrange(0, 400)]), start + rnd.randrange(-3, 500)))
    d = spark.createDataFrame([(k, *r) for k, mine in rows.items() for r in mine], "k string, idx long, high double, low double")
    q = spark.createDataFrame(queries, "k string, id int, start long, above double, below double, last long, stop long")
    tower = Pyramid(d, ["k"], {"top": ("high", "max"), "low": ("low", "min")}, fan=4)
    assert tower.height >= 5
    either = tower.first(q, F.col("start"), lambda x: (x["top"] >= F.col("above")) | (x["low"] <= F.col("below")), "hit", until=F.col("last"))
    # a band that must be overlapped: blocks can overlap it where none of their rows does
    band = tower.first(either, F.col("start"), lambda x: (x["top"] >= F.col("above")) & (x["low"] <= F.col("above") + 0.05), "inside")
    got = {r.id: r for r in tower.extremes(band, F.col("start"), F.col("stop"), {"top": "most", "low": "least"}).collect()}
    assert len(got) == len(queries)
    for key, i, start, above, below, last, stop in queries:
        later = [r for r in rows[key] if r[0] >= start]
        hit = next((r[0] for r in later if (last is None or r[0] <= last) and (r[1] >= above or r[2] <= below)), None)
        inside = next((r[0] for r in later if r[1] >= above and r[2] <= above + 0.05), None)
        span = [r for r in later if r[0] < stop]
        assert (got[i].hit, got[i].inside) == (hit, inside)
        assert (got[i].most, got[i].least) == (max((r[1] for r in span), default=None), min((r[2] for r in span), default=None))


def test_an_empty_table_has_no_match(spark):
    d = spark.createDataFrame([], "k string, idx long, v double")
    q = spark.createDataFrame([("a", 0)], "k string, start long")
    tower = Pyramid(d, ["k"], {"v": ("v", "max")})
    assert [r.hit for r in tower.first(q, F.col("start"), lambda x: x["v"] > 0, "hit").collect()] == [None]
