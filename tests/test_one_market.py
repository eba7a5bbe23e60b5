"""One market may be the whole tape: its prints stay where they are, and only the newest days are ranked."""

from pyspark.sql import functions as F

from tapelib.operators import flow, timeline
from tapelib.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prints_are_not_shuffled_by_market(spark, sf):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = tables.stored_prints(spark, sf)
        state = flow.market_state(p)
        for d in (timeline.with_steps(p, 86_400_000), flow.summary_at(p, 86_400_000, state), flow.big_prints(p, ["market"], limited=False)):
            assert "SortMergeJoin" not in _plan(d)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_only_the_newest_days_are_ranked(spark):
    """The newest rows equal a full ranking, also where a key has fewer than are wanted, and where days are torn."""
    d = spark.range(3000).select(F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("k"), F.timestamp_seconds(F.col("id") * 4001).alias("timestamp"), F.format_string("%05d", "id").alias("sequence_id"))
    got = flow.newest(d, ["k"], 50)
    for k in "ab":
        want = sorted(r.sequence_id for r in d.collect() if r.k == k)[-50:]
        assert [r.sequence_id for r in got.filter(F.col("k") == k).orderBy("newest_rank").collect()] == want[::-1]
    assert "_since" in _plan(got)  # the days go before the ranking
