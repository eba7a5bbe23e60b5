"""Quotes between two milliseconds and files in many pieces: the queries beside their SQL."""

import os

import duckdb
import pytest
from compare import TABLES, compare, duck

import __spark_entry__ as entry
from pyspark.sql import functions as F
from tapelib.operators import stats


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """20,000 quotes, one a second: some lie 300 us before a ten-minute border or a tolerance, some 400 us after an hour, some in one
    millisecond with the quote before and with a smaller id.  Two series take turns, so that both have holes."""
    d = str(tmp_path_factory.mktemp("odd"))
    for t in set(TABLES.split()) - {"events"}:
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{d}/{t}.parquet")
    duckdb.connect().execute(f"""copy (select case when i % 7 = 3 then i - 1 when i % 7 = 2 then i + 1 else i end as event_id,
        timestamp '2024-01-02' + to_microseconds(case when i % 7 = 3 and i % 600 <> 1 then (i - 1) * 1000000 + 200 else i * 1000000 + case when i % 1200 = 0 then 400 when i % 600 = 0 or i % 3600 = 2700 then -300 else 0 end end) as ts,
        i * 31 % 97 as user_id, case when i // 200 % 2 = 0 then 'click' else 'view' end as event_type, (i * 7919 % 101)::double + 0.25 as value, '{{}}' as props
        from (select unnest(range(20000)) as i) order by hash(i)) to '{d}/events.parquet' (format parquet, row_group_size 2048)""")
    return d


@pytest.mark.parametrize("name", ["asof_forward", "asof_forward_tolerance", "dedupe_bars_last_wins", "quote_minutes", "stream_minute_bars",
                                  "stream_live_minutes", "stream_repair_ranges", "stream_forming_minutes"])
def test_queries_on_odd_quotes(spark, odd, name):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        err, n = compare(spark, duck(odd), odd, entry.queries()[name], entry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert err is None and n > 0, err


def test_two_outcomes_have_a_clustered_t(spark):
    d = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("b", 1, 2.0), ("b", 1, 2.0)], "series string, day int, r double")
    got = {r.series: (r.n, r.mean, r.t) for r in stats.cluster_t(d, ["series"], "r", F.col("day")).collect()}
    assert got["a"][:2] == (2, 2.0) and abs(got["a"][2] - 2 / (2 ** 0.5 / 2)) < 1e-12
    assert got["b"] == (2, 2.0, None)
