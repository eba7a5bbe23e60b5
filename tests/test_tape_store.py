"""The day store read by some columns only, and the landed JSON documents."""

from pyspark.sql import functions as F

from tapelib.catalog import store_queries
from tapelib.sources import tape


def test_read_all_by_columns_is_the_same_store(spark, tmp_path):
    d = spark.range(40).select((F.col("id") % 30).cast("string").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 9000).alias("timestamp"),
                               F.when(F.col("id") % 3 == 0, "LC").otherwise("odd").alias("flow_class"), F.col("id").cast("double").alias("contracts"))
    root = str(tmp_path / "tape")
    for _ in range(2):
        tape.append_tape(tape.conform(d), root)
    some = tape.read_all(spark, root, ["flow_class", "contracts"])
    want = sorted((r.id, r.flow_class, r.contracts) for r in tape.read_all(spark, root).collect())
    assert some.columns == ["id", "flow_class", "contracts"] and sorted(map(tuple, some.collect())) == want and len(want) == 30
    assert "premium_usd" not in some._jdf.queryExecution().executedPlan().toString()


def test_json_documents_are_compressed(spark, sf, tmp_path, monkeypatch):
    path = str(tmp_path / "documents")
    monkeypatch.setattr(store_queries, "_path", lambda *_: path)
    assert store_queries.tape_json_columns(spark, sf).count() == 25
    names = [p.name for p in (tmp_path / "documents").iterdir() if p.name.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names)
