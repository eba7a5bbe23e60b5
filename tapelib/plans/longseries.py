"""Exact row recurrences and row frames over series too long for one task.

A window over ``partitionBy(series)`` puts a whole series into one task, and one series may hold a third of
all rows.  Every helper here works on (series, block) instead, where a block is a run of ``BLOCK``
consecutive rows, so a task's group is bounded whatever the keys look like:

``with_index``  numbers the rows of each series from counts per time bucket;
``blocked``     evaluates bounded look-back / look-ahead frames after copying the few rows a block needs
                from its neighbours;
``carry``       unbounded running aggregates (block summaries, then a window over the block table);
``scan``        first-order smoothing (EMA / Wilder) from block-local weighted sums and composed carries;
``fsm``         state machines that do not compose: blocks run speculatively and only blocks whose incoming
                state changed run again, until nothing changes.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

BLOCK = 4096
SCAN_BLOCK = 512


# -- materialisation ------------------------------------------------------------------------------

def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.  Where that is unset, a local session gets a folder of its own and a
    cluster is refused: its executors would write to disks that others cannot read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write once to shared storage and read back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# -- row numbers ----------------------------------------------------------------------------------

def with_index(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str = "idx") -> DataFrame:
    """0-based row number per key in ``order``.  ``bucket`` is a coarse monotone function of the order
    (rows per key and bucket must be bounded, e.g. a fixed number of bar steps)."""
    d = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, "_bkt", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy(*keys, "_bkt").orderBy(*order))
    return (d.withColumn("_rn", rn).join(offsets, [*keys, "_bkt"])
            .withColumn(name, F.col("_off") + F.col("_rn") - 1).drop("_bkt", "_rn", "_off"))


# -- bounded frames -------------------------------------------------------------------------------

class Frame:
    """Window builders for one block."""

    def __init__(self, keys: list[str], idx: str):
        self.w = Window.partitionBy(*keys, "_blk").orderBy(idx)

    def rows(self, a: int, b: int):
        return self.w.rowsBetween(a, b)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(c, n).over(self.w)

    def full(self, agg: Column, c, a: int, b: int) -> Column:
        """``agg`` over rows a..b, NULL unless every row of the frame is present and ``c`` is not null."""
        return F.when(F.count(c).over(self.rows(a, b)) == b - a + 1, agg.over(self.rows(a, b)))


def _spread(df: DataFrame, idx: str, size: int, back: int, ahead: int) -> DataFrame:
    i = F.col(idx)
    own, pos = F.floor(i / size), F.pmod(i, F.lit(size))
    blocks = [own]
    if back:
        blocks.append(F.when(pos >= size - back, own + 1))
    if ahead:
        blocks.append(F.when((pos < ahead) & (own > 0), own - 1))
    if len(blocks) == 1:
        return df.withColumn("_blk", own)
    return df.withColumn("_blk", F.explode(F.array_compact(F.array(*blocks))))


def blocked(df: DataFrame, keys: list[str], fn, back: int = 0, ahead: int = 0, idx: str = "idx",
            size: int | None = None) -> DataFrame:
    """Run ``fn(df, Frame)`` with exact frames reaching ``back`` rows behind and ``ahead`` rows in front."""
    size = size or max(BLOCK, back, ahead)
    if max(back, ahead) > size:
        raise ValueError("frame longer than a block")
    out = fn(_spread(df, idx, size, back, ahead), Frame(keys, idx))
    return out.filter(F.floor(F.col(idx) / size) == F.col("_blk")).drop("_blk")


# -- unbounded running aggregates -----------------------------------------------------------------

def carry(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, str]], forward: bool = True,
          inclusive: bool = True, idx: str = "idx", size: int = BLOCK) -> DataFrame:
    """Running aggregates over all earlier rows (``forward``) or all later rows of a key.

    ``specs`` maps an output name to (kind, column), kind in last / sum / max / min.  ``last`` is the
    nearest non-null value."""
    d = df.withColumn("_blk", F.floor(F.col(idx) / size))
    w = Window.partitionBy(*keys, "_blk").orderBy(F.col(idx) if forward else F.col(idx).desc())
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    wb = (Window.partitionBy(*keys).orderBy(F.col("_blk") if forward else F.col("_blk").desc())
          .rowsBetween(Window.unboundedPreceding, -1))

    def over(kind, c, frame):
        agg = {"last": lambda: F.last(c, ignorenulls=True), "sum": lambda: F.sum(c),
               "max": lambda: F.max(c), "min": lambda: F.min(c)}[kind]()
        return agg.over(frame)

    def total(kind, c):
        if kind == "last":
            pick = F.max_by if forward else F.min_by
            return pick(c, F.when(F.col(c).isNotNull(), F.col(idx)))
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](c)

    blocks = d.groupBy(*keys, "_blk").agg(*[total(k, c).alias(f"_t_{o}") for o, (k, c) in specs.items()])
    before = blocks.select(*keys, "_blk", *[over(k, f"_t_{o}", wb).alias(f"_c_{o}") for o, (k, _) in specs.items()])
    local = d.select("*", *[over(k, c, frame).alias(f"_l_{o}") for o, (k, c) in specs.items()])
    joined = local.join(before, [*keys, "_blk"])

    def combine(kind, o):
        a, b = F.col(f"_l_{o}"), F.col(f"_c_{o}")
        if kind == "last":
            return F.coalesce(a, b)
        if kind == "sum":
            return F.coalesce(a + b, a, b)
        return F.greatest(a, b) if kind == "max" else F.least(a, b)

    return joined.select(*df.columns, *[combine(k, o).alias(o) for o, (k, _) in specs.items()])


# -- smoothing ------------------------------------------------------------------------------------

def scan(df: DataFrame, keys: list[str], specs: list[tuple[str, str, str, int]], prepare=None,
         prepare_back: int = 0, lead: int | dict | None = 0, idx: str = "idx") -> DataFrame:
    """EMA (``ema``) and Wilder (``rma``) smoothing of columns, seeded with the mean of the first n values.

    ``specs`` holds (output, input column, kind, n).  ``lead`` is the number of leading rows of each key on
    which the inputs are NULL: a number, a dict per input, or None when it depends on the data (inputs may
    only be NULL at the start of a key).  ``prepare(df, Frame)`` may add input columns from frames reaching
    ``prepare_back`` rows back.

    Inside a block of S rows, y_p = q^p * sum(b_j q^-j) + q^(p+1) * y(previous block), so one window per
    block and a carry per block suffice.  Carries are composed over full blocks; terms of weight below
    1e-20 are not representable next to the result and are left out."""
    if not specs:
        return prepare(df, None) if prepare else df
    size = SCAN_BLOCK
    while size < max(n for _, _, _, n in specs) + prepare_back + 1:
        size *= 2
    if size > SCAN_BLOCK and min(n for _, _, _, n in specs) * 160 < size:
        # A short and a very long period do not fit one block size: run them apart.
        cut = size // 160
        short = [s for s in specs if s[3] < cut]
        long_ = [s for s in specs if s[3] >= cut]
        return scan(scan(df, keys, short, prepare, prepare_back, lead, idx), keys, long_, None, 0, lead, idx)
    back = max(n for _, _, _, n in specs) - 1 + prepare_back

    if lead is None:
        inputs = sorted({c for _, c, _, _ in specs})
        firsts = df.groupBy(*keys).agg(*[F.min(F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"_w_{c}")
                                         for c in inputs])
        df_in = df.join(firsts, keys)
        start = {c: F.col(f"_w_{c}") for c in inputs}
    else:
        df_in = df
        start = {c: F.lit(lead[c] if isinstance(lead, dict) else lead) for _, c, _, _ in specs}

    d = _spread(df_in, idx, size, back, 0)
    fr = Frame(keys, idx)
    if prepare:
        d = prepare(d, fr)
    p = F.col(idx) - F.col("_blk") * size
    d = d.withColumn("_p", p.cast("double"))
    stage, local, meta = [], [], {}
    for out, c, kind, n in specs:
        q = 1.0 - 2.0 / (n + 1.0) if kind == "ema" else (n - 1.0) / n
        m = F.col(idx) - start[c] + 1
        x = F.col(c)
        if n == 1:
            stage.append(x.alias(f"_b_{out}"))
            local.append(x.alias(f"_y_{out}"))
        else:
            seed = F.avg(x).over(fr.rows(-(n - 1), 0))
            b = F.when((F.col("_p") < 0) | x.isNull() | (m < n), 0.0).when(m == n, seed).otherwise(x * (1.0 - q))
            stage.append(b.alias(f"_b_{out}"))
            s = F.sum(F.col(f"_b_{out}") * F.pow(F.lit(q), -F.col("_p"))).over(fr.rows(Window.unboundedPreceding, 0))
            local.append((s * F.pow(F.lit(q), F.col("_p"))).alias(f"_y_{out}"))
        meta[out] = (q, n, m, x)
    d = d.select("*", *stage)
    d = d.select("*", *local).filter(F.col("_p") >= 0)

    ends = d.filter(F.col("_p") == size - 1).select(*keys, "_blk", *[f"_y_{o}" for o, *_ in specs])
    wb = Window.partitionBy(*keys).orderBy("_blk")
    carries = []
    for out, _, _, n in specs:
        q = meta[out][0]
        step = q ** size
        reach = 0 if step < 1e-20 else math.ceil(math.log(1e-20) / math.log(step))
        y = F.col(f"_y_{out}")
        for k in range(1, reach + 1):
            y = y + F.coalesce(F.lag(f"_y_{out}", k).over(wb), F.lit(0.0)) * (step ** k)
        carries.append(y.alias(f"_e_{out}"))
    ends = ends.select(*keys, (F.col("_blk") + 1).alias("_blk"), *carries)
    d = d.join(ends, [*keys, "_blk"], "left")
    outs = []
    for out, *_ in specs:
        q, n, m, x = meta[out]
        y = F.col(f"_y_{out}")
        if n > 1:
            y = y + F.coalesce(F.col(f"_e_{out}"), F.lit(0.0)) * F.pow(F.lit(q), F.col("_p") + 1)
        outs.append(F.when((m >= n) & x.isNotNull(), y).alias(out))
    tmp = {f"_{t}_{o}" for o, *_ in specs for t in ("b", "y", "e")} | {"_p", "_blk"} | {
        c for c in d.columns if c.startswith("_w_")}
    return d.select(*[c for c in d.columns if c not in tmp], *outs)


# -- state machines -------------------------------------------------------------------------------

def fsm(df: DataFrame, keys: list[str], run, init: list[float], out: T.StructType, idx: str = "idx",
        size: int = BLOCK, cols: list[str] | None = None) -> DataFrame:
    """Sequential state machine per key.

    ``run(pdf, state) -> (DataFrame of outputs, end state)`` folds a bounded run of rows sorted by ``idx``;
    a state is a list of floats.  Blocks first run from ``init`` side by side; then only blocks whose
    incoming state differs from the one used run again.  When no state changes the result equals the
    row-by-row fold of the whole key."""
    cols = cols or [c for c in df.columns if c not in keys]
    # read once per round: write the narrow input first
    data = materialize(df.select(*keys, *cols), "fsm").withColumn("_blk", F.floor(F.col(idx) / size).cast("long"))
    key_fields = [df.schema[k] for k in keys]
    state_t = T.ArrayType(T.DoubleType())
    state_schema = T.StructType([*key_fields, T.StructField("_blk", T.LongType()), T.StructField("_s0", state_t),
                                 T.StructField("_s1", state_t)])
    order = [idx]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        s0 = [float(v) for v in first["_s0"]]
        _, s1 = run(pdf.sort_values(order), list(s0))
        return pd.DataFrame([[*[first[k] for k in keys], int(first["_blk"]), s0, [float(v) for v in s1]]],
                            columns=[*keys, "_blk", "_s0", "_s1"])

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        s0 = [float(v) for v in pdf.iloc[0]["_s0"]]
        res, _ = run(pdf.sort_values(order), s0)
        for k in keys:
            res[k] = pdf.iloc[0][k]
        return res

    start = F.array(*[F.lit(float(v)) for v in init])

    def folded(d: DataFrame) -> DataFrame:
        # Arrow hands NaN inside lists back as NULL; restore it so that states compare equal.
        r = d.groupBy(*keys, "_blk").applyInPandas(fold, state_schema)
        nan = F.lit(float("nan"))
        return r.select(*keys, "_blk", *[F.transform(c, lambda x: F.coalesce(x, nan)).alias(c) for c in ("_s0", "_s1")])

    states = materialize(folded(data.withColumn("_s0", start)), "state")
    w = Window.partitionBy(*keys).orderBy("_blk")
    while True:
        wanted = states.select(*keys, "_blk", "_s0", "_s1",
                               F.coalesce(F.lag("_s1").over(w), start).alias("_in"))
        stale = wanted.filter(~F.col("_in").eqNullSafe(F.col("_s0")))
        if stale.isEmpty():
            break
        redo = folded(data.join(stale.select(*keys, "_blk", F.col("_in").alias("_s0")), [*keys, "_blk"]))
        states = materialize(states.join(stale.select(*keys, "_blk"), [*keys, "_blk"], "left_anti")
                             .unionByName(redo), "state")
    result = T.StructType([*key_fields, *out.fields])
    names = [f.name for f in result]
    return (data.join(states.select(*keys, "_blk", "_s0"), [*keys, "_blk"])
            .groupBy(*keys, "_blk").applyInPandas(lambda p: emit(p)[names], result))
