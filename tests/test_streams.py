"""Streams fed by several unordered files in several batches."""

import pandas as pd

from tapelib.streaming import live_minutes, streams


def test_minute_bars_of_unordered_files_lose_nothing(spark, tmp_path):
    """20,000 ticks of one series and a few of another, shuffled over 6 files that arrive one by one, equal a fold in order."""
    n = 20_000
    ms = [1_700_000_000_000 + 37 * i for i in range(n)]
    bid = [100 + (i // 3 * 7919 % 101) / 10 for i in range(n)]  # runs of three equal quotes
    t = pd.DataFrame({"series": "a", "event_id": range(n), "ms": ms, "bid": bid, "ask": [b + 0.1 for b in bid]})
    t = pd.concat([t, pd.DataFrame({"series": "b", "event_id": [n, n + 1], "ms": ms[:1] * 2, "bid": [1.0, float("nan")], "ask": [1.5, 2.0]})])
    shuffled = t.sample(frac=1, random_state=4)
    src = tmp_path / "src"
    src.mkdir()
    for k in range(6):
        part = shuffled.iloc[k::6].assign(time=lambda d: pd.to_datetime(d.ms, unit="ms")).drop(columns="ms")
        part["time"] = part["time"].astype("datetime64[us]")
        part.to_parquet(src / f"{k}.parquet", index=False)
    quotes = spark.readStream.schema("series string, event_id long, bid double, ask double, time timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    root = str(tmp_path / "minutes")
    streams.collect_minutes(quotes, root, root + "-state").awaitTermination()
    got = {(r.series, int(r.time.timestamp() * 1000)): r for r in streams.minute_bars(spark, root).collect()}
    want, last = {}, {}
    for r in t[t.bid == t.bid].sort_values(["ms", "event_id"]).itertuples():
        if last.get(r.series) == (r.bid, r.ask):
            continue
        last[r.series] = (r.bid, r.ask)
        want.setdefault((r.series, r.ms // 60_000 * 60_000), []).append((r.bid + r.ask) / 2)
    assert set(got) == set(want)
    for k, mids in want.items():
        r = got[k]
        assert (r.open, r.high, r.low, r.close, r.ticks) == (mids[0], max(mids), min(mids), mids[-1], len(mids)), k
    assert sum(r.ticks + r.repeated for k, r in got.items() if k[0] == "a") == n
    assert sum(r.dropped for k, r in got.items() if k[0] == "b") == 1


def test_late_prints_are_kept_once(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for k, day in enumerate(("2024-02-01", "2024-01-01", "2024-02-01")):  # the second file is a month late, the third a repeat
        spark.createDataFrame([(f"i{day}", f"{day} 10:00:00", float(k))], "id string, t string, value double").selectExpr("id", "cast(t as timestamp) timestamp", "value").coalesce(1).write.mode("append").parquet(str(src))
    prints = spark.readStream.schema("id string, timestamp timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(src))
    root = str(tmp_path / "store")
    streams.collect_prints(prints, root, root + "-state", None).awaitTermination()
    got = streams.collected_prints(spark, root, "id string, timestamp timestamp, value double, date date").collect()
    assert sorted(r.id for r in got) == ["i2024-01-01", "i2024-02-01"]


QUOTES = "series string, event_id long, bid double, ask double, time timestamp"


def _quote_files(spark, tmp_path, batches):
    src = tmp_path / "quotes"
    src.mkdir()
    for k, rows in enumerate(batches):
        d = pd.DataFrame(rows, columns=["series", "event_id", "bid", "ask", "ms"])
        d["time"] = pd.to_datetime(d.pop("ms"), unit="ms").astype("datetime64[us]")
        d.astype({"bid": float, "ask": float}).to_parquet(src / f"{k:02}.parquet", index=False)
    return spark.readStream.schema(QUOTES).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))


def _two_series(batches=10, minutes=3, per_minute=20):
    """A fast series ten minutes ahead of a slow one; in later batches some quotes are older than ones before, bad or repeated,
    and the slow series skips five minutes once."""
    out, n, t0 = [], 0, 1_700_000_040_000 // 60_000 * 60_000
    for b in range(batches):
        rows = []
        for series, ahead in (("fast", 600_000), ("slow", 0)):
            skip = 300_000 if series == "slow" and b >= 6 else 0
            for i in range(minutes * per_minute):
                ms = t0 + ahead + skip + (b * minutes * per_minute + i) * 3_000
                bid = 100 + (n * 7919 % 97) / 8
                rows.append((series, n, bid, bid + 0.25, ms))
                n += 1
            if b in (3, 5):
                rows.append((series, n, 1.0, 2.0, rows[-1][4] - 600_000))  # late against the batches before
                rows.append((series, n + 1, float("nan"), 2.0, rows[-2][4]))
                rows.append((series, n + 2, rows[-3][2], rows[-3][3], rows[-3][4] + 500))  # the last quote once more
                n += 3
        out.append(rows)
    return out


def _fold(batches):
    """One pass over the quotes, batch by batch, each in order of time."""
    state, closed, gaps = {}, {}, []
    for rows in batches:
        for series, seq, bid, ask, ms in sorted(rows, key=lambda r: (r[4], r[1])):
            s = state.setdefault(series, {"last": None, "bar": None, "late": 0, "bad": 0, "repeated": 0})
            if bid != bid or ask != ask:
                s["bad"] += 1
            elif s["last"] and ms < s["last"][0]:
                s["late"] += 1
            elif s["last"] and s["last"][1:] == (bid, ask):
                s["repeated"] += 1
            else:
                s["last"], minute, mid = (ms, bid, ask), ms // 60_000 * 60_000, (bid + ask) / 2
                if s["bar"] and s["bar"][0] != minute:
                    closed[series, s["bar"][0]] = s["bar"][1]
                    if minute - s["bar"][0] > 120_000:
                        gaps.append((series, s["bar"][0], minute))
                    s["bar"] = None
                s["bar"] = s["bar"] or (minute, [])
                s["bar"][1].append((mid, ask - bid))
    return state, closed, gaps


def test_live_minutes_equal_a_fold(spark, tmp_path):
    """Ten batches of two series ten minutes apart: no quote of the slow one is lost, late ones are counted, a hole is told once."""
    batches = _two_series()
    root = str(tmp_path / "live")
    live_minutes.collect_live_minutes(_quote_files(spark, tmp_path, batches), root, root + "-state").awaitTermination()
    state, closed, gaps = _fold(batches)
    got = live_minutes.closed_minutes(spark, root).collect()
    assert len(got) == len(closed) and len(closed) > 50
    for r in got:
        bar = closed[r.series, int(r.time.timestamp() * 1000)]
        mids = [m for m, _ in bar]
        assert (r.open, r.high, r.low, r.close, r.ticks) == (mids[0], max(mids), min(mids), mids[-1], len(mids))
        assert abs(r.spread - sum(x for _, x in bar) / len(bar)) < 1e-12
    ms = lambda t: int(t.timestamp() * 1000)
    assert sorted((r.series, ms(r.after), ms(r.before)) for r in live_minutes.repair_ranges(spark, root).collect()) == sorted(gaps) and gaps
    for r in live_minutes.forming_minutes(spark, root).collect():
        s = state[r.series]
        assert (r.late, r.bad, r.repeated, r.minute, r.ticks, r.last_ms) == (s["late"], s["bad"], s["repeated"], s["bar"][0], len(s["bar"][1]), s["last"][0])
        assert r.late == 2 and r.bad == 2 and r.repeated >= 2
    assert live_minutes.closed_minutes(spark, root, newest=5).count() == 10


def test_collected_minutes_lose_no_late_quote(spark, tmp_path):
    """The same batches through the store: late quotes are folded in where they belong."""
    batches = _two_series()
    root = str(tmp_path / "minutes")
    streams.collect_minutes(_quote_files(spark, tmp_path, batches), root, root + "-state").awaitTermination()
    _, closed, _ = _fold([[r for rows in batches for r in rows]])
    got = {(r.series, int(r.time.timestamp() * 1000)): r for r in streams.minute_bars(spark, root).collect()}
    assert set(closed) <= set(got) and len(got) == len(closed) + 2  # and the two forming minutes
    for k, bar in closed.items():
        mids = [m for m, _ in bar]
        assert (got[k].open, got[k].high, got[k].low, got[k].close, got[k].ticks) == (mids[0], max(mids), min(mids), mids[-1], len(mids)), k


def test_ids_seen_long_ago_are_not_stored_again(spark, tmp_path):
    """An id comes again three months later, and twice with other values in one batch: the first row of each id stays."""
    src = tmp_path / "src"
    src.mkdir()
    batches = [[("a", "2024-01-01 10:00:00", 1.0), ("b", "2024-01-01 11:00:00", 2.0)], [("a", "2024-04-01 10:00:00", 3.0), ("c", "2024-04-01 09:00:00", 5.0), ("c", "2024-04-01 08:00:00", 4.0)], [("b", "2024-04-02 10:00:00", 6.0)]]
    for rows in batches:
        spark.createDataFrame(rows, "id string, t string, value double").selectExpr("id", "cast(t as timestamp) timestamp", "value").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("id string, timestamp timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(src))
    root = str(tmp_path / "store")
    for k in range(2):  # the second run reads everything once more
        streams.append_unseen(stream, root, f"{root}-state{k}").awaitTermination()
    got = spark.read.schema("id string, timestamp timestamp, value double, date date").parquet(root).collect()
    assert sorted((r.id, r.value) for r in got) == [("a", 1.0), ("b", 2.0), ("c", 4.0)]
