"""Fixed table schemas.  Tables are never read with inferred types."""

from pyspark.sql import DataFrame, types as T


def _fields(ddl: str) -> T.StructType:
    out = T.StructType()
    for part in ddl.split(","):
        name, kind = part.split()
        out.add(name, {"string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
                       "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType()}[kind])
    return out


PRINTS = _fields(
    "id string, timestamp timestamp, symbol string, instrument string, underlying string, expiration timestamp, "
    "dte double, strike double, option_type string, trade_price double, contracts double, bid double, ask double, "
    "aggressor_side string, flow_class string, premium_usd double, underlying_price double, exchange string, "
    "sequence_id string, implied_volatility double, flag_block boolean, flag_sweep boolean, "
    "flag_multi_leg boolean, flag_spread boolean, source string")
BARS = _fields("series string, time timestamp, open double, high double, low double, close double, volume double")
CALENDAR = _fields("time timestamp, currency string, name string, impact int, source string")
QUOTES = _fields("series string, time timestamp, bid double, ask double")
OUTCOMES = _fields(
    "series string, cell string, side int, entry_time timestamp, entry_price double, stop double, target double, "
    "exit_time timestamp, exit_price double, exit_kind string, pnl double, r double, mae double, mfe double")


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` by name and fail when one is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema}
    bad = [f"{f.name}: {have.get(f.name)} != {f.dataType}" for f in schema if have.get(f.name) != f.dataType]
    if bad:
        raise ValueError("schema mismatch: " + "; ".join(bad))
    return df.select(*[f.name for f in schema])
