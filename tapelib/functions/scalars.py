"""Column expressions: rounding, print classification, premium conventions, sizing."""

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c, digits: int = 0) -> Column:
    """Round half towards +infinity at ``digits`` places."""
    scale = float(10 ** digits)
    return F.floor(col(c) * scale + 0.5) / scale


def to_fixed(c, digits: int) -> Column:
    """Round on the exact decimal value of the double (used for days to expiry)."""
    return F.round(col(c), digits)


def clamp(c, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def sanitize(c) -> Column:
    c = col(c)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))


def ms(c) -> Column:
    return F.unix_millis(col(c))


def near_ms(c) -> Column:
    """The nearest millisecond, half a millisecond up: the clock of a feed that stamps its quotes in milliseconds."""
    return F.floor((F.unix_micros(col(c)) + 500) / 1000)


def from_ms(c) -> Column:
    return F.timestamp_millis(col(c))


def is_synthetic(high="high", low="low") -> Column:
    """A bar without a range of its own, as made from a single close."""
    return col(high) == col(low)


def finite(c) -> Column:
    """NULL instead of NaN or infinity."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a, b) -> Column:
    return F.try_divide(col(a), col(b))


# -- prints ---------------------------------------------------------------------------------------

def option_type(c) -> Column:
    letter = F.substring(F.upper(F.trim(col(c))), 1, 1)
    return F.when(letter == "C", "CALL").when(letter == "P", "PUT")


def aggressor(c) -> Column:
    v = F.upper(F.trim(col(c)))
    return (F.when(v.isin("BUY", "LONG", "B"), "BUY").when(v.isin("SELL", "SHORT", "S"), "SELL")
            .otherwise("UNKNOWN"))


def expiry_bucket(dte) -> Column:
    return F.when(col(dte) <= 1, "DAILY").when(col(dte) <= 7, "WEEKLY").otherwise("MONTHLY")


def flow_class(kind="option_type", side="aggressor_side") -> Column:
    k, s = col(kind), col(side)
    return F.when(s == "BUY", F.when(k == "CALL", "LC").otherwise("LP")).when(
        s == "SELL", F.when(k == "CALL", "SC").otherwise("SP")).otherwise("UNKNOWN")


def is_bull(c="flow_class") -> Column:
    return col(c).isin("LC", "SP")


def is_bear(c="flow_class") -> Column:
    return col(c).isin("LP", "SC")


def position_sign(c="flow_class") -> Column:
    return F.when(col(c).isin("LC", "LP"), 1.0).when(col(c).isin("SC", "SP"), -1.0).otherwise(0.0)


def infer_aggressor(price, bid, ask, prev, eps: float = 1e-8) -> Column:
    """Quote rule first, then the tick rule against the previous print."""
    p, b, a, q = col(price), col(bid), col(ask), col(prev)
    mid = (b + a) / 2
    quoted = (F.when(p >= a - eps, "BUY").when(p <= b + eps, "SELL")
              .when(p > mid + eps, "BUY").when(p < mid - eps, "SELL"))
    tick = F.when(p > q + eps, "BUY").when(p < q - eps, "SELL")
    return F.coalesce(F.when(a >= b, quoted), tick, F.lit("UNKNOWN"))


def premium_usd(price, contracts, multiplier) -> Column:
    return col(price) * col(contracts) * multiplier


def premium_usd_in_underlying(price, contracts, index_price) -> Column:
    return col(price) * col(index_price) * col(contracts)


def notional_usd(contracts, underlying, multiplier) -> Column:
    return col(contracts) * col(underlying) * multiplier


def delta_adjusted_notional(contracts, underlying, delta, multiplier) -> Column:
    return notional_usd(contracts, underlying, multiplier) * F.abs(col(delta))


def dte(now, expiration) -> Column:
    return (ms(expiration) - ms(now)) / 86_400_000.0


def expiry_weight(c) -> Column:
    c = col(c)
    return (F.when(c <= 0.25, 1.5).when(c <= 1, 1.3).when(c <= 3, 1.15).when(c <= 7, 1.0).otherwise(0.8))


def signed_contracts(side="aggressor_side", contracts="contracts") -> Column:
    return F.when(col(side) == "BUY", col(contracts)).when(col(side) == "SELL", -col(contracts)).otherwise(0.0)


def content(*cols) -> Column:
    return F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols])


def content_hash(*cols) -> Column:
    """Id of a print's content; equal content gives an equal id."""
    return F.sha2(content(*cols), 256)


def lots_for_risk(risk_usd, stop_distance, contract_size: float, step: float, min_lot: float) -> Column:
    raw = col(risk_usd) / (col(stop_distance) * contract_size)
    return F.greatest(F.floor(raw / step) * step, F.lit(min_lot))


# -- bars -----------------------------------------------------------------------------------------

def hlc3() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def price_source(name: str) -> Column:
    return hlc3() if name == "hlc3" else F.col(name)


def sane_bar() -> Column:
    return (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high"))


# -- draws ----------------------------------------------------------------------------------------

def draw(seed, *parts) -> Column:
    """Reproducible uniform in [0, 1) from a seed and identifying columns."""
    h = F.xxhash64(col(seed) if isinstance(seed, (str, Column)) else F.lit(seed), *[col(p) for p in parts])
    return F.pmod(h, F.lit(1 << 53)) / float(1 << 53)
