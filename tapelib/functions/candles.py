"""Candle shapes.  ``p1``/``p2`` are structs of the previous one and two bars."""

from pyspark.sql import Column, functions as F


def _b(s: str, f: str) -> Column:
    return F.col(f"{s}.{f}") if s else F.col(f)


def body(s: str = "") -> Column:
    return F.abs(_b(s, "close") - _b(s, "open"))


def span(s: str = "") -> Column:
    return _b(s, "high") - _b(s, "low")


def upper_shadow(s: str = "") -> Column:
    return _b(s, "high") - F.greatest(_b(s, "close"), _b(s, "open"))


def lower_shadow(s: str = "") -> Column:
    return F.least(_b(s, "close"), _b(s, "open")) - _b(s, "low")


def doji(max_body: float, min_range, s: str = "") -> Column:
    return (span(s) >= min_range) & (body(s) <= max_body * span(s))


def marubozu(max_shadow: float) -> Column:
    """+1 / -1 / 0."""
    r = span()
    ok = ((r > 0) & (F.try_divide(body(), r) >= 1.0 - 2.0 * max_shadow)
          & (F.try_divide(upper_shadow(), r) <= max_shadow) & (F.try_divide(lower_shadow(), r) <= max_shadow))
    c, o = F.col("close"), F.col("open")
    return F.when(ok & (c > o), 1).when(ok & (c < o), -1).otherwise(0)


def outside_bar(p: str = "p1") -> Column:
    c, o = F.col("close"), F.col("open")
    wide = (F.col("high") > _b(p, "high")) & (F.col("low") < _b(p, "low"))
    up = (c > o) & (c > F.least(_b(p, "high"), F.greatest(_b(p, "close"), _b(p, "open"))))
    down = (c < o) & (c < F.greatest(_b(p, "low"), F.least(_b(p, "close"), _b(p, "open"))))
    return F.when(wide & up, 1).when(wide & down, -1).otherwise(0)


def star(small_body: float, first: str = "p2", middle: str = "p1") -> Column:
    """Morning (+1) / evening (-1) star, doji centre included."""
    c, o = F.col("close"), F.col("open")
    fo, fc = _b(first, "open"), _b(first, "close")
    mid = (fo + fc) / 2.0
    ok = ((span(first) > 0) & (span(middle) > 0) & (span() > 0)
          & (F.try_divide(body(middle), span(middle)) <= small_body)
          & (F.try_divide(body(first), span(first)) >= small_body)
          & (F.try_divide(body(), span()) >= small_body))
    up = (fc < fo) & (_b(middle, "high") < F.greatest(fc, fo)) & (c > o) & (c > mid)
    down = (fc > fo) & (_b(middle, "low") > F.least(fc, fo)) & (c < o) & (c < mid)
    return F.when(ok & up, 1).when(ok & down, -1).otherwise(0)


def reversal(small_body: float, max_shadow: float) -> Column:
    """First matching shape: star, then outside bar, then marubozu."""
    s, ob, m = star(small_body), outside_bar(), marubozu(max_shadow)
    return F.when(F.col("p2").isNotNull() & (s != 0), s).when(
        F.col("p1").isNotNull() & (ob != 0), ob).otherwise(m)
