"""Exact dedup: group by a 128-bit content hash, keep one id, and compare bytes inside groups to exclude collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelib.llm.store import stored

#: Members of one hash group that are compared with one copy of the representative's text in one join key.
GROUP_SHARE = 256


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None, digest=F.md5) -> DataFrame:
    """One row per distinct (id, text): ``id, digest, sha256, copies, keep_id, group_size``.

    ``keep`` is ``min`` or ``max`` of the ids of equal texts; ``normalise`` is a Column -> Column function applied before
    hashing and comparing.  ``copies`` counts rows repeated with the same id and text; they count in ``group_size``.

    Null texts count as empty; a null id takes part like any other, but represents only a group without other ids; the
    same id with two texts is two rows; other columns are not looked at.  An empty table gives an empty result.

    Plan: only (id, hash) rows are grouped.  Texts move once, by id, and only members of groups of two and more go on to
    the byte comparison, where a group of n rows is dealt over n / 256 join keys, each with its own copy of the
    representative; a group with a third of all rows is spread like any other.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    docs = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    rows = stored(docs.groupBy("id", "digest", F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies")), "exact-rows")
    sums = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("members"), F.sum("copies").alias("group_size"), pick("id").alias("keep_id"))
    placed = stored(rows.join(stored(sums, "exact-sums"), "digest"), "exact-placed")  # two plain exchanges: a hot digest can be split
    texts = stored(_member_texts(docs, placed), "exact-members")
    heads = texts.filter(F.col("id").eqNullSafe(F.col("keep_id"))).select("digest", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("text").alias("head"))
    heads = heads.groupBy("digest", "share").agg(F.max("head").alias("head"))
    odd = stored(texts.join(heads, ["digest", "share"]).filter(F.col("text") != F.col("head")).select("id", "digest", "text").distinct(), "exact-collisions")
    out = placed if odd.isEmpty() else _without_collisions(placed, odd, pick)
    return out.select("id", "digest", "sha256", "copies", "keep_id", "group_size")


def _member_texts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Texts of members of groups of two and more, with the share of the group that each is compared in."""
    shares = F.ceil(F.col("members") / GROUP_SHARE).cast("int")
    wanted = placed.filter("members > 1").select(F.col("id").alias("m_id"), F.col("digest").alias("m_digest"), "keep_id", shares.alias("shares")).distinct().hint("shuffle_hash")
    found = docs.join(wanted, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")))
    return found.select("id", "digest", "keep_id", "shares", F.pmod(F.xxhash64("id"), "shares").cast("int").alias("share"), "text")


def _without_collisions(placed: DataFrame, odd: DataFrame, pick) -> DataFrame:
    """``placed`` after the rows of ``odd``, equal in hash but not in bytes, became groups of their own by whole text."""
    apart = odd.withColumn("sha256", F.sha2("text", 256)).join(placed.select("id", "digest", "sha256", "copies"), ["id", "digest", "sha256"])
    own = apart.groupBy("digest", "text").agg(F.sum("copies").alias("group_size"), pick("id").alias("keep_id"))
    fixed = apart.join(own, ["digest", "text"]).drop("text")
    rest = placed.join(fixed, ["digest", "sha256"], "left_anti")
    sums = rest.groupBy("digest").agg(F.sum("copies").alias("group_size"), pick("id").alias("keep_id"))
    return rest.drop("group_size", "keep_id").join(sums, "digest").select(fixed.columns).unionByName(fixed)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None) -> DataFrame:
    """The rows of ``df``, all columns, that stay: one of each group of equal texts (see :func:`exact_groups`).

    Rows repeated with the same id and text stay once.  Only rows that may be repeated are dealt by id again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    groups = exact_groups(df, id_col, text_col, keep, normalise)
    stay = groups.filter(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("copies").alias("__copies")).hint("shuffle_hash")
    kept = df.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (F.md5(text) == F.col("__digest")))
    once = kept.filter("__copies > 1").dropDuplicates(["__id", "__digest"])
    return kept.filter("__copies = 1").unionByName(once).drop("__id", "__digest", "__copies")


