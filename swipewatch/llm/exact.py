"""Exact duplicates: groups by a 128-bit content hash, bytes compared inside the groups, the smallest id stays.

The texts are shuffled once, as keys of a grouping by hash and bytes: tasks merge their own copies before the shuffle,
so a group of copies sends at most one text a task however large it is. A hash with more than one text behind it is a
collision; its rows are told apart by their bytes, all others by the hash alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text

SPACES = r"[\x20\x09-\x0D]+"


def normalised() -> Column:
    """The text with every run of white space as one space, a null text as the empty one."""
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")


def content_hash(body: Column) -> Column:
    return F.unhex(F.md5(body))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``(doc, tie, keep_doc, group_size, kept, sha)`` for every row of ``docs``: the id of the row that stays of the row's
    group, how many rows the group has, whether this row stays, and the SHA-256 (32 bytes) of the normalised text.

    Of a group the smallest id stays, a null id being the least; of rows with that id the one with the least text hash,
    and of rows equal in both any one. An empty table gives no rows. ``digest`` steers the grouping only: rows of one
    digest and different bytes are never put together.
    """
    body = docs.select(text.doc_id().alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"),
                       normalised().alias("body")).withColumn("hash", digest(F.col("body")))
    # the row number is written, so it is the same for every later reader
    rows = text.stored(body.select("doc", "tie", "hash", F.unhex(F.sha2("body", 256)).alias("sha"),
                                   F.monotonically_increasing_id().alias("row")), "document-digests")
    collided = text.stored(body.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("hash")
                           .agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash"), "collided-digests")
    first = F.struct(F.lit(False).alias("apart"), F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("tie"))
    if collided.isEmpty():
        rows = rows.withColumn("leader", first)
    else:
        texts = body.join(collided, "hash", "left_semi")
        leaders = texts.groupBy("hash", "body").agg(F.min(F.struct(F.lit(True).alias("apart"), "doc", "tie")).alias("leader"))
        apart = texts.select("hash", "body", "doc", "tie").distinct().join(leaders, ["hash", "body"]).drop("body")
        rows = rows.join(apart, ["hash", "doc", "tie"], "left").withColumn("leader", F.coalesce("leader", first))
    groups = text.stored(rows.groupBy("hash", "leader").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tie", "row")).alias("stays")), "exact-groups")
    return text.join_groups(rows, groups, ["hash", "leader"]).select(
        "doc", "tie", F.col("stays.doc").alias("keep_doc"), F.col("n").alias("group_size"),
        (F.col("stays.row") == F.col("row")).alias("kept"), "sha")


def keep_first(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they came, whatever their names."""
    stays = exact_groups(docs, digest).groupBy("doc", "tie").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    stays = text.stored(stays.where("kept").select("doc", "tie", "n"), "kept-rows")
    packed = docs.select(F.struct("*").alias("row"), text.doc_id().alias("doc"),
                         F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"))
    pick = lambda which: packed.join(stays.where(which), ["doc", "tie"], "left_semi")
    # only rows that are themselves repeated have to be compared
    return pick("n = 1").unionAll(pick("n > 1").dropDuplicates(["doc", "tie"])).select("row.*")
