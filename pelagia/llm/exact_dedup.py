"""Exact duplicates by a 128-bit content hash, with the bytes of a group compared before it counts.

Texts are equal when they are identical after the characters of ``[\\x20\\x09-\\x0D]`` are deleted; null
counts as empty. The first pass keeps a digest of each row; only rows whose digest occurs more than
once are read a second time, to compare their bytes with one row of their group. A large group's rows
are spread over salts, and that one row is sent to each salt. If bytes differ, the groups
of that digest are formed anew by the normalised bytes themselves.

Repeated rows (same id, text and all) form one group like any other copies: exactly one row of a group
is kept. Null ids come after all others where the smallest id decides. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.tables import small_side, stored

SALT_ROWS = 2_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, longest: bool = False,
                 digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id is kept, with ``longest`` the one with the most code points and
    then the smallest id.
    """
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    bare = bare.select("doc_id", F.length("_text").alias("chars"), normalised(F.col("_text")).alias("_bare"))
    bare = bare.withColumn("digest", digest(F.col("_bare")))
    rows = stored(bare.select("doc_id", "chars", "digest", F.sha2(F.col("_bare"), 256).alias("text_sha256")), "digests")

    collided = _collisions(bare, rows)
    if not collided.isEmpty():
        texts = bare.join(collided, "digest", "left_semi").withColumn("_key", F.col("_bare").cast("binary"))
        texts = texts.select("doc_id", "chars", "_key", F.sha2("_bare", 256).alias("text_sha256"))
        rows = rows.join(collided, "digest", "left_anti").withColumnRenamed("digest", "_key").unionByName(texts)
    else:
        rows = rows.withColumnRenamed("digest", "_key")

    same = rows.groupBy("_key", "doc_id", "chars", "text_sha256").agg(F.count("*").alias("copies"))
    order = F.struct((-F.col("chars") if longest else F.lit(0)).alias("chars"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    best = F.struct(order.alias("order"), F.col("chars").alias("chars"))
    groups = same.groupBy("_key").agg(F.min(best).alias("best"), F.sum("copies").alias("group_size"))
    joined = same.join(groups, "_key")
    first = F.col("doc_id").eqNullSafe(F.col("best.order.doc_id")) & (F.col("chars") == F.col("best.chars"))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("doc_id", F.col("best.order.doc_id").alias("keep_id"), "group_size",
                       (first & (F.col("copy") == 1)).alias("kept"), "text_sha256", "chars")


def _collisions(bare: DataFrame, rows: DataFrame) -> DataFrame:
    """Digests under which different bytes were found."""
    sizes = rows.groupBy("digest").agg(F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    repeated = stored(sizes.where("size > 1").select("digest", F.col("first.doc_id").alias("first"),
                                                     F.ceil(F.col("size") / SALT_ROWS).cast("long").alias("salts")), "repeated")
    members = bare.select("doc_id", "_bare", "digest").join(small_side(repeated, 48), "digest")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    leaders = members.where(F.col("doc_id").eqNullSafe(F.col("first"))) \
        .groupBy("digest", "salts").agg(F.min("_bare").alias("_lead"))
    leaders = leaders.select("digest", "_lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    unlike = salted.join(leaders, ["digest", "salt"]).where(F.col("_bare") != F.col("_lead"))
    return stored(unlike.select("digest").distinct(), "collisions")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without the rows that repeat a kept one."""
    found = exact_groups(docs)
    again = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept"))
    mixed = stored(again.where("rows > 1 and kept > 0 and kept < rows").select("doc_id"), "repeated-ids")
    gone = stored(again.where("kept = 0").select("doc_id"), "dropped-ids")
    left = docs.join(small_side(gone, 16), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
    if mixed.isEmpty():
        return left
    # An id that names both kept and dropped rows: one row of each normalised text stays.
    twice = left.join(mixed, left["doc_id"].eqNullSafe(mixed["doc_id"]), "left_semi")
    once = left.join(mixed, left["doc_id"].eqNullSafe(mixed["doc_id"]), "left_anti")
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), "text_sha256")
    twice = twice.withColumn("_sha", F.sha2(normalised(F.col("text")), 256)).dropDuplicates(["doc_id", "_sha"])
    twice = twice.join(kept, twice["doc_id"].eqNullSafe(kept["_id"]) & (twice["_sha"] == kept["text_sha256"]), "left_semi")
    return once.unionByName(twice.drop("_sha"))
