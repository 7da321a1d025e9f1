"""Exact dedup by progressive refinement: length, then the hash of a prefix, then the hash of the whole text.

Each level only looks at the rows that the level before could not tell apart. What survives a level is published as a bit table of
fixed size, so no text is ever shuffled: the hash of the whole text is computed in the scan, for surviving rows alone.

Defined results: a null text counts as empty, so all null, empty and white texts are equal. Rows with a null id take part; the id is
null in their own row, and they never stay before a row with an id. Repeated rows are copies with the same id, and ``kept`` is true
for each of them if that id stays. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, member_bits, stored, with_membership

#: space and U+0009 to U+000D, which do not count when texts are compared
WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", prefix_chars: int = 64,
                 digests: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256 of the normalised text.

    Of equal texts the one with the most code points stays, then the smallest id. ``text_sha256`` is only filled where the refinement
    needs it; with ``digests`` the rows that were told apart earlier are hashed as well, for reporting.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    shape = {"norm_chars": F.length("norm").cast("long"), "n_chars": F.length("text").cast("long"),
             "prefix_hash": F.xxhash64(F.substring("norm", 1, prefix_chars))}
    read = rows.withColumn("norm", normalised(F.col("text"))).withColumns(shape)
    keys = stored(read.select("norm_chars", "prefix_hash"))

    lengths = keys.groupBy("norm_chars").count().filter("count > 1")
    same_length = with_membership(keys, F.col("norm_chars"), member_bits(lengths, "norm_chars"), "open").filter("open")
    pair = F.struct("norm_chars", "prefix_hash")
    prefixes = same_length.groupBy("norm_chars", "prefix_hash").count().filter("count > 1").select(pair.alias("pair"))
    undecided = stored(member_bits(prefixes, "pair"))

    full = F.sha2(F.col("norm").cast("binary"), 256)
    marked = with_membership(read, pair, undecided, "open")
    hashed = stored(marked.select("doc_id", "n_chars", "norm_chars", "prefix_hash", "open",
                                  (full if digests else F.when(F.col("open"), full)).alias("text_sha256")))

    key = ["norm_chars", "prefix_hash", "text_sha256"]
    members = hashed.filter("open").drop("open")
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id")))
    groups = stored(members.groupBy(*key).agg((-best["minus_id"]).alias("keep_id"), F.count("*").alias("group_size")))
    grouped = join_groups(members, groups, key, "group_size").select("doc_id", "keep_id", "group_size", "text_sha256")
    alone = hashed.filter("not open").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    return grouped.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
