"""What several corpus operators need: tables, checked skew-safe joins, fixed-size membership bits, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import stored  # noqa: F401  re-exported for the operators

#: bits of a membership table; with 8 Mi bits it takes 1 MiB whatever the number of keys
MEMBER_BITS = 1 << 23
#: a group counts as hot when it holds more than one row in so many; there are fewer hot groups than this
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_column: str = "doc_id") -> Column:
    """True for the fifth of the documents from which nothing may be learned. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def member_bits(keys: DataFrame, column: str) -> DataFrame:
    """A fixed-size bit table (at most 1 MiB) of the keys in ``column``; false positives only cost the reader some work."""
    at = F.pmod(F.xxhash64(column), F.lit(MEMBER_BITS))
    return (keys.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")))


def with_membership(rows: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether the key may be one of those that ``bits`` was made of. The side that is broadcast has a fixed size."""
    at = F.pmod(F.xxhash64(key), F.lit(MEMBER_BITS))
    octet = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    probed = rows.withColumns({"_bucket": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)})
    joined = probed.join(F.broadcast(bits), "_bucket", "left")
    is_set = F.expr("(shiftright(_octet, cast(_bit % 8 as int)) & 1) = 1")
    return joined.withColumn("_octet", octet).withColumn(name, F.coalesce(is_set, F.lit(False))).drop("_bucket", "_bit", "_bits", "_octet")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows to the one line of their group, safe when one group holds a large share of the rows.

    Both sides are stored tables and ``groups`` is an aggregate of ``rows``. Groups with more than one row in HOT_SHARE number fewer
    than HOT_SHARE, so they are broadcast; all other groups are joined by a shuffle in which no key is large.
    """
    least = max(2, rows.count() // HOT_SHARE + 1)
    hot = F.broadcast(groups.filter(F.col(size) >= least))
    cold = groups.filter(F.col(size) < least)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def send_few_rows(spark: SparkSession) -> None:
    """Whole documents are large rows: let Spark send Python a tenth of its default number at a time. Another setting is kept."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def with_computed(df: DataFrame, added: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 256,
                  keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of the DDL string ``added``, computed in Python over slices of at most ``rows`` rows.

    ``make`` runs once per task and returns the function from a slice to the new columns. Slices keep the memory of a worker bounded
    whatever the size of the batches that Spark sends. Only the columns in ``keep`` are returned besides (default: all others).
    """
    send_few_rows(df.sparkSession)
    fields = StructType.fromDDL(added).fields
    names = [field.name for field in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        kinds = {field.name: to_arrow_type(field.dataType) for field in fields}
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                new = compute(part)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(new[n], kinds[n]) for n in names], kept + names)

    return df.mapInArrow(run, schema)
