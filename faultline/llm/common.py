"""What the operators of this package share: settings, batches and training folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.session import configure

#: Rows and bytes that a Python worker holds at once. Results do not depend on either.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the jobs here: those of the library, and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def fold(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo `buckets`. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def parts(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str
) -> DataFrame:
    """Applies `function` to every Arrow batch; it returns the columns of `schema` as lists."""
    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            columns = function(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[n], arrow.field(n).type) for n in names], schema=arrow
            )

    return df.mapInArrow(run, schema)


def smallest(df: DataFrame, place: str, order: list[str], bound: int) -> DataFrame:
    """The `bound` rows with the smallest `place`, a uniform 64-bit hash; all rows if there are fewer.

    A threshold on the hash leaves about twice the bound before anything is sorted, so that tasks
    do not each send a full bound of rows. It is widened until enough rows are left.
    """
    total = df.count()
    share = 2.0
    while bound * share < total:
        limit = int(-(1 << 63) + (1 << 64) * (bound * share / total))
        found = df.where(F.col(place) <= F.lit(limit))
        if found.count() >= bound:
            df = found
            break
        share *= 4
    return df.orderBy(place, *order).limit(bound)


def ranked(df: DataFrame, group: str, order: list[str], spread: list[str], into: str = "rank") -> DataFrame:
    """Adds a rank from 0 within each group; a common group is ranked in buckets of its rows.

    `spread` are the columns that deal rows to buckets. Only sizes of buckets are summed up, so no
    task sees a whole group.
    """
    bucket = F.pmod(F.xxhash64(*spread), F.lit(parts(df.sparkSession))).cast("int")
    dealt = df.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (
        dealt.withColumn("_own", F.row_number().over(own))
        .join(sizes, [group, "_bucket"])
        .withColumn(into, F.col("_before") + F.col("_own") - 1)
        .drop("_bucket", "_own", "_before")
    )
