"""Spark helpers of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch of rows that crosses to Python, about.  Long texts make Spark's own batches large: a task holds a
#: batch on both sides, and buffers of that size stay with the executor.
BATCH_BYTES = 4 << 20


def modest(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32(id as text) mod n; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def parts(df: DataFrame) -> int:
    modest(df.sparkSession)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder named by spark.checkpoint.dir."""
    _folder(df)
    return df.checkpoint(True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the same folder and read again."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")  # one machine, and no folder named
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows of one key that one task joins, at least; more where more than MOST_HOT keys would be hot.
HOT_ROWS, MOST_HOT = 2_000, 100_000


def spread_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, by: list[str], total: int) -> DataFrame:
    """left with what right, which has one row for each key, says of its key; null where nothing.

    sizes: key, n (rows of left, `total` in all).  Rows of a hot key are dealt over several tasks by a hash of the
    columns `by`, and right's row goes to each.  The hot keys are broadcast; there are at most MOST_HOT of them.
    """
    per = max(HOT_ROWS, -(-total // MOST_HOT))
    hot = F.broadcast(sizes.where(F.col("n") > per).select(key, F.ceil(F.col("n") / per).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def steady(df: DataFrame) -> DataFrame:
    """df, if each reading of it gives the same rows in the same partitions and order, as that of files does; else, as
    where rows come through a shuffle, df written once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return keep(df) if "Exchange" in plan or "Shuffle" in plan else df


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def shielded(df: DataFrame) -> DataFrame:
    """df with all columns but doc_id and text renamed, so that they clash with no column an operator adds; `toDF` of the
    old names gives them back."""
    return df.toDF(*[c if c in ("doc_id", "text") else f"_p{k}" for k, c in enumerate(df.columns)])


def regroup(df: DataFrame, key: str = "bucket", tasks: int = 0) -> DataFrame:
    """Packed rows of one bucket brought together, in spark.sql.shuffle.partitions tasks or more."""
    return df.repartition(max(parts(df), tasks), key)


#: Bytes of input to a bucket, about, and the most buckets.
PER_BUCKET, MOST_BUCKETS = 8 << 20, 1 << 16
#: Spark says such sizes of what it knows nothing of.
UNKNOWN = 1 << 53


def buckets_for(df: DataFrame) -> int:
    """Buckets for packed rows of df: two to a task, and more for large inputs, by the size of its files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < UNKNOWN else 0
    return max(2 * parts(df), min(known // PER_BUCKET, MOST_BUCKETS))


#: Bits of a filter: at least, at most (16 MB), and for each wanted key.
LEAST_BITS, MOST_BITS, KEY_BITS = 20, 27, 8


def flagged(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """df with a column `_maybe`: false only where the key is surely not among the wanted keys (a table written before).

    Keeps rows out of a shuffle that the exact join after it would drop.  A filter of KEY_BITS bits for each wanted key,
    16 MB at most, is broadcast; where it is too small for the data, more rows go to the join.
    """
    bits = min(max((KEY_BITS * wanted.count()).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.pmod(F.xxhash64(wanted_key), F.lit(1 << bits))
    table_ = wanted.select(F.bitmap_bucket_number(place).alias("_b"), F.bitmap_bit_position(place).alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_m"))
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    pos = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_m", (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = df.withColumn("_b", F.bitmap_bucket_number(at)).join(F.broadcast(table_), "_b", "left")
    return out.withColumn("_maybe", F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False))).drop("_b", "_m")
