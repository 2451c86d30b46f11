"""What the operators of this package share: the shared folder, staged tables, joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: A key is hot if it holds more than one in so many rows; there are fewer hot keys than this, whatever the table.
HOT_KEYS = 2048
#: Partitions that a hot key is dealt over, and rows below which no key is hot.
PIECES, NEVER_HOT = 64, 512
#: Bytes of a counted table that may be sent to every executor.
SENT_BYTES = 48 << 20
STAGED: list[str] = []


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered_columns(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: an operator's own names then clash with none, and names may hold anything."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``.  Where that is unset, a temporary folder is made
    and set as the checkpoint folder, but only if driver and executors are one process.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="passgrid-")
        spark.sparkContext.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else "file://" + where


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder (not yet made) under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, into: list[DataFrame] | None = None, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage, so that a lost executor costs a read and no recomputation, and lets several
    consumers use one costly pass.  ``into`` collects the tables of a job, to be released together.
    Tables of hashes are written with ``compression`` "none": they do not shrink, and a codec's buffers
    add up where a job writes many small files.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    STAGED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if into is not None:
        into.append(out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete the folder of a staged table that nothing will read again."""
    path = getattr(df, "staged_path", None)
    if path in STAGED:
        _delete(df.sparkSession, path)
        STAGED.remove(path)


def release_but(tables: list[DataFrame], *keep: DataFrame) -> None:
    """Delete the folders of all these staged tables but those to keep."""
    for table in tables:
        if not any(table is k for k in keep):
            release(table)
    tables[:] = keep


def clear_staged(spark: SparkSession) -> int:
    """Delete every staged folder this driver has made, once the results that read them are written; returns how many."""
    done = len(STAGED)
    while STAGED:
        _delete(spark, STAGED.pop())
    return done


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` (staged, any number of rows a key) to ``table`` (one row a key) on ``key``.

    A key that holds more than one in HOT_KEYS of the rows would land in one task; its rows are
    dealt over PIECES partitions by a hash of ``by`` and its row of the table is copied to each.
    Only the hot keys, of which there are fewer than HOT_KEYS, reach the driver.  ``sizes`` (key,
    count; staged) are counted rows where they are known.
    """
    spark, hot = rows.sparkSession, []
    total = rows.count() if sizes is None else sizes.agg(F.sum("count")).first()[0] or 0
    if total > NEVER_HOT:
        counts = rows.groupBy(key).count() if sizes is None else sizes
        hot = counts.where(F.col("count") > max(NEVER_HOT, total // HOT_KEYS)).select(key).collect()
    if not hot:
        return rows.join(table, key, how)
    marks = F.broadcast(spark.createDataFrame([(r[0], PIECES) for r in hot if r[0] is not None], rows.select(key).schema.add("__pieces", IntegerType())))
    dealt = rows.join(marks, key, "left").withColumn("__piece", F.when(F.col("__pieces").isNotNull(), F.pmod(F.xxhash64(by), F.col("__pieces"))).otherwise(F.lit(0)).cast("int"))
    copied = table.join(marks, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1)))
    return dealt.drop("__pieces").join(copied.drop("__pieces"), [key, "__piece"], how).drop("__piece")


def sent_or_joined(rows: DataFrame, wanted: DataFrame, key: str, row_bytes: int, most: int = SENT_BYTES) -> DataFrame:
    """Join wide ``rows`` to a narrow staged table on ``key``: it is sent to them if it holds at most ``most`` bytes, else both are shuffled."""
    return rows.join(F.broadcast(wanted) if wanted.count() * row_bytes <= most else wanted, key)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
