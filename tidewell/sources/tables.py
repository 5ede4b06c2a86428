"""Parquet tables, and nested records built from them."""

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch between Spark and Python at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Where kept tables lie.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def small_batches(spark: SparkSession) -> None:
    """Rows of text can be long: at most BATCH_ROWS of them, and about BATCH_BYTES, cross to Python at once, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":  # nobody has set it
        spark.conf.set(name, f"{BATCH_BYTES}b")


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, so many at once at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder at which nothing is yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder: cuts the lineage and survives lost executors; `dropped` deletes it."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order (code, title, price) with its lines as ordered nested sections: sections are gathered before the join, so each side shuffles once."""
    fields = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sections"))
    orders = table(spark, sf_dir, "orders")
    code = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return joined.select("o_orderkey", "o_custkey", code.alias("code"), "o_orderstatus", "o_totalprice", "o_orderdate", F.coalesce("sections", F.array().cast(lines.schema["sections"].dataType)).alias("sections"))
