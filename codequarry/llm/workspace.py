"""Tables that cut lineage, in the folder that driver and executors share.

The folder is the one named in ``spark.checkpoint.dir``.  Where that is unset
(tests in local mode) a folder of this process is used instead; on a cluster
without it nothing is written to machine-local disk, an error is raised.
"""

import atexit
import functools
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


@functools.cache
def _own_folder():
    path = tempfile.mkdtemp(prefix="codequarry-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def folder(spark):
    """A new path below the shared folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = _own_folder()
    return f"{top.rstrip('/')}/codequarry/{uuid.uuid4().hex}"


def filesystem(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop(spark, path):
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


#: Rows and bytes that Spark hands to Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def small_batches(spark):
    """Bounds what lies between the JVM and its Python workers, as whole texts can be long: two settings of the caller's session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class Table:
    """A DataFrame written as Parquet to the shared folder; drop() when later tables hold what was needed of it."""

    def __init__(self, df):
        self.spark = df.sparkSession
        self.path = folder(self.spark)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self):
        drop(self.spark, self.path)


def fresh(df, name):
    """A column name that df hasn't."""
    while name in df.columns:
        name += "_"
    return name


def quoted(names):
    """Column names as Spark reads them, whatever characters they have."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def extended(df, function, more):
    """df.mapInArrow(function) for one that adds fields (DDL) to the batches it gets; df's columns are numbered there, as Spark can't pass on all names."""
    added = StructType.fromDDL(more)
    plain = [StructField(f"_{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    out = df.toDF(*(f.name for f in plain)).mapInArrow(function, StructType(plain + added.fields))
    return out.toDF(*df.columns, *added.names)


def bitmap(df, column, bits=23):
    """A bitmap of 2**bits places (a fixed size, whatever the input) of the values of a long column.

    It is a filter: absent means absent, present may be a collision.  Spark
    builds it from 4 kB pieces, so the driver gets 2**bits / 8 bytes at most.
    """
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).cast("long") + 1  # Spark's first bucket begins with 1
    rows = df.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in rows:
        start = (r["b"] - 1) << 12
        out[start : start + 4096] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)[: len(out) - start]
    return out


def in_bitmap(map_, values):
    """Which of the unsigned hashes may be in the bitmap."""
    place = values & np.uint64(len(map_) * 8 - 1)
    return (map_[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
