"""Cutting the lineage of iterative operators."""

import tempfile
import uuid


def folder(spark):
    """A new path in the folder of spark.checkpoint.dir, or of this process where that is unset, in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='codequarry-')).rstrip('/')}/{uuid.uuid4().hex}"


def cut(df):
    """df, computed once and kept in the folder of spark.checkpoint.dir (a folder of this process where that is unset, in local mode)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="codequarry-"))
    return df.checkpoint()
