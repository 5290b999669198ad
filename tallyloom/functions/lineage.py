"""Cutting the lineage of iterative plans, in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, or the session's own checkpoint folder where that is unset. Only a session that is
    one process (``local[n]``) gets a temporary folder where there is neither; on a cluster that is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set, nor has the session a checkpoint folder")
        path = tempfile.mkdtemp(prefix="tallyloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table of which the planner knows that it is empty, so what is joined with it costs nothing."""
    columns = StructType.fromDDL(schema)
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in columns])


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, with a folder for each value of ``by``: what reads it takes only the columns and
    folders that it needs."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def in_methods(df: DataFrame, plain: str, *columns: str | Column) -> DataFrame:
    """``df.select(*columns)`` for many or long expressions. Fused with its neighbours, such a projection becomes one method, and the JVM never compiles a
    method of more than 8000 bytes. Spark doesn't fuse a projection that has a higher-order function, and splits its code into small methods;
    so ``plain``, one of the columns, goes through one that leaves it as it is. The expressions themselves must not be inside such a function."""
    same = F.transform(F.array(plain), lambda x: x)[0].alias(plain)
    return df.select(*[same if isinstance(c, str) and c == plain else c for c in columns])
