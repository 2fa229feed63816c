"""Tables in the shared folder: how iterative operators cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, another the warehouse."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _own:
        local = master.startswith("local") and not master.startswith("local-cluster")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="weft-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_weft"
    return _own[app]


def settle(df: DataFrame, label: str = "table", options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: later plans start from files that every executor can read."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that no later plan reads."""
    path = getattr(df, "_weft_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
