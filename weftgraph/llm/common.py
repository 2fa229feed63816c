"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

#: Rows converted between Arrow and Python objects at a time; bounds a worker's memory, not the result.
SLICE_ROWS = 256

#: Rows of an Arrow batch between the JVM and Python. Texts run to megabytes, and a batch is held whole, off heap, on both sides.
BATCH_ROWS = 256
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

from weftgraph.runtime import shared_folder

_own_dirs: dict[str, str] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """Sets the session's Arrow batches to BATCH_ROWS rows, unless they are smaller already."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df


def words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space (0x20 and 0x09 to 0x0D); none for null."""
    return text.encode().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which driver and executors share; it goes when the driver ends.

    Where the setting is missing, a local session takes a temporary folder and any other the warehouse, which is shared.
    """
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = f"{shared_folder(spark)}/llm-{app}-{uuid.uuid4().hex[:8]}"
        _own_dirs[app] = path
        at, files = _files(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
    return _own_dirs[app]


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


#: Rows that a file of a small table holds.
FILE_ROWS = 250_000


def files_for(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS))


def materialize(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and any executor can reread it.

    A bound of its rows, where one is known, keeps a small table from becoming a file for each shuffle partition.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(files_for(most_rows))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files behind :func:`materialize` results that no later plan reads; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path:
            at, files = _files(df.sparkSession, path)
            files.delete(at, True)


def arrow_type(kind: DataType) -> pa.DataType:
    if isinstance(kind, ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {
        LongType: pa.int64(), IntegerType: pa.int32(), DoubleType: pa.float64(), StringType: pa.string(),
        BooleanType: pa.bool_(), BinaryType: pa.binary(),
    }[type(kind)]


def emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def flat_map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: str) -> DataFrame:
    """Each row's values through the function that ``make`` builds once a task; it yields any number of output rows."""
    out = StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, pending = make(), []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for values in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                    for row in fn(*values):
                        pending.append(row)
                        if len(pending) >= 8192:
                            yield emit(pending, arrow)
                            pending = []
                if pending:
                    yield emit(pending, arrow)
                    pending = []

    return small_batches(df).mapInArrow(run, out)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row for each input row."""

    def once() -> Callable[..., Iterator[tuple]]:
        fn = make()
        return lambda *values: (fn(*values),)

    return flat_map_rows(df, once, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Slices of rows through a function that keeps the columns of ``df``, which may have any names and types."""
    slots = [f"c{i}" for i in range(len(df.columns))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(slots, df.schema, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield fn(batch.slice(at, SLICE_ROWS))

    return small_batches(df).toDF(*slots).mapInArrow(run, schema).toDF(*df.columns)


def in_slots(df: DataFrame) -> DataFrame:
    """The same rows under column names that clash with none of an operator's own; toDF(*names) gives them back theirs."""
    return df.toDF(*[f"_slot{i}" for i in range(len(df.columns))])


def slot(df: DataFrame, name: str) -> str:
    return f"_slot{df.columns.index(name)}"
