"""The data model: a graph space is a set of named DataFrames, one for each tag and edge type.

A tag's DataFrame has ``vid`` and its properties; an edge type's has ``src``, ``dst``, ``rank`` and its properties. Tables are
immutable: data changes swap the DataFrame, which makes a transaction a saved reference.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from weftgraph.lang.lexer import QueryError

#: Type names of the language and Spark's.
TYPES = {
    "BOOL": "boolean", "BOOLEAN": "boolean", "SMALLINT": "smallint", "INT8": "tinyint", "INT16": "smallint", "INT32": "int", "INT": "bigint", "INTEGER": "bigint",
    "INT64": "bigint", "BIGINT": "bigint", "FLOAT": "double", "DOUBLE": "double", "DECIMAL": "decimal(38,18)", "DECIMAL128": "decimal(38,18)", "STRING": "string",
    "TEXT": "string", "VARCHAR": "string", "FIXED_STRING": "string", "FIXEDSTRING": "string", "BLOB": "binary", "DATE": "date", "TIME": "bigint", "DATETIME": "timestamp",
    "TIMESTAMP": "timestamp", "LIST": "array<string>", "MAP": "map<string,string>", "SET": "array<string>", "VECTOR": "array<float>", "JSON": "string", "JSONB": "string",
    "UUID": "string", "GEOGRAPHY": "string", "DURATION": "interval day to second",
}


def spark_type(name: str) -> str:
    base, _, rest = name.upper().partition("(")
    if base == "DECIMAL" and rest:
        return f"decimal({rest}"
    found = TYPES.get(base.rstrip("0123456789") if base.startswith("FIXEDSTRING") else base)
    if not found:
        raise QueryError(f"unknown type {name}")
    return found


@dataclass(frozen=True)
class Schema:
    """What was declared of a tag or edge type besides its columns."""

    defaults: dict[str, Any] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    comments: dict[str, str] = field(default_factory=dict)
    ttl_column: str | None = None
    ttl_seconds: int | None = None


@dataclass(frozen=True)
class Tag:
    name: str
    df: DataFrame
    schema: Schema = Schema()

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c != "vid"]

    def live(self) -> DataFrame:
        return alive(self.df, self.schema)


@dataclass(frozen=True)
class EdgeType:
    name: str
    df: DataFrame
    src_tag: str | None = None
    dst_tag: str | None = None
    schema: Schema = Schema()

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("src", "dst", "rank")]

    def live(self) -> DataFrame:
        return alive(self.df, self.schema)


def alive(df: DataFrame, schema: Schema) -> DataFrame:
    """Rows that haven't outlived their time to live, judged as they are read."""
    if not schema.ttl_column or not schema.ttl_seconds:
        return df
    col = F.col(schema.ttl_column)
    seconds = F.unix_timestamp(col) if df.schema[schema.ttl_column].dataType.typeName().startswith(("timestamp", "date")) else col.cast("bigint")
    return df.where(col.isNull() | (seconds + schema.ttl_seconds > F.unix_timestamp()))


@dataclass(frozen=True)
class Index:
    name: str
    kind: str
    on: str
    fields: tuple[str, ...]
    options: dict[str, Any] = field(default_factory=dict)


class GraphSpace:
    """A named graph with its schema, indexes and saved states."""

    def __init__(self, spark: SparkSession, name: str = "default", vid_type: DataType | None = None, options: dict[str, Any] | None = None):
        self.spark, self.name, self.options = spark, name, options or {}
        self.vid_type = vid_type or LongType()
        self.tags: dict[str, Tag] = {}
        self.edges: dict[str, EdgeType] = {}
        self.indexes: dict[str, Index] = {}
        self.saved: list[tuple[str | None, tuple]] = []
        #: Full-text indexes that have been built, each with the table that it was built of.
        self.postings: dict[str, tuple[DataFrame, Any]] = {}

    # -- definition
    def add_tag(self, name: str, df: DataFrame, vid: str, schema: Schema = Schema()) -> GraphSpace:
        """Register a DataFrame as a tag; the key column stays available as a property too."""
        props = [F.col(c) for c in df.columns if c != "vid"]
        self.tags[name] = Tag(name, df.select(F.col(vid).alias("vid"), *props), schema)
        return self

    def add_edge(self, name: str, df: DataFrame, src: str, dst: str, rank: str | None = None, src_tag: str | None = None, dst_tag: str | None = None, schema: Schema = Schema()) -> GraphSpace:
        props = [F.col(c) for c in df.columns if c not in ("src", "dst", "rank")]
        ranked = (F.col(rank).cast("long") if rank else F.lit(0).cast("long")).alias("rank")
        self.edges[name] = EdgeType(name, df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), ranked, *props), src_tag, dst_tag, schema)
        return self

    def empty_tag(self, fields: list[StructField]) -> DataFrame:
        return self.spark.createDataFrame([], StructType([StructField("vid", self.vid_type), *fields]))

    def empty_edge(self, fields: list[StructField]) -> DataFrame:
        ends = [StructField("src", self.vid_type), StructField("dst", self.vid_type), StructField("rank", LongType())]
        return self.spark.createDataFrame([], StructType([*ends, *fields]))

    # -- access
    def tag(self, name: str) -> Tag:
        if name not in self.tags:
            raise QueryError(f"no tag {name} in space {self.name}")
        return self.tags[name]

    def edge(self, name: str) -> EdgeType:
        if name not in self.edges:
            raise QueryError(f"no edge type {name} in space {self.name}")
        return self.edges[name]

    def swap_tag(self, name: str, df: DataFrame) -> None:
        self.tags[name] = replace(self.tags[name], df=df)

    def swap_edge(self, name: str, df: DataFrame) -> None:
        self.edges[name] = replace(self.edges[name], df=df)

    # -- full-text indexes as data
    def build_text_index(self, name: str) -> None:
        """Write the postings of a full-text index on a tag; one on an edge type, or of rows that expire, is searched by scans."""
        from weftgraph.operators.textindex import TextIndex

        index = self.indexes[name]
        tag = self.tags.get(index.on)
        if tag and not tag.schema.ttl_column:
            self.postings[name] = tag.df, TextIndex(tag.df, list(index.fields))

    def text_index(self, index: Index) -> Any:
        """The postings of an index, if they were built of its tag's present rows; REBUILD INDEX builds them anew."""
        table, made = self.postings.get(index.name, (None, None))
        return made if made and index.on in self.tags and self.tags[index.on].df is table else None

    # -- transactions: states are references to immutable tables
    def state(self) -> tuple:
        return dict(self.tags), dict(self.edges), dict(self.indexes)

    def begin(self, name: str | None = None) -> None:
        self.saved.append((name, self.state()))

    def commit(self) -> None:
        if not self.saved:
            raise QueryError("no transaction to commit")
        self.saved.clear()

    def rollback(self, name: str | None = None) -> None:
        at = next((i for i in range(len(self.saved) - 1, -1, -1) if name is None or self.saved[i][0] == name), None)
        if at is None:
            raise QueryError("no transaction to roll back")
        at = 0 if name is None else at
        self.tags, self.edges, self.indexes = (dict(x) for x in self.saved[at][1])
        del self.saved[at if name is None else at + 1 :]

    # -- querying
    def query(self, text: str, **params: Any) -> DataFrame:
        """Run one statement or several; the result of the last one."""
        from weftgraph.session import Session

        return Session(self).query(text, **params)


def string_space(spark: SparkSession, name: str) -> GraphSpace:
    return GraphSpace(spark, name, StringType())
