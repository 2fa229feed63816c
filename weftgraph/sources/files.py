"""CSV, JSON and JSON Lines import and export, whole-space dumps, schema export, and output formats."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from weftgraph.model import GraphSpace, Index, Schema


def import_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """Without a schema, types are inferred by a pass over the file."""
    reader = spark.read.option("sep", delimiter).option("header", header).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def export_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", delimiter).option("header", header).option("escape", '"').csv(path)


def import_json(spark: SparkSession, path: str, schema: StructType | str | None = None, array: bool = False) -> DataFrame:
    """JSON Lines, or (array) files that hold one array each."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON Lines; NULL fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_json_array(df: DataFrame, pretty: bool = False) -> str:
    """A result of modest size as one JSON array."""
    rows = [json.loads(x) for x in df.toJSON().toLocalIterator()]
    return json.dumps(rows, indent=2 if pretty else None, ensure_ascii=False)


def schema_of(space: GraphSpace) -> dict:
    def declared(s: Schema) -> dict:
        return {"defaults": s.defaults, "required": list(s.required), "comments": s.comments, "ttl_column": s.ttl_column, "ttl_seconds": s.ttl_seconds}

    return {
        "space": space.name,
        "tags": {n: {"columns": json.loads(t.df.schema.json()), **declared(t.schema)} for n, t in space.tags.items()},
        "edges": {n: {"columns": json.loads(e.df.schema.json()), "src_tag": e.src_tag, "dst_tag": e.dst_tag, **declared(e.schema)} for n, e in space.edges.items()},
        "indexes": {n: {"kind": i.kind, "on": i.on, "fields": list(i.fields), "options": i.options} for n, i in space.indexes.items()},
    }


def schema_yaml(value: object, depth: int = 0) -> str:
    """The schema as YAML: maps and lists as blocks, everything else as JSON scalars, which YAML contains."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{k}:" + (f"\n{schema_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {json.dumps(v)}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f"\n{schema_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {json.dumps(v)}\n") for v in value)
    return f"{pad}{json.dumps(value)}\n"


def dump(space: GraphSpace, path: str, format: str = "parquet") -> None:
    """Every table below ``path`` (Parquet or JSON Lines) and the schema beside them."""
    for n, t in space.tags.items():
        t.df.write.mode("overwrite").format(format).save(f"{path}/tags/{n}")
    for n, e in space.edges.items():
        e.df.write.mode("overwrite").format(format).save(f"{path}/edges/{n}")
    text = space.spark.createDataFrame([(json.dumps(schema_of(space), default=str),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def restore(spark: SparkSession, path: str, format: str = "parquet") -> GraphSpace:
    s = json.loads(spark.read.text(f"{path}/schema").first()[0])
    space = GraphSpace(spark, s["space"])

    def schema(x: dict) -> Schema:
        return Schema(x["defaults"], tuple(x["required"]), x["comments"], x["ttl_column"], x["ttl_seconds"])

    def read(kind: str, name: str, x: dict) -> DataFrame:
        return spark.read.schema(StructType.fromJson(x["columns"])).format(format).load(f"{path}/{kind}/{name}")

    for n, x in s["tags"].items():
        space.add_tag(n, read("tags", n, x), "vid", schema(x))
    for n, x in s["edges"].items():
        space.add_edge(n, read("edges", n, x), "src", "dst", "rank", x["src_tag"], x["dst_tag"], schema(x))
    for n, x in s["indexes"].items():
        space.indexes[n] = Index(n, x["kind"], x["on"], tuple(x["fields"]), x["options"])
    return space


def render(df: DataFrame, format: str = "table", most: int = 100) -> str:
    """The first rows as text: table, vertical, csv, json or html."""
    rows, names = df.limit(most).collect(), df.columns
    cells = [["NULL" if v is None else str(v) for v in r] for r in rows]
    if format == "json":
        return json.dumps([r.asDict(recursive=True) for r in rows], default=str, ensure_ascii=False)
    if format == "csv":
        quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
        return "\n".join(",".join(map(quote, r)) for r in [names, *cells])
    if format == "html":
        tag = lambda kind, values: "<tr>" + "".join(f"<{kind}>{html.escape(v)}</{kind}>" for v in values) + "</tr>"
        return "<table>" + tag("th", names) + "".join(tag("td", r) for r in cells) + "</table>"
    if format == "vertical":
        width = max(map(len, names), default=0)
        return "\n".join(f"-[ {i + 1} ]\n" + "\n".join(f"{n.ljust(width)} | {v}" for n, v in zip(names, r, strict=True)) for i, r in enumerate(cells))
    widths = [max(len(x) for x in column) for column in zip(names, *cells, strict=True)]
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) + " |"
    bar = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    return "\n".join([bar, line(names), bar, *map(line, cells), bar])


def batches(df: DataFrame, size: int = 1000) -> Iterator[list]:
    """A result in pages, partition by partition, so the driver holds one at a time."""
    page: list = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


