"""Readers for delimited, JSON and nested files, and sinks for tables and small reports."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a message row holds.
_FIELDS = {"message_id": "string", "parent_id": "string", "user_id": "string", "role": "string", "lang": "string", "created_date": "string", "review_count": "int", "rank": "int"}
#: Message rows in an Arrow batch, at most.
_BATCH = 10_000


def tree_schema() -> str:
    """A message tree: the prompt stays JSON text, so that no schema bounds the depth of its replies."""
    return "message_tree_id string, prompt string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headed CSV file with a stated schema; unreadable fields become null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path, header=True)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None, *, partitions: int | None = None) -> DataFrame:
    """JSON lines, gzipped or not.  A gzip file is read by one task, so dealing it out again pays for large ones."""
    # Jackson would take lines nested more than 1,000 deep for malformed.
    df = (spark.read.schema(schema) if schema else spark.read).option("maxNestingDepth", 2**31 - 1).json(path)
    return df.repartition(partitions) if partitions else df


def read_log(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Lines of a text log as `line` and typed fields, each name: (pattern with one group, type); null where a line lacks one."""
    text = spark.read.text(path).withColumnRenamed("value", "line")
    found = {name: F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)).cast(kind).alias(name) for name, (pattern, kind) in fields.items()}
    return text.select("line", *found.values())


def sections(log: DataFrame, start: str, *keys: str, order: str) -> DataFrame:
    """`section` counts the lines of a stream (keys) that match `start`, up to and with each line; 0 before the first."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("section", F.sum(F.col("line").rlike(start).cast("long")).over(upto))


def read_summary(path: str) -> dict:
    """S3: a small JSON summary, on the driver."""
    return json.loads(Path(path).read_text())


def parsed(text: str):
    """A JSON value of any depth: json.loads() gives up on deep nesting, a stack does not."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    scalar, i, need, result = json.JSONDecoder().raw_decode, 0, "value", None
    stack: list = []  # containers still open, and the key each object waits for a value of
    keys: list = []
    while i < len(text):
        c, holder = text[i], stack[-1] if stack else None
        end = "}" if isinstance(holder, dict) else "]"
        if c in " \t\n\r":
            i += 1
        elif need == "after" and c == "," and stack:
            need, i = "key" if end == "}" else "value", i + 1
        elif need in ("after", "first") and stack and c == end:
            stack.pop()
            keys.pop()
            need, i = "after", i + 1
        elif need == ":" and c == ":":
            need, i = "value", i + 1
        elif (need == "key" or need == "first" and end == "}") and c == '"':
            keys[-1], i = scalar(text, i)
            need = ":"
        elif need == "value" or need == "first" and end == "]":
            value, i = ({} if c == "{" else [], i + 1) if c in "{[" else scalar(text, i)
            if not stack:
                result = value
            elif isinstance(holder, dict):
                holder[keys[-1]] = value
            else:
                holder.append(value)
            need = "first" if c in "{[" else "after"
            if c in "{[":
                stack.append(value)
                keys.append(None)
        else:
            raise json.JSONDecodeError("not JSON", text, i)
    if stack or need != "after":
        raise json.JSONDecodeError("ends early", text, i)
    return result


def summary_rows(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON summaries as rows file, name, value: nested names are joined by dots, places in lists are numbers; null values stay null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, text in zip(*(c.to_pylist() for c in batch.columns)):
                stack = [("", parsed(text))]
                while stack:
                    name, v = stack.pop()
                    inner = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else None
                    if inner is None:
                        out.append((file, name, _as_string(v)))
                    else:
                        stack.extend((f"{name}.{k}" if name else str(k), x) for k, x in inner)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["file", "name", "value"])

    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return text.mapInArrow(rows, "file string, name string, value string")


def _as_string(v):
    return v if v is None or isinstance(v, str) else json.dumps(v)


def _as_int(v):
    return v if type(v) is int and -(2**31) <= v < 2**31 else None


def _nodes(prompt: str | None) -> Iterator[tuple[int, dict]]:
    """(depth, node) of a tree; what is not an object counts as a node without fields."""
    stack = [(0, parsed(prompt) if prompt else None)]
    while stack:
        depth, node = stack.pop()
        node = node if isinstance(node, dict) else {}
        yield depth, node
        replies = node.get("replies")
        stack.extend((depth + 1, r) for r in reversed(replies if isinstance(replies, list) else []))


def flatten_trees(trees: DataFrame) -> DataFrame:
    """Message rows from nested trees of any depth, one row per node; prompt: JSON text, or a struct."""
    if trees.schema["prompt"].dataType.typeName() == "struct":
        trees = trees.withColumn("prompt", F.to_json("prompt"))
    names = ["message_tree_id", "depth", *_FIELDS]
    kinds = [pa.string(), pa.int32(), *(pa.string() if k == "string" else pa.int32() for k in _FIELDS.values())]
    read = [_as_string if k == "string" else _as_int for k in _FIELDS.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((tree, depth, *(f(node.get(k)) for k, f in zip(_FIELDS, read))) for tree, prompt in zip(*(c.to_pylist() for c in batch.columns)) for depth, node in _nodes(prompt))
            while some := list(islice(rows, _BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)

    return trees.select(F.col("message_tree_id").cast("string"), "prompt").mapInArrow(run, ", ".join(["message_tree_id string", "depth int", *(f"{k} {v}" for k, v in _FIELDS.items())]))


def walk(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Node, root and depth of an adjacency table (node, parent; roots have a null parent).

    Each round doubles the distance to the ancestor that a node knows, so the rounds grow with the
    logarithm of the depth, and neither depth nor rows are bounded.  A node has a row for each way
    to a root; nodes that reach none have no row.  A cycle that reaches a root has no end of ways.
    """
    start = edges.select("node", F.coalesce("parent", "node").alias("root"), F.col("parent").isNotNull().cast("int").alias("depth"), F.col("parent").isNull().alias("done"))
    start = written(start, "ways")
    ended, ahead = [start.where("done")], start.where("not done")
    left = most = ahead.count()
    steps = 1
    while left:
        known = reduce(DataFrame.unionByName, [*ended, ahead]).select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), "done")
        step = ahead.drop("done").join(known, "root").select("node", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), "done")
        if steps > most:
            # Ways longer than there are edges go in circles.
            if step.where("done").head(1):  # they lead on to a root
                raise ValueError("a cycle of the edges reaches a root")
            break
        step = written(step, "ways")
        ended, ahead = [*ended, step.where("done")], step.where("not done")
        left = ahead.count()
        steps *= 2
    return reduce(DataFrame.unionByName, ended).drop("done")


def named_value(names: str, values: str, wanted: str):
    """The value beside a name in parallel arrays."""
    at = F.array_position(names, wanted)
    return F.when(at > 0, F.get(F.col(values), (at - 1).cast("int")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir.  Only where that is unset and the master is
    local (tests on one machine) a temporary folder is made; elsewhere that is an error, since
    every executor would write to a disk of its own.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at:
        at = context.getCheckpointDir()
    if not at and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not at:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="raterline-"))
        at = context.getCheckpointDir()
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A Parquet or headed CSV sink."""
    (df.write.parquet(path) if kind == "parquet" else df.write.csv(path, header=True))


def _report_rows(df: DataFrame, most: int) -> list:
    """All rows of a small result; more than `most` are an error, never a shorter report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows: write it as a table")
    return rows


def json_report(df: DataFrame, most: int = 1000) -> str:
    """A small result as a JSON list of records."""
    return json.dumps([r.asDict(recursive=True) for r in _report_rows(df, most)], default=str)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = _report_rows(df, most)
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.6g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def latex(df: DataFrame, most: int = 1000) -> str:
    """A small result as a LaTeX tabular."""
    rows = _report_rows(df, most)
    text = lambda c: "" if c is None else f"{c:.6g}" if isinstance(c, float) else str(c).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = "\n".join(" & ".join(map(text, r)) + r" \\" for r in [df.columns, *rows])
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body}\n\\end{{tabular}}"
