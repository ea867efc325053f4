"""Source trees, document lines and tables inside documents."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.shipping import by_value
from ..functions.text import any_of, contains_any, matches, strip, sub
from ..rules import code as C


def read_sources(
    spark: SparkSession,
    root: str,
    language: str,
    exclude: Sequence[str] = tuple(C.EXCLUDED),
    extension: str | None = None,
) -> DataFrame:
    """Text files of a language below ``root``; a path holding an excluded word is left out."""
    df = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{extension or C.EXTENSIONS[language]}")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    if exclude:
        df = df.filter(~any_of([F.col("path").contains(w) for w in exclude]))
    return df.select(F.md5("path").alias("doc_id"), "path", F.lit(language).alias("language"), "text")


def write_tree(docs: DataFrame, root: str, folder: str = "project", extension: str = ".txt") -> None:
    """A file for every row of ``docs`` (folder, text), text and a line break, below ``root/folder=value``.

    The tasks write with Arrow's file systems: on local and mounted folders Spark's own writer starts processes to set
    rights for each file. A store that Arrow cannot open goes through that writer.
    """
    try:
        pyarrow.fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        docs.select(folder, "text").write.option("maxRecordsPerFile", 1).partitionBy(folder).text(root)
        return

    def files(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(root)
        made, task, n = set(), TaskContext.get().partitionId(), 0
        for batch in source:
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # names of folders as Spark's writer gives them
                name = re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"
                at = f"{base}/{folder}={name}"
                if at not in made:
                    store.create_dir(at, recursive=True)
                    made.add(at)
                with store.open_output_stream(f"{at}/f{task:05d}-{n}{extension}") as out:
                    out.write(f"{text or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    docs.select(F.col(folder).cast("string"), "text").mapInArrow(files, "n long").agg(F.sum("n")).collect()


def document_lines(docs: DataFrame, *, last_empty: bool = True) -> DataFrame:
    """One row per line, numbered from 1; every other column of the document is kept.

    With ``last_empty=False`` a text that ends with a line break has no further
    empty line.
    """
    text = sub(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    if not last_empty:
        text = sub(text, r"\n\z")
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, F.posexplode_outer(F.split(text, "\n")).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).cast("long").alias("line_no"), "line"
    )


def cells_of(line: Column) -> Column:
    """Trimmed cells of a table line."""
    inner = sub(strip(line), r"\A\|+|\|+\z")
    return F.transform(F.split(inner, r"\|"), strip)


def markdown_tables(lines: DataFrame, size: int = ordered.CHUNK) -> DataFrame:
    """Rows of pipe tables: doc_id, table_no, row_no, header, cells.

    A table is a run of lines that start and end with a pipe. Separator rows do
    not count; the first remaining row is the header and at least one more row
    is needed. Runs are numbered with chunked running sums.
    """
    text = strip("line")
    df = lines.select(
        "doc_id", "line_no", "line", (text.startswith("|") & text.endswith("|")).alias("_in")
    )
    df = ordered.running_sum(df, ["doc_id"], "line_no", {"_gap": F.when(F.col("_in"), 0).otherwise(1)}, size=size)
    df = df.filter("_in").withColumn("cells", cells_of(F.col("line")))
    separator = F.forall("cells", lambda c: sub(c, "[-: ]") == "")
    df = df.filter(~separator)
    runs = df.groupBy("doc_id", "_gap").agg(
        F.min("line_no").alias("_first"), F.min_by("cells", "line_no").alias("header"), F.count(F.lit(1)).alias("_rows")
    )
    runs = runs.filter("_rows >= 2")
    numbered = ordered.row_numbers(runs, ["doc_id"], "_first", "table_no", size=size)
    rows = df.join(numbered, ["doc_id", "_gap"]).filter(F.col("line_no") > F.col("_first"))
    return rows.select("doc_id", "table_no", "line_no", "header", "cells")


# Header words of interface and module tables, then the columns that name a task.
INTERFACE_WORDS = ["接口", "api", "url", "路径", "endpoint", "http", "method", "请求", "请求方式", "请求方法"]
MODULE_WORDS = ["模块", "功能", "任务", "接口名称", "接口名", "功能模块", "功能名称"]
NAME_COLUMNS = ["接口名称", "接口名", "功能", "功能名称", "接口"]
PLAIN_TASK = "普通任务"


def table_kind(header: Column) -> Column:
    """``interface``, ``module`` or NULL by the words in the header row."""
    text = F.lower(F.array_join(header, " "))
    return F.when(contains_any(text, INTERFACE_WORDS), "interface").when(contains_any(text, MODULE_WORDS), "module")


def interface_tasks(tables: DataFrame) -> DataFrame:
    """One task per row of interface and module tables; its content is the naming column, else the first cell."""
    low = F.transform("header", F.lower)
    named = [
        F.nullif(strip(F.get("cells", F.array_position(low, name).cast("int") - 1)), F.lit("")) for name in NAME_COLUMNS
    ]
    present = [F.when(F.array_contains(low, name), value) for name, value in zip(NAME_COLUMNS, named)]
    content = F.coalesce(*present, F.nullif(strip(F.get("cells", F.lit(0))), F.lit("")))
    df = tables.withColumns({"kind": table_kind(F.col("header")), "content": content})
    return df.filter(F.col("kind").isNotNull() & F.col("content").isNotNull()).select(
        "doc_id", "table_no", "line_no", "kind", "content", F.lit(PLAIN_TASK).alias("task_type")
    )


by_value(__name__)
