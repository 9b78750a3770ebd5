"""CSV whose quoted cells span lines, read by many tasks.

A byte range of a file does not tell whether its first line stands inside a quoted cell. A first pass counts the quotes of
every range; the ranges before it, one row each, then say how a range begins. The second pass cuts each range into
records; what crosses a border is put together from one fragment per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte ranges whose beginnings are sent to the tasks; more need larger ranges (spark.sql.files.maxPartitionBytes).
MOST_RANGES = 2_000_000

_RECORDS = "file string, block long, kind int, first boolean, record string"
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines in the order of their range, which starts at byte ``block``."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def range_starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a range begins inside a quoted cell; a doubled quote changes nothing."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range, whole or as far as the range holds them."""
    where, held, open_, started, first = None, [], False, False, False

    def row(kind: int, record: str) -> tuple:
        return (*where, kind, first, record)

    def leftover() -> list[tuple]:
        """What the range that ends has not closed."""
        if not held:
            return []
        return [row(TAIL if started else MIDDLE, "\n".join(held))]

    for batch in batches:
        out: list[tuple] = []
        value, file, block, inside = batch.columns
        odd = pc.bit_wise_and(pc.count_substring(value, '"'), 1).to_numpy(zero_copy_only=False).astype(bool)
        names, blocks = file.dictionary_encode(), block.to_numpy()
        code = names.indices.to_numpy()
        edges = np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        bounds = [0, *edges.tolist(), len(blocks)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            here = (names.dictionary[int(code[a])].as_py(), int(blocks[a]))
            if here != where:
                out += leftover()
                where, held, open_ = here, [], inside[a].as_py()
                started, first = not open_, here[1] == 0
            for text, flips in zip(value.slice(a, b - a).to_pylist(), odd[a:b].tolist()):
                if not open_ and not held:
                    started = True
                held.append(text)
                open_ ^= flips
                if not open_:
                    out.append(row(WHOLE if started else HEAD, "\n".join(held)))
                    held, first, started = [], False, True
        columns = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))],
                                         names=["file", "block", "kind", "first", "record"])
    rest = leftover()
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))],
                                         names=["file", "block", "kind", "first", "record"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the logical records of all files, their line breaks included; ``first`` marks a file's first."""
    lines = physical_lines(spark, path)
    starts = range_starts(lines)
    ranges = starts.count()
    if ranges > MOST_RANGES:
        raise ValueError(f"{ranges} byte ranges; raise spark.sql.files.maxPartitionBytes")
    # A broadcast join leaves the lines of a range in their order; one row per range, MOST_RANGES at most.
    cut = lines.join(F.broadcast(starts), ["file", "block"]).select("value", "file", "block", "inside").mapInArrow(_cut, _RECORDS)
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # Two fragments a range at most: a record begins with a tail and ends with the next head.
    parts = cut.where(F.col("kind") != WHOLE).withColumn("nth", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = parts.groupBy("file", "nth").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda p: p["record"]), "\n").alias("record"))
    return cut.where(F.col("kind") == WHOLE).select("file", "first", "record").union(joined.select("file", "first", "record"))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header per file; cells may be quoted, span lines and hold doubled quotes. Any range of a file is a task of its own."""
    rows = records(spark, path).where("NOT first").select(F.regexp_replace("record", "\r$", "").alias("record")).where("record != ''")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    cells = F.from_csv("record", ddl, {"quote": '"', "escape": '"'})
    return rows.select(cells.alias("r")).select("r.*")

