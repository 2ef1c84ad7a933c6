"""Units as JSON lines, a folder each (`unit_id=5`), named and filled as `partitionBy` does, so that Spark's JSON reader takes them.

On a local or mounted file system Hadoop starts a process for the rights of each file and folder that it makes, and Spark's listing by default a task a
folder. There the JVM makes the lines, and a task writes them, sorted by unit, through pyarrow below a hidden folder; the driver moves the units into place once
all tasks are done, so of a task that fails or is repeated a reader sees nothing. Other file systems have Spark's own writer.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import located

#: The folder of rows without a unit, and what names of folders don't hold: fixed by Spark.
NO_UNIT, ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")
#: The most tasks that list folders.
LISTING_TASKS = 64


def unit_folder(column: str, unit: str | None) -> str:
    escaped = lambda text: ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", text)
    return f"{escaped(column)}={escaped(unit) if unit else NO_UNIT}"


@dataclass
class Written(WriterCommitMessage):
    folder: str


class UnitsWriter(DataSourceArrowWriter):
    """Rows (unit, lines): lines with their ends, those of a unit one after the other and in one task."""

    def __init__(self, options):
        self.path, self.column = options["path"], options["column"]
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator[pa.RecordBatch]) -> Written:
        system, folder = located(self.path)
        own = f"{folder}/_writing-{self.run}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        stream, last = None, None
        try:
            for batch in rows:
                for unit, lines in runs(batch.column("unit"), batch.column("lines")):
                    if stream is None or unit != last:
                        if stream:
                            stream.close()
                        last, at = unit, f"{own}/{unit_folder(self.column, unit)}"
                        system.create_dir(at, recursive=False)
                        stream = system.open_output_stream(f"{at}/part-{self.run}.json")
                    stream.write(lines)
        finally:
            if stream:
                stream.close()
        return Written(own)

    def commit(self, messages: list[Written]) -> None:
        system, at = located(self.path)
        system.create_dir(at, recursive=True)
        for m in messages:
            for unit in system.get_file_info(fs.FileSelector(m.folder)) if m else []:
                system.move(unit.path, f"{at}/{unit.base_name}")
        self.abort(messages)
        system.open_output_stream(f"{at}/_SUCCESS").close()

    def abort(self, messages: list[Written]) -> None:
        system, at = located(self.path)
        hidden = f"{at}/_writing-{self.run}"
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


def runs(units: pa.Array, lines: pa.Array) -> Iterator[tuple[str | None, pa.Buffer]]:
    """(unit, its lines as they stand in the array's memory) of each run of one unit."""
    if not len(units):
        return
    _, offsets, said = lines.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(lines.type) else np.int32)[lines.offset :].tolist()
    found, start = pc.run_end_encode(units), 0
    for unit, end in zip(found.values.to_pylist(), found.run_ends.to_pylist(), strict=True):
        yield unit, said.slice(at[start], at[end] - at[start])
        start = end


class Units(DataSource):
    @classmethod
    def name(cls) -> str:
        return "units"

    def schema(self) -> str:
        return "unit string, lines string"

    def writer(self, schema, overwrite: bool) -> UnitsWriter:
        return UnitsWriter(self.options)


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def write_units(df: DataFrame, path: str, unit: str = "unit_id") -> None:
    """One folder of JSON per unit. Rows of a unit are brought together first, so a unit is a file of its task, not of every task."""
    if "://" in path and not path.startswith("file:"):
        df.repartition(unit).write.mode("errorifexists").partitionBy(unit).json(path)
        return
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    df.sparkSession.dataSource.register(Units)
    line = F.to_json(F.struct(*[_quoted(c) for c in df.drop(unit).columns]))
    rows = df.select(F.nullif(_quoted(unit).cast("string"), F.lit("")).alias("unit"), F.concat(line, F.lit("\n")).alias("lines"))
    rows.repartition("unit").sortWithinPartitions("unit").write.format("units").mode("append").option("column", unit).save(path)


def read_units(spark: SparkSession, path: str, schema: StructType, unit: str = "unit_id") -> DataFrame:
    """The rows of all units in a folder, their unit from its folder's name. Folders are listed many a task; partitions are not inferred, as Spark then
    takes each against all."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, min(int(before), LISTING_TASKS))
    try:
        rows = spark.read.schema(StructType([f for f in schema.fields if f.name != unit])).option("recursiveFileLookup", True).json(path)
    finally:
        spark.conf.set(tasks, before)
    folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
    name = F.substring_index(folder, "=", -1)
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    named = F.when(name != NO_UNIT, decoded(decoded(name))).cast(schema[unit].dataType)  # the path is a URI of an escaped name
    return rows.select(*[named.alias(unit) if c == unit else _quoted(c) for c in schema.names])
