"""Arrow and Feather files as a Spark data source: schema from one footer, one partition for each run of record batches."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from arborlake.session import ship

#: What an Arrow file, other than a stream, begins with.
MAGIC = b"ARROW1"
SUFFIXES = (".arrow", ".feather", ".ipc")


@dataclass
class Batches(InputPartition):
    """Record batches first to last (not included) of one file; all of them where last is None."""

    path: str
    first: int = 0
    last: int | None = None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    # the files of a folder at any depth, in order of their names; hidden ones and those of other kinds are left out
    store, inner = _store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return store, [inner]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    return store, sorted(f.path for f in found if f.is_file and f.base_name.endswith(SUFFIXES) and f.base_name[0] not in "._")


def _open(file: pa.NativeFile, options: pa.ipc.IpcReadOptions | None = None) -> pa.RecordBatchFileReader | pa.RecordBatchStreamReader:
    head = file.read(len(MAGIC))
    file.seek(0)
    return pa.ipc.open_file(file, options=options) if head == MAGIC else pa.ipc.open_stream(file, options=options)


class ArrowFiles(DataSource):
    """Options: path; columns, names with commas, to read these only; batches, how many record batches a partition has (1); footers, up to how many files are planned by their footers (1,000).

    A stream has no footer and is one partition, as is each file where there are more files than `footers`; both are read batch by batch.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> T.StructType:
        store, files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Arrow files in {self.options['path']}")
        with store.open_input_file(files[0]) as file:
            found = from_arrow_schema(_open(file).schema, prefer_timestamp_ntz=True)
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        return T.StructType([found[c] for c in wanted]) if wanted else found

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowReader(self.options["path"], schema, int(self.options.get("batches", 1)), int(self.options.get("footers", 1000)))


class ArrowReader(DataSourceReader):
    """Reads Batches into the schema; columns that a file lacks are null."""

    def __init__(self, path: str, schema: T.StructType, batches: int, footers: int):
        self.path, self.wanted, self.batches, self.footers = path, schema, batches, footers

    def partitions(self) -> list[InputPartition]:
        store, files = _files(self.path)
        if len(files) > self.footers:
            return [Batches(f) for f in files]

        def plan(path: str) -> list[Batches]:
            with store.open_input_file(path) as file:
                reader = _open(file)
                if isinstance(reader, pa.RecordBatchStreamReader):
                    return [Batches(path)]
                total = reader.num_record_batches
            return [Batches(path, i, min(i + self.batches, total)) for i in range(0, total, self.batches)]

        with ThreadPoolExecutor(16) as pool:
            # Spark asks for a partition even where there is no row
            return [part for parts in pool.map(plan, files) for part in parts] or [Batches(files[0], 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        store = _store(self.path)[0]
        target = to_arrow_schema(self.wanted)
        with store.open_input_file(partition.path) as file:
            own = _open(file).schema
            file.seek(0)
            # only the buffers of wanted columns are read
            columns = [i for i, n in enumerate(own.names) if n in set(target.names)]
            reader = _open(file, pa.ipc.IpcReadOptions(included_fields=columns) if columns else None)
            if isinstance(reader, pa.RecordBatchStreamReader):
                batches = iter(reader)
            else:
                last = reader.num_record_batches if partition.last is None else partition.last
                batches = map(reader.get_batch, range(partition.first, last))
            for batch in batches:
                names = batch.schema.names
                arrays = [batch.column(names.index(f.name)).cast(f.type) if f.name in names else pa.nulls(batch.num_rows, f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)


def write_arrow(df: DataFrame, path: str, compression: str = "zstd") -> int:
    """df as Arrow files in a new folder, one a task, a record batch for each that Spark sends; the number of rows. A task that is run again replaces its file."""
    ship(df.sparkSession)
    schema = to_arrow_schema(df.schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, inner = _store(path)
        store.create_dir(inner, recursive=True)
        # written under a hidden name of the attempt, and shown when whole
        hidden, name = f"{inner}/.{task.taskAttemptId()}.arrow", f"{inner}/part-{task.partitionId():06d}.arrow"
        rows = 0
        with store.open_output_stream(hidden) as sink, pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
            for batch in batches:
                rows += batch.num_rows
                out.write_batch(batch.cast(schema))
        store.move(hidden, name)
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    total = df.mapInArrow(write, "rows long").agg({"rows": "sum"}).first()[0]
    if total is None:
        # no task ran: the schema is left in a file without rows
        store, inner = _store(path)
        store.create_dir(inner, recursive=True)
        with store.open_output_stream(f"{inner}/part-000000.arrow") as sink, pa.ipc.new_file(sink, schema):
            pass
    return total or 0


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, batches: int = 1) -> DataFrame:
    """Arrow files or streams at a path (a file or a folder, local or of a store that pyarrow knows). No content of a file comes to the driver but footers."""
    ship(spark)
    spark.dataSource.register(ArrowFiles)
    rows = spark.read.format("arrow_files").option("batches", batches)
    return (rows.option("columns", ",".join(columns)) if columns else rows).load(path)
