"""Run folders: a data source that lists and writes them, and what is read out of them.

``RUN_FOLDER`` is a Spark data source. Reading gives one row per file (path, name, ext, size) without its content: the driver
looks at folders only until there are enough subtrees for all tasks, which list some of them each; filters on ``ext`` are pushed into the
listing. ``json_files`` reads the contents of such rows in tasks. Writing is in two steps: tasks write to a staging folder, the driver's commit puts what the successful attempts
wrote in place, an abort removes it, so that failed tasks and failed jobs leave no row. Layouts:

* ``log``: rows (value) as lines of files in a folder of their own for each batch, put in place by one rename: readers see all of
  a batch or nothing. A batch that is written again under the same ``batch`` name changes nothing, so replays are safe.
* ``csv``: the same with a header and all columns.
* ``files``: rows (path, content) as one file each at their path below the folder, the last writer winning; each file is put in
  place whole.

Folders are reached through Arrow's file systems: local and mounted ones, and the object stores Arrow knows.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .files import EXTENSIONS

RUN_FOLDER = "attestra_run_folder"
LISTING = "path string, name string, ext string, size long"
STAGING = ".staging-"
#: Folders within one that the driver hands out one by one, a wider one is listed by one task; files of a batch of the listing; bytes of a batch of contents.
WIDE, ROWS, BYTES = 10_000, 10_000, 1 << 26
# Folders that hold a task's documents, the first one there wins; files that control a task.
DOCUMENT_FOLDERS = ["source_documents", "input_documents", "documents", "docs"]
CONTROL_FILES = ["task.json", "instruction.md", "scores.json", "status.json"]

c = F.col


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def extension(name: str) -> str:
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


@dataclass
class Subtree(InputPartition):
    folder: str
    deep: bool
    others: tuple = ()


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parallel, self.wanted = options["path"], int(options.get("parallel", 64)), None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ext",):
                self.keep({f.value})
            elif isinstance(f, In) and f.attribute == ("ext",):
                self.keep(set(f.value))
            else:
                yield f

    def keep(self, values: set) -> None:
        self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = filesystem(self.path)
        flat, deep, todo = [], [], [root]
        while todo and len(flat) + len(deep) + len(todo) < self.parallel:
            inner = []
            for folder in todo:
                own = [x.path for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == fs.FileType.Directory and not x.base_name.startswith(STAGING)]
                if len(own) > WIDE:
                    deep.append(folder)
                else:
                    flat.append(folder)
                    inner += own
            todo = inner
        found = [(x, False) for x in flat] + [(x, True) for x in deep + todo]
        tasks = len(found) if len(found) <= 4 * self.parallel else self.parallel
        return [Subtree(*found[i], tuple(found[i + tasks :: tasks])) for i in range(tasks)]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = filesystem(self.path)
        rows = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["path", "name", "ext", "size"])

        for folder, deep in [(partition.folder, partition.deep), *partition.others]:
            for x in store.get_file_info(fs.FileSelector(folder, recursive=deep, allow_not_found=True)):
                ext = extension(x.base_name)
                if x.type == fs.FileType.File and STAGING not in x.path and (self.wanted is None or ext in self.wanted):
                    rows.append((x.path, x.base_name, ext, x.size))
                if len(rows) >= ROWS:
                    yield batch()
        yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.layout = options["path"], options.get("layout", "log")
        self.batch = options.get("batch") or uuid.uuid4().hex
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def place(self) -> tuple:
        store, root = filesystem(self.path)
        return store, root, f"{root}/{self.staging}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import csv

        store, _, staging = self.place()
        attempt = uuid.uuid4().hex
        store.create_dir(f"{staging}/{attempt}", recursive=True)
        files = []
        if self.layout == "files":
            for batch in iterator:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at = f"{attempt}/{len(files)}"
                    with store.open_output_stream(f"{staging}/{at}") as out:
                        out.write((content or "").encode())
                    files.append((at, path))
            return Written(files)
        at, out = f"{attempt}/part-{attempt}.{'csv' if self.layout == 'csv' else 'jsonl'}", None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                out = store.open_output_stream(f"{staging}/{at}")
                if self.layout == "csv":
                    out = csv.CSVWriter(out, batch.schema)
            if self.layout == "csv":
                out.write_batch(batch)
            else:
                out.write("".join(f"{x}\n" for x in batch.column(0).to_pylist() if x is not None).encode())
        if out is None:
            return Written([])
        out.close()
        return Written([(at, posixpath.basename(at))])

    def commit(self, messages: list) -> None:
        store, root, staging = self.place()
        found = [x for m in messages if m is not None for x in m.files]
        if self.layout == "files":
            for at, path in found:
                store.create_dir(posixpath.dirname(f"{root}/{path}"), recursive=True)
                store.move(f"{staging}/{at}", f"{root}/{path}")
        else:
            batch = f"{root}/batch={self.batch}"
            if found and not self.there(store, batch):
                store.create_dir(f"{staging}/ready", recursive=True)
                for at, name in found:
                    store.move(f"{staging}/{at}", f"{staging}/ready/{name}")
                store.move(f"{staging}/ready", batch)
        self.drop(store, staging)

    def abort(self, messages: list) -> None:
        store, _, staging = self.place()
        self.drop(store, staging)

    def there(self, store, path: str) -> bool:
        from pyarrow import fs

        return store.get_file_info(path).type != fs.FileType.NotFound

    def drop(self, store, staging: str) -> None:
        if self.there(store, staging):
            store.delete_dir(staging)


class RunFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return RUN_FOLDER

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FolderWriter(self.options)


def known(spark: SparkSession) -> SparkSession:
    """The data source is known to the session, and takes filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunFolder)
    return spark


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, ext, size of all files below a folder."""
    return known(spark).read.format(RUN_FOLDER).load(folder)


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, ext, size of the files with a known extension, by path."""
    return listed(spark, folder).where(c("ext").isin(EXTENSIONS)).orderBy("path")


def written(rows: DataFrame, folder: str, layout: str = "log", batch: str | None = None) -> None:
    """``rows`` below ``folder`` in one of the layouts. ``batch`` names a log's batch; one that is there already stays as it is."""
    known(rows.sparkSession)
    writer = rows.write.format(RUN_FOLDER).mode("append").option("layout", layout)
    (writer.option("batch", batch) if batch else writer).save(folder)


def below(path: Column, folder: str) -> Column:
    """What comes behind the folder in a path, with or without a scheme."""
    plain = filesystem(folder)[1].rstrip("/")
    return F.substring_index(F.regexp_replace(path, "^file:/+", "/"), f"{plain}/", -1)


def discovered(files: DataFrame, folder: str, depth: int = 1) -> DataFrame:
    """task, path, name, ext, size: the documents of each task (a folder ``depth`` levels down): those below the first of the known
    document folders that is there, whatever it holds, else the files at the top without the control files; known extensions only."""
    parts = F.split(below(c("path"), folder), "/")
    rest = F.slice(parts, depth + 1, F.size(parts))
    sub = F.when(F.size(rest) > 1, rest[0])
    rank = F.coalesce(*[F.when(sub == name, i) for i, name in enumerate(DOCUMENT_FOLDERS)], F.when(F.size(rest) == 1, len(DOCUMENT_FOLDERS)))
    rows = files.where(F.size(parts) > depth).withColumn("task", F.array_join(F.slice(parts, 1, depth), "/")).withColumn("_rank", rank)
    first = rows.groupBy("task").agg(F.min("_rank").alias("_rank"))
    # not a filter that the source takes: the other side of the join looks at files of all extensions
    good = F.array_contains(F.array(*map(F.lit, EXTENSIONS)), c("ext")) & ((c("_rank") < len(DOCUMENT_FOLDERS)) | ~c("name").isin(CONTROL_FILES))
    return rows.join(first, ["task", "_rank"]).where(good).select("task", "path", "name", "ext", "size")


def _contents(folder: str):
    """(path, value): the bytes of listed files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        paths, values, size = [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], ["path", "value"])
        for b in batches:
            for path in b.column("path").to_pylist():
                with store.open_input_stream(path) as file:
                    values.append(file.read())
                paths.append(path)
                size += len(values[-1])
                if len(paths) >= ROWS or size >= BYTES:
                    yield batch()
                    paths, values, size = [], [], 0
        yield batch()

    return read


def json_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """path (below the folder), json (VARIANT) of the files with these names; what is no JSON object is left out, and what is hidden
    (below the folder, with a name that begins with a dot or an underscore)."""
    path = below(c("path"), folder)
    files = listed(spark, folder).where(c("ext").isin(sorted({extension(n) for n in names})) & c("name").isin(names)).where(~path.rlike("(^|/)([.]|_[^/=]*(/|$))"))
    texts = files.select("path").repartition("path").mapInArrow(_contents(folder), "path string, value binary")
    rows = texts.select(path.alias("path"), F.try_parse_json(F.regexp_replace(c("value").cast("string"), "^\ufeff", "")).alias("json"))
    return rows.where(F.schema_of_variant("json").startswith("OBJECT"))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """task, task_key (without scenario-n), n_passed, n_criteria, rate (percent, one decimal), all_pass of each score file."""
    rows = json_files(spark, folder, ["scores.json"])
    task = F.regexp_replace("path", "/?scores[.]json$", "")
    n = lambda name: F.coalesce(F.try_variant_get("json", f"$.{name}", "long"), F.lit(0))
    key = F.array_join(F.filter(F.split(task, "/"), lambda x: ~x.rlike("^scenario-[0-9]+$")), "/")
    got = rows.select(task.alias("task"), key.alias("task_key"), n("n_passed").alias("n_passed"), n("n_criteria").alias("n_criteria"), F.coalesce(F.try_variant_get("json", "$.all_pass", "boolean"), F.lit(False)).alias("all_pass"))
    return got.withColumn("rate", F.when(c("n_criteria") > 0, F.round(100 * c("n_passed") / c("n_criteria"), 1)).otherwise(0.0))
