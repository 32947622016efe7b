"""Files behind table rows: references, path resolution, scan and text extraction."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.config import TableConfig
from lectern.functions import text as X
from lectern.operators import documents as D
from lectern.operators.joins import resolve_paths
from lectern.operators.prefilter import maybe_among
from lectern.operators.skew import fits_broadcast, skewed_join
from lectern.session import materialise

#: Paths sent to every task at most; they are measured in bytes too.
WANTED_PATHS = 500_000
#: Splits of a scan of files that one task reads at most, and tasks for each core below which none are put together.
SPLITS, TASKS_PER_CORE = 16, 3
#: Files and bytes of files that a task opens, about; names that a listing and bytes that a reader hand on at once.
TASK_FILES, TASK_BYTES, NAMES_AT_ONCE, BYTES_AT_ONCE = 4096, 64 << 20, 4096, 4 << 20


def file_refs(df: DataFrame, cfg: TableConfig) -> DataFrame:
    """One row per non-blank file reference of a table.

    The parent key goes along, and references beyond the first file column
    carry their column name, so that chunk keys never collide.
    """
    schema = df.schema
    pk = D.key_value(schema, cfg.pk_column, D.render(schema, cfg))

    def text(name: str) -> Column:
        return X.clean(F.col(name), schema[name].dataType) if name else F.lit("")

    refs = F.array(*[
        F.struct(F.lit(i).alias("path_no"), F.lit(path).alias("path_col"), text(path).alias("path"),
                 text(kind).alias("file_type"))
        for i, (path, kind) in enumerate(cfg.file_columns)
    ])
    return (
        df.select(F.lit(cfg.key).alias("table_key"), pk.alias("row_id"), F.explode(refs).alias("ref"))
        .select("table_key", "row_id", "ref.*")
        .where(F.col("path") != "")
        .withColumn("parent_id", F.concat_ws(".", "table_key", "row_id"))
    )


# ---- extraction --------------------------------------------------------------


# Patterns of comma-separated files. Groups and runs are possessive: they need no way back, and long fields no stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:{_QUOTED}(?:"[^,\n]*+|\z)|[^,\n]*+)'


def _csv_records(content: Column) -> Column:
    """Rows of a comma-separated file as they stand; a quoted field may hold line ends, one without its end takes the rest."""
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(rf"\n({_FIELD}(?:,{_FIELD})*+)"), F.lit(1))


def _csv_fields(record: Column) -> Column:
    """Values of a row; none for an empty line. Only a quote that begins a field opens one."""
    def value(field: Column) -> Column:
        inside = F.regexp_extract(field, rf'^"({_QUOTED[1:]})', 1)
        rest = F.substr(field, F.length(inside) + 3)
        return F.when(F.startswith(field, F.lit('"')), F.concat(F.replace(inside, F.lit('""'), F.lit('"')), rest)).otherwise(field)

    fields = F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf",({_FIELD})"), F.lit(1)), value)
    return F.when(record == "", F.array().cast("array<string>")).otherwise(fields)


def _csv_text(content: Column) -> Column:
    return F.array_join(F.transform(_csv_records(content), lambda r: F.array_join(_csv_fields(r), " | ")), "\n")


def _csv_documents(content: Column) -> Column:
    """One text per row below the header: ``column: value`` lines. A value that is missing is empty."""
    def texts(rows: Column) -> Column:
        def one(header: Column, row: Column) -> Column:
            return F.array_join(F.transform(header, lambda name, i: F.concat(name, F.lit(": "), F.coalesce(F.get(row, i), F.lit("")))), "\n")

        below = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.size(r) > 0)
        return X.let(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")),
                     lambda header: F.transform(below, lambda r: one(header, r)))

    return X.let(F.transform(_csv_records(content), _csv_fields), texts)


def _plain_text(content: Column) -> Column:
    return F.regexp_replace(X.decode_bytes(content), "\r\n?", "\n")


def _html_text(content: Column) -> Column:
    return X.html_to_text(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n"))


class Extractors:
    """Text extractors by file extension.

    ``native`` ones map a binary Column to a text Column. ``python`` ones map
    the bytes of one file to its text and run as an Arrow UDF on the files of
    their extensions only; an error there is kept with the file. ``records``
    ones give several texts per file, for :meth:`documents`; native ones map a binary Column to an array of texts.
    """

    def __init__(self) -> None:
        self._native: dict[str, Callable[[Column], Column]] = {}
        self._python: dict[str, Callable[[bytes], str]] = {}
        self._records: dict[str, Callable[[bytes], list[str]]] = {}
        self._native_records: dict[str, Callable[[Column], Column]] = {}
        self.register_native(("txt", "text", "log", "md", "rst"), _plain_text)
        self.register_native(("html", "htm"), _html_text)
        self.register_native(("csv", "tsv"), _csv_text)
        self.register_native_records(("csv", "tsv"), _csv_documents)

    def register_native(self, extensions: Sequence[str], fn: Callable[[Column], Column]) -> None:
        for e in extensions:
            self._native[e.lower().lstrip(".")] = fn

    def register_python(self, extensions: Sequence[str], fn: Callable[[bytes], str]) -> None:
        for e in extensions:
            self._python[e.lower().lstrip(".")] = fn

    def register_records(self, extensions: Sequence[str], fn: Callable[[bytes], list[str]]) -> None:
        for e in extensions:
            self._records[e.lower().lstrip(".")] = fn

    def register_native_records(self, extensions: Sequence[str], fn: Callable[[Column], Column]) -> None:
        for e in extensions:
            self._native_records[e.lower().lstrip(".")] = fn

    def supported(self) -> list[str]:
        return sorted({*self._native, *self._python})

    def extract(self, df: DataFrame, content: str = "content", extension: str = "extension") -> DataFrame:
        """Adds ``text`` (NULL when blank or not extractable) and ``error``."""
        ext = F.col(extension)
        by_function: dict[Callable, list[str]] = {}
        for e, fn in self._native.items():
            by_function.setdefault(fn, []).append(e)
        text = F.lit(None).cast("string")
        for fn, extensions in by_function.items():
            text = F.when(ext.isin(extensions), fn(F.col(content))).otherwise(text)
        out = df.withColumn("_native", text)
        if self._python:
            functions = dict(self._python)

            @F.pandas_udf("text string, error string")
            def run(contents: pd.Series, extensions: pd.Series) -> pd.DataFrame:
                texts, errors = [], []
                for data, e in zip(contents, extensions):
                    done, failure = None, None
                    if data is not None:
                        try:
                            done = functions[e](data)
                        except Exception as exc:
                            failure = f"{type(exc).__name__}: {exc}"
                    texts.append(done)
                    errors.append(failure)
                return pd.DataFrame({"text": texts, "error": errors}, dtype="object")

            own = F.when(ext.isin(list(functions)), F.col(content))
            out = out.withColumn("_python", run(own, ext))
        else:
            out = out.withColumn("_python", F.lit(None).cast("struct<text:string,error:string>"))
        stripped = X.strip(F.coalesce("_native", "_python.text"))
        return (out.withColumn("text", X.let(stripped, lambda t: F.when(t != "", t))).withColumn("error", F.col("_python.error"))
                .drop("_native", "_python"))

    def documents(self, df: DataFrame, content: str = "content", extension: str = "extension") -> DataFrame:
        """Adds ``texts``: the texts of a file of records, else its one text; empty when there is none."""
        functions = dict(self._records)
        ext = F.col(extension)
        records = F.lit(None).cast("array<string>")
        for e, fn in self._native_records.items():
            if e not in functions:
                records = F.when(ext == e, fn(F.col(content))).otherwise(records)
        if functions:
            @F.pandas_udf("array<string>")
            def split(contents: pd.Series, extensions: pd.Series) -> pd.Series:
                return pd.Series([None if data is None else functions[e](data) for data, e in zip(contents, extensions)], dtype="object")

            many = ext.isin(list(functions))
            records = F.coalesce(split.asNondeterministic()(F.when(many, F.col(content)), ext), records)
        single = self.extract(df, content, extension)
        return single.withColumn("texts", F.filter(F.coalesce(records, F.array("text")), lambda t: X.strip(t) != ""))


# ---- files -------------------------------------------------------------------


def plain_path(path: str) -> str:
    """A path as ``scan_files`` shows it: a local one without a scheme."""
    return re.sub("^file:/+", "/", path)


def _uri(spark: SparkSession, root: str) -> tuple[str, str, bool]:
    """A folder as a URI and as a path for people, both with its file system, and whether it is there as a folder. One
    without a scheme belongs to the session's default file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(place)
    uri = str(full.toUri())
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    return uri, full.toString(), system.exists(place) and system.getFileStatus(place).isDirectory()


def _left_out(name: str, length: int | None) -> bool:
    """What Spark's readers leave out: empty files, and hidden files and folders."""
    hidden = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    if length is None:
        return hidden and not name.startswith(("_common_metadata", "_metadata"))
    return hidden or length == 0


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, str, int | None]]:
    """Name, path and length of what is in a folder; a folder in it has no length. Local ones are read as a stream."""
    if not isinstance(system, fs.LocalFileSystem):
        for found in system.get_file_info(fs.FileSelector(folder)):
            yield found.base_name, found.path, None if found.type == fs.FileType.Directory else found.size
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                entry.name.encode()
                yield entry.name, entry.path, None if entry.is_dir() else entry.stat().st_size
            except (FileNotFoundError, UnicodeEncodeError):  # gone meanwhile, or a name that is no text
                continue


def _list_files(spark: SparkSession, uri: str, base: str) -> DataFrame:
    """``(path, length)`` of the files below a folder, in its file system's own paths. Folders are listed by tasks, those
    of one depth side by side, and what is found is written down: the driver sees the number of folders only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(uri)

        def batch(rows: list[tuple[str, int | None]]) -> pa.RecordBatch:
            paths, sizes = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

        for folders in batches:
            for folder in folders.column(0).to_pylist():
                rows = []
                for name, path, length in _entries(system, folder):
                    if not _left_out(name, length):
                        rows.append((path, length))
                    if len(rows) == NAMES_AT_ONCE:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    levels, folders = [], spark.createDataFrame([(base,)], "path string").coalesce(1)
    while True:
        found = materialise(folders.mapInArrow(run, "path string, length bigint").repartition(tasks, "path"), "listing")
        levels.append(found.where("length IS NOT NULL"))
        below = found.where("length IS NULL").select("path")
        n = below.count()
        if not n:
            return reduce(DataFrame.unionByName, levels)
        folders = below.repartition(min(n, tasks), "path")


def _read_files(uri: str, path: Column) -> Column:
    """The bytes of each file. Few are held at once, whatever the number of paths in a batch."""
    @F.arrow_udf("binary")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        system, _ = fs.FileSystem.from_uri(uri)
        for paths in batches:
            held, size = [], 0
            for p in paths.to_pylist():
                with system.open_input_file(p) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BYTES_AT_ONCE:
                    yield pa.array(held, pa.binary())
                    held, size = [], 0
            yield pa.array(held, pa.binary())

    return read(path)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder as ``(path, length, content)``; the content is read only when used.

    Tasks list the folder and open its files, in about as many tasks as bytes and files ask for. Spark's own reader of
    files holds the status of each of them on the driver, and once more for each scan. It still reads patterns, single
    files and stores that pyarrow cannot open; there, neighbouring splits are put together, never to fewer than the
    cores keep busy, as Spark counts every file as 4 MB at least.
    """
    uri, full, is_folder = _uri(spark, root)
    try:
        base = fs.FileSystem.from_uri(uri)[1].rstrip("/") if is_folder else ""
    except (pa.ArrowException, OSError):
        base = ""
    if not base or not full.endswith(base):
        return _scan_by_spark(spark, root)
    place = "" if full.startswith("file:") else full.removesuffix(base)
    files = _list_files(spark, uri, base)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(min(n, TASKS_PER_CORE * spark.sparkContext.defaultParallelism), -(-n // TASK_FILES), -(-size // TASK_BYTES), 1)
    return files.repartition(tasks, "path").select(
        F.concat(F.lit(place), "path").alias("path"), "length", _read_files(uri, F.col("path")).alias("content"))


def _scan_by_spark(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    splits = files.rdd.getNumPartitions()
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-splits // SPLITS))
    if tasks < splits:
        files = files.coalesce(tasks)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content")


def place_refs(refs: DataFrame, files: DataFrame, prefixes: Sequence[str] = X.UPLOAD_PREFIXES) -> DataFrame:
    """File references with ``resolved_path`` and ``extension``, written once for the steps that follow."""
    placed = resolve_paths(refs, files.select("path"), prefixes=prefixes)
    typed = placed.withColumn("extension", X.file_extension(F.col("resolved_path"), F.col("file_type")))
    return materialise(typed, "placed")


def _wanted(placed: DataFrame, files: DataFrame) -> DataFrame:
    """The files that are referred to, with their bytes. These stay where they are read as long as the paths are few
    enough to be sent to every task; beyond that, bytes of files that may be wanted are shuffled, and of no others."""
    wanted = materialise(placed.where(F.col("resolved_path").isNotNull()).select("resolved_path", "extension").distinct(), "wanted")
    named = files.select(F.col("path").alias("resolved_path"), "content")
    if fits_broadcast(wanted, WANTED_PATHS):
        return named.join(F.broadcast(wanted), "resolved_path")
    return maybe_among(named, "resolved_path", wanted.select("resolved_path").distinct()).join(wanted, "resolved_path")


def extract_files(placed: DataFrame, files: DataFrame, extractors: Extractors | None = None) -> DataFrame:
    """``(resolved_path, extension, text, error)``; a file named by many rows is read once."""
    return (extractors or Extractors()).extract(_wanted(placed, files)).drop("content")


def text_parts(texts: DataFrame, *columns: str) -> DataFrame:
    """One row per text of ``texts``: its columns, the number of texts as ``parts``, ``part`` and ``text``.

    The texts are counted in a step of their own: counted beside the generator, a copy of the whole array would go
    along with each of its texts.
    """
    counted = texts.select(*columns, F.size("texts").alias("parts"), "texts")
    return (counted.select(*columns, "parts", F.posexplode_outer("texts").alias("part", "text"))
            .where(F.col("text").isNotNull()))


def file_documents(placed: DataFrame, files: DataFrame, extractors: Extractors | None = None) -> DataFrame:
    """``(resolved_path, extension, parts, part, text)``: the texts of each file; a file named by many rows is read once."""
    return text_parts((extractors or Extractors()).documents(_wanted(placed, files)), "resolved_path", "extension")


def extract_refs(refs: DataFrame, files: DataFrame, extractors: Extractors | None = None,
                 prefixes: Sequence[str] = X.UPLOAD_PREFIXES) -> DataFrame:
    """File references with ``resolved_path``, ``extension``, ``text`` and ``error``."""
    placed = place_refs(refs, files, prefixes)
    return skewed_join(placed, extract_files(placed, files, extractors), ["resolved_path", "extension"], "left")


def file_results(extracted: DataFrame) -> DataFrame:
    """One result row per reference: extracted or not, text length, error."""
    return extracted.select(
        "table_key", "row_id", "path", F.col("text").isNotNull().alias("extracted"),
        F.coalesce(F.length("text"), F.lit(0)).alias("text_length"), "error")


def csv_rows_as_documents(df: DataFrame) -> DataFrame:
    """One text per CSV row: ``column: value`` lines."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit(""))) for c in df.columns]
    return df.withColumn("text", F.concat_ws("\n", *lines))


def write_files(df: DataFrame, root: str, name: str, content: str) -> DataFrame:
    """One file per row, ``(path, length)`` of the files written.

    Writes through the file system of the folder's URI from the tasks; a
    repeated task writes the same file again. A path without a scheme belongs
    to the session's default file system, as it does for ``scan_files``.
    """
    target, _, _ = _uri(df.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(target)
        system.create_dir(base, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for file_name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{base}/{file_name}") as out:
                    out.write(data)
                paths.append(f"{base}/{file_name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())],
                                             names=["path", "length"])

    return df.select(F.col(name), F.col(content)).mapInArrow(run, "path string, length bigint")
