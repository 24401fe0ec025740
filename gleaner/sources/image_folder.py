"""Image folders as DataFrames of facts: one row per image file, decoded once.

``read_images`` reads a mounted folder; ``ImageFolder`` is the same as a batch data source.  Both list hidden names, empty files and
upper-case extensions, which Spark's own file sources skip; directory links are not followed.  The
driver lists ``LISTED`` entries, breadth first; folders it has not come to are listed by the tasks that read them.
``facts_of`` makes the same rows from any (path, content) table; it is taken with Spark's
``binaryFile`` for roots that name a store (``scheme://``).  An unreadable file is a row with its error, never a failed task.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleaner.functions.columns import degenerate_kind, split_of
from gleaner.functions.imaging import facts

#: Extensions that count as images, in lower case.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
#: Bytes and files of one partition, and entries that the driver lists.
PARTITION_BYTES, PARTITION_FILES, LISTED = 64 << 20, 2000, 50_000

RAW = "path string, rel string, size_bytes long, ok boolean, error string, width int, height int, mode string, pmin int, pmax int, dhash long, thumb16 array<float>, decodable boolean"
_ARROW = pa.schema([
    ("path", pa.string()), ("rel", pa.string()), ("size_bytes", pa.int64()), ("ok", pa.bool_()), ("error", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()),
    ("pmin", pa.int32()), ("pmax", pa.int32()), ("dhash", pa.int64()), ("thumb16", pa.list_(pa.float32())), ("decodable", pa.bool_()),
])


def is_image(name: str) -> bool:
    return os.path.splitext(name)[1].lower() in EXTENSIONS


def _row(path: str, rel: str, data: bytes | None, size: int, thumb: int = 16, hash_size: int = 8, error: str | None = None) -> dict:
    out = facts(data, thumb, hash_size) if data is not None else facts(b"") | {"error": error}
    out["thumb16"] = out.pop("thumb")
    return out | {"path": path, "rel": rel, "size_bytes": size}


def _entries(folder: str) -> tuple[list[tuple[str, int]], list[str]]:
    """(image files with their sizes, folders) directly in a folder, by name; links to folders are neither."""
    files, folders = [], []
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [], []
    for e in found:
        if e.is_dir(follow_symlinks=False):
            folders.append(e.path)
        elif is_image(e.name) and not e.is_dir():
            try:
                files.append((e.path, e.stat().st_size))
            except OSError:
                files.append((e.path, 0))
    return files, folders


class _Share(InputPartition):
    """Files to read (path, size), and folders to list and read with all below them."""

    def __init__(self, files: list[tuple[str, int]], folders: list[str]):
        self.files, self.folders = files, folders

    def all_files(self) -> Iterator[tuple[str, int]]:
        yield from self.files
        folders = list(self.folders)
        while folders:
            files, more = _entries(folders.pop())
            yield from files
            folders += more


class _Reader(DataSourceReader):
    def __init__(self, root: str, thumb: int, hash_size: int, listed: int):
        self.root, self.thumb, self.hash_size, self.listed = os.path.abspath(root), thumb, hash_size, listed

    def partitions(self) -> list[_Share]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no such folder: {self.root}")
        out: list[_Share] = []
        held, size, seen = [], 0, 0
        folders = deque([self.root])
        while folders and seen < self.listed:
            files, more = _entries(folders.popleft())
            folders += more
            seen += len(files) + len(more)
            for path, n in files:
                if held and (size + n > PARTITION_BYTES or len(held) >= PARTITION_FILES):
                    out.append(_Share(held, []))
                    held, size = [], 0
                held.append((path, n))
                size += n
        out += [_Share([], [folder]) for folder in folders]
        return [*out, _Share(held, [])] if held or not out else out

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        return _facts(partition.all_files(), self.root, self.thumb, self.hash_size)


def _facts(files: Iterator[tuple[str, int]], root: str, thumb: int, hash_size: int) -> Iterator[pa.RecordBatch]:
    """``RAW`` rows of the files, read and decoded one by one."""
    rows = []
    for path, size in files:
        rel = os.path.relpath(path, root).replace(os.sep, "/")
        try:
            with open(path, "rb") as f:
                rows.append(_row(path, rel, f.read(), size, thumb, hash_size))
        except OSError as e:
            rows.append(_row(path, rel, None, size, error=f"Unreadable: {type(e).__name__}"))
        if len(rows) == 256:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, _ARROW)


class ImageFolder(DataSource):
    """spark.read.format("gleaner_images").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "gleaner_images"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("thumb", 16)), int(self.options.get("hashSize", 8)), int(self.options.get("listed", LISTED)))


def with_derived(raw: DataFrame) -> DataFrame:
    """Split and degenerate kind, as expressions over the raw facts."""
    return raw.withColumn("split", split_of(F.col("rel"))).withColumn("degenerate", degenerate_kind(F.col("pmin"), F.col("pmax")))


def in_store(root: str) -> bool:
    """Whether the root names a store that only Spark's readers open."""
    return "://" in root


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, ...) of the files of a store below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def read_images(spark: SparkSession, root: str, thumb: int = 16, hash_size: int = 8) -> DataFrame:
    """Facts of every image below ``root``: a folder that driver and executors can open, or a store.

    ``thumb``: side of the thumbnail; ``hash_size``: rows of the difference hash (at most 8).
    """
    if in_store(root):
        return facts_of(files_below(spark, root), root, thumb, hash_size)
    # What the data source would read in its partitions, dealt to more tasks and without the processes that plan it.
    root = os.path.abspath(root)
    shares = _Reader(root, thumb, hash_size, LISTED).partitions()
    found = [(path, size, False) for s in shares for path, size in s.files] + [(folder, 0, True) for s in shares for folder in s.folders]
    listed = spark.createDataFrame(found, "path string, size long, folder boolean")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sizes, folders = (c.to_pylist() for c in b.columns)
            files = [(p, n) for p, n, folder in zip(paths, sizes, folders, strict=True) if not folder]
            yield from _facts(_Share(files, [p for p, folder in zip(paths, folders, strict=True) if folder]).all_files(), root, thumb, hash_size)

    tasks = max(len(shares), min(spark.sparkContext.defaultParallelism, len(found)), 1)
    return with_derived(listed.repartition(tasks).mapInArrow(read, RAW))


def facts_of(contents: DataFrame, root: str, thumb: int = 16, hash_size: int = 8) -> DataFrame:
    """The same facts from a table (path, content), paths being below ``root``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, r, c in zip(*b.columns, strict=True):
                data = c.as_py()
                yield pa.RecordBatch.from_pylist([_row(p.as_py(), r.as_py(), data, len(data or b""), thumb, hash_size, "Unreadable: no content")], _ARROW)

    prefix = root.rstrip("/") + "/"
    # Spark writes a local path of a store with one slash or three after the scheme.
    path, own = (F.regexp_replace(F.col("path"), "^file:/+", "file:///"), re.sub("^file:/+", "file:///", prefix)) if in_store(root) else (F.col("path"), prefix)
    rel = F.when(path.startswith(own), F.substring(path, len(own) + 1, 1 << 30)).otherwise(path)
    keep = F.lower(F.regexp_extract(rel, r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)
    return with_derived(contents.select(path.alias("path"), rel.alias("rel"), "content").where(keep).mapInArrow(read, RAW))
