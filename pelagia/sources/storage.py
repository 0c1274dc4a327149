"""Small wrappers over the Hadoop file system API, used on the driver for listings only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileInfo:
    path: str
    name: str
    size: int
    modified_ms: int
    folder: bool


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def filesystem(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return filesystem(spark, path).exists(_path(spark, path))


def children(spark: SparkSession, path: str) -> list[FileInfo]:
    fs = filesystem(spark, path)
    return sorted((FileInfo(s.getPath().toString(), s.getPath().getName(), s.getLen(),
                            s.getModificationTime(), s.isDirectory())
                   for s in fs.listStatus(_path(spark, path))), key=lambda f: f.name)


def data_files(spark: SparkSession, path: str) -> list[FileInfo]:
    """The files behind a source: the file itself, or every visible file under a folder."""
    fs = filesystem(spark, path)
    status = fs.getFileStatus(_path(spark, path))
    if not status.isDirectory():
        return [FileInfo(path, status.getPath().getName(), status.getLen(),
                         status.getModificationTime(), False)]
    found: list[FileInfo] = []
    for item in children(spark, path):
        if item.name.startswith(("_", ".")):
            continue
        found.extend(data_files(spark, item.path) if item.folder else [item])
    return found


def total_size(spark: SparkSession, path: str) -> int:
    return sum(f.size for f in data_files(spark, path))


def rename(spark: SparkSession, source: str, target: str) -> bool:
    return filesystem(spark, source).rename(_path(spark, source), _path(spark, target))


def remove(spark: SparkSession, path: str) -> bool:
    return filesystem(spark, path).delete(_path(spark, path), True)


def make_folder(spark: SparkSession, path: str) -> None:
    filesystem(spark, path).mkdirs(_path(spark, path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    stream = filesystem(spark, path).create(_path(spark, path), True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small driver-side file such as a manifest."""
    fs = filesystem(spark, path)
    stream = fs.open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Atomic rename over an existing file."""
    jvm = spark._jvm
    rename_type = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename_type, 1)
    how[0] = rename_type.OVERWRITE
    root = filesystem(spark, target).makeQualified(_path(spark, target)).toUri()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        root, spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(_path(spark, source), _path(spark, target), how)
