"""MATLAB recordings (Level 4 and 5) as a Spark data source, for reading and writing.

``spark.read.format("matfile").load(folder)`` gives a row a variable: path, ord
(its place in the file), var, data (all values, column by column) and
read_error. A file that can't be read gives one row with the error. The option
``channel`` keeps variables whose name contains it, before their data are
decoded. ``recordings`` does the same through Spark's own ``binaryFile``.

``df.write.format("matfile").mode("append").save(folder)`` writes a Level-5 file for each
row of (path, variables: array of (var, data)), paths being below the folder. Tasks write
into a folder of their own; when all are done the files are moved to their places, and if
the job fails everything it wrote is removed, so readers see whole jobs only. With mode
``overwrite`` the .mat files that were there go once the new ones are written.

Both use Arrow's file systems, so a folder may be local to all executors or in any store
these know (``s3://``, ``gs://``, ``hdfs://`` ...); ``recordings`` also reads what only
Spark knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, ord int, var string, data array<double>, read_error string"

#: The format's numeric types.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED, _UTF8 = 14, 15, 16
_NUMERIC_CLASSES = range(6, 16)


#: The number types of Level 4, by the third digit of a matrix's type.
_TYPES_4 = ("f8", "f4", "i4", "i2", "u2", "u1")

WRITTEN = "path string, variables array<struct<var string, data array<double>>>"


class MatError(ValueError):
    pass


def _level4(data: bytes, channel: str | None) -> Iterator[tuple[str, np.ndarray]]:
    """A Level-4 file: matrices one after the other, each with a header of five numbers and its name. Text and sparse matrices are skipped."""
    at = 0
    while at < len(data):
        if at + 20 > len(data):
            raise MatError("truncated header")
        order = "<" if 0 <= struct.unpack_from("<i", data, at)[0] < 5000 else ">"
        kind, rows, columns, imaginary, size = struct.unpack_from(order + "iiiii", data, at)
        machine, _, number, what = kind // 1000, kind // 100 % 10, kind // 10 % 10, kind % 10
        if not 0 <= kind < 5000 or number >= len(_TYPES_4) or machine > 1 or min(rows, columns, size) < 0:
            raise MatError(f"unknown matrix type {kind}")
        dtype = np.dtype(_TYPES_4[number]).newbyteorder("<" if machine == 0 else ">")
        begin, count = at + 20 + size, rows * columns
        at = begin + count * dtype.itemsize * (2 if imaginary else 1)
        if at > len(data):
            raise MatError("truncated content")
        name = data[begin - size : begin].decode("latin-1").rstrip("\0")
        if what == 0 and not name.startswith("__") and not (channel and channel.lower() not in name.lower()):
            yield name, np.frombuffer(data, dtype, count, begin).astype(float)


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """(type, content, start of the next element); small elements hold up to four bytes in their tag."""
    if at + 8 > len(data):
        raise MatError("truncated element")
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    if at + 8 + size > len(data):
        raise MatError("truncated content")
    padded = size if kind == _COMPRESSED else -(-size // 8) * 8
    return kind, data[at + 8 : at + 8 + size], at + 8 + padded


def _numbers(kind: int, content: bytes, order: str) -> np.ndarray:
    if kind not in _TYPES:
        raise MatError(f"no numbers: type {kind}")
    return np.frombuffer(content, np.dtype(_TYPES[kind]).newbyteorder(order)).astype(float)


def variables(data: bytes, channel: str | None = None) -> Iterator[tuple[str, np.ndarray]]:
    """(name, values) of the numeric variables; names that start with __ are skipped."""
    if len(data) >= 20 and 0 in data[:4]:  # Level 5 begins with text
        yield from _level4(data, channel)
        return
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise MatError("neither a Level-5 nor a Level-4 file")
    order = "<" if data[126:128] == b"IM" else ">"
    at = 128
    while at < len(data):
        kind, content, at = _element(data, at, order)
        if kind == _COMPRESSED:
            try:
                kind, content, _ = _element(zlib.decompress(content), 0, order)
            except zlib.error as error:
                raise MatError(str(error)) from error
        if kind != _MATRIX:
            continue
        _, flags, inner = _element(content, 0, order)
        _, _, inner = _element(content, inner, order)
        _, name, inner = _element(content, inner, order)
        text = name.decode("latin-1").rstrip("\0")
        if text.startswith("__") or struct.unpack_from(order + "I", flags)[0] & 0xFF not in _NUMERIC_CLASSES or channel and channel.lower() not in text.lower():
            continue
        part, values, _ = _element(content, inner, order)
        yield text, _numbers(part, values, order)


def _padded(kind: int, content: bytes) -> bytes:
    return struct.pack("<II", kind, len(content)) + content + bytes(-len(content) % 8)


def encoded(matrices: dict[str, np.ndarray], compressed: bool = True) -> bytes:
    """A Level-5 file of double matrices; vectors become one column."""
    out = [b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"]
    for name, values in matrices.items():
        values = np.atleast_1d(np.asarray(values, float))
        values = values[:, None] if values.ndim == 1 else values
        body = _padded(6, struct.pack("<II", 6, 0)) + _padded(5, struct.pack("<ii", *values.shape)) + _padded(1, name.encode("latin-1")) + _padded(9, values.tobytes("F"))
        matrix = struct.pack("<II", _MATRIX, len(body)) + body
        out.append(struct.pack("<II", _COMPRESSED, len(z := zlib.compress(matrix))) + z if compressed else matrix)
    return b"".join(out)


def _rows(path: str, data: bytes, channel: str | None) -> list[tuple]:
    try:
        found = list(variables(data, channel))
    except (MatError, struct.error, ValueError) as error:
        return [(path, None, None, None, str(error) or type(error).__name__)]
    return [(path, k, name, values.tolist(), None) for k, (name, values) in enumerate(found)]


def decoded(files: DataFrame, channel: str | None = None) -> DataFrame:
    """binaryFile rows (path, content) -> SCHEMA; reads through Spark's own file systems."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.string()]
    names = ["path", "ord", "var", "data", "read_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if rows := _rows(path, data.as_py(), channel):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All .mat files below root (path, content ...); an error if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mat").load(root)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no .mat files below {root}")
    return files


def recordings(spark: SparkSession, root: str, channel: str | None = None) -> DataFrame:
    """SCHEMA for all .mat files below root, from any file system that Spark reads."""
    return decoded(scan(spark, root), channel)


def _store(root: str):
    """The file system of root, and root's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _listed(root: str) -> list[str]:
    """The .mat files below root, without those of unfinished jobs."""
    from pyarrow import fs

    store, at = _store(root)
    info = store.get_file_info(at)
    if info.is_file:
        return [at]
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    inside = lambda path: path[len(at) :].strip("/").split("/")
    return sorted(x.path for x in found if x.is_file and x.path.endswith(".mat") and not any(part.startswith("_") for part in inside(x.path)))


def register(spark: SparkSession) -> None:
    """Makes the format ``matfile`` known to the session."""
    import uuid
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options = dict(options)

        def partitions(self):
            found = _listed(self.options["path"])
            if not found:
                raise FileNotFoundError(f"no .mat files below {self.options['path']}")
            size = int(self.options.get("filesPerPartition", 16))
            return [InputPartition(found[k : k + size]) for k in range(0, len(found), size)]

        def read(self, partition):
            store, _ = _store(self.options["path"])
            for path in partition.value:
                with store.open_input_stream(path) as file:
                    yield from _rows(path, file.read(), self.options.get("channel"))

    @dataclass
    class Files(WriterCommitMessage):
        folder: str
        paths: list[str]

    class Writer(DataSourceArrowWriter):
        def __init__(self, options: dict[str, str], overwrite: bool):
            self.root, self.overwrite, self.job = options["path"], overwrite, f"_pending-{uuid.uuid4().hex}"

        def write(self, iterator):
            store, root = _store(self.root)
            folder, paths = f"{root}/{self.job}/{uuid.uuid4().hex}", []
            for batch in iterator:
                for path, found in zip(batch.column("path").to_pylist(), batch.column("variables"), strict=True):
                    parts = path.split("/")
                    if any(part in ("", ".", "..") or part.startswith("_") for part in parts):
                        raise ValueError(f"not a path below the folder: {path}")
                    content = encoded({v["var"].as_py(): v["data"].values.to_numpy(zero_copy_only=False) for v in found.values.take(pa.array(range(len(found.values))))} if found.is_valid else {})
                    store.create_dir("/".join([folder, *parts[:-1]]), recursive=True)
                    with store.open_output_stream(f"{folder}/{path}") as file:
                        file.write(content)
                    paths.append(path)
            return Files(folder, paths)

        def commit(self, messages):
            store, root = _store(self.root)
            before = _listed(self.root) if self.overwrite else []
            for message in messages:
                for path in message.paths if message else []:
                    store.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                    store.move(f"{message.folder}/{path}", f"{root}/{path}")
            written = {f"{root}/{path}" for message in messages if message for path in message.paths}
            for path in before:
                if path not in written:
                    store.delete_file(path)
            self._clear(store, root)

        def abort(self, messages):
            self._clear(*_store(self.root))

        def _clear(self, store, root):
            if store.get_file_info(f"{root}/{self.job}").type.name == "Directory":
                store.delete_dir(f"{root}/{self.job}")

    class MatFile(DataSource):
        @classmethod
        def name(cls):
            return "matfile"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

        def writer(self, schema, overwrite):
            return Writer(dict(self.options), overwrite)

    spark.dataSource.register(MatFile)


def write(files: DataFrame, root: str, mode: str = "append") -> int:
    """Writes files (WRITTEN) below root by the format ``matfile``; returns their number."""
    register(files.sparkSession)
    seen = Observation("matfiles")
    files.select("path", "variables").observe(seen, F.count(F.lit(1)).alias("n")).write.format("matfile").mode(mode).save(root)
    return seen.get["n"]


# ---- channels ----------------------------------------------------------------


def channel_of(variables_: DataFrame, mark: str, rule: str = "ends", into: str = "signal") -> DataFrame:
    """(path, into): the first variable of each file whose name ends with, contains, or contains in any case the mark."""
    name = F.col("var")
    matches = {"ends": name.endswith(mark), "contains": name.contains(mark), "any_case": F.lower(name).contains(mark.lower())}[rule]
    return variables_.filter(matches).groupBy("path").agg(F.min_by("data", "ord").alias(into))


def inspected(variables_: DataFrame) -> DataFrame:
    """path, n_samples_DE/FE/BA (the last match of each), rpm_from_file, read_error."""
    size = F.size("data").cast("long")
    last = lambda value, mark: F.max_by(value, F.when(F.col("var").endswith(mark), F.col("ord")))
    return variables_.groupBy("path").agg(
        *(last(size, f"_{c}_time").alias(f"n_samples_{c}") for c in ("DE", "FE", "BA")),
        last(F.get("data", F.lit(0)), "RPM").alias("rpm_from_file"),
        F.max("read_error").alias("read_error"),
    )


def enriched(manifest: DataFrame, variables_: DataFrame, path: str = "path") -> DataFrame:
    """manifest with the nine features of each file's drive-end signal and its rpm; null where there is none."""
    from ..functions.statistics import recording_features, with_statistics

    signal = channel_of(variables_, "DE_time", "any_case").withColumnRenamed("path", "_path")
    features = with_statistics(signal, "signal").select("_path", *(c.alias(k) for k, c in recording_features(F.col("stats")).items()))
    rpm = channel_of(variables_, "RPM", "any_case", "_rpm").select(F.col("path").alias("_rpm_path"), F.get("_rpm", F.lit(0)).alias("rpm"))
    return manifest.join(features, F.col(path) == F.col("_path"), "left").join(rpm, F.col(path) == F.col("_rpm_path"), "left").drop("_path", "_rpm_path")
