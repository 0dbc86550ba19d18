"""Readers of time series: text tables by Spark's own sources, array files through their bytes.

Every path goes through Spark's readers, so any file system that Spark knows will do.
"""

from __future__ import annotations

import io
import pickle
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".tsv", ".txt", ".npy", ".mat", ".pkl", ".nii", ".nii.gz")


def _bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row.content)


def array_panel(spark: SparkSession, data: np.ndarray, rois: list[str] | None = None) -> DataFrame:
    """(subject, t, roi, x) of an array (T, P) or (S, T, P)."""
    cube = np.asarray(data, float)
    cube = cube[None] if cube.ndim == 2 else cube
    if cube.ndim != 3:
        raise ValueError("an array must be (T, P) or (S, T, P)")
    s, t, p = cube.shape
    import pandas as pd

    names = np.array(rois, object) if rois else np.arange(p)
    frame = pd.DataFrame({"subject": np.repeat(np.arange(s), t * p), "t": np.tile(np.repeat(np.arange(t), p), s), "roi": np.tile(names, s * t), "x": cube.ravel()})
    return spark.createDataFrame(frame, f"subject long, t long, roi {'string' if rois else 'long'}, x double")


def read_matrix_text(spark: SparkSession, path: str) -> DataFrame:
    """A whitespace-separated matrix as a panel; rows are times in order of the file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda v: F.trim(v) != "")).alias("t", "line"))
    cells = rows.select("t", F.posexplode(F.split(F.trim("line"), "\\s+")).alias("roi", "v"))
    return cells.select(F.lit(0).cast("long").alias("subject"), F.col("t").cast("long").alias("t"), F.col("roi").cast("long").alias("roi"), F.expr("try_cast(v as double)").alias("x"))


def read_tsv(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A table of series as a panel. If each cell of the first row is a number there is no header, else it names the regions.

    `n/a` and other text are missing; columns and times without any value are left out, and times renumbered.
    """
    first = spark.read.text(path).first()
    if first is None:
        return spark.createDataFrame([], "subject long, t long, roi string, x double")
    cells = [c.strip() for c in first.value.split(separator)]

    def number(c: str) -> bool:
        try:
            return np.isfinite(float(c))
        except ValueError:
            return False

    header = not all(map(number, cells))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda v: F.trim(v) != "")).alias("line_no", "line"))
    if header:
        rows = rows.filter("line_no > 0")
    names = F.array(*[F.lit(c if header else str(k)) for k, c in enumerate(cells)])
    long = rows.select("line_no", F.posexplode(F.split("line", separator)).alias("k", "v")).select("line_no", F.get(names, F.col("k")).alias("roi"), F.expr("try_cast(trim(v) as double)").alias("x")).filter("x is not null and not isnan(x)")
    places = long.select("line_no").distinct().selectExpr("line_no", "row_number() over (order by line_no) - 1 as t")  # the times of one file
    return long.join(places, "line_no").select(F.lit(0).cast("long").alias("subject"), F.col("t").cast("long").alias("t"), "roi", "x")


def read_confounds(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """(subject, t, name, x) of a delimited file with a header; the delimiter is the most frequent of tab, comma, semicolon.

    Of columns, those the file lacks are dropped without notice.
    """
    first = spark.read.text(path).first()
    separator = max("\t,;", key=(first.value if first else "").count)
    table = read_tsv(spark, path, separator)
    table = table.select("subject", "t", F.col("roi").alias("name"), "x")
    return table.filter(F.col("name").isin(columns)) if columns is not None else table


class _ArraysOnly(pickle.Unpickler):
    """Unpickles NumPy arrays, numbers, text and containers; anything else is refused."""

    allowed = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer")}

    def find_class(self, module, name):
        if (module, name) in self.allowed:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1"}


def parse_mat5(data: bytes) -> dict[str, np.ndarray]:
    """Numeric arrays of a MATLAB level 5 file by name; other variables are left out."""
    if data[:8] == b"\x89HDF\r\n\x1a\n" or b"MATLAB 7.3" in data[:128]:
        return _parse_mat73(data)
    order = "<" if data[126:128] == b"IM" else ">"

    def element(buf: bytes, at: int) -> tuple[int, bytes, int]:
        kind, size = struct.unpack_from(order + "II", buf, at)
        if kind >> 16:
            small = kind >> 16
            return kind & 0xFFFF, buf[at + 4 : at + 4 + small], at + 8
        return kind, buf[at + 8 : at + 8 + size], at + 8 + size + (-size % 8 if kind != 15 else 0)

    def matrix(buf: bytes) -> tuple[str, np.ndarray] | None:
        _, flags, at = element(buf, 0)
        kind = flags[0] if order == "<" else flags[3]
        _, dims, at = element(buf, at)
        _, name, at = element(buf, at)
        if not 6 <= kind <= 15:
            return None
        real, values, _ = element(buf, at)
        shape = np.frombuffer(dims, order + "i4")
        return name.decode("latin-1"), np.frombuffer(values, order + _MAT_TYPES[real]).astype(float).reshape(shape, order="F")

    out, at = {}, 128
    while at + 8 <= len(data):
        kind, body, at = element(data, at)
        if kind == 15:
            kind, body, _ = element(zlib.decompress(body), 0)
        found = matrix(body) if kind == 14 else None
        if found:
            out[found[0]] = found[1]
    return out


def _parse_mat73(data: bytes) -> dict[str, np.ndarray]:
    """Numeric arrays of a MATLAB 7.3 file, which is HDF5 with axes reversed. Needs h5py, which is not required otherwise."""
    try:
        import h5py
    except ImportError as e:
        raise ValueError("MATLAB 7.3 files are HDF5; reading them needs h5py") from e
    with h5py.File(io.BytesIO(data), "r") as f:
        return {k: np.asarray(v[()], float).T for k, v in f.items() if isinstance(v, h5py.Dataset) and v.dtype.kind in "iufb"}


def read_notebook(spark: SparkSession, path: str) -> DataFrame:
    """(cell, source): the code cells of a notebook file in order; other cells are left out, and so is a file without cells."""
    text = spark.read.text(path, wholetext=True)
    cells = F.from_json("value", "cells array<struct<cell_type: string, source: array<string>>>")["cells"]
    rows = text.select(F.posexplode(cells).alias("cell", "c")).filter("c.cell_type = 'code'")
    return rows.select("cell", F.array_join("c.source", "").alias("source"))


def read_mat(spark: SparkSession, path: str, key: str | None = None) -> np.ndarray:
    """One array of a .mat file: key, or by priority dfc_data, graph_data, the last one."""
    found = parse_mat5(_bytes(spark, path))
    name = key or next((k for k in ("dfc_data", "graph_data") if k in found), list(found)[-1] if found else None)
    if name not in found:
        raise ValueError(f"no numeric array {name}")
    return found[name]


def load_timeseries(spark: SparkSession, path: str) -> DataFrame | dict[str, np.ndarray] | None:
    """By suffix: .tsv, .txt, .npy and .pkl give a panel, .mat a dict of arrays, images None; others raise ValueError."""
    if path.endswith(".tsv"):
        return read_tsv(spark, path)
    if path.endswith(".txt"):
        return read_matrix_text(spark, path)
    if path.endswith(".npy"):
        return array_panel(spark, np.load(io.BytesIO(_bytes(spark, path)), allow_pickle=False))
    if path.endswith(".pkl"):
        return array_panel(spark, _ArraysOnly(io.BytesIO(_bytes(spark, path))).load())
    if path.endswith(".mat"):
        return parse_mat5(_bytes(spark, path))
    if path.endswith((".nii", ".nii.gz")):
        return None
    raise ValueError(f"unknown file type of {path}; known: {', '.join(SUFFIXES)}")


def read_cifti(spark: SparkSession, path: str) -> DataFrame:
    """(subject, t, vertex, x) of a .dtseries.nii file. Needs nibabel, which is not required otherwise."""
    try:
        import nibabel
    except ImportError as e:
        raise ImportError("reading CIFTI files needs nibabel") from e
    image = nibabel.Cifti2Image.from_bytes(_bytes(spark, path))
    return array_panel(spark, np.asarray(image.get_fdata())).withColumnRenamed("roi", "vertex")


def list_scans(paths: DataFrame, subject: str | None = None, task: str | None = None, run: str | None = None) -> DataFrame:
    """(path, subject, task, run, suffix) parsed from a column `path` of file names of the form sub-X_task-Y_run-Z_suffix."""
    parts = {k: F.regexp_extract("path", rf"(?:^|[/_]){k}-([A-Za-z0-9]+)", 1) for k in ("sub", "task", "run")}
    found = paths.select("path", *[F.when(v != "", v).alias(k) for k, v in parts.items()], F.regexp_extract("path", r"_([A-Za-z0-9]+)\.[a-z.]+$", 1).alias("suffix")).withColumnRenamed("sub", "subject")
    for name, wanted in (("subject", subject), ("task", task), ("run", run)):
        if wanted is not None:
            found = found.filter(F.col(name) == wanted)
    return found


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path) of all files below a directory; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def read_props(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with the JSON text in a column replaced by the fields of a schema (`k long, ..`); what is missing or malformed is null."""
    fields = [f.split()[0] for f in schema.split(",")]
    return rows.withColumn("_props", F.from_json(column, schema)).drop(column).select("*", *[F.col(f"_props.{f}").alias(f) for f in fields]).drop("_props")
