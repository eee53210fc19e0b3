"""Readers of sensor and log files."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null
from ..operators.timeseries import ordered_index


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; unreadable values and NaN become NULL."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with what restores their order: file, block offset, position in the block."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lines without header as ``(cycle_id, samples)``; the id is the 0-based line number."""
    lines = _lines(spark, path).filter(F.trim("value") != "")
    numbered = ordered_index(lines, ["_file", "_block", "_pos"], "cycle_id")
    samples = F.transform(F.split("value", sep), lambda x: F.trim(x).try_cast("double"))
    return numbered.select("cycle_id", samples.alias("samples"))


def read_whitespace(spark: SparkSession, path: str, columns: int | None = None, ragged: str = "null") -> DataFrame:
    """Whitespace-separated lines as columns ``Col_1..n``.

    The widest line gives n when not stated. Shorter lines end in NULLs, or with ``ragged='error'`` are refused, as lines
    wider than a stated n always are. A column is double if all its values are numbers, else it stays text.
    """
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(parts.alias("_p"))
    least, widest = lines.agg(F.min(F.size("_p")), F.max(F.size("_p"))).first()
    width = (widest or 0) if columns is None else columns
    if (widest or 0) > width or ragged == "error" and least is not None and least < width:
        raise ValueError(f"lines of {least} to {widest} values where {width} are expected")
    value = [F.get("_p", F.lit(i)) for i in range(width)]
    if not value:
        return lines.select()
    texts = lines.agg(*[F.count_if(v.isNotNull() & v.try_cast("double").isNull()) for v in value]).first()
    return lines.select(*[(v if n else v.try_cast("double")).alias(f"Col_{i + 1}") for i, (v, n) in enumerate(zip(value, texts, strict=True))])


def scan_tree(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All ``.csv`` and ``.txt`` files below a folder.

    Returns one status row per file and the readable frames by path. Only names and sizes are listed, by the file system,
    so that empty files appear, too; one unreadable file does not stop the others.
    """
    frames: dict[str, DataFrame] = {}
    status = []
    for path, size in _listed(spark, root):  # names only; each file has its own schema
        try:
            if size == 0:
                raise ValueError("empty file")
            if path.endswith(".csv"):
                frame = spark.read.option("header", True).option("inferSchema", True).csv(path)
            else:
                frame = read_whitespace(spark, path)
            if not frame.columns:
                raise ValueError("no columns")
            frames[path] = frame
            status.append((path, size, len(frame.columns), "ok"))
        except Exception as problem:  # noqa: BLE001  reported per file
            status.append((path, size, 0, f"error: {problem}"))
    return spark.createDataFrame(status, "path string, bytes long, columns int, status string"), frames


def _listed(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    files = []
    while found.hasNext():
        status = found.next()
        path = status.getPath().toString()
        if path.endswith((".csv", ".txt")):
            files.append((path, status.getLen()))
    return sorted(files)


def read_optional(read: Callable[[str], DataFrame], paths: Mapping[str, str], required: str | None = None) -> dict[str, DataFrame] | None:
    """Readable sources by name; absent ones are left out, an absent ``required`` one gives None."""
    found = {}
    for name, path in paths.items():
        try:
            found[name] = read(path)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            if name == required:
                return None
    return found


def read_sensors(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame | None:
    """Long table ``(cycle_id, sensor, samples)`` of the sensor files that exist."""
    found = read_optional(lambda p: read_matrix(spark, p), paths)
    out = None
    for name, frame in found.items():
        part = frame.withColumn("sensor", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower case, blanks to underscores, brackets removed."""
    clean = str.maketrans({" ": "_", "[": None, "]": None})
    return df.toDF(*[c.lower().translate(clean) for c in df.columns])
