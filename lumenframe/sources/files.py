"""File sources: folder listings and small text tables, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_EXTENSIONS = ["cr2", "cr3", "nef", "arw", "dng", "raf", "orf", "rw2"]


def scan_folder(spark: SparkSession, path: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length of the files below ``path``, newest first. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "modificationTime", "length")
    if extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(extensions))
    return files.orderBy(F.desc("modificationTime"), "path")


def list_folder(entries: DataFrame, name: str, is_dir: str, tie: list[str]) -> DataFrame:
    """Folders before files, by name without case; the data folder and ``.ml6d`` files are hidden."""
    hidden = (F.col(is_dir) & (F.lower(name) == "ml/data")) | F.col(name).endswith(".ml6d")
    return entries.where(~hidden).orderBy(F.desc(is_dir), F.lower(name), *tie)


def pipe_table(spark: SparkSession, path: str) -> DataFrame:
    """``id|contrast|saturation|tone|bias|wb_r|wb_b[|ca|fringe]`` or the first four: comments and bad rows are skipped, the last row of an id wins."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    return parse_pipe_lines(lines)


def parse_pipe_lines(lines: DataFrame) -> DataFrame:
    names = ["contrast", "saturation", "tone", "bias", "wb_r", "wb_b", "ca", "fringe"]
    cells = F.split(F.trim("value"), r"\|")
    rows = lines.where(~F.trim("value").startswith("#")).withColumn("c", cells).where(F.size("c").isin(4, 7, 9) | (F.size("c") > 9))
    number = lambda i: F.expr(f"try_cast(trim(get(c, {i})) as double)")
    rows = rows.select("_at", F.expr("try_cast(trim(c[0]) as int)").alias("lens_id"), F.size("c").alias("_n"), *[number(i + 1).alias(n) for i, n in enumerate(names)])
    whole = F.lit(True)
    for i, n in enumerate(names):
        whole = whole & ((F.col("_n") <= i + 1) | F.col(n).isNotNull())
    rows = rows.where(F.col("lens_id").isNotNull() & whole).fillna(0.0, names)
    return rows.groupBy("lens_id").agg(F.max_by(F.struct(*names), "_at").alias("r")).select("lens_id", "r.*")


def json_array(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """A JSON array of bodies with clamped trims; a broken file gives no rows."""
    rows = spark.read.schema("model string, trim_r double, trim_b double, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    clamp = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(1.0)), F.lit(low)), F.lit(high)).alias(c)
    return rows.where("model is not null").select(F.lower(F.trim("model")).alias("model"), clamp("trim_r"), clamp("trim_b"))


def line_lists(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct lines of several lists, comments left out; ``pos`` keeps the first place, lists in the order given."""
    parts = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("list"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    first = rows.groupBy("line").agg(F.min(F.struct("list", "at")).alias("f"))
    return first.select("line", F.row_number().over(Window.orderBy("f")).alias("pos"))  # a list of names, read from a few files


def safe_decode(rows: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON rows decoded to ``schema``; rows that do not parse are skipped."""
    return rows.select(F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").na.drop("all")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``.npy`` files of one float vector each: path and vector."""

    def read(batches):
        import io

        import numpy as np
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "vector": [np.load(io.BytesIO(c), allow_pickle=False).astype(float).ravel() for c in b["content"]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(read, "path string, vector array<double>")
