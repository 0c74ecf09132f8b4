"""Reading and writing the three datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# Cell texts that mean "missing" in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Position of a row in its dataset; present on every table read here.
ROW_SEQ = "_row_seq"


def _first_line(spark: SparkSession, file: str) -> str:
    """The first line of a text file in any file system Spark reads, compressed or not."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = codec.createInputStream(stream) if codec else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """CSV files with a header, every column as text, missing-value tokens as null, plus the row position.

    Columns are told by name: files of one dataset may have them in any order, and a column that a file
    lacks is null there. Types are left to validation, which can then tell "missing" from "present but unreadable".
    Large files are split; ``multi_line=True`` reads quoted line breaks, for which each file is read by one task.
    """
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise ValueError(f"no file in {path}")
    by_header: dict[str, list[str]] = {}
    for file in files:
        by_header.setdefault(_first_line(spark, file), []).append(file)
    by_header = {header: group for header, group in by_header.items() if header} or by_header  # empty files hold no rows
    parts = [_read_alike(spark, group, multi_line) for group in by_header.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_alike(spark: SparkSession, files: list[str], multi_line: bool) -> DataFrame:
    """Files with one header."""
    raw = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(files)
    )
    cells = [
        F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns
    ]
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(*cells, place.alias(ROW_SEQ))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A Parquet table plus the row position."""
    raw = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return raw.select("*", place.alias(ROW_SEQ))


def read_dataset(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, form: str | None = None
) -> DataFrame:
    """A dataset as ``form`` says, "csv" or "parquet"; without it the endings of all its files must agree."""
    if form is None:
        names = {file.split("?")[0].rsplit("/", 1)[-1].lower() for file in spark.read.text(path).inputFiles()}
        forms = {"parquet" if name.endswith(".parquet") else "csv" if ".csv" in name else "" for name in names}
        if len(forms) != 1 or "" in forms:
            raise ValueError(f"can't tell the form of {path}; pass form='csv' or form='parquet'")
        form = forms.pop()
    if form not in ("csv", "parquet"):
        raise ValueError(f"unknown form {form!r}")
    return read_parquet(spark, path) if form == "parquet" else read_csv(spark, path, multi_line)


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write every table as Parquet below ``folder``; returns the paths."""
    paths = {}
    for name, table in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}.parquet"
        table.write.mode("overwrite").parquet(paths[name])
    return paths
