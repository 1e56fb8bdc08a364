"""Reading and writing labelled message files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.dedup import union_sources

MESSAGE_ORDER = ("file_seq", "file_path", "block_seq", "row_seq")
_SPLITS = ("train", "test")


def _csv(spark: SparkSession, encoding: str, multi_line: bool):
    return (
        spark.read.option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
    )


def read_messages(
    spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8", multi_line: bool = True
) -> DataFrame:
    """Positional CSV: column 0 is the label, column 1 the text, any further column is ignored.

    Rows with fewer fields are dropped and undecodable bytes replaced. ``file_seq, file_path, block_seq,
    row_seq`` keep the order of the paths, of the files in a folder by name, of the blocks in a file and of the rows in
    a block. Quoted line breaks need
    ``multi_line``, which reads a file in one task; large files without them should be read without it.
    """
    frames = []
    for at, path in enumerate(paths):
        rows = _csv(spark, encoding, multi_line).schema("type string, text string").csv(path)
        placed = rows.select(
            "type", "text", F.lit(at).alias("file_seq"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_seq"),
            F.monotonically_increasing_id().alias("row_seq"),
        )
        frames.append(placed.where(F.col("text").isNotNull()))
    return union_sources(frames, check_empty=False)


def read_labelled(
    spark: SparkSession, path: str, required: Sequence[str] = ("text", "type"), encoding: str = "UTF-8",
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header that must name the required columns; all columns are strings, in any order."""
    df = _csv(spark, encoding, multi_line).option("header", True).csv(path)
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


def read_split(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One side of a written split."""
    if name not in _SPLITS:
        raise ValueError(f"a split is one of {_SPLITS}, not {name!r}")
    return read_labelled(spark, f"{folder}/{name}_data")


def write_messages(
    df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True, encoding: str = "UTF-8"
) -> None:
    """CSV with every field quoted and kept as it is, white space included."""
    options = {
        "header": header, "encoding": encoding, "quoteAll": True, "quote": '"', "escape": '"', "lineSep": "\n",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    df.write.options(**options).mode(mode).csv(path)


def write_split(split: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Both sides of a split, each to its own folder, without the ``split`` column."""
    for name in _SPLITS:
        write_messages(split.where(F.col("split") == name).drop("split"), f"{folder}/{name}_data", mode)


def write_stats(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Statistics as JSON lines."""
    df.write.option("ignoreNullFields", False).mode(mode).json(path)
