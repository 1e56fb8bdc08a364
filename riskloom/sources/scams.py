"""The tables of known and of real-time scams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.operators.ranking import with_position

# Columns, defaults and required columns of the two tables.
SCAMS = "scams"
REALTIME_SCAMS = "realtime_scams"
_COLUMNS = {
    SCAMS: {"id": "bigint", "scam_text": "string", "scam_type": "string", "confidence": "double",
            "detected_at": "timestamp_ntz"},
    REALTIME_SCAMS: {"id": "bigint", "source": "string", "scam_text": "string", "scam_type": "string",
                     "confidence": "double", "detected_at": "timestamp_ntz"},
}
_CONFIDENCE = {SCAMS: 1.0, REALTIME_SCAMS: 0.8}
_REQUIRED = {SCAMS: ["scam_text"], REALTIME_SCAMS: ["source", "scam_text"]}
# The sample rows an empty real-time table starts with (source, text, type, confidence).
SEED_ROWS = [
    ("sample", "Your account has been compromised, verify now", "phishing", 0.9),
    ("sample", "Congratulations! You've won $1,000,000", "lottery", 0.95),
    ("sample", "Urgent: Transfer money to secure account", "financial", 0.85),
]


def read_scams(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.format(file_format).load(path)


def read_scams_jdbc(
    spark: SparkSession, table: str, id_range: tuple[int, int], partitions: int, options: Mapping[str, str]
) -> DataFrame:
    """The table over JDBC, read in parallel by ranges of ``id``.

    Connection details come from the caller in ``options`` (url, user, password, driver).
    """
    low, high = id_range
    return (
        spark.read.format("jdbc")
        .options(**options)
        .option("dbtable", table)
        .option("partitionColumn", "id")
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", partitions)
        .load()
    )


def scams_of_type(df: DataFrame, scam_type: str) -> DataFrame:
    return df.where(F.col("scam_type") == scam_type)


def _shaped(df: DataFrame, table: str, now: Column | None) -> DataFrame:
    if table not in _COLUMNS:
        raise ValueError(f"unknown table {table!r}")
    if "timestamp" in df.columns and "detected_at" not in df.columns:
        df = df.withColumnRenamed("timestamp", "detected_at")
    given = {
        name: (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
        for name, kind in _COLUMNS[table].items()
    }
    moment = (F.current_timestamp() if now is None else now).cast("timestamp_ntz")
    given["confidence"] = F.coalesce(given["confidence"], F.lit(_CONFIDENCE[table]))
    given["detected_at"] = F.coalesce(given["detected_at"], moment)
    return df.select(*[column.alias(name) for name, column in given.items()])


def conform(df: DataFrame, table: str = SCAMS, now: Column | None = None) -> DataFrame:
    """Rows in the table's shape: types, defaults for confidence and time, and no null in required columns.

    ``timestamp`` is taken as ``detected_at``; a missing ``id`` stays null until ``assign_ids``. Rows that are left out
    are those of ``rejected``.
    """
    return _shaped(df, table, now).dropna(subset=_REQUIRED[table])


def rejected(df: DataFrame, table: str = SCAMS, now: Column | None = None) -> DataFrame:
    """The rows that ``conform`` leaves out, in the table's shape, and ``missing``: their required columns without a value."""
    shaped = _shaped(df, table, now)
    missing = F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in _REQUIRED[table]]))
    return shaped.withColumn("missing", missing).where(F.size("missing") > 0)


def assign_ids(df: DataFrame, key: Sequence[str], existing: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Running ids after the highest one in ``existing``, in the seeded order of ``key``.

    Ids are positions computed per hash bucket: no task numbers the whole table.
    """
    ranked = with_position(df.drop("id"), [], key, seed)
    start = F.lit(0) if existing is None else existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = ranked.withColumn("id", (F.col("_position") + start).cast("bigint"))
    return numbered.select("id", *[c for c in df.columns if c != "id"])


def seed_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_ROWS, "source string, scam_text string, scam_type string, confidence double")


def seed_if_empty(df: DataFrame, seed: DataFrame) -> DataFrame:
    """``df`` and, only if it has no rows, the seed."""
    return df.unionByName(seed.where(~df.exists()))
