"""Exact deduplication as a stateful stream.

A stream of (digest, doc_id, locator) rows keeps one state row per digest of the normalised text, for ever: the
smallest doc_id, where its text is found, and how many rows there were. State lies in RocksDB on the executors'
disks and is checkpointed to the shared folder, so a lost executor loads it again. Copies of a hot text fold into one
row on each task before the shuffle. Texts stay out of the state; a hit is compared with the kept row's text, byte
for byte, by a join on the locator afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskloom.session import shared_folder, stored

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else every partition of the state reserves 4 MB for its manifest.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Else every partition of the state keeps four threads for it, hundreds in an executor; the folder serves one run.
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}
#: A micro-batch of the registered query holds about this many bytes of digests, and the table takes two or more.
BYTES_PER_BATCH = 16 << 30
LEAST_BATCHES = 2
#: Columns that tell where a row's text is read from.
FILE, ROW = "__file", "__row"
#: Rows to drop are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_ROWS = 200_000
_WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    """Runs of blanks, tabs and line ends as one blank; null as the empty text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), _WHITE, " ")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns FILE and ROW: the place its text is read from. A table not read from files is written."""
    place = {FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")}
    try:
        return docs.withColumns(place)
    except Exception as error:
        if "UNRESOLVED_COLUMN" not in str(error) and "UNSUPPORTED" not in str(error):
            raise
    return stored(docs, "documents").withColumns(place)


def _file_bytes(table: DataFrame) -> int:
    """Size of the files behind a table that has rows in each of them."""
    files = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    return files.distinct().agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def _stream(spark: SparkSession, slim: DataFrame, bytes_per_batch: int | None, least_batches: int = 1) -> DataFrame:
    """Run the stream over all rows of ``slim`` and return (digest, keep, group_size) as of its end."""
    source, sink, checkpoint = (shared_folder(spark, name) for name in ("arrivals", "keepers", "state"))
    slim.write.parquet(source)
    reader = spark.readStream.schema(slim.schema)
    if least_batches > 1:
        share = -(-_file_bytes(spark.read.schema(slim.schema).parquet(source)) // least_batches)
        bytes_per_batch = max(1, min(share, bytes_per_batch or share))
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_batch))
    state = reader.parquet(source).groupBy("digest").agg(
        F.min(F.struct("none", "doc_id", FILE, ROW)).alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for key, value in _STATE.items():
            spark.conf.set(key, value)
        query = (state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                 .foreachBatch(write).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    schema = T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])
    if not query.lastProgress and not query.recentProgress:
        return spark.createDataFrame([], state.schema)
    updates = spark.read.schema(schema).parquet(sink)
    # State only ever shrinks the id and raises the count, so its last value is the least and the most.
    return updates.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))


def exact_dedup(
    docs: DataFrame, digest: Callable[[Column], Column] = digest, bytes_per_batch: int | None = None,
    least_batches: int = 1,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): ``doc_id, keep_id, group_size, kept, text_sha256`` and its
    place, FILE and ROW.

    Texts are equal when identical after ``normalised``. Of equal texts the row with the smallest doc_id stays; a row
    without an id only where no other has one; of repeated ids the first by place. So one row of a group is
    ``kept``, whatever repeats. Rows that share a digest but not the bytes are grouped by their bytes.

    Digests arrive in micro-batches of about ``bytes_per_batch`` bytes, and in ``least_batches`` or more of about equal
    size as far as they lie in that many files; a later batch looks its digests up in what earlier ones have left. The
    result does not depend on either.
    """
    spark = docs.sparkSession
    known = [c for c in (FILE, ROW) if c in docs.columns]
    rows = docs.select("doc_id", "text", *known)
    if not known:
        rows = located(rows)
    text = normalised()
    slim = stored(rows.select(
        "doc_id", F.col("doc_id").isNull().alias("none"), digest(text).alias("digest"), FILE, ROW), "digests")
    keepers = stored(_stream(spark, slim.select("digest", "none", "doc_id", FILE, ROW), bytes_per_batch,
                             least_batches)
                     .select("digest", F.col("keep.doc_id").alias("keep_id"), F.col(f"keep.{FILE}").alias("keep_file"),
                             F.col(f"keep.{ROW}").alias("keep_row"), "group_size"), "keepers")
    grouped = slim.join(keepers, "digest").withColumn(
        "kept", (F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row")))
    grouped = stored(grouped, "grouped")

    # Full bytes of every hit against those of the row that stays. One shuffle fetches the texts of both by place.
    places = grouped.where(~F.col("kept")).select("digest", FILE, ROW, F.lit(False).alias("keeper")).union(
        grouped.where(F.col("kept") & (F.col("group_size") > 1)).select("digest", FILE, ROW, F.lit(True)))
    fetched = stored(rows.select(FILE, ROW, text.alias("body")).join(places, [FILE, ROW]), "bodies")
    of_keepers = fetched.where("keeper").select("digest", F.col("body").alias("keep_body"))
    unequal = stored(fetched.where("not keeper").join(of_keepers, "digest").where("body <> keep_body").select(
        "digest", FILE, ROW, "body"), "unequal")
    if unequal.isEmpty():
        final = grouped
    else:
        final = _regrouped(grouped, unequal)
    # The hex digest that is reported is always that of the text.
    if digest is globals()["digest"]:
        final = final.withColumn("text_sha256", F.col("digest"))
    else:
        final = final.join(rows.select(FILE, ROW, F.sha2(text, 256).alias("text_sha256")), [FILE, ROW])
    return final.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", FILE, ROW)


def deduplicate(docs: DataFrame, bytes_per_batch: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    placed = located(docs)
    dropped = stored(exact_dedup(placed, bytes_per_batch=bytes_per_batch).where(~F.col("kept")).select(FILE, ROW),
                     "dropped")
    small = dropped.count() <= BROADCAST_ROWS
    return placed.join(F.broadcast(dropped) if small else dropped, [FILE, ROW], "left_anti").drop(FILE, ROW)


def _regrouped(grouped: DataFrame, unequal: DataFrame) -> DataFrame:
    """Groups of a shared digest, split: those unlike the kept row are grouped by their whole text."""
    away = unequal.join(grouped.select(FILE, ROW, "doc_id", "none"), [FILE, ROW])
    own = away.groupBy("digest", "body").agg(
        F.min(F.struct("none", "doc_id", FILE, ROW)).alias("first"), F.count(F.lit(1)).alias("size"))
    moved = away.join(own, ["digest", "body"]).select(
        FILE, ROW, F.col("first.doc_id").alias("new_id"), F.col(f"first.{FILE}").alias("new_file"),
        F.col(f"first.{ROW}").alias("new_row"), "size")
    lost = own.groupBy("digest").agg(F.sum("size").alias("lost"))
    return (grouped.join(moved, [FILE, ROW], "left").join(lost, "digest", "left").select(
        "doc_id", "none", "digest", FILE, ROW,
        F.when(F.col("size").isNull(), F.col("keep_id")).otherwise(F.col("new_id")).alias("keep_id"),
        F.when(F.col("size").isNull(), F.col("group_size") - F.coalesce("lost", F.lit(0))).otherwise(
            F.col("size")).alias("group_size"),
        F.when(F.col("size").isNull(), F.col("kept")).otherwise(
            (F.col(FILE) == F.col("new_file")) & (F.col(ROW) == F.col("new_row"))).alias("kept")))
