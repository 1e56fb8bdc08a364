"""Shards of even size by sampled splitters.

Records are put in order of (text hash, id hash, row number), so equal texts stand together. A sample, drawn with a
chance in proportion to size, gives quantile boundaries that range-partition the records; ranges that still hold too
much are sampled again and subdivided. Sums per range place every record on a line of bytes, and a record belongs to
the shard in which its middle lies. A group of equal texts moves as one unless it is large, so a hot text is spread
over as many ranges and shards as its size asks for. All of it is DataFrame expressions on slim rows; only samples
and sums per range, both bounded, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.session import stored

SHARDS = 24
#: Ranges per shard at least, rows of a range at most (until ``MOST_RANGES``), and sampled records per range.
RANGES_PER_SHARD = 32
RANGE_ROWS = 1_000_000
MOST_RANGES = 20_000
SAMPLES_PER_RANGE = 24
#: A range is overfull beyond this many times the mean, in bytes or rows.
OVERFULL = 2.0
_ROUNDS = 4
#: A group of equal texts moves as one up to this share of a shard.
GROUP_SHARE = 0.01
LAW = "bytes"
_LEAST = -(1 << 63)
_KEY = ("h", "i", "u")


def _numbers(values: list[int], kind: str = "bigint") -> Column:
    """A constant array; parsed from one string, which stays cheap for thousands of numbers."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """Number of splitters at or below the row's key, by binary search in constant arrays."""
    if not splitters:
        return F.lit(0)
    parts = [_numbers([s[at] for s in splitters]) for at in range(3)]
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]

    def forward(found: Column, step: Column) -> Column:
        at = (found + step - 1).cast("int")
        h, i, u = (F.get(p, at) for p in parts)
        reached = (F.col("h") > h) | ((F.col("h") == h) & (
            (F.col("i") > i) | ((F.col("i") == i) & (F.col("u") >= u))))
        return F.when((found + step <= len(splitters)) & F.coalesce(reached, F.lit(False)), found + step).otherwise(
            found)

    return F.aggregate(_numbers(steps, "int"), F.lit(0), forward)


def _uniform(seed: int) -> Column:
    return F.pmod(F.xxhash64("u", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _quantiles(sample: list[tuple], parts: int) -> list[tuple[int, int, int]]:
    """Keys at even distances in the sorted sample. The first to fall into a group of equal texts goes to its start."""
    sample.sort()
    cuts: list[tuple[int, int, int]] = []
    for at in range(1, parts):
        key = sample[at * len(sample) // parts]
        whole = (key[0], _LEAST, _LEAST)
        cut = whole if not cuts or cuts[-1][0] != key[0] else key
        if not cuts or cut > cuts[-1]:
            cuts.append(cut)
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes (none for a null) plus 8. ``law`` is ``bytes``: the sums of sizes are even up
    to one record, or to a small group of equal texts, at either end of a shard. ``slot`` counts a shard's rows from 0
    without a gap. ``grown_shard`` is null under this law. Null and repeated ids are sharded like any row; with fewer
    rows than shards, some stay empty. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    slim = stored(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.xxhash64("doc_id", F.lit(5)).alias("i"),
        F.monotonically_increasing_id().alias("u")), "sizes")
    total, rows = slim.agg(F.sum("size"), F.count(F.lit(1))).head()
    if not rows:
        return slim.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.lit(0).alias("shard"),
                           F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = min(MOST_RANGES, max(RANGES_PER_SHARD * shards, -(-rows // RANGE_ROWS)))
    splitters, sums = _split(slim, total, rows, ranges)

    before_bytes, before_rows, b, n = [], [], 0, 0
    for at in range(len(splitters) + 1):
        before_bytes.append(b)
        before_rows.append(n)
        more_b, more_n = sums.get(at, (0, 0))
        b, n = b + more_b, n + more_n
    # Bytes and rows ahead of each record, first inside its range, then on the whole line.
    inside = Window.partitionBy("r").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("r", "h")
    placed = (slim.withColumn("r", _range_of(splitters))
              .withColumns({"b": F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.get(_numbers(before_bytes), "r"),
                            "n": F.count(F.lit(1)).over(inside) + F.get(_numbers(before_rows), "r")})
              .withColumns({"group_start": F.min("b").over(group), "group_bytes": F.sum("size").over(group)}))
    together = F.col("group_bytes") <= GROUP_SHARE * total / shards
    middle = F.when(together, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("b") + F.col("size") / 2)
    placed = stored(placed.select(
        "doc_id", "size", "text_crc32", "n",
        F.least(F.floor(middle * shards / float(total)), F.lit(shards - 1)).cast("int").alias("shard")), "shards")
    firsts = {r.shard: r.n for r in placed.groupBy("shard").agg(F.min("n").alias("n")).collect()}
    starts = _numbers([firsts.get(at, 0) for at in range(shards)])
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                         (F.col("n") - F.get(starts, "shard")).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))


def _split(slim: DataFrame, total: int, rows: int, ranges: int) -> tuple[list[tuple[int, int, int]], dict]:
    """Splitters, and (bytes, rows) of every range, after overfull ranges were subdivided."""
    keys = slim.select(*_KEY, "size")
    weight = (F.col("size") / float(total) + F.lit(1.0 / rows)) / 2
    chance = weight * (ranges * SAMPLES_PER_RANGE)
    sample = [tuple(r) for r in keys.where(_uniform(1) < chance).select(*_KEY).collect()]
    splitters = _quantiles(sample, ranges) if sample else []
    for seed in range(2, 2 + _ROUNDS):
        sums = {r.r: (r.b, r.n) for r in keys.withColumn("r", _range_of(splitters)).groupBy("r").agg(
            F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
        full = {at: max(b * ranges / total, n * ranges / rows) for at, (b, n) in sums.items()
                if n > 1 and max(b * ranges / total, n * ranges / rows) > OVERFULL}
        if not full or len(splitters) >= 2 * MOST_RANGES or seed == 1 + _ROUNDS:
            break
        # Records of the overfull ranges only, more of them, and splitters inside a group of equal texts as well.
        more = [tuple(r) for r in keys.withColumn("r", _range_of(splitters))
                .where(F.get(_numbers([int(at in full) for at in range(len(splitters) + 1)], "int"), "r") == 1)
                .where(_uniform(seed) < chance * 2).select("r", *_KEY).collect()]
        inside: dict[int, list[tuple]] = {}
        for at, *key in more:
            inside.setdefault(at, []).append(tuple(key))
        added = []
        for at, keys_in in inside.items():
            parts = int(full[at]) + 1
            keys_in.sort()
            added += [keys_in[k * len(keys_in) // parts] for k in range(1, parts)]
        fresh = sorted(set(splitters) | set(added))
        if fresh == splitters:
            break
        splitters = fresh
    return splitters, sums

