"""Exact positions and cuts in a seeded random order, without one task per group.

The order is the md5 of ``seed:key``, so any engine can repeat it. Rows fall into even buckets by the first hex
digits of that hash, and bucket counts say at which position each bucket starts. A label that holds a third
of all rows is thereby spread over every bucket.

``with_parts`` cuts groups at given positions: only the bucket that holds a cut is ever sorted, and what comes
back to the rows is one hash per cut, so splitting a table is a map over it. ``with_position`` numbers every
row, which takes one shuffle; buckets that hold too many rows for one task are refined by further digits first, so
what a task numbers is bounded at any size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskloom.session import stored

# Buckets per group: 16^3 to begin with when all rows are numbered, 16^4 when only the bucket of a cut is sorted.
_NUMBER_DIGITS = 3
_CUT_DIGITS = 4
# A bucket of more rows is refined before its rows are numbered, to this many digits at most.
_CELL_ROWS = 1_000_000
_MOST_DIGITS = 14
# Up to this many cuts over all groups are broadcast.
_MAX_CUTS = 10_000
# Group column of a table that is one group.
_WHOLE = "_all"


def seeded_hash(seed: int, *key: str | Column) -> Column:
    """md5 of ``seed:key[:key...]`` as a hex string."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _bucket(digits: int) -> Column:
    return F.conv(F.substring("_hash", 1, digits), 16, 10).cast("int")


def _cell(digits: Column) -> Column:
    """The lowest hash, to ``_MOST_DIGITS`` digits, that begins with a row's first ``digits`` digits."""
    padded = F.rpad(F.substring(F.col("_hash"), F.lit(1), digits), F.lit(_MOST_DIGITS), F.lit("0"))
    return F.conv(padded, 16, 10).cast("bigint")


def _cells(hashed: DataFrame, groups: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``hashed`` with ``_bucket``, the cell of its row, and the rows ``_rows`` of each cell of each group.

    Cells are the leaves of a trie over the digits of the hash. A cell above ``_CELL_ROWS`` is refined by as many
    digits as its count asks for, and only its rows are counted again. So a group has at most 16^3 cells, or 16 for
    every ``_CELL_ROWS`` of its rows. Cells do not overlap, and the order of ``_bucket`` is that of the hashes.
    """
    hashed = hashed.withColumn("_bucket", _cell(F.lit(_NUMBER_DIGITS)))
    counted = lambda rows, digits: rows.groupBy("_bucket", *keys, *groups, digits.alias("_digits")).agg(
        F.count(F.lit(1)).alias("_rows"))
    cells = stored(counted(hashed, F.lit(_NUMBER_DIGITS)), "cells")
    crowded = (F.col("_rows") > _CELL_ROWS) & (F.col("_digits") < _MOST_DIGITS)
    while True:
        over = cells.where(crowded)
        n = over.count()
        if not n:
            return hashed, cells
        wanted = F.col("_digits") + F.ceil(F.log(16.0, F.col("_rows") / _CELL_ROWS))
        deeper = over.select("_bucket", *keys, F.least(wanted, F.lit(_MOST_DIGITS)).cast("int").alias("_deeper"))
        told = hashed.join(F.broadcast(deeper) if n <= _MAX_CUTS else deeper, ["_bucket", *keys], "left")
        hashed = told.withColumn(
            "_bucket", F.when(F.col("_deeper").isNull(), F.col("_bucket")).otherwise(_cell(F.col("_deeper")))
        )
        again = counted(hashed.where(F.col("_deeper").isNotNull()), F.col("_deeper"))
        cells = stored(cells.where(~crowded).unionByName(again), "cells")
        hashed = hashed.drop("_deeper")


def with_position(
    df: DataFrame, groups: Sequence[str], key: Sequence[str], seed: int = 42,
    position: str = "_position", size: str = "_size",
    per_group: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its group, and the group's row count.

    ``key`` must identify a row. With no ``groups`` the whole table is one group. ``per_group`` turns the
    table of group sizes ``(groups..., n)`` into figures per group, which are added too: they ride along
    with the bucket starts, so no join runs on the group columns alone and nothing is counted twice.
    """
    # Null-free key columns, the bucket first: the join and the window then ask for the same partitioning, so
    # rows are shuffled once, and the sort compares a number before anything else.
    hashed = df.withColumn("_hash", seeded_hash(seed, *key)).withColumns(
        {f"_key{at}": F.coalesce(F.col(g).cast("string"), F.lit("")) for at, g in enumerate(groups)}
        | {f"_null{at}": F.col(g).isNull() for at, g in enumerate(groups)}
    )
    keys = [f"_{part}{at}" for at in range(len(groups)) for part in ("key", "null")]
    cells = ["_bucket", *keys]
    hashed, counts = _cells(hashed, groups, keys)
    # One row per cell of a group from here to the join.
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    along = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *cells,
        *[F.col(g).alias(f"_s_{g}") for g in groups],
        F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias(size),
    )
    extra = []
    if per_group is not None:
        figures = per_group(counts.groupBy(*groups).agg(F.sum("_rows").alias("n")))
        extra = [c for c in figures.columns if c not in groups]
        named = figures.select(*[F.col(g).alias(f"_g_{g}") for g in groups], *extra)
        match = [F.col(f"_s_{g}").eqNullSafe(F.col(f"_g_{g}")) for g in groups]
        starts = starts.join(named, on=match, how="inner")
    starts = starts.select(*cells, "_before", size, *extra)
    # Numbered before the join: the sort this needs also serves the join.
    inside = Window.partitionBy(*cells).orderBy("_hash", *key)
    numbered = hashed.withColumn("_number", F.row_number().over(inside)).drop("_hash")
    ranked = numbered.join(starts, cells).withColumn(
        position, (F.col("_number") + F.col("_before")).cast("bigint")
    )
    return ranked.select(*df.columns, position, size, *extra)


def _local(table: DataFrame, limit: int) -> DataFrame | None:
    """A table of one row per group as local rows, or None if it has more than ``limit`` rows and cuts."""
    rows = table.limit(limit + 1).collect()
    if len(rows) + sum(len(row["_quotas"]) for row in rows if "_quotas" in table.columns) > limit:
        return None
    return table.sparkSession.createDataFrame(rows, table.schema)


def _literal(value, kind: T.DataType) -> Column:
    """A driver value as a column of the given type; lists of structs are the widest it needs to take."""
    if isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value or []]).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def with_parts(
    df: DataFrame, groups: Sequence[str], key: Sequence[str], quotas: Callable[[DataFrame], DataFrame],
    seed: int = 42, part: str = "_part", max_cuts: int = _MAX_CUTS,
) -> DataFrame:
    """Cut each group at given positions and add the number of the part, from 0, that a row falls into.

    Parts have exactly the sizes asked for. Rows that share ``key`` may be cut apart; which of them go where is
    then not determined, as nothing tells them apart.
    ``quotas`` turns the table of group sizes ``(groups..., n)`` into ``(groups..., _quotas, ...)``: the
    ascending positions to cut after, and any figures to add to the rows of the group. Two narrow passes over
    groups and key find the cuts; the result is then a map over ``df`` with no shuffle. Should the groups
    have more than ``max_cuts`` cuts, or a cut fall between rows that share a key, rows are numbered and compared
    with the quotas instead, with the same sizes.
    """
    if not groups:
        whole = df.withColumn(_WHOLE, F.lit(0))
        return with_parts(whole, [_WHOLE], key, quotas, seed, part, max_cuts).drop(_WHOLE)
    hashed = df.withColumn("_hash", seeded_hash(seed, *key))
    slim = hashed.select(*dict.fromkeys([*groups, *key]), "_hash", _bucket(_CUT_DIGITS).alias("_bucket"))
    # Small tables from here on: at most 16^4 rows per group, then one row per group or cut.
    counts = stored(slim.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows")), "bucket-counts")
    figures = _local(quotas(counts.groupBy(*groups).agg(F.sum("_rows").alias("n"))), max_cuts)

    def numbered() -> DataFrame:
        ranked = with_position(df, groups, key, seed, per_group=quotas)
        extra = [c for c in ranked.columns if c not in (*df.columns, "_position", "_size", "_quotas")]
        passed = F.size(F.filter("_quotas", lambda quota: quota < F.col("_position")))
        return ranked.select(*df.columns, *extra, passed.alias(part))

    if figures is None:
        return numbered()
    extra = [c for c in figures.columns if c not in (*groups, "_quotas")]

    of_group = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    renamed = lambda table, *rest: table.select(*[F.col(g).alias(f"_g_{g}") for g in groups], *rest)
    upto = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = counts.withColumn("_after", F.sum("_rows").over(upto))
    cuts = renamed(figures, F.posexplode("_quotas").alias("_cut", "_quota"))
    before = F.col("_after") - F.col("_rows")
    edges = filled.join(F.broadcast(cuts), of_group).where(
        (before < F.col("_quota")) & (F.col("_quota") <= F.col("_after"))
    )
    edges = renamed(edges, F.col("_bucket").alias("_edge"), "_cut", (F.col("_quota") - before).alias("_need"))

    # The rows of those buckets, and among them the last one before each cut.
    near = slim.join(F.broadcast(edges), [*of_group, F.col("_bucket") == F.col("_edge")])
    turn = F.row_number().over(Window.partitionBy(*groups, "_cut").orderBy("_hash", *key))
    own = F.struct("_hash", *key)
    turned = near.withColumn("_turn", turn)
    following = F.lead(own).over(Window.partitionBy(*groups, "_cut").orderBy("_hash", *key))
    last = turned.withColumn("_tied", F.coalesce(following == own, F.lit(False))).where(
        F.col("_turn") == F.col("_need"))
    found = renamed(last.groupBy(*groups).agg(
        F.sort_array(F.collect_list(own)).alias("_cuts"), F.max("_tied").alias("_tied")), "_cuts", "_tied")
    per_group = figures.join(found, of_group, "left").select(
        *[F.col(g).alias(f"_h_{g}") for g in groups], *extra, "_cuts",
        F.size(F.filter("_quotas", lambda quota: quota <= 0)).alias("_passed"), "_tied",
    )
    # One row per group, as many as the figures have.
    rows = per_group.collect()
    # A cut between rows of the same key: a value cannot part them.
    if any(row["_tied"] for row in rows):
        return numbered()
    schema = per_group.schema
    if groups == [_WHOLE]:
        # One group: its row becomes literals.
        joined = hashed
        for name in [*extra, "_cuts", "_passed"]:
            joined = joined.withColumn(name, _literal(rows[0][name] if rows else None, schema[name].dataType))
    else:
        small = df.sparkSession.createDataFrame(rows, schema).drop("_tied")
        joined = hashed.join(F.broadcast(small), [F.col(g).eqNullSafe(F.col(f"_h_{g}")) for g in groups])
    beyond = F.size(F.filter(F.coalesce("_cuts", F.array().cast(schema["_cuts"].dataType)), lambda at: at < own))
    return joined.select(*df.columns, *extra, (F.col("_passed") + beyond).alias(part))
