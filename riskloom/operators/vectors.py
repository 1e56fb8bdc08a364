"""Vectors and nearest neighbours.

Exact top-k without a cross join. A corpus that is measured and found small is broadcast, and each task
searches for its own queries, with no shuffle at all. A larger corpus is cut into cells around pivot vectors;
each query visits only the cells that can still hold one of its k nearest, cells are cut into blocks of even
size, and what leaves a block is at most k rows per query.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.session import stored

# The kernels below travel inside the tasks, so executors need numpy, pandas and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_BYTES = 64 * 1024 * 1024
_TILE_QUERIES, _TILE_ROWS = 512, 4096  # queries and corpus rows of which one task holds the scores at once
_TILE = 2_000_000  # gaps to pivots held at once by one task
_PAIRS = 16_384  # pairs compared exactly at once
_BAND_BYTES = 16 * 1024 * 1024  # vectors of one side that meet in one call
_BANDS = 8  # bands that a side is cut into at least, so that there is work for many tasks
_MAX_PIVOTS = 512  # bounds the tables of cells and of cell pairs
_ROWS_PER_CELL = 8192  # smaller cells cost more in calls than they save in comparisons
_TERMS = 50_000  # hashed terms a task remembers
_CHARS = 250_000  # characters whose terms a task holds at once
_VECTORS = 1024  # hashed vectors a task holds at once
_DIGITS = 9  # scores are compared to this many places, ties by id


# --- expressions -------------------------------------------------------------------------------------------


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit length; a zero vector stays as it is."""
    length = F.col("_norm")
    unit = F.transform(column, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))
    return df.withColumn("_norm", norm(F.col(column))).withColumn(column, unit).drop("_norm")


def scaled_similarity(inner_product: Column) -> Column:
    """Cosine in [-1, 1] to a similarity in [0, 0.5], 4 places."""
    return F.round((inner_product + 1) / 2 * 0.5, 4)


def hash_vectors(df: DataFrame, column: str = "text", dims: int = 256, out: str = "embedding") -> DataFrame:
    """Text to a unit vector of term counts; a term's axis follows from its md5. Null text gives the zero vector.

    A task hashes a term once for as long as it remembers it, and holds the vectors of a slice of its texts.
    """

    @F.arrow_udf("array<double>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _hashed(batches, dims)

    # So that a condition on the vector is not moved below it, where the whole of it would run once more.
    return df.withColumn(out, counted.asNondeterministic()(F.lower(F.coalesce(F.col(column), F.lit("")))))


# --- kernels on Arrow batches ------------------------------------------------------------------------------


def _hashed(batches: Iterator[pa.Array], dims: int) -> Iterator[pa.Array]:
    """Vectors of lower-case texts, in pieces that leave one by one: the terms of a slice of texts take many times the
    room of the texts, and so do their vectors."""
    word, axis = re.compile(r"\w+"), {}
    for batch in batches:
        row = np.arange(len(batch))
        chars = np.cumsum(pc.utf8_length(batch).to_numpy(zero_copy_only=False)) // _CHARS
        cuts = np.flatnonzero((np.diff(chars) != 0) | (np.diff(row // _VECTORS) != 0)) + 1
        for own in np.split(row, cuts):
            if not len(own):
                continue
            if len(axis) > _TERMS:
                axis.clear()
            found = [word.findall(text) for text in batch.slice(own[0], len(own)).to_pylist()]
            for term in {t for terms in found for t in terms}.difference(axis):
                axis[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dims
            flat = np.fromiter((axis[t] for terms in found for t in terms), np.int64)
            flat += np.repeat(np.arange(len(found)), [len(terms) for terms in found]) * dims
            counts = np.bincount(flat, minlength=len(found) * dims).reshape(len(found), dims).astype(float)
            counts /= np.maximum(np.sqrt((counts ** 2).sum(axis=1, keepdims=True)), 1e-300)
            yield pa.ListArray.from_arrays(np.arange(0, counts.size + 1, dims, dtype=np.int32), counts.ravel())


def _matrix(vectors, metric: str, side: int) -> np.ndarray:
    """Rows as float64; for cosine scaled to unit length.

    Two extra axes hold the zero vectors of either side, so that their cosine with anything is 0 and
    distances between rows still follow from the inner product.
    """
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    if metric == "l2":
        return rows
    lengths = np.linalg.norm(rows, axis=1)
    out = np.zeros((rows.shape[0], rows.shape[1] + 2))
    np.divide(rows, lengths[:, None], out=out[:, : rows.shape[1]], where=lengths[:, None] > 0)
    out[lengths == 0, rows.shape[1] + side] = 1.0
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(gap, 0.0)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """A number per row, equal for equal rows."""
    return pd.factorize(np.fromiter((row.tobytes() for row in rows), dtype=object, count=len(rows)))[0]


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column without nulls, in the type they came in."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(lengths[0]))


def _lengths(rows: np.ndarray, metric: str) -> np.ndarray | None:
    """What the rows are divided by: for cosine their lengths, of which that of a zero vector leaves it as it is."""
    if metric == "l2":
        return None
    parts = [np.linalg.norm(rows[at : at + _TILE_ROWS].astype(np.float64), axis=1) for at in range(0, len(rows), _TILE_ROWS)]
    lengths = np.concatenate(parts) if parts else np.zeros(0)
    return np.where(lengths == 0, np.inf, lengths)


def _ready(rows: np.ndarray, lengths: np.ndarray | None, at) -> np.ndarray:
    """Some of the rows as float64, for cosine at unit length."""
    some = rows[at].astype(np.float64)
    return some if lengths is None else some / lengths[at][:, None]


def _gains(part: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """What orders the rows of a tile for each query, highest first; never NaN."""
    gain = part @ rows.T
    if metric == "l2":
        gain -= 0.5 * (rows * rows).sum(1)
    if not (np.isfinite(part).all() and np.isfinite(rows).all()):
        gain[np.isnan(gain)] = -np.inf
    return gain


def _best_of(row, col, value, place, keep: int, metric: str):
    """The ``keep`` best of the pairs of each query row, best first."""
    order = np.lexsort((place[col], np.round(-value if metric == "ip" else value, _DIGITS), row))
    row, col, value = row[order], col[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    kept = rank <= keep
    return row[kept], col[kept], value[kept], rank[kept]


def _search(asked, known, k: int, metric: str, place=None, tiles=None, may=None) -> Iterator[tuple]:
    """The k best known rows of each asked row, as arrays ``(row, col, value, rank)``, some rows after the others.

    Both sides are rows and their lengths. Ties go to the lowest ``place``. ``tiles`` cuts the known rows, and
    ``may(rows, tile)`` masks the asked rows that a tile can matter to. The first pass over the tiles finds a bound
    that the k-th best score reaches: the best scores of runs of columns. The second one looks only into the tiles that
    reach it, and takes the pairs that do.
    """
    n = len(known[0])
    keep = min(k, n)
    place = np.arange(n) if place is None else place
    tiles = tiles or [(at, min(at + _TILE_ROWS, n)) for at in range(0, n, _TILE_ROWS)]
    largest = lambda side: max([np.abs(side[0][at : at + _TILE_ROWS]).max(initial=0.0) for at in range(0, len(side[0]), _TILE_ROWS)] + [0.0])
    scale = 1.0 if metric == "ip" else float(largest(asked)) + float(largest(known))
    tolerance = 1e-8 + 4e-12 * scale ** 2 * known[0].shape[1]

    for at in range(0, len(asked[0]), _TILE_QUERIES):
        part = _ready(*asked, slice(at, at + _TILE_QUERIES))
        top = np.full((len(part), keep), -np.inf)
        peak = np.full((len(part), len(tiles)), -np.inf)
        gain = None
        for number, (a, b) in enumerate(tiles):
            some = np.arange(len(part)) if may is None else np.flatnonzero(may(np.arange(at, at + len(part)), number))
            if not len(some):
                continue
            gain = _gains(part if len(some) == len(part) else part[some], _ready(*known, slice(a, b)), metric)
            width = max(1, min(128, (b - a) // (4 * keep)))
            whole = (b - a) // width * width
            best = gain[:, :whole].reshape(len(some), -1, width).max(2)
            if whole < b - a:
                best = np.concatenate([best, gain[:, whole:].max(1, keepdims=True)], axis=1)
            peak[some, number] = best.max(1)
            up = np.flatnonzero(peak[some, number] > top[some, 0])
            if len(up):
                # The lowest of the kept scores comes first.
                top[some[up]] = np.partition(np.concatenate([top[some[up]], best[up]], axis=1), best.shape[1], axis=1)[:, best.shape[1]:]
        bound = top.min(1, initial=np.inf) - tolerance
        row, col, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rank = row
        for number, (a, b) in enumerate(tiles):
            some = np.flatnonzero((peak[:, number] >= bound) & (peak[:, number] > -np.inf))
            if not len(some):
                continue
            rows = _ready(*known, slice(a, b))
            if len(tiles) > 1 or may is not None:
                gain = _gains(part[some], rows, metric)
                hit, place_in = np.nonzero((gain >= bound[some][:, None]) & (gain > -np.inf))
                hit = some[hit]
            else:
                hit, place_in = np.nonzero((gain >= bound[:, None]) & (gain > -np.inf))
            for cut in range(0, len(hit), _PAIRS):
                left, right = hit[cut : cut + _PAIRS], place_in[cut : cut + _PAIRS]
                if metric == "ip":
                    exact = np.einsum("ij,ij->i", part[left], rows[right])
                else:
                    exact = ((part[left] - rows[right]) ** 2).sum(1)
                row, col, value, rank = _best_of(
                    np.concatenate([row, left]), np.concatenate([col, right + a]), np.concatenate([value, exact]),
                    place, keep, metric)
        yield row + at, col, value, rank


def _top_k(query_ids, queries, ids, corpus, k: int, metric: str) -> Iterator[pd.DataFrame]:
    """The k best corpus rows per query, of float64 rows as ``_matrix`` makes them; ``ids`` ascend, so position breaks
    ties by id."""
    query_ids = np.asarray(query_ids)
    # Copies of a query are searched for once.
    number = _distinct(queries)
    first = np.unique(number, return_index=True)[1]
    for row, col, value, rank in _search((queries[first], None), (corpus, None), k, metric):
        if not len(row):
            continue
        found = pd.DataFrame({"row": row, "rank": rank, "neighbour_id": ids[col], "value": value})
        asked = pd.DataFrame({"query_id": query_ids, "row": number})[np.isin(number, row)]
        yield asked.merge(found, on="row", sort=False)[["query_id", "rank", "neighbour_id", "value"]]


def _found(query_ids: pa.Array, number: np.ndarray, ids: pa.Array, found) -> Iterator[pa.RecordBatch]:
    """Rows of the results of a search whose asked rows are the distinct ones that ``number`` counts."""
    by_number = np.argsort(number, kind="stable")
    sorted_number = number[by_number]
    for row, col, value, rank in found:
        if not len(row):
            continue
        # Each result once per query that has its vector.
        lo, hi = np.searchsorted(sorted_number, row), np.searchsorted(sorted_number, row, side="right")
        times = hi - lo
        which = np.repeat(np.arange(len(row)), times)
        within = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        yield pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(by_number[lo[which] + within])), pa.array(rank[which].astype(np.int64)),
             ids.take(pa.array(col[which])), pa.array(value[which])], ["query_id", "rank", "neighbour_id", "value"])


def _by_id(ids, vectors, metric: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus rows in id order. Of equal rows only the k lowest ids can be reported, so only those are kept."""
    ids = np.asarray(ids)
    order = np.argsort(ids, kind="stable")
    rows = _matrix(vectors, metric, 0)[order]
    number = pd.Series(_distinct(rows))
    kept = (number.groupby(number).cumcount() < k).to_numpy()
    return ids[order][kept], rows[kept]


def _in_order(corpus: pa.Table, k: int) -> pa.Table:
    """``_by_id`` for a table ``(id, vec[, text])``, whose vectors stay as they came."""
    corpus = corpus.take(pc.sort_indices(corpus["id"])).combine_chunks()
    number = pd.Series(_distinct(_vectors(corpus["vec"])))
    return corpus.filter(pa.array((number.groupby(number).cumcount() < k).to_numpy())).combine_chunks()


# --- operators ---------------------------------------------------------------------------------------------


def knn(
    queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "ip",
    query_id: str = "vec_id", corpus_id: str = "vec_id", vector: str = "embedding",
    slack: float = 0.0, broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = 32_768, pivots: int | None = None,
) -> DataFrame:
    """``(query_id, rank, neighbour_id, value)``: the k nearest corpus rows of every query, fewer if the
    corpus is smaller. No self-exclusion.

    metric 'ip' is the cosine (best = highest), 'l2' the squared Euclidean distance (best = lowest). Null
    vectors are left out on both sides. With ``slack`` > 0 the search may skip cells that can only improve
    the k-th distance by less than the factor 1 + slack.
    """
    if metric not in ("ip", "l2"):
        raise ValueError("metric is 'ip' or 'l2'")
    q = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("vec")).where("vec is not null")
    c = corpus.select(F.col(corpus_id).alias("id"), F.col(vector).alias("vec")).where("vec is not null")

    size, rows = _measured(c)
    if size > broadcast_bytes:
        # A corpus of many copies may be small without them.
        c = stored(_slim(c, k), "corpus")
        size, rows = _measured(c)
    if size <= broadcast_bytes:
        return _broadcast(q, c, k, metric)
    pivots = pivots or max(8, min(_MAX_PIVOTS, rows // _ROWS_PER_CELL))
    found = _blocked(q, c, k, metric, slack, block_rows, pivots)
    best = F.desc(F.round("value", _DIGITS)) if metric == "ip" else F.asc(F.round("value", _DIGITS))
    order = Window.partitionBy("query_id").orderBy(best, "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbour_id", "value")


def _schema(q: DataFrame, c_type: str) -> str:
    return f"query_id {q.schema['id'].dataType.simpleString()}, rank bigint, neighbour_id {c_type}, value double"


def _measured(c: DataFrame) -> tuple[int, int]:
    """Bytes that the rows ``(id, vec[, text])`` take on the driver, and their number."""
    width = F.size("vec") * 8 + (F.octet_length("text") if "text" in c.columns else F.lit(0)) + 64
    return tuple(c.agg(F.coalesce(F.sum(width), F.lit(0)), F.count(F.lit(1))).head())


def _slim(c: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k lowest ids, the only ones that can ever be reported; most copies go before the shuffle."""
    copies = Window.partitionBy("vec").orderBy("id")
    return c.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k).drop("_n")


def _broadcast(q: DataFrame, c: DataFrame, k: int, metric: str) -> DataFrame:
    """Every task gets one copy of the corpus, which is within its byte bound."""
    schema = _schema(q, c.schema["id"].dataType.simpleString())
    small = _in_order(c.toArrow(), k)
    if not small.num_rows:
        return q.sparkSession.createDataFrame([], schema)
    rows = _vectors(small["vec"])
    shared = q.sparkSession.sparkContext.broadcast((small["id"].combine_chunks(), rows, _lengths(rows, metric)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *known = shared.value
        for batch in batches:
            if len(batch):
                rows = _vectors(batch.column("vec"))
                number = _distinct(rows)
                rows = rows[np.unique(number, return_index=True)[1]]
                yield from _found(batch.column("id"), number, ids, _search((rows, _lengths(rows, metric)), known, k, metric))

    return q.mapInArrow(search, schema)


def knn_other_folds(
    queries: DataFrame, corpus: DataFrame, k: int = 3, query_id: str = "vec_id", corpus_id: str = "vec_id",
    vector: str = "embedding", fold: str = "fold", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``knn`` by cosine where every query is compared with the corpus rows of all folds but its own.

    One search whatever the number of folds: a task finds the k best of each fold and merges those it may use. A
    corpus beyond ``broadcast_bytes`` is searched fold by fold, and the results are merged in the same way.
    """
    q = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("vec"), F.col(fold).alias("fold")).where(
        "vec is not null and fold is not null")
    c = corpus.select(F.col(corpus_id).alias("id"), F.col(vector).alias("vec"), F.col(fold).alias("fold")).where(
        "vec is not null and fold is not null")
    c_type = c.schema["id"].dataType.simpleString()
    if _measured(c)[0] > broadcast_bytes:
        c = stored(c, "corpus")
        folds = [r.fold for r in c.select("fold").distinct().orderBy("fold").collect()]
        found = reduce(DataFrame.unionByName, [
            knn(q.where(F.col("fold") != f), c.where(F.col("fold") == f), k, query_id="id", corpus_id="id", vector="vec",
                broadcast_bytes=broadcast_bytes) for f in folds])
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("value", _DIGITS)), "neighbour_id")
        ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "neighbour_id", "value")
    small = c.toPandas()
    shared = q.sparkSession.sparkContext.broadcast(
        {f: _by_id(rows["id"], rows["vec"], "ip", k) for f, rows in small.groupby("fold")})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own, asked = batch["fold"].to_numpy(), _matrix(batch["vec"], "ip", 1)
            found = []
            for f, (ids, rows) in shared.value.items():
                may = np.flatnonzero(own != f)
                if len(may):
                    found += _top_k(may, asked[may], ids, rows, k, "ip")
            if not found:
                continue
            every = pd.concat(found, ignore_index=True)
            every = every.iloc[np.lexsort((every["neighbour_id"], -every["value"].round(_DIGITS), every["query_id"]))]
            every["rank"] = every.groupby("query_id").cumcount() + 1
            every = every[every["rank"] <= k]
            yield every.assign(query_id=batch["id"].to_numpy()[every["query_id"].to_numpy(np.int64)])

    return q.mapInPandas(search, _schema(q, c_type))


def attach_cases(
    df: DataFrame, corpus: DataFrame, k: int = 3, vector: str = "embedding", corpus_id: str = "case_id",
    corpus_vector: str = "embedding", corpus_text: str = "text", out: str = "similar_cases",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame | None:
    """``df`` with the texts and scaled similarities of its k nearest cases, or None if the corpus is too large.

    A map over rows, streams included: only the vector column visits Python, and nothing is shuffled. Rows
    without a vector get an empty list; corpus rows without a text are left out.
    """
    held = corpus.select(
        F.col(corpus_id).alias("id"), F.col(corpus_vector).alias("vec"), F.col(corpus_text).alias("text")
    ).dropna()
    if _measured(held)[0] > broadcast_bytes:
        # A corpus of many copies may be small without them.
        held = stored(_slim(held, k), "cases")
        if _measured(held)[0] > broadcast_bytes:
            return None
    small = _in_order(held.toArrow(), k)
    none = F.array().cast("array<struct<text:string,similarity:double>>")
    if not small.num_rows:
        return df.withColumn(out, none)
    cases = _vectors(small["vec"])
    shared = df.sparkSession.sparkContext.broadcast((small["text"].combine_chunks(), cases, _lengths(cases, "ip")))

    @F.arrow_udf("array<struct<text:string,value:double>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        texts, *known = shared.value
        for batch in batches:
            asked = np.flatnonzero(batch.is_valid().to_numpy(zero_copy_only=False))
            rows = _vectors(batch.drop_null())
            number = _distinct(rows)
            rows = rows[np.unique(number, return_index=True)[1]]
            hits = [pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())],
                                               ["query_id", "rank", "neighbour_id", "value"])]
            hits += _found(pa.array(asked), number, pa.array(np.arange(len(texts))),
                           _search((rows, _lengths(rows, "ip")), known, k, "ip") if len(asked) else ())
            every = pa.Table.from_batches(hits).sort_by([("query_id", "ascending"), ("rank", "ascending")])
            sizes = np.bincount(every["query_id"].to_numpy(), minlength=len(batch))
            starts = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(sizes == 0, False))
            yield pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays(
                [texts.take(every["neighbour_id"].combine_chunks()), every["value"].combine_chunks()], ["text", "value"]))

    scaled = F.transform(
        "_found",
        lambda case: F.struct(case["text"].alias("text"), scaled_similarity(case["value"]).alias("similarity")),
    )
    return df.withColumn("_found", search(vector)).withColumn(out, F.coalesce(scaled, none)).drop("_found")


def _bands(sizes: np.ndarray, centres: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """First band and number of bands of every cell, of at most about ``limit`` rows each: neighbouring cells share
    one, a cell beyond the limit has several."""
    parts = np.maximum(1, -(-sizes // limit))
    first, last, load = np.zeros(len(sizes), dtype=np.int64), -1, limit + 1
    left, cell = set(range(len(sizes))), 0
    while left:
        left.discard(cell)
        if parts[cell] > 1 or load + sizes[cell] > limit:
            first[cell], load = last + 1, sizes[cell] if parts[cell] == 1 else limit + 1
            last += parts[cell]
        else:
            first[cell], load = last, load + sizes[cell]
        if left:
            others = np.array(sorted(left))
            cell = int(others[((centres[others] - centres[cell]) ** 2).sum(1).argmin()])
    return first, parts


def _blocked(
    q: DataFrame, c: DataFrame, k: int, metric: str, slack: float, block_rows: int, pivots: int
) -> DataFrame:
    """The k best of every block for every query. ``c`` is stored and holds no more than k of equal vectors.

    ``block_rows`` bounds the corpus rows that are compared at once. Blocks travel in bands, as do queries: each side is
    sent once per band of the other that it may need.
    """
    id_type = c.schema["id"].dataType.simpleString()
    vec_type = c.schema["vec"].dataType.simpleString()
    chosen = c.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()
    centres = _matrix(chosen["vec"], metric, 0)
    dims = max(1, centres.shape[1])

    def gaps_to(column, against: np.ndarray, side: int) -> Iterator[tuple[int, np.ndarray]]:
        rows, step = _vectors(column), max(1, _TILE // len(against))
        for at in range(0, len(rows), step):
            yield at, np.sqrt(_squared(_matrix(rows[at : at + step], metric, side), against))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, gaps in gaps_to(batch.column("vec"), centres, 0):
                cell = np.nan_to_num(gaps, nan=np.inf).argmin(1)
                part = batch.slice(at, len(cell))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(cell)), cell])],
                    ["id", "vec", "cell", "radius"])

    # Read by three jobs below.
    placed = stored(c.mapInArrow(place, f"id {id_type}, vec {vec_type}, cell int, radius double"), "cells")

    # One row per pivot: the cell's size, its radii, and its k smallest radii.
    near = Window.partitionBy("cell").orderBy("radius", "id")
    closest = (
        placed.select("cell", "radius", "id").withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k)
        .groupBy("cell").agg(F.sort_array(F.collect_list("radius")).alias("closest"))
    )
    figures = (
        placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi"))
        .join(closest, "cell").orderBy("cell").toPandas()
    )
    cells = figures["cell"].to_numpy()
    lo, hi = figures["lo"].to_numpy(), figures["hi"].to_numpy()
    owner = np.repeat(np.arange(len(cells)), [len(r) for r in figures["closest"]])
    inner = np.concatenate([np.asarray(r) for r in figures["closest"]])
    centre = centres[cells]

    def reachable(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query the nearest cell, and a mask of the cells that may hold one of its k nearest."""
        for at, gaps in gaps_to(column, centre, 1):
            # k known corpus rows lie within `reach`, so nothing farther away can be among the k nearest.
            upper = gaps[:, owner] + inner[None, :]
            take = min(k, upper.shape[1])
            picks = np.argpartition(upper, take - 1, axis=1)[:, :take]
            reach = np.take_along_axis(upper, picks, axis=1).max(1)
            at_least = np.maximum(0.0, np.maximum(gaps - hi[None, :], lo[None, :] - gaps))
            open_ = at_least**2 <= ((reach / (1.0 + slack)) ** 2 + 1e-8)[:, None]
            np.put_along_axis(open_, owner[picks], True, axis=1)
            yield at, gaps.argmin(1), open_

    def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visits = np.zeros((len(cells), len(cells) + 1), dtype=np.int64)
        for batch in batches:
            for _, home, open_ in reachable(batch.column("vec")):
                for own in np.unique(home):
                    visits[own] += np.append(open_[home == own].sum(0), (home == own).sum())
        row, col = np.nonzero(visits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(visits[row, col])], ["home", "cell", "n"])

    # Queries are grouped by their own nearest cell, so that a group shares the cells it visits. At most
    # pivots * (pivots + 1) rows: which groups visit which cell, and how many queries a group has (the last cell).
    survey = (
        q.mapInArrow(count_visits, "home int, cell int, n bigint")
        .groupBy("home", "cell").agg(F.sum("n").alias("n")).toPandas()
    )
    alone = survey["cell"] == len(cells)
    asking = np.zeros(len(cells), dtype=np.int64)
    asking[survey["home"][alone]] = survey["n"][alone]
    bound = max(block_rows, _BAND_BYTES // (8 * dims))
    limit = lambda rows: int(min(bound, max(block_rows, -(-rows // _BANDS))))
    held_first, held_parts = _bands(figures["n"].to_numpy(), centre, limit(figures["n"].sum()))
    asked_first, asked_parts = _bands(asking, centre, limit(asking.sum()))
    # A row per cell and band of queries that may need it.
    needed = sorted({
        (int(cells[cell]), int(band), int(held_first[cell]), int(held_parts[cell]))
        for home, cell in zip(survey["home"][~alone], survey["cell"][~alone])
        for band in range(asked_first[home], asked_first[home] + asked_parts[home])})
    bands_of = np.zeros((len(cells), int((held_first + held_parts).max())), dtype=np.float32)
    for cell, (band, parts) in enumerate(zip(held_first, held_parts)):
        bands_of[cell, band : band + parts] = 1.0

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, home, open_ in reachable(batch.column("vec")):
                row, band = np.nonzero(open_.astype(np.float32) @ bands_of)
                part = batch.slice(at, len(home))
                for cut in range(0, len(row), _PAIRS):
                    some, to = pa.array(row[cut : cut + _PAIRS]), band[cut : cut + _PAIRS]
                    own = home[row[cut : cut + _PAIRS]]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(some), part.column("vec").take(some), pa.array(asked_first[own]),
                         pa.array(asked_parts[own]), pa.array(to.astype(np.int64))], ["id", "vec", "first", "parts", "held_band"])

    q_type = q.schema["id"].dataType.simpleString()
    spread = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    asked = q.mapInArrow(
        visit, f"id {q_type}, vec {q.schema['vec'].dataType.simpleString()}, first bigint, parts bigint, held_band bigint"
    ).select("id", "vec", "held_band", spread.alias("asked_band"))
    plan = q.sparkSession.createDataFrame(needed, "cell int, asked_band bigint, first bigint, parts bigint")
    held = placed.join(F.broadcast(plan), "cell").select("id", "vec", "cell", spread.alias("held_band"), "asked_band")
    schema = _schema(q, id_type)
    at_of = np.zeros(pivots, dtype=np.int64)
    at_of[cells] = np.arange(len(cells))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = [left["id"].slice(0, 0).combine_chunks(), pa.array([], pa.int64()), right["id"].slice(0, 0).combine_chunks(),
                pa.array([], pa.float64())]
        found = [pa.RecordBatch.from_arrays(none, ["query_id", "rank", "neighbour_id", "value"])]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks()
            cell = at_of[right["cell"].to_numpy()]
            place = np.empty(len(cell), dtype=np.int64)
            place[pc.sort_indices(right["id"]).to_numpy()] = np.arange(len(cell))
            # Blocks of one cell each.
            starts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            step = min(block_rows, _TILE_ROWS)
            tiles = [(at, min(at + step, b)) for a, b in zip(starts[:-1], starts[1:]) for at in range(a, b, step)]
            tile_cell = cell[[a for a, _ in tiles]]
            rows, known = _vectors(left["vec"]), _vectors(right["vec"])
            number = _distinct(rows)
            first = np.unique(number, return_index=True)[1]
            open_ = np.concatenate([mask for _, _, mask in reachable(left["vec"].combine_chunks().take(pa.array(first)))])
            found += _found(
                left["id"].combine_chunks(), number, right["id"].combine_chunks(),
                _search((rows[first], _lengths(rows[first], metric)), (known, _lengths(known, metric)), k, metric, place, tiles,
                        None if open_.all() else lambda some, tile: open_[some, tile_cell[tile]]))
        return pa.Table.from_batches(found)

    spot = ["held_band", "asked_band"]
    return asked.groupBy(*spot).cogroup(held.groupBy(*spot)).applyInArrow(search, schema)


def similar(neighbours: DataFrame) -> DataFrame:
    """Neighbours with the scaled similarity instead of the raw cosine."""
    return neighbours.withColumn("similarity", scaled_similarity(F.col("value"))).drop("value")


def similar_cases(
    neighbours: DataFrame, texts: DataFrame, text_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per query the known texts near it, best first; ids without a text are dropped.

    ``neighbours`` has ``query_id, rank, neighbour_id, similarity``. One popular case may be the neighbour
    of a large share of the queries; AQE splits that side of the join.
    """
    known = texts.select(F.col(text_id).alias("neighbour_id"), F.col(text).alias("text"))
    found = neighbours.join(known, "neighbour_id", "inner")
    listed = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", "similarity"))).alias("_cases")
    )
    cases = F.transform("_cases", lambda c: F.struct(c["text"].alias("text"), c["similarity"].alias("similarity")))
    return listed.select("query_id", cases.alias("similar_cases"))


def max_similarity(queries: DataFrame, neighbours: DataFrame, query_id: str = "vec_id") -> DataFrame:
    """Best similarity per query, 0 where there is no neighbour."""
    best = neighbours.groupBy("query_id").agg(F.max("similarity").alias("max_similarity"))
    joined = queries.join(best, queries[query_id] == best["query_id"], "left")
    return joined.select(*queries.columns, F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))


def _planes(tables: int, bits: int, dims: int) -> np.ndarray:
    """Directions of plus and minus ones, from md5, so that any engine can repeat them."""
    sign = [
        1.0 if hashlib.md5(f"{t}:{b}:{axis}".encode()).hexdigest()[0] < "8" else -1.0
        for t in range(tables) for b in range(bits) for axis in range(dims)
    ]
    return np.array(sign).reshape(tables * bits, dims)


def knn_approx(
    queries: DataFrame, corpus: DataFrame, k: int = 3, tables: int = 40, bits: int = 6,
    query_id: str = "vec_id", corpus_id: str = "vec_id", vector: str = "embedding", block_rows: int = 32_768,
) -> DataFrame:
    """The k best by cosine among the corpus rows that share a bucket with the query, for large corpora.

    Each of ``tables`` buckets a vector by the signs of ``bits`` projections, so two vectors at an angle a meet in one
    with the chance (1 - a / pi) ** bits. More tables raise recall and work, more bits lower both. Candidates are ranked
    exactly, with ties by id as in ``knn``. A bucket with more rows than ``block_rows`` is cut into blocks, and what
    leaves a block is k rows per query.
    """
    q = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("vec")).where("vec is not null")
    c = corpus.select(F.col(corpus_id).alias("id"), F.col(vector).alias("vec")).where("vec is not null")

    def bucketed(df: DataFrame) -> DataFrame:
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            planes, powers = None, 1 << np.arange(bits)
            for batch in batches:
                if not len(batch):
                    continue
                rows = np.stack([np.asarray(v, dtype=np.float64) for v in batch["vec"]])
                if planes is None:
                    planes = _planes(tables, bits, rows.shape[1])
                signs = ((rows @ planes.T) > 0).reshape(len(rows), tables, bits)
                cells = (signs * powers).sum(axis=2) + (np.arange(tables) << bits)
                for table in range(tables):
                    yield batch.assign(cell=cells[:, table].astype(np.int32))

        kind = df.schema
        return df.mapInPandas(
            assign, f"id {kind['id'].dataType.simpleString()}, vec {kind['vec'].dataType.simpleString()}, cell int"
        )

    asked, held = bucketed(q), bucketed(c)
    # At most tables * 2 ** bits rows: into how many parts the rows of either side of a bucket are cut.
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias(name))
    plan = stored(parts(asked, "chunks").join(parts(held, "blocks"), "cell"), "buckets")
    spread = lambda name: F.pmod(F.xxhash64("id"), F.col(name))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))
    left = asked.join(F.broadcast(plan), "cell").select(
        "id", "vec", "cell", spread("chunks").alias("chunk"), every("blocks").alias("block"))
    right = held.join(F.broadcast(plan), "cell").select(
        "id", "vec", "cell", every("chunks").alias("chunk"), spread("blocks").alias("block"))

    def search(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        if near.empty or far.empty:
            return pd.DataFrame({"query_id": near["id"][:0], "rank": [], "neighbour_id": far["id"][:0], "value": []})
        ids, rows = _by_id(far["id"], far["vec"], "ip", k)
        found = _top_k(near["id"].to_numpy(), _matrix(near["vec"], "ip", 1), ids, rows, k, "ip")
        return pd.concat(list(found), ignore_index=True)

    spot = ["cell", "chunk", "block"]
    hits = left.groupBy(*spot).cogroup(right.groupBy(*spot)).applyInPandas(
        search, _schema(q, c.schema["id"].dataType.simpleString()))
    # The same pair from several tables is one.
    once = hits.groupBy("query_id", "neighbour_id").agg(F.max("value").alias("value"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("value", _DIGITS)), "neighbour_id")
    ranked = once.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbour_id", "value")


def l2_risk(queries: DataFrame, corpus: DataFrame, k: int = 3, query_id: str = "vec_id", **options) -> DataFrame:
    """Risk 1 - exp(-5 d), d the mean squared distance to the k nearest: distance is read as risk."""
    near = knn(queries, corpus, k, metric="l2", query_id=query_id, **options)
    mean = near.groupBy("query_id").agg(F.avg("value").alias("mean_distance"))
    return mean.withColumn("risk_score", 1 - F.exp(-5 * F.col("mean_distance")))
