"""Near-duplicate texts: an n-gram Jaccard join through MinHash banding.

Texts are sets of word five-grams. A signature of min-hashes gives a text one path of labels in each of ``trees``
bands. All paths are cut to one length, fixed before the data is seen: from the longest on it is shortened until the
chance that two texts at the threshold share a path in some band reaches ``target_recall``. This is an LSH forest
only with its depth fixed; no sorted trie is kept. Two texts must share a path to become candidates. Every
candidate pair is then checked exactly on its shingle sets.

How it stays linear in rows:

* texts with equal sets are one node from the start, so thousands of copies cost one;
* a bucket of a band yields one edge per member, to its smallest member, never all pairs;
* the components of those edges are the families. A family beyond one block is taken apart again without losing a
  link (``_parted``): of two similar sets, the rarest shingles of one hold a shingle that is among the rarest of the
  other. Texts that only share a common frame have none in common and leave the family.
* each text travels once or a few times to its family, where *all* pairs of comparable size are compared, including
  those that met in no band. A family that is still large is cut into blocks by size class and hash, one task per
  pair of blocks, and a task returns one row per text: its number of links and the smallest text it is linked to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm import arrays
from riskloom.llm.components import components, join_hot
from riskloom.session import stored

THRESHOLD = 0.8
TREES = 64
MAX_DEPTH = 12
TARGET_RECALL = 0.99999
#: A block of a family holds about this many texts and shingles at most.
BLOCK_TEXTS = 384
BLOCK_SHINGLES = 600_000
#: Counters of shingles in large families, shared by hash; the table of them is what tasks receive (8 bytes each).
COUNTERS = 1 << 20
_SEED = 20240


def prefix_length(threshold: float, trees: int, target_recall: float, longest: int = MAX_DEPTH) -> int:
    """The longest prefix at which a pair of the threshold's similarity still meets with the wanted chance."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target_recall:
        depth -= 1
    return depth


def row_key(text: str | Column = "text", doc_id: str | Column = "doc_id") -> Column:
    """Finds a row again on a second reading, by its id and text; a null text counts as empty.

    Ids may repeat with different texts. Rows equal in both share a key.
    """
    text, doc_id = (F.col(c) if isinstance(c, str) else c for c in (text, doc_id))
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def _signer(trees: int, depth: int, width: int):
    random = np.random.default_rng(_SEED)
    # Each band has functions of its own: the formula of ``prefix_length`` holds for independent labels only.
    functions = trees * depth
    flips = random.integers(0, 2**32, functions, dtype=np.uint32)
    factors = random.integers(0, 2**32, functions, dtype=np.uint32) | np.uint32(1)
    weights = random.integers(0, 2**63, depth, dtype=np.uint64) | np.uint64(1)
    salts = arrays.mix(np.arange(trees, dtype=np.uint64))

    def signature(shingles: np.ndarray) -> np.ndarray:
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        step = max(1, 200_000 // len(high))
        return np.concatenate([
            ((high[None, :] ^ flips[at:at + step, None]) * factors[at:at + step, None]).min(axis=1)
            for at in range(0, functions, step)])

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, texts in arrays.runs(frame["text"].tolist()):
                sets = arrays.shingles(texts, width)
                rows = frame.iloc[first:first + len(texts)]
                digests = [arrays.mix(np.array([s.sum() if len(s) else 0, np.bitwise_xor.reduce(arrays.mix(s))],
                                               np.uint64)).astype(np.int64) for s in sets]
                prefixes = []
                for shingles in sets:
                    if not len(shingles):
                        prefixes.append(np.zeros(0, np.int64))
                        continue
                    path = signature(shingles).reshape(trees, depth).astype(np.uint64)
                    prefixes.append(arrays.mix((path * weights).sum(axis=1, dtype=np.uint64) ^ salts).astype(np.int64))
                yield pd.DataFrame({
                    "row_key": rows["row_key"].to_numpy(), "d1": [d[0] for d in digests],
                    "d2": [d[1] for d in digests], "n_shingles": [len(s) for s in sets], "prefixes": prefixes})

    return sign


def _member_sets(width: int):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, texts in arrays.runs(frame["text"].tolist()):
                sets = arrays.shingles(texts, width)
                yield pd.DataFrame({"uid": frame["uid"].to_numpy()[first:first + len(texts)],
                                    "shingles": [s.tobytes() for s in sets]})
    return read


def _counter(shingles: np.ndarray, counters: int) -> np.ndarray:
    return (shingles % np.uint64(counters)).astype(np.int64)


def _count_shingles(counters: int):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(counters, np.int64)
        for frame in frames:
            for shingles in frame["shingles"]:
                np.add.at(total, _counter(np.frombuffer(shingles, np.uint64), counters), 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"counter": used, "n": total[used]})
    return count


def rarest(shingles: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles by which a set meets every similar one, and which of them serve sets of its size or more.

    Shingles are taken in one order for all sets: by the count of their counter, then by value. Two sets of a
    Jaccard similarity of the threshold share at least threshold / (1 + threshold) of their sizes together. So the
    first shingle that both hold is, in the larger set, among the first ``size - threshold * size + 1`` and, in the
    smaller one, among the first ``size - 2 * threshold / (1 + threshold) * size + 1``.
    """
    size = len(shingles)
    # The 1e-9 keeps a product's binary error from making the prefix too short.
    as_larger = size - int(np.ceil(threshold * size - 1e-9)) + 1
    as_smaller = size - int(np.ceil(2 * threshold / (1 + threshold) * size - 1e-9)) + 1
    order = np.lexsort((shingles, counts[_counter(shingles, len(counts))]))[:as_larger]
    return shingles[order], np.arange(len(order)) < as_smaller


def _rarest_shingles(counts, threshold: float):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [rarest(np.frombuffer(s, np.uint64), counts.value, threshold) for s in frame["shingles"]]
            lengths = [len(taken) for taken, _ in found]
            if sum(lengths):
                yield pd.DataFrame({
                    "uid": np.repeat(frame["uid"].to_numpy(), lengths),
                    "family": np.repeat(frame["family"].to_numpy(), lengths),
                    "shingle": np.concatenate([taken for taken, _ in found]).view(np.int64),
                    "as_smaller": np.concatenate([small for _, small in found])})
    return read


def _two_blocks(task: str) -> bool:
    """Whether a task, ``family`` or ``family:class:class:block:block``, compares two different blocks."""
    _, *sides = task.split(":")
    return sides[0::2] != sides[1::2]


def _verifier(threshold: float):
    def shared(sets: list[np.ndarray]) -> np.ndarray:
        """How many shingles each two texts have in common, as matrix products over blocks of shingles."""
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = count[column] > 1
        owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((len(sets), len(sets)), np.float32)
        step = 4096
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + step + 1, step))
        for low, high, base in zip(edges[:-1], edges[1:], range(0, 1 << 62, step)):
            if high > low:
                present = np.zeros((len(sets), int(column[high - 1]) - base + 1), np.float32)
                present[owner[low:high], column[low:high] - base] = 1
                total += present @ present.T
        return total

    def verify(key: tuple[str], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("uid").sort_values("uid")
        uid, copies = frame["uid"].to_numpy(), frame["copies"].to_numpy()
        side = frame["side"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in frame["shingles"]]
        size = np.array([len(s) for s in sets])
        both = shared(sets)
        union = size[:, None] + size[None, :] - both
        linked = both.astype(np.float64) / np.maximum(union, 1) >= threshold
        np.fill_diagonal(linked, False)
        if _two_blocks(key[0]):
            # Pairs inside either block belong to other tasks, also where the other block turns out empty.
            linked &= side[:, None] != side[None, :]
        links = linked @ copies
        # The first linked text of each component in this task, by breadth-first search over matrix rows.
        root = np.full(len(uid), -1)
        for start in range(len(uid)):
            if root[start] >= 0:
                continue
            reached, fresh = np.zeros(len(uid), bool), np.zeros(len(uid), bool)
            fresh[start] = True
            while fresh.any():
                reached |= fresh
                fresh = linked[fresh].any(axis=0) & ~reached
            root[reached] = start
        keep = links > 0
        return pd.DataFrame({"uid": uid[keep], "other": uid[root[keep]], "links": links[keep].astype(np.int64)})

    return verify


def jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target_recall: float = TARGET_RECALL,
    width: int = arrays.WORDS_PER_SHINGLE,
) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text, ...).

    One row per row of ``docs``: ``doc_id``, ``row_key``, ``class_id`` (smallest doc_id of the class; a class is a
    connected component of links), ``n_links`` (other rows whose Jaccard similarity reaches the threshold, copies
    included), ``n_shingles`` and ``kept`` (exactly one row per class: the smallest doc_id). Words are runs of
    letters and digits in any case; a text of fewer than ``width`` words is one shingle; a null text or one
    without words is linked to nothing. Other columns are ignored. Similarities are exact on 64-bit shingle hashes.
    """
    depth = prefix_length(threshold, trees, target_recall)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = source.withColumn("row_key", row_key())
    keyed_ids = keyed.select("row_key", "text").mapInPandas(
        _signer(trees, depth, width),
        "row_key long, d1 long, d2 long, n_shingles long, prefixes array<long>")
    signed = stored(keyed_ids.withColumn("uid", F.monotonically_increasing_id()), "forest")
    some = signed.where("n_shingles > 0")

    # Equal sets are one node, named by its smallest row.
    nodes = some.groupBy("d1", "d2").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes, "nodes")
    alive = some.select("uid", "prefixes").join(nodes.select("uid"), "uid", "left_semi")
    members = alive.select("uid", F.explode("prefixes").alias("prefix"))
    heads = members.groupBy("prefix").agg(F.min("uid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = join_hot(members, heads, ["prefix"]).where("uid <> head").select("uid", "head").distinct()
    families = stored(components(edges, "uid", "head"), "families")

    linked = _links(keyed, some, nodes, families, threshold, width)
    classes = components(linked, "uid", "other")
    degree = linked.groupBy("uid").agg(F.sum("links").alias("links"))

    # Back to the rows. The doc_id is read again with the row's key; the rest comes from slim tables.
    ids = keyed.select("doc_id", "row_key").groupBy("row_key").agg(F.min("doc_id").alias("doc_id"))
    per_node = (nodes.join(classes.withColumnRenamed("node", "uid"), "uid", "left")
                .join(degree, "uid", "left")
                .select("d1", "d2", F.coalesce("root", "uid").alias("class"),
                        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    rows = (some.select("uid", "row_key", "d1", "d2", "n_shingles").join(per_node, ["d1", "d2"])
            .select("uid", "row_key", "n_shingles", "class", "n_links"))
    lone = signed.where("n_shingles = 0").select(
        "uid", "row_key", "n_shingles", F.col("uid").alias("class"), F.lit(0).cast("long").alias("n_links"))
    rows = stored(rows.union(lone).join(ids, "row_key"), "classed")
    # A struct with the null flag first: a row without an id is kept only where no other row has one.
    first = rows.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    return join_hot(rows, first, ["class"]).select(
        "doc_id", "row_key", F.col("first.doc_id").alias("class_id"), "n_links", "n_shingles",
        (F.col("uid") == F.col("first.uid")).alias("kept"))


def without(docs: DataFrame, dropped: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` whose ``row_key()`` is not in ``dropped`` (row_key).

    ``dropped`` is counted: up to ``broadcast_rows`` numbers it is broadcast, beyond that it is joined by a shuffle.
    """
    dropped = stored(dropped.select("row_key").distinct(), "dropped")
    small = dropped.count() <= broadcast_rows
    return docs.join(F.broadcast(dropped) if small else dropped, row_key(docs["text"], docs["doc_id"])
                     == dropped["row_key"], "left_anti")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``jaccard_join`` keeps, one per class, with all their columns."""
    classes = stored(jaccard_join(docs, threshold).select("row_key", "kept"), "verdicts")
    keys = classes.groupBy("row_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    remaining = without(docs, keys.where(~F.col("kept")))
    if keys.where("kept and n > 1").isEmpty():
        return remaining
    # Rows repeated with id and text are told apart by nothing: one of them stays.
    return remaining.withColumn("__key", row_key()).dropDuplicates(["__key"]).drop("__key")


def _blocks() -> Column:
    return F.ceil(F.greatest(F.col("n") / F.lit(BLOCK_TEXTS), F.col("s") / F.lit(BLOCK_SHINGLES))).cast("int")


def _sized(slim: DataFrame, *keys: str) -> DataFrame:
    return slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))


def _parted(slim: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``slim`` (uid, family, ...) with every family beyond one block taken apart into smaller ones.

    Members stay together if they share one of their rarest shingles and one of them may be the smaller of the two,
    directly or through others. Linked texts always do, whatever the counts: counters decide only the order. A
    member that shares none has no link and is left out. The work is linear in the members' shingles.
    """
    large = _sized(slim, "family").where(_blocks() > 1).select("family")
    if large.isEmpty():
        return slim
    rows = slim.join(large.withColumn("large", F.lit(True)), "family", "left")
    members = stored(sets.join(rows.where("large").select("uid", "family"), "uid"), "large")
    counted = members.select("shingles").mapInPandas(_count_shingles(COUNTERS), "counter long, n long")
    # One row per counter that is used.
    figures = counted.groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[figures["counter"].to_numpy()] = figures["n"].to_numpy()
    rare = members.mapInPandas(
        _rarest_shingles(slim.sparkSession.sparkContext.broadcast(counts), threshold),
        "uid long, family long, shingle long, as_smaller boolean")
    keys = ["family", "shingle"]
    meeting = rare.groupBy(*keys).agg(
        F.min("uid").alias("head"), F.max("uid").alias("last"), F.max("as_smaller").alias("some"))
    edges = join_hot(rare, meeting.where("some and head < last").drop("last", "some"), keys).where(
        "uid <> head").select("uid", "head").distinct()
    parts = components(edges, "uid", "head").select(F.col("node").alias("uid"), F.col("root").alias("part"))
    return (rows.where("large is null").drop("large")
            .unionByName(rows.where("large").join(parts, "uid").withColumn("family", F.col("part"))
                         .drop("large", "part")))


def _links(keyed: DataFrame, some: DataFrame, nodes: DataFrame, families: DataFrame, threshold: float,
           width: int) -> DataFrame:
    """(uid, other, links) of every text with a link, from all tasks that compare it."""
    family = families.select(F.col("node").alias("uid"), F.col("root").alias("family"))
    # Two sets whose sizes differ by more than the threshold allows cannot be similar: only equal and
    # neighbouring size classes are compared.
    size_class = F.floor(F.log("n_shingles") / F.lit(float(-np.log(threshold))) + F.lit(1e-9)).cast("int")
    slim = (some.select("uid", "row_key", "n_shingles").join(family, "uid")
            .join(nodes.select("uid", "copies"), "uid").withColumn("cls", size_class))
    slim = stored(slim, "members")
    # The text is fetched once per member; from here on its shingles travel.
    texts = keyed.join(slim.select("row_key", "uid"), "row_key").select("uid", "text")
    sets = stored(texts.mapInPandas(_member_sets(width), "uid long, shingles binary"), "sets")
    slim = stored(_parted(slim.drop("row_key"), sets, threshold), "parted")

    cells = _sized(slim, "family", "cls")
    whole = cells.groupBy("family").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    blocks = _blocks()
    # A family that fits one block is one task, whatever its sizes.
    small = whole.where((blocks == 1) & (F.col("n") > 1)).select("family")
    in_one = join_hot(slim, small, ["family"]).select(
        "uid", "copies", F.array(F.concat_ws(":", "family")).alias("tasks"), F.lit("all").alias("side"))
    counts = cells.select("family", "cls", blocks.alias("blocks"))
    large = join_hot(slim, whole.where(blocks > 1).select("family"), ["family"])
    own = join_hot(large, counts, ["family", "cls"]).withColumn(
        "block", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")).cast("int"))
    below = counts.select("family", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("below"))
    above = counts.select("family", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("above"))
    own = join_hot(join_hot(own, below, ["family", "cls"], "left"), above, ["family", "cls"], "left")

    def task(*parts):
        return F.concat_ws(":", "family", *[F.col(p) if isinstance(p, str) else p for p in parts])

    def lower(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    mine = lower(F.col("blocks"))
    same = F.transform(mine, lambda b: task("cls", "cls", F.least(b, "block"), F.greatest(b, "block")))
    down = F.transform(lower(F.coalesce("below", F.lit(0))),
                       lambda b: task(F.col("cls") - 1, "cls", b, "block"))
    up = F.transform(lower(F.coalesce("above", F.lit(0))),
                     lambda b: task("cls", F.col("cls") + 1, "block", b))
    in_many = own.select("uid", "copies", F.concat(same, down, up).alias("tasks"),
                         F.concat_ws(":", "cls", "block").alias("side"))
    where = in_one.unionByName(in_many)
    spread = sets.join(where, "uid").select("uid", "copies", "side", "shingles", F.explode("tasks").alias("task"))
    return stored(spread.groupBy("task").applyInPandas(
        _verifier(threshold), "uid long, other long, links long"), "links")
