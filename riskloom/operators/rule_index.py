"""Rule packs of any size: a text fetches the rules whose literals it holds, and only those run.

Every match of a rule holds its needle, a literal taken from its pattern. A rule that is one word, or the beginning of
one, is looked up for each different word of a text, whose rules a task remembers. The needles of the others make one
automaton that reads a text once. A rule that is a literal between word boundaries, or with one on either side, is
decided where the needle was found; of the others the regular expression runs. So the time of a text follows from what
it holds and hardly from the number of rules. Rules without a literal cannot be indexed and run on every text; ``unindexed`` counts them.

Matching is a map. Rules of words are columns sorted by a hash of their literal, some 40 bytes a rule with the words of a
corpus, and no object of Python each. The pack goes to every task, which reads a text once for as many blocks as
``block_chars`` allows; a larger pack takes several passes over the texts, so what a task and the driver send and hold
at once is bounded.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.session import stored

# The kernel below travels inside the tasks, so executors need numpy, pyarrow and ahocorasick but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of the patterns of one pass over the texts, and ``_EACH`` more a rule: a task holds some 170 MB of rules of words.
BLOCK_CHARS, _EACH = 128_000_000, 16
#: Words whose rules a task remembers; rows and characters of texts whose hits it holds at once.
_WORDS, _ROWS, _CHARS = 100_000, 1_000, 1_000_000
_HITS, _FOUND = "_hits", "_found"
_HIT = pa.list_(pa.struct([("category", pa.string()), ("pattern", pa.string()), ("weight", pa.float64())]))
_HIT_TYPE = T.ArrayType(T.StructType([
    T.StructField("category", T.StringType()), T.StructField("pattern", T.StringType()),
    T.StructField("weight", T.DoubleType())]))
# Of a text: one for each category, with its rules.
_OF_CATEGORY = pa.list_(pa.struct([("pattern", pa.string()), ("weight", pa.float64())]))
_GROUP_TYPE = T.ArrayType(T.StructType([
    T.StructField("category", T.StringType()), T.StructField("rules", T.ArrayType(T.StructType([
        T.StructField("pattern", T.StringType()), T.StructField("weight", T.DoubleType())])))]))
_TOKEN = re.compile(r"\w+")
_LITERAL = re.compile(r"(\\b)?((?:[^\\.^$*+?{}\[\]|()]|\\[^A-Za-z0-9])+)(\\b)?")
# How a rule is found: as a whole word, as the beginning of one, otherwise.
_WHOLE, _BEGIN, _OTHER = range(3)


def needle_of(pattern: str) -> str | None:
    """The longest literal that every match of a pattern holds, as far as its outermost level tells; else None."""
    runs, run, at, inside = [], "", 0, 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            piece, literal = pattern[at:at + 2], pattern[at + 1:at + 2] if not pattern[at + 1:at + 2].isalnum() else ""
        elif sign == "[":
            # A closing bracket that comes first belongs to the class.
            end = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]", re.S).match(pattern, at)
            if not end:
                return None
            piece, literal = end[0], ""
        else:
            piece, literal = sign, "" if sign in ".^$*+?{}|()" else sign
        if sign == "|" and not inside or pattern.startswith("(?", at):
            # An alternative need not hold it; of flags and assertions nothing is assumed.
            return None
        after = at + len(piece)
        inside += (piece == "(") - (piece == ")")
        quantified = pattern[after:after + 1] in ("?", "*", "{") and piece not in ("?", "*", "+", "}")
        if literal and not inside and not quantified:
            run += literal
        elif not (piece == "\\b" and not inside):
            runs.append(run)
            run = ""
        if literal and not inside and pattern[after:after + 1] == "+":
            runs.append(run)
            run = ""
        if piece == "{":
            after = pattern.find("}", at) + 1 or len(pattern)
        at = after
    runs.append(run)
    return max(runs, key=len) or None


def _literal(plain: re.Match) -> str:
    return re.sub(r"\\(.)", r"\1", plain[2], flags=re.S)


def _shape(pattern: str) -> tuple[int, bytes]:
    """How a rule is found, and the word or beginning it is."""
    plain = _LITERAL.fullmatch(pattern)
    if plain and plain[1] and _TOKEN.fullmatch(literal := _literal(plain)):
        return _WHOLE if plain[3] else _BEGIN, literal.encode()
    return _OTHER, b""


def _multipliers(n: int) -> np.ndarray:
    """An odd number of 64 bits for each of the first positions."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def _sums(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins, its length, and running sums: those at two places tell the hash of what lies between."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    signs = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    signs *= _multipliers(int(sizes.max(initial=0)))[np.arange(len(signs)) - np.repeat(starts, sizes)]
    return starts, sizes, np.concatenate([np.zeros(1, np.uint64), np.cumsum(signs, dtype=np.uint64)])


def _hashes(words: list[bytes]) -> np.ndarray:
    starts, sizes, sums = _sums(words)
    return (sums[starts + sizes] - sums[starts]).view(np.int64)


def _runs(words: list[bytes], most: int = _CHARS) -> Iterator[list[bytes]]:
    """The words in runs of so many bytes, or of one word."""
    run, size = [], 0
    for word in words:
        if run and size + len(word) > most:
            yield run
            run, size = [], 0
        run.append(word)
        size += len(word)
    if run:
        yield run


class _Block(NamedTuple):
    """Rules as a hit takes them: whole words and then beginnings, each by the hash of the literal, and then the others."""

    rules: pa.StructArray
    hashes: np.ndarray
    #: Rules that are a whole word; lengths of the beginnings, and of the longest literal, in bytes.
    whole: int
    lengths: tuple[int, ...]
    longest: int

    @classmethod
    def of(cls, rules: pa.StructArray, kinds: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> "_Block":
        """From rules in this order."""
        whole, words = (int(np.searchsorted(kinds, kind)) for kind in (_BEGIN, _OTHER))
        return cls(rules, hashes[:words].copy(), whole, tuple(np.unique(sizes[whole:words]).tolist()),
                   int(sizes[:words].max(initial=0)))

    @classmethod
    def sorted(cls, rules: pa.StructArray) -> "_Block":
        kinds, hashes, sizes = _shapes(rules.field("pattern").to_pylist())
        order = np.lexsort((hashes, kinds))
        return cls.of(rules.take(pa.array(order)), kinds[order], hashes[order], sizes[order])


def _shapes(patterns: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pattern how it is found, the hash of its literal and that one's length in bytes."""
    shapes = [(_OTHER, b"") if p is None else _shape(p) for p in patterns]
    literals = [literal for _, literal in shapes]
    hashes = [np.zeros(0, np.int64), *map(_hashes, _runs(literals))]
    return (np.array([kind for kind, _ in shapes], np.int8), np.concatenate(hashes),
            np.fromiter(map(len, literals), np.int32, len(literals)))


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _shapes(batch.column("pattern").to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)],
                                         [*batch.schema.names, "kind", "hash", "size"])


#: Columns of a rule with its shape, as they reach the driver.
_COLUMNS = [*_HIT.value_type, pa.field("kind", pa.int8()), pa.field("hash", pa.int64()), pa.field("size", pa.int32())]


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row, with a value for every column."""
    for batch in batches:
        packets = []
        for field in _COLUMNS:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, pa.schema([field])) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays([batch.column(field.name).cast(field.type)], schema=pa.schema([field])))
            packets.append(pa.array([out.getvalue().to_pybytes()], pa.binary()))
        yield pa.RecordBatch.from_arrays(packets, [field.name for field in _COLUMNS])


def _block(pieces: dict[str, list[pa.Array]]) -> _Block:
    """From the columns of rules that come in the order of a block; takes the pieces, so that none is held twice."""
    whole = {f.name: pa.concat_arrays(pieces.pop(f.name) or [pa.array([], f.type)]) for f in _COLUMNS}
    fields = list(_HIT.value_type)
    rules = pa.StructArray.from_arrays([whole[f.name] for f in fields], fields=fields)
    return _Block.of(rules, *(whole[name].to_numpy() for name in ("kind", "hash", "size")))


@dataclass(frozen=True)
class IndexedPack:
    """Blocks of rules ``(category, pattern, weight)``, the cap of every category, and what one pass over the texts takes."""

    blocks: tuple[tuple[tuple[str, str, float], ...] | _Block, ...]
    caps: dict[str, float]
    block_chars: int = BLOCK_CHARS

    @property
    def categories(self) -> list[str]:
        return list(self.caps)

    @property
    def unindexed(self) -> int:
        # Rules of words have a literal.
        others = (block.rules[len(block.hashes):].field("pattern").to_pylist() if isinstance(block, _Block)
                  else (pattern for _, pattern, _ in block) for block in self.blocks)
        return sum(needle_of(pattern) is None for patterns in others for pattern in patterns)

    def passes(self) -> Iterator[_Block]:
        """The blocks, joined as far as one pass over the texts takes them."""
        held, size = [], 0
        for block in self.blocks:
            if isinstance(block, _Block):
                # Cut to a pass each.
                yield block
                continue
            own = sum(len(pattern) + _EACH for _, pattern, _ in block)
            if held and size + own > self.block_chars:
                yield _Block.sorted(_packed(held))
                held, size = [], 0
            held += block
            size += own
        if held or not self.blocks:
            yield _Block.sorted(_packed(held))

    @classmethod
    def from_frames(cls, rules: DataFrame, caps: DataFrame, block_chars: int = BLOCK_CHARS) -> "IndexedPack":
        """Pack kept as tables ``(category, pattern, weight)`` and ``(category, max_score)``; each category needs a cap."""
        limits = {r.category: float(r.max_score) for r in caps.orderBy("category").collect()}
        rules = rules.select("category", "pattern", F.col("weight").cast("double").alias("weight"))
        # Read by the test below, for the order's bounds and for the blocks.
        rules = stored(rules.mapInArrow(_shaped, T.StructType([
            *rules.schema.fields, T.StructField("kind", T.ByteType()), T.StructField("hash", T.LongType()),
            T.StructField("size", T.IntegerType())])), "rules")
        if missing := rules.select("category").distinct().where(~F.col("category").isin(*limits)).orderBy(
                "category").limit(5).collect():
            raise ValueError(f"no cap for the categories {[r.category for r in missing]}")
        blocks, held, size = [], {f.name: [] for f in _COLUMNS}, 0
        packets = rules.where("pattern is not null").distinct().orderBy("kind", "hash", "category", "pattern", "weight").mapInArrow(
            _packets, ", ".join(f"{f.name} binary" for f in _COLUMNS))
        for r in packets.toLocalIterator():
            piece = {f.name: pa.ipc.open_stream(r[f.name]).read_next_batch().column(0) for f in _COLUMNS}
            ends = np.cumsum(pc.utf8_length(piece["pattern"]).to_numpy().astype(np.int64) + _EACH)
            at, before = 0, 0
            while at < len(ends):
                to = min(int(np.searchsorted(ends, before + block_chars - size)) + 1, len(ends))
                for name, column in piece.items():
                    held[name].append(column.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at, before = to, int(ends[to - 1])
                if size >= block_chars:
                    blocks.append(_block(held))
                    held, size = {f.name: [] for f in _COLUMNS}, 0
        return cls(tuple(blocks + [_block(held)] if size or not blocks else blocks), limits, block_chars)


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at] == "_" or text[at].isalnum())


def _packed(rules) -> pa.StructArray:
    """Rules ``(category, pattern, weight)`` as a hit takes them."""
    fields = list(_HIT.value_type)
    return pa.StructArray.from_arrays([pa.array([r[at] for r in rules], f.type) for at, f in enumerate(fields)], fields=fields)


class _Index:
    def __init__(self, rules):
        import ahocorasick

        block = rules if isinstance(rules, _Block) else _Block.sorted(_packed(rules))
        self.rules, self._hashes, self._whole, self._lengths, self._longest = block
        self._patterns = self.rules.field("pattern")
        self._compiled: dict[int, re.Pattern] = {}
        # The rules of the words seen.
        self._of_word: dict[str, tuple[int, ...]] = {}
        self._always, by_needle = [], {}
        for at, pattern in enumerate(self._patterns[len(self._hashes):].to_pylist(), len(self._hashes)):
            plain = _LITERAL.fullmatch(pattern)
            literal = _literal(plain) if plain else needle_of(pattern)
            if not literal:
                self._always.append(at)
                continue
            # Where the literal is all of a rule: whether a word has to begin or end there.
            edges = (bool(plain[1]), bool(plain[3])) if plain else None
            by_needle.setdefault(literal, []).append((at, edges))
        self._automaton = ahocorasick.Automaton()
        for literal, found in by_needle.items():
            self._automaton.add_word(literal, (len(literal), found))
        if by_needle:
            self._automaton.make_automaton()

    def _fires(self, at: int, text: str) -> bool:
        if at not in self._compiled:
            self._compiled[at] = re.compile(self.rules[at]["pattern"].as_py())
        return bool(self._compiled[at].search(text))

    def _learn(self, words: set[str]) -> None:
        """Remember the rules that are one of these words or a beginning of it."""
        if len(self._of_word) + len(words) > _WORDS:
            self._of_word = {word: self._of_word[word] for word in words & self._of_word.keys()}
        new = [word for word in words if word not in self._of_word]
        self._of_word.update(dict.fromkeys(new, ()))
        at = 0
        # Of a longer word no more is needed than that it is longer.
        for heads in _runs([word.encode()[:self._longest + 1] for word in new]):
            starts, sizes, sums = _sums(heads)
            own, every = new[at:at + len(heads)], np.arange(len(heads))
            self._find(own, heads, every, sizes, sums[starts + sizes] - sums[starts], 0, self._whole)
            for length in self._lengths:
                fit = np.flatnonzero(sizes >= length)
                self._find(own, heads, fit, np.full(len(fit), length), sums[starts[fit] + length] - sums[starts[fit]],
                           self._whole, len(self._hashes))
            at += len(heads)

    def _find(self, words, heads, fit, sizes, hashes, first, last) -> None:
        """Remember the rules numbered from ``first`` up to ``last`` that are so many bytes of the words ``fit``."""
        there, hashes = self._hashes[first:last], hashes.view(np.int64)
        left = np.searchsorted(there, hashes)
        met = np.flatnonzero((left < len(there)) & (there[np.minimum(left, len(there) - 1)] == hashes)) if len(there) else left[:0]
        counts = np.searchsorted(there, hashes[met], "right") - left[met]
        numbers = first + np.repeat(left[met] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        which, sizes = (np.repeat(of[met], counts).tolist() for of in (fit, sizes))
        for row, size, at, pattern in zip(which, sizes, numbers.tolist(), self._patterns.take(pa.array(numbers)).to_pylist()):
            # Equal hashes need not be equal literals.
            if at < self._whole and pattern == f"\\b{words[row]}\\b" or _shape(pattern)[1] == heads[row][:size]:
                self._of_word[words[row]] += (at,)

    def fired(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of the rules that match each text, in order."""
        words = [set(_TOKEN.findall(text)) if text and len(self._hashes) else () for text in texts]
        self._learn(set().union(*words))
        of = self._of_word.__getitem__
        return [self._fired(text, set(chain.from_iterable(map(of, own)))) if text else [] for text, own in zip(texts, words)]

    def _fired(self, text: str, fired: set[int]) -> list[int]:
        tried = set()
        if len(self._automaton):
            for last, (length, rules) in self._automaton.iter(text):
                first = last + 1 - length
                for at, edges in rules:
                    if at in fired or at in tried:
                        continue
                    if edges is None:
                        tried.add(at)
                        if self._fires(at, text):
                            fired.add(at)
                    # A boundary has a word character on one side only.
                    elif (not edges[0] or _word(text, first - 1) != _word(text, first)) and (
                            not edges[1] or _word(text, last) != _word(text, last + 1)):
                        fired.add(at)
        fired.update(at for at in self._always if self._fires(at, text))
        return sorted(fired)

    def matches(self, text: str) -> list[dict]:
        return self.rules.take(pa.array(self.fired([text])[0], pa.int64())).to_pylist()


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """At most so many rows and characters at once, or one row: hits take many times the room of their texts."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("_lowered")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(batch):
        to = max(at + 1, min(at + _ROWS, int(np.searchsorted(ends, before + _CHARS, "right"))))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def _hits(rules: pa.StructArray, fired: list[list[int]]) -> pa.ListArray:
    """The rules of each text."""
    starts = np.cumsum([0, *map(len, fired)], dtype=np.int32)
    numbers = np.fromiter(chain.from_iterable(fired), np.int64, int(starts[-1]))
    return pa.ListArray.from_arrays(pa.array(starts), rules.take(pa.array(numbers)))


def _by_category(rules: pa.StructArray, fired: list[list[int]]) -> pa.ListArray:
    """The categories of each text, with the rules of each."""
    hits = _hits(rules, fired)
    named, texts = hits.values.field("category").dictionary_encode("encode"), np.diff(hits.offsets.to_numpy())
    codes, rows = named.indices.to_numpy(), np.repeat(np.arange(len(texts)), texts)
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1).astype(bool) | np.diff(rows, prepend=-1).astype(bool))
    found = hits.values.take(pa.array(order))
    own = pa.StructArray.from_arrays([found.field(f.name) for f in _OF_CATEGORY.value_type], fields=list(_OF_CATEGORY.value_type))
    groups = pa.StructArray.from_arrays(
        [named.dictionary.take(pa.array(codes[first])),
         pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), own)], ["category", "rules"])
    starts = np.searchsorted(rows[first], np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), groups)


def _matcher(shared, form):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(_Block(*shared.value))
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            found = form(index.rules, index.fired(batch.column("_lowered").to_pylist()))
            kept = [n for n in batch.schema.names if n != "_lowered"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), found], [*kept, _FOUND])

    return match


def _found(df: DataFrame, block: _Block, column: str, kept: list[str] | None = None, form=_hits,
           kind: T.DataType = _HIT_TYPE) -> DataFrame:
    """``df``, or some of its columns, with the matching rules of one pass in ``_FOUND``; null and empty texts match none."""
    # A plain tuple, as executors lack this package.
    shared = df.sparkSession.sparkContext.broadcast(tuple(block))
    kept = df if kept is None else df.select(*[F.col(f"`{n}`") for n in kept])
    given = df.select(*[F.col(f"`{n}`") for n in kept.columns], F.lower(F.col(column)).alias("_lowered"))
    return given.mapInArrow(_matcher(shared, form), T.StructType([*kept.schema.fields, T.StructField(_FOUND, kind)]))


def _rows(df: DataFrame, pack: IndexedPack, column: str, kept: list[str], **form) -> DataFrame:
    """One row per row of ``df`` and element that is found, each once as the rules of a pack are."""
    return reduce(DataFrame.unionAll, (_found(df, block, column, kept, **form).select(
        *[F.col(f"`{n}`") for n in kept], F.inline(_FOUND)) for block in pack.passes()))


def _matched(df: DataFrame, pack: IndexedPack, column: str) -> DataFrame:
    """``df`` with the matching rules in ``_HITS``, in order, each once as the rules of a pack are."""
    out = None
    for block in pack.passes():
        # Written between passes: one after another in the same tasks, all would be held at once.
        given = df.withColumn(_HITS, F.lit([]).cast(_HIT_TYPE)) if out is None else stored(out, "hits")
        out = _found(given, block, column).withColumn(_HITS, F.concat(_HITS, _FOUND)).drop(_FOUND)
    return out.withColumn(_HITS, F.sort_array(_HITS))


def _of(category: str) -> Column:
    return F.filter(_HITS, lambda hit: hit["category"] == category)


def match_rules(df: DataFrame, pack: IndexedPack, column: str = "text", by_category: bool = False,
                keep: list[str] | None = None) -> DataFrame:
    """Long form: one row per message and matching rule, with ``category, pattern, weight``.

    ``by_category``: one row per message and category instead, its rules as an array of ``(pattern, weight)`` in ``rules``;
    a category whose rules are in several passes has a row of each. An aggregate sorts far fewer rows of this form.
    ``keep``: the columns of ``df`` in the result, all by default. What is left out, such as the text, does not go through
    the tasks' workers.
    """
    return _rows(df, pack, column, df.columns if keep is None else keep, **(
        {"form": _by_category, "kind": _GROUP_TYPE} if by_category else {}))


def analyse(df: DataFrame, pack: IndexedPack, column: str = "text") -> DataFrame:
    """``score_<category>`` (the highest weight matched, at most the cap), ``patterns_<category>``, ``total_score``."""
    scored = _matched(df, pack, column).withColumns({
        f"score_{c}": F.least(F.greatest(F.lit(0.0), F.coalesce(
            F.array_max(F.transform(_of(c), lambda hit: hit["weight"])), F.lit(0.0))), F.lit(pack.caps[c]))
        for c in pack.categories
    } | {
        f"patterns_{c}": F.sort_array(F.array_distinct(F.transform(_of(c), lambda hit: hit["pattern"])))
        for c in pack.categories
    })
    total = reduce(lambda a, b: a + b, [F.col(f"score_{c}") for c in pack.categories])
    return scored.withColumn("total_score", F.round(total / len(pack.categories), 4)).drop(_HITS)


def rule_coverage(df: DataFrame, rules: DataFrame, pack: IndexedPack, column: str = "text") -> DataFrame:
    """Messages hit by each rule of the pack table; those that never fire are listed with 0."""
    hits = _rows(df.select(column), pack, column, []).groupBy("category", "pattern").agg(
        F.count(F.lit(1)).alias("rule_hits"))
    return rules.select("category", "pattern").distinct().join(hits, ["category", "pattern"], "left").select(
        "category", "pattern", F.coalesce("rule_hits", F.lit(0)).alias("rule_hits"))
