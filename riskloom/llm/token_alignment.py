"""Cross-tokenizer alignment by spans: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level BPE of `tokenizers`, B a BPE with byte fallback of `sentencepiece`. The character
spans of both are coarse cuts of the text. Where tokens share a character, or a byte-fallback token has
no span of its own, the cut is refined with the bytes the tokens decode to, counted on from the last coarse cut.
Where tokens of both end is a cut between groups; where byte ranges overlap is a link.

Both tokenizers treat a blank behind a character that is no white space as the beginning of a token, whatever stands
around it. Texts are cut there, and the alignment of such a chunk is the same wherever it occurs, so a task works it
out once and keeps it while there is room.

The links of a document and the dictionary of a part (some documents of one task) are written once. How many documents
hold a pair is a shuffled aggregate over the dictionaries, and each part gets its own pairs' counts back by a join: no
table of all pairs is ever in one place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from riskloom.session import stored

#: Characters of the documents of a part, apart from a single text that is longer by itself.
PART_CHARS = 4_000_000
#: Characters of texts that are looked up together.
_RUN_CHARS = 500_000
#: Chunks and links that a task keeps before it begins anew.
KEPT_CHUNKS = 400_000
KEPT_LINKS = 4_000_000
_CUT = re.compile(r" (?<=\S )(?=.)", re.S)
_B_BLANK = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


class Tokenizers:
    """Both tokenizers and the bytes of every entry."""

    def __init__(self, path_a: str, path_b: str):
        import os

        import sentencepiece
        import tokenizers

        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # Printable stand-ins of bytes: printable ones stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain}
        byte |= {chr(256 + at): b for at, b in enumerate(b for b in range(256) if b not in plain)}
        self.bytes_a = [bytes(byte.get(c, 0) for c in self.a.id_to_token(at) or "")
                        for at in range(self.a.get_vocab_size())]
        self.bytes_b = []
        for at in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(at)
            single = _BYTE_PIECE.fullmatch(piece) if self.b.is_byte(at) else None
            self.bytes_b.append(bytes([int(single[1], 16)]) if single else piece.replace(_B_BLANK, " ").encode())
        self.length_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.length_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.shift = len(self.bytes_b).bit_length()

    def spans_a(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and character spans."""
        encoding = self.a.encode(text, add_special_tokens=False)
        return _flat(encoding.ids, encoding.offsets)

    def spans_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and character spans, not counting the blank that the tokenizer adds.

        These are the spans of its proto, which the library also hands out as lists.
        """
        mapping = self.b.encode(text, return_type="offset_mapping")
        return _flat(mapping["ids"], mapping["offsets"])


def _flat(ids: list[int], spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(ids, np.int64), np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


@cache
def _loaded(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _refined(coarse: np.ndarray, ragged: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ends of all tokens: a coarse cut, or, at a ragged one, the last sound cut and the bytes since then."""
    if not len(coarse):
        return coarse
    exact = np.cumsum(lengths)
    anchor = np.maximum.accumulate(np.where(ragged, -1, np.arange(len(coarse))))
    base = np.where(anchor < 0, 0, coarse[anchor] - exact[anchor])
    return np.where(ragged, base + exact, coarse)


class _Grown:
    """A flat array that is appended to."""

    def __init__(self, dtype):
        self._all, self.size = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self._all):
            self._all = np.resize(self._all, max(2 * len(self._all), self.size + len(values)))
        self._all[self.size:self.size + len(values)] = values
        self.size += len(values)

    @property
    def values(self) -> np.ndarray:
        return self._all[:self.size]


class _Chunks:
    """Alignments of the chunks met so far, by number."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        # A token of a group string: its id and what follows, by (id, whether it ends its side of the group).
        self._marks_a = [f"{at}{sign}".encode() for at in range(len(tokenizers.bytes_a)) for sign in ",|"]
        self._marks_b = [f"{at}{sign}".encode() for at in range(len(tokenizers.bytes_b)) for sign in ",;"]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        #: n_a, n_b, n_groups, n_links; a chunk whose tokens do not give its bytes has n_a = -1.
        self.figures = [_Grown(np.int64) for _ in _FIGURES]
        self.first, self.pairs, self.times = _Grown(np.int64), _Grown(np.int64), _Grown(np.int64)

    @property
    def full(self) -> bool:
        return len(self.groups) > KEPT_CHUNKS or self.pairs.size > KEPT_LINKS

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that are not known."""
        # Only the last chunk of a text may end in white space, behind which no cut is certain.
        inner = [c for c in chunks if c and not c[-1].isspace()]
        if inner:
            self._learn(inner)
        for chunk in chunks:
            if not chunk or chunk[-1].isspace():
                self._learn([chunk])

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks end to end, each behind its blank; those that do not give their bytes are told apart."""
        t, joined = self.t, " ".join(chunks)
        (id_a, span_a), (id_b, span_b) = t.spans_a(" " + joined), t.spans_b(joined)
        raw = (" " + joined).encode()
        if not (b"".join(map(t.bytes_a.__getitem__, id_a.tolist())) == raw
                == b"".join(map(t.bytes_b.__getitem__, id_b.tolist()))):
            if len(chunks) > 1:
                self._learn(chunks[:len(chunks) // 2])
                self._learn(chunks[len(chunks) // 2:])
            else:
                self._keep(chunks, [np.array([-1])] * len(_FIGURES), np.zeros(1, np.int64), *np.zeros((2, 0), np.int64),
                           [b""])
            return
        # Bytes before every character.
        before = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        # Tokens inside one character all have its span in A; in B all but the last have none.
        ragged_a = np.append(span_a[1:, 0] < span_a[:-1, 1], False)
        ragged_b = span_b[:, 0] == span_b[:, 1]
        end_a = _refined(before[span_a[:, 1]], ragged_a, t.length_a[id_a])
        end_b = _refined(before[span_b[:, 1] + 1], ragged_b, t.length_b[id_b])
        cell = np.union1d(end_a, end_b)
        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        # Where every chunk ends: chunks begin at blanks, so their number is that of the sizes in characters.
        stop = before[np.cumsum([len(c) + 1 for c in chunks])]

        def per_chunk(ends: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(ends, stop, side="right"), prepend=0)

        owner = np.searchsorted(stop, cell)
        pair = (id_a[np.searchsorted(end_a, cell)] << t.shift) | id_b[np.searchsorted(end_b, cell)]
        order = np.lexsort((pair, owner))
        owner, pair = owner[order], pair[order]
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))
        marks = self._marks(id_a, end_a, id_b, end_b, cut)
        figures = [per_chunk(e) for e in (end_a, end_b, cut, cell)]
        last = np.cumsum(figures[0] + figures[1]).tolist()
        self._keep(chunks, figures, np.bincount(owner[new], minlength=len(chunks)), pair[new],
                   np.diff(np.append(new, len(pair))), [b"".join(marks[x:y]) for x, y in zip([0, *last], last)])

    def _keep(self, chunks, figures, held, pairs, times, groups) -> None:
        for target, values in zip(self.figures, figures):
            target.add(values)
        self.first.add(np.cumsum(held) - held + self.pairs.size)
        self.pairs.add(pairs)
        self.times.add(times)
        self.number.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks))))
        self.groups += groups

    def _marks(self, id_a, end_a, id_b, end_b, cut) -> list[bytes]:
        """The tokens of all groups as they are written: A's of a group, then B's."""
        group = np.concatenate((np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)))
        side = np.repeat([0, 1], [len(id_a), len(id_b)])
        token = np.concatenate((2 * id_a + np.isin(end_a, cut, assume_unique=True),
                                2 * id_b + np.isin(end_b, cut, assume_unique=True)))
        order = np.lexsort((side, group))
        return [(self._marks_b if s else self._marks_a)[at]
                for s, at in zip(side[order].tolist(), token[order].tolist())]


def _align(path_a: str, path_b: str, part_chars: int):
    def flush(rows: list[tuple], part: int, id_type: pa.DataType) -> pa.RecordBatch:
        ids, figures, digests, keys, times = zip(*rows)
        every = np.concatenate(keys)
        pairs, place = np.unique(every, return_inverse=True)
        # A document has each of its pairs once, so this counts documents.
        held = np.bincount(place, minlength=len(pairs))
        bounds = np.cumsum([0, *map(len, keys)])
        nothing = [None] * (len(rows) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([i.as_py() for i in ids], id_type), pa.array([part] * len(rows), pa.int64()),
             *(pa.array(f, pa.int64()) for f in zip(*figures)), pa.array(digests, pa.string()),
             pa.array([place[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
             pa.array([t.astype("<u4").tobytes() for t in times], pa.binary()),
             pa.array([pairs, *nothing], pa.list_(pa.int64())), pa.array([held, *nothing], pa.list_(pa.int64()))],
            ["doc_id", "part", *_FIGURES, "groups_sha256", "places", "times", "pairs", "held"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Chunks(_loaded(path_a, path_b))
        part, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            first = 0
            while first < len(batch):
                run, chars, last = [], 0, first
                while last < len(batch) and (not run or chars < _RUN_CHARS):
                    text = texts[last].as_py() or ""
                    run.append(_CUT.split(text) if text else [])
                    chars += len(text)
                    last += 1
                if known.full:
                    known.clear()
                number = known.number
                unknown = dict.fromkeys(c for chunks in run for c in chunks if c not in number)
                if unknown:
                    known.learn(list(unknown))
                for at, chunks in enumerate(run):
                    rows.append((ids[first + at], *_document(known, chunks)))
                size += chars
                first = last
                if size >= part_chars:
                    yield flush(rows, part, ids.type)
                    part, rows, size = part + 1, [], 0
        if rows:
            yield flush(rows, part, ids.type)

    return align


def _document(known: _Chunks, chunks: list[str]) -> tuple:
    """Figures, digest, pairs and how often each is linked."""
    none = np.zeros(0, np.int64)
    numbers = [known.number[c] for c in chunks]
    of = np.array(numbers, np.int64)
    if not numbers or (known.figures[0].values[of] < 0).any():
        return (0, 0, 0, 0), "", none, none
    digest = hashlib.sha256(b"".join(map(known.groups.__getitem__, numbers))[:-1]).hexdigest()
    figures = tuple(int(f.values[of].sum()) for f in known.figures)
    of, often = np.unique(of, return_counts=True)
    first = known.first.values
    start = first[of]
    stop = np.where(of + 1 < len(first), first[np.minimum(of + 1, len(first) - 1)], known.pairs.size)
    n = stop - start
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pairs, times = known.pairs.values[at], known.times.values[at] * np.repeat(often, n)
    pairs, place = np.unique(pairs, return_inverse=True)
    return figures, digest, pairs, np.bincount(place, weights=times, minlength=len(pairs)).astype(np.int64)


def _weigh(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of every document of a part."""
    n = np.zeros(counts.num_rows, np.int64)
    best = np.zeros(counts.num_rows, np.int64)
    place = counts["place"].to_numpy()
    n[place], best[place] = counts["n"].to_numpy(), counts["best"].to_numpy()
    sums = []
    for places, times in zip(docs["places"], docs["times"]):
        own = np.frombuffer(places.as_py(), "<u4")
        often = np.frombuffer(times.as_py(), "<u4").astype(np.int64)
        sums.append((int(often @ best[own]), int(often @ n[own])))
    n_best, count_sum = zip(*sums)
    return docs.select(["doc_id", *_FIGURES]).append_column("n_best", pa.array(n_best, pa.int64())).append_column(
        "count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A encodes a blank and the text, B the text, before which it sets a blank itself; strings of special tokens are
    plain text. A group is what lies between two byte offsets at which tokens of both end. A link is a pair of tokens
    whose byte ranges overlap; the count of its ids is how many documents hold them linked. ``n_best`` counts the
    links whose count is the highest of their A id, ties included; ``count_sum`` adds up the counts of all links.

    Null and empty texts, and those whose tokens do not give back the text's bytes (B reads U+2581 as a blank), have
    zeros and an empty digest. Repeated rows count as documents each; null ids are carried through. Only doc_id and
    text are read, whatever other columns there are.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    figures = ", ".join(f"{f} long" for f in _FIGURES)
    linked = stored(docs.select("doc_id", "text").mapInArrow(
        _align(path_a, path_b, part_chars),
        f"doc_id {id_type}, part long, {figures}, groups_sha256 string, places binary, times binary, "
        "pairs array<long>, held array<long>"), "links")
    entries = linked.where(F.col("pairs").isNotNull()).select(
        F.col("part").alias("of_part"), F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "entry")).select(
        "of_part", "place", F.col("entry.pairs").alias("pair"), F.col("entry.held").alias("held"))
    shift = _loaded(path_a, path_b).shift
    counted = stored(entries.groupBy("pair").agg(F.sum("held").alias("n")), "pair_counts")
    first = F.shiftright("pair", shift)
    # One row per entry of A's vocabulary.
    highest = counted.groupBy(first.alias("a")).agg(F.max("n").alias("highest"))
    judged = counted.join(F.broadcast(highest), first == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("highest")).cast("int").alias("best"))
    looked = entries.join(judged, "pair").select("of_part", "place", "n", "best")
    return linked.drop("pairs", "held").groupBy("part").cogroup(looked.groupBy("of_part")).applyInArrow(
        _weigh, f"doc_id {id_type}, {figures}, n_best long, count_sum long, groups_sha256 string")
