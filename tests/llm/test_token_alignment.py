"""Alignment against whole texts encoded at once and every pair of tokens compared."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import token_alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string"


def byte_of_sign():
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in plain}
    extra = 0
    for b in range(256):
        if b not in plain:
            signs[chr(256 + extra)] = b
            extra += 1
    return signs


def tokens(text, a, b, signs):
    left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return left, right


def ranges(side):
    at, out = 0, []
    for number, raw in side:
        out.append((number, at, at + len(raw)))
        at += len(raw)
    return out


def brute(docs):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    signs = byte_of_sign()
    read = []
    for doc, text in docs:
        left, right = tokens(text, a, b, signs) if text else ([], [])
        wanted = (" " + text).encode() if text else b""
        if b"".join(r for _, r in left) != wanted or b"".join(r for _, r in right) != wanted:
            left, right = [], []
        read.append((doc, ranges(left), ranges(right)))
    links = [[(x, y) for x, s, e in left for y, t, f in right if max(s, t) < min(e, f)] for _, left, right in read]
    count = Counter(pair for own in links for pair in set(own))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    rows = []
    for (doc, left, right), own in zip(read, links):
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        text = ";".join(
            ",".join(str(x) for x, _, e in left if low < e <= high) + "|"
            + ",".join(str(y) for y, _, e in right if low < e <= high) for low, high in zip([0, *cuts], cuts))
        rows.append((doc, len(left), len(right), len(cuts), len(own), sum(count[p] == best[p[0]] for p in own),
                     sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(rows, key=repr)


def found(docs, **options):
    return sorted(map(tuple, token_alignment.align(docs, A, B, **options).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "x\n  y", "tab\t tab \t end\t", "　 wide　blank",
       "café naïve é", "日本語 日本", "\U0001F44D\U0001F3FD ok \U0001F468‍\U0001F469",
       "\U00013000\U00013001 rare ᚠ", "<s> </s> <unk> <|endoftext|> <0x41>", "it's we'll they've 'd", "▁under▁",
       "a▁b c", "\x00nul \x1c sep\x1d end", "\r\n\r\n win", "1234567890 12 3", "!!!???... &&&", "ﬁ Å é", "x" * 300,
       "word " * 50, " nbsp  here", "​zero ​ width", "e ́ combining", "\x85 nel   line"]


def test_odd_texts_equal_brute_force(frame):
    docs = list(enumerate(ODD)) + [(3, "a"), (None, "café naïve"), (3, "a")]
    got = found(frame(docs, DOC))
    assert got == brute(docs)
    assert any(r[1] == 0 and r[0] == ODD.index("a▁b c") for r in got)


def test_random_texts_equal_brute_force(frame):
    draw = random.Random(5)
    signs = "  ab é\n\t.,'sStT日\U0001F44D　 <|>0x1éᚠ "
    docs = [(at, "".join(draw.choice(signs) for _ in range(draw.randint(1, 40)))) for at in range(400)]
    assert found(frame(docs, DOC)) == brute(docs)


def test_small_parts_and_forgotten_chunks(spark, frame, sf, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where(
        "length(text) < 800").collect()]
    assert len(docs) > 30
    whole = brute(docs)
    assert found(frame(docs, DOC), part_chars=1) == whole
    assert found(frame(docs, DOC, 1)) == whole

    known = token_alignment._Chunks(token_alignment.Tokenizers(A, B))
    chunks = ["the", "café", "ᚠx", "a▁"]
    known.learn(chunks)
    one = [token_alignment._document(known, [c]) for c in chunks]
    known.clear()
    known.learn(["café"])
    again = token_alignment._document(known, ["café"])
    assert all(str(x) == str(y) for x, y in zip(one[1], again))


def test_a_very_long_text(frame):
    docs = [(1, "café " * 20_000), (2, "日" * 30_000), (3, " " * 50_000)]
    got = {r[0]: r for r in found(frame(docs, DOC))}
    assert got[1][3] >= 20_000
    assert all(r[4] == r[1] + r[2] - r[3] for r in got.values())
    assert got[2][1] > 0 and got[3][2] > 0


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "")]])
def test_nothing_to_align(frame, docs):
    assert found(frame(docs, DOC)) == [(d, 0, 0, 0, 0, 0, 0, "") for d, _ in docs]


def test_other_columns_are_ignored(frame):
    rows = [(1, "hello there", 4, "x"), (2, "hello you", 5, "y")]
    assert found(frame(rows, DOC + ", part int, n_a string")) == brute([r[:2] for r in rows])
