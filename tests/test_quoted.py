"""Files with quoted line breaks read block by block, against the reader that takes a file as a whole."""

import random

import pytest

from riskloom.sources import messages as files, quoted


@pytest.fixture
def small_blocks(spark):
    """Blocks of some bytes, so that records cross several of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, value in before.items():
        spark.conf.set(n, value)


def rows(df):
    return [(r.type, r.text) for r in df.orderBy(*files.MESSAGE_ORDER).collect()]


def random_file(draw, crlf=False):
    out = []
    signs = ["a", "b,", '""', "\n", " ", "é", "long word", "\n\n", ",", "'", "\\"]
    for _ in range(draw.randint(1, 60)):
        body = "".join(draw.choice(signs) for _ in range(draw.randint(0, 12)))
        if draw.random() < .7:
            fields = ["spam", f'"{body}"']
        else:
            fields = ["ham", "".join(c for c in body if c not in ',"\n') + draw.choice(["", 'x"y'])]
        if draw.random() < .3:
            fields.append('"more\nof it"')
        out.append(",".join(fields))
    end = "\r\n" if crlf else "\n"
    return end.join(out) + draw.choice(["", end])


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_equal_to_the_whole_file_reader(spark, tmp_path, small_blocks, size):
    draw = random.Random(size)
    for at in range(6):
        (tmp_path / f"{at}.csv").write_bytes(random_file(draw).encode())
    want = rows(files.read_messages(spark, [str(tmp_path)]))
    small_blocks(size)
    assert rows(quoted.read_messages(spark, [str(tmp_path)])) == want
    assert len(want) > 50


def test_one_record_over_many_blocks_and_many_tasks(spark, tmp_path, small_blocks):
    path = tmp_path / "a.csv"
    path.write_bytes(('spam,"' + "line of it\n" * 500 + '"\nham,short one\n' + 'spam,"two\nlines"\n' * 300).encode())
    want = rows(files.read_messages(spark, [str(path)]))
    small_blocks(512)
    got = quoted.read_messages(spark, [str(path)])
    assert rows(got) == want
    assert got.select("block_seq").distinct().count() > 5


def test_encodings_bad_bytes_short_rows_and_line_ends(spark, tmp_path, small_blocks):
    small_blocks(16)
    (tmp_path / "a.csv").write_bytes(b'type,text\r\nspam,"quoted, comma"\r\nham\r\n\r\nham,"say ""hi"""\r\nham,bad \xff byte')
    got = rows(quoted.read_messages(spark, [str(tmp_path / "a.csv")]))
    assert got == [("type", "text"), ("spam", "quoted, comma"), ("ham", 'say "hi"'), ("ham", "bad � byte")]
    (tmp_path / "b.csv").write_bytes("spam,\"caf\xe9\nun\"\n".encode("latin-1"))
    assert rows(quoted.read_messages(spark, [str(tmp_path / "b.csv")], "ISO-8859-1")) == [("spam", "caf\xe9\nun")]
    (tmp_path / "c.csv").write_bytes(b"")
    assert rows(quoted.read_messages(spark, [str(tmp_path / "c.csv")])) == []


def test_quotes_left_open_take_the_rest(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes(b'spam,fine\nham,"never closed\nspam,x\n' + b"more,y\n" * 20)
    small_blocks(32)
    got = rows(quoted.read_messages(spark, [str(tmp_path / "a.csv")]))
    assert got[0] == ("spam", "fine") and len(got) == 2 and got[1][1].startswith("never closed\nspam,x\nmore,y")
