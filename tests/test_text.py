from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import text as ops


def apply(frame, fn, *values):
    rows = frame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.out for r in rows.select("i", fn(F.col("t")).alias("out")).orderBy("i").collect()]


def test_normalise_strips_any_white_space(frame):
    assert apply(frame, tx.normalised, " \t\nHELLO World\xa0　\x1f", " É\x85", None, "  ") == [
        "hello world", "é", None, ""]


def test_mask_order_and_tags(frame):
    got = apply(
        frame, tx.masked,
        "call 5550123456 now", "123456789", "a.b+c@mail.example.com!", "see http://x.y/z?q=1 and https://a b",
        "1234567890@mail.com", "été@mail.com", "x@y", "ftp://x", "a@b.c", "a@b.c|d",
    )
    assert got == [
        "call [PHONE] now", "123456789", "[EMAIL]!", "see [URL] and [URL] b",
        # the digits go first, so what is left is no address any more
        "[PHONE]@mail.com", "été@mail.com", "x@y", "ftp://x",
        # a bar counts as a letter of the last part
        "a@b.c", "[EMAIL]",
    ]


def test_mask_unicode_digits(frame):
    assert apply(frame, tx.masked, "٠١٢٣٤٥٦٧٨٩") == ["[PHONE]"]


def test_clean(frame):
    got = apply(
        frame, tx.cleaned,
        "I won't, can't and don't\r\n\tgo", "stop!!??.. now", "see http://x.y/z?q=1 ok", "50% off* #1 [tag] a@b $5",
        None, "  ", "café_naïve – ok", "end...", "!" * 50_000,
    )
    assert got == [
        "I will not, cannot and do not go", "stop. now", "see URL ok", "50% off 1 tag a@b $5",
        "", "", "café_naïve ok", "end.", "!",
    ]


def test_english(frame):
    rows = frame(
        [(0, "one two three", "en"), (1, "one two", "en"), (2, "one two three", "de"), (3, "1234 5678 abcdefgh", "en"),
         (4, "", "en"), (5, "éé éé éé abc", "en"), (6, "abc de 123", "en"), (7, None, "en"), (8, "a b c", None),
         (9, "aaa bb 1111", "en")],
        "i int, t string, lang string",
    )
    out = ops.is_english(rows, "t")
    assert [r.is_english for r in out.orderBy("i").collect()] == [
        True, False, False, False, False, False, True, False, False, False]


def test_length_gate_is_inclusive_and_counts_characters(frame):
    rows = frame([("é" * 10,), ("x" * 9,), ("y" * 12,), (None,)], "text string")
    assert sorted(len(r.text) for r in ops.length_gate(rows, 10, 11).collect()) == [10]


def test_labels_and_binary(frame):
    rows = frame([(" Spam ",), ("HAM",), ("other",), (None,)], "type string")
    kept = ops.to_binary(ops.keep_labels(rows))
    assert sorted((r.type, r.y_true) for r in kept.collect()) == [("ham", 0), ("spam", 1)]


def test_drop_null(frame):
    rows = frame([("a", "b"), ("a", None), (None, "b"), ("", "b")], "x string, y string")
    assert ops.drop_null(rows, ["x", "y"]).count() == 2
    assert ops.drop_null(rows, ["x", "y"], or_empty=True).count() == 1


def test_page_text(frame):
    html = (
        "<html><head><title>a long title here</title></head><body><!-- <p>hidden comment text</p> -->"
        "<script>var t='</p> not shown at all';</script><style>p{}</style><p>First <b>piece</b> of text &amp; more</p>"
        "<p>short</p><pre>some code that is long</pre><div>Second piece<br>of the page text</div></body></html>"
    )
    rows = frame([(0, html), (1, "<body><p>tiny</p><p>bits</p></body>"), (2, None)], "i int, html string")
    got = [r.text for r in ops.page_text(rows).orderBy("i").collect()]
    assert got == ["First piece of text & more\nSecond piece\nof the page text", "tiny bits", None]


def test_character_references(frame):
    given = "<p>caf&eacute; &#8217;x&#x27; &amp;lt; &bogus; &am &#0; &#xD800; &nbsp;&copy;&#128512; R&D; a&b long enough</p>"
    got = ops.page_text(frame([(1, given)], "i int, html string")).head().text
    assert got == "café ’x' &lt; &bogus; &am \ufffd \ufffd ©\U0001f600 R&D; a&b long enough"


def page(frame, html):
    return ops.page_text(frame([(1, html)], "i int, html string")).head().text


def test_listings_nested_and_unclosed(frame):
    assert page(frame, "<p>before the listing</p><pre>a <pre>b</pre> still outer</pre><p>behind the listing</p>") == (
        "before the listing\nbehind the listing")
    assert page(frame, "<p>before the script</p><script>var unclosed = 'code here';</p>") == "before the script"
    assert page(frame, "<p>before the style</p><style>p { color: red }<p>all of it is style") == "before the style"
    # What holds an unclosed listing ends it; formatting goes on until its own end tag.
    assert page(frame, "<div>first part here<pre>int x;</div><div>second part here</div>") == (
        "first part here\nsecond part here")
    assert page(frame, "<p>some text and <code>x <code>y</code> z</code> more of it</p>") == "some text and more of it"
    assert page(frame, "<p>a long text with <code>x</p><p>still within</code> and then prose</p>") == (
        "a long text with and then prose")
    assert page(frame, "<ul><li><pre>listing one<li>second item here</ul>") == "second item here"


def test_signs_that_are_no_tags(frame):
    assert page(frame, '<p>It costs 1 < 2 and more.</p><p title="a > b ...">Second piece here</p>') == (
        "It costs 1 < 2 and more.\nSecond piece here")
    assert page(frame, "<p>a <3 b and <= c here</p><!-- x > y --><p data-x='>'>quoted sign here</p></ p>") == (
        "a <3 b and <= c here\nquoted sign here")
    assert page(frame, "<p>a long first part <b unclosed tag") == "a long first part"
    assert page(frame, "<p>a long first part <!-- unclosed comment </p>") == "a long first part"
    assert page(frame, "<?xml version='1'?><!DOCTYPE html><head><title>t</title><p>the head is left out</p>") == (
        "the head is left out")


def test_time_is_linear_in_the_page():
    import time

    from riskloom.functions import pages

    parts = ["<object>", "<div>", "</section>", "<p><button>", "<code>", "<svg><b>", "<a x='", "<td><li>", "<!--", "&amp"]
    for part in parts:
        took = []
        for times in (8_000, 32_000):
            html = "<p>some words</p>" + part * times
            began = time.process_time()
            pages.read(html)
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + .2, part


def test_against_the_tree_of_a_plain_parser():
    """Well-formed random pages: text outside silent elements, by the parser of the standard library."""
    import random
    from html.parser import HTMLParser

    from riskloom.functions import pages

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out = [], []

        def handle_starttag(self, tag, attrs):
            self.open.append(tag)
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.open.remove(tag)
            self.out.append(" ")

        def handle_data(self, data):
            if not set(self.open) & pages.SILENT:
                self.out.append(data)

    draw = random.Random(4)

    def tree(depth):
        if depth == 0 or draw.random() < .3:
            return draw.choice(["words here ", "caf&eacute; ", "1 < 2 ", "x &amp; y ", "long text of a page "])
        name = draw.choice(["div", "section", "b", "pre", "code", "span", "ul", "article", "script", "i"])
        inner = "var a = '<p>';" if name == "script" else "".join(tree(depth - 1) for _ in range(draw.randint(0, 4)))
        return f"<{name} title=\"a > b\">{inner}</{name}>"

    for _ in range(300):
        html = "".join(tree(4) for _ in range(3))
        plain = Plain()
        plain.feed(html)
        plain.close()
        got = pages.read(html)[1]
        assert got.replace(" ", "") == "".join("".join(plain.out).split())
