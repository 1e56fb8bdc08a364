import re

import pytest

from riskloom.llm import url_filter

URLS = [
    "http://A.Example.NET/en/1?x#y", "https://example.net/de/", "net/", "http://net/", "http://x.net", "http://x.net?/",
    "http://mynet/", "http://example.com/de/x", "http://xexample.com/de/x", "http://a.org/fr/", "http://a.org/fr",
    "http://a.org/FR/", "HTTP://org/fr/casino", "http://casino.org/", "http://cas.ino/", "http://b.com/p/poker-tips",
    "http://b.com/pokerface", "http://u@b.com:80/a", "://", "a://b://c/d", "", None, "http://ÀB.net/", "http://x.net/ adult",
    "http://a b.net/x", "http://a b.org/fr/x", "http://net /", "http://x.example.com /de/", "http://m.casino-win.com/x",
    "http://casino", "http://a\nb.net/x", "http://x.net\n/", "http://casino\n",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rule = None
    for name, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
                          ("org/fr/", "allow")):
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (not rule or len(name) > len(rule[0])):
            rule = (name, verdict)
    word = None
    if not rule:
        words = [r.name for r in url_filter.WORD_RULES
                 if re.search(rf"(^|[^a-z0-9]){r.name}([^a-z0-9]|$)", host + " " + path)]
        word = min(words, key=lambda w: (-len(w), w)) if words else None
    return host, path, *(rule or (None, "block" if word else "allow")), word


def shown(r):
    return r.host, r.path, r.rule, r.verdict, r.method_rule


@pytest.mark.parametrize("form", ["literal", "long", "table"])
def test_all_forms_of_the_index(spark, frame, form):
    rows = [(at, url, "keep", "host") for at, url in enumerate(URLS)] * 2
    df = frame(rows, "page_id long, url string, verdict string, path string")
    rules = url_filter.HOST_RULES + url_filter.WORD_RULES
    if form == "table":
        rules = url_filter.rule_table(spark, rules)
    out = url_filter.judge(df, rules, literal_rules=0 if form == "long" else 2_000).collect()
    assert sorted((r.page_id, *map(str, shown(r))) for r in out) == sorted(
        (at, *map(str, expected(url))) for at, url, *_ in rows)


def test_a_rule_is_named_only_where_a_host_rule_decides(frame):
    got = url_filter.judge(frame([(1, "http://m.casino-win.example.com/en/4033.html")], "page_id long, url string")).head()
    assert (got.rule, got.verdict, got.method_rule) == (None, "block", "casino")


def test_rules_for_a_host_alone(frame):
    rules = [url_filter.host_rule("a.com", "block")]
    urls = ["http://a.com", "http://x.a.com/y", "http://a.com.de/", "http://ba.com", "http://a.com\n"]
    got = {r.url: r.verdict for r in url_filter.judge(frame([(u,) for u in urls], "url string"), rules).collect()}
    assert [got[u] for u in urls] == ["block", "block", "allow", "allow", "allow"]


def test_every_page_like_plain_rules(spark, sf):
    from riskloom.llm import queries

    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.QUERIES["op7_url_filters"](spark, sf).collect():
        assert shown(r) == expected(urls[r.page_id])


def test_edges(spark, frame):
    assert url_filter.judge(frame([], "page_id long, url string")).collect() == []
    long = url_filter.judge(frame([(1, "http://x.com/" + "a/" * 200_000 + "poker")], "page_id long, url string")).head()
    assert long.verdict == "block"
    assert url_filter.judge(frame([(1, "http://x.net/")], "page_id long, url string"), rules=()).head().verdict == "allow"
    with pytest.raises(ValueError):
        url_filter.judge(frame([], "url string"), [url_filter.Rule("any", ".", (), 1, "block")])
    with pytest.raises(ValueError):
        url_filter.judge(frame([], "url string"), url_filter.rule_table(spark, [url_filter.Rule("any", ".", (), 1, "block")]))
    assert url_filter.judge(frame([], "url string"), url_filter.rule_table(spark, [])).collect() == []
