"""URL filtering with pattern rules that are found through their rarest literal token.

A rule is a pattern over host and path, one behind the other: a host holds no ``/``, and a path that is not empty
begins with one. The index files a rule under the one of its literal tokens that fewest URLs hold. A URL looks up its
own tokens and runs only the patterns it finds there. The whole judgement is a map over the rows: the index of a rule
pack is a literal, an array of cells by token hash. A pack beyond ``LITERAL_RULES``, or one given as a table, is joined
on the token instead, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.session import stored

#: A pack of up to this many rules is a literal in the plan.
LITERAL_RULES = 2_000
_TOKEN = re.compile(r"[a-z0-9]+")
_SPLIT = "[^a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name``, a regular expression over host and path, literal tokens that every match holds, rank, verdict.

    Of the rules that match, the highest rank decides, then the first name. One that is ``listed`` is named as the
    rule of a URL; the others are the method's own and only give the verdict.
    """

    name: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    verdict: str
    listed: bool = True


def host_rule(name: str, verdict: str) -> Rule:
    """A rule like ``example.net/en/``: this host and all its subdomains, paths that start so. Longer ranks higher."""
    host, slash, path = name.partition("/")
    path = slash + path
    # A path may go on after the rule's, so a token that ends with the rule is not sure to be a whole one.
    sure = path if path.endswith("/") or not path else path[:len(path) - len(re.search(r"[a-z0-9]*$", path)[0])]
    tokens = tuple(dict.fromkeys(_TOKEN.findall(host) + _TOKEN.findall(sure.lower())))
    follows = rf"\Q{path}\E" if path else r"(?:/|\z)"
    return Rule(name, rf"^([^/]*\.)?\Q{host}\E{follows}", tokens, 1_000 + len(name), verdict)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A word of the host or path, alone between signs or at the start or end of a part of the name."""
    return Rule(word, rf"(^|[^a-z0-9])\Q{word}\E([^a-z0-9]|$)", (word,), len(word), verdict, False)


#: Host rules, in words: net is closed but for English pages of example.net; German pages of example.com are
#: closed; French pages of org are open.
HOST_RULES = (
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
)
#: Words that close a URL no host rule speaks about. Fixed values.
WORD_RULES = tuple(word_rule(w) for w in (
    "adult", "porn", "xxx", "sex", "casino", "poker", "betting", "viagra", "pharma", "spam", "malware", "phishing",
    "warez", "torrent"))
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _subject() -> Column:
    return F.concat("host", "path")


def _url_tokens() -> Column:
    return F.array_distinct(F.split(F.translate(_subject(), _UPPER, _LOWER), _SPLIT))


def _rank_tokens(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs hold each literal token of the rules, over the whole table; one row per token comes back."""
    tokens = sorted({t for r in rules for t in r.tokens})
    seen = urls.select(F.explode(_url_tokens()).alias("token")).where(F.col("token").isin(*tokens))
    return {r.token: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A pack as a table, the form a pack kept in files has: ``name, pattern, tokens, rank, verdict, listed``."""
    return spark.createDataFrame(
        [(r.name, r.pattern, list(r.tokens), r.rank, r.verdict, r.listed) for r in rules],
        "name string, pattern string, tokens array<string>, rank int, verdict string, listed boolean")


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame = HOST_RULES + WORD_RULES,
          literal_rules: int = LITERAL_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``method_rule``; columns of these names are replaced.

    A null url, or one without ``://``, has an empty host and path and is judged on those. ``rule`` is the listed rule
    that decides, else null; ``method_rule`` the one of the method's own that does. Where none matches the verdict is
    ``allow``. Every row is judged by itself, repeated ones alike. ``rules`` may be a table like ``rule_table``; a
    rule without a literal token cannot be found and is an error.
    """
    kept = [f"`{c}`" for c in pages.columns if c not in ("host", "path", "rule", "verdict", "method_rule")]
    parsed = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame):
        blind = rules.where(F.size(F.coalesce("tokens", F.array().cast("array<string>"))) == 0).select("name").head()
    else:
        blind = next(((r.name,) for r in rules if not r.tokens), None)
    if blind:
        raise ValueError(f"rule {blind[0]} has no literal token to be found by")
    if not isinstance(rules, DataFrame) and len(rules) > literal_rules:
        rules = rule_table(pages.sparkSession, rules)
    if isinstance(rules, DataFrame):
        found = _by_join(parsed, rules)
    elif rules:
        counts = _rank_tokens(parsed, rules)
        found = _by_literal(parsed, [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), r) for r in rules])
    else:
        found = parsed.withColumn("_best", F.lit(None).cast("struct<name:string,verdict:string,listed:boolean>"))
    return found.select(
        *kept, "host", "path", F.when(F.col("_best.listed"), F.col("_best.name")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
        F.when(~F.col("_best.listed"), F.col("_best.name")).alias("method_rule"))


def _entry(token: str, r: Rule) -> Column:
    return F.struct(F.lit(token).alias("token"), F.lit(r.pattern).alias("pattern"), F.lit(-r.rank).alias("order"),
                    F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.listed).alias("listed"))


def _by_literal(parsed: DataFrame, filed: list[tuple[str, Rule]]) -> DataFrame:
    """Rules in an array of cells by token hash, so that a token finds its rules in one step."""
    width = 1 << max(1, (2 * len(filed)).bit_length())
    spark = parsed.sparkSession
    tokens = sorted({t for t, _ in filed})
    hashed = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(width)).alias(f"c{at}")
                                     for at, t in enumerate(tokens)]).head()
    cell_of = dict(zip(tokens, hashed))
    cells: list[list[Column]] = [[] for _ in range(width)]
    for token, r in filed:
        cells[cell_of[token]].append(_entry(token, r))
    entry_type = "array<struct<token:string,pattern:string,order:int,name:string,verdict:string,listed:boolean>>"
    index = F.array(*[F.array(*c) if c else F.array().cast(entry_type) for c in cells])
    candidates = F.flatten(F.transform(_url_tokens(), lambda token: F.filter(
        F.get(index, F.pmod(F.xxhash64(token), F.lit(width)).cast("int")), lambda r: r["token"] == token)))
    matching = F.filter(candidates, lambda r: F.regexp_like(_subject(), r["pattern"]))
    return parsed.withColumn("_best", F.array_min(F.transform(
        matching, lambda r: F.struct(r["order"].alias("order"), r["name"].alias("name"),
                                     r["verdict"].alias("verdict"), r["listed"].alias("listed")))))


def _by_join(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """The index as a table: URLs are judged once per distinct host and path, copies fold before the shuffle."""
    urls = stored(parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    held = urls.select("host", "path", "n", F.explode(_url_tokens()).alias("token"))
    wanted = rules.select("name", F.explode("tokens").alias("token"))
    counts = held.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(
        F.sum("n").alias("urls"))
    rarest = wanted.join(counts, "token", "left").groupBy("name").agg(
        F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))["token"].alias("token"))
    index = stored(rules.join(rarest, "name").select(
        "token", "pattern", (-F.col("rank")).alias("order"), "name", "verdict", "listed"), "rules")
    best = (held.select("host", "path", "token").join(index, "token").where(F.regexp_like(_subject(), F.col("pattern")))
            .groupBy("host", "path").agg(F.min(F.struct("order", "name", "verdict", "listed")).alias("_best")))
    return parsed.join(best, ["host", "path"], "left")
