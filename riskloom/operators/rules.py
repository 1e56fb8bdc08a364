"""Weighted regex rules over message text.

A pack is matched inside one projection, rule by rule, with no join between messages and rules. Scores and
pattern lists mention the same test of a rule, which code generation evaluates once per row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.text import BOUNDARY


@dataclass(frozen=True)
class Rule:
    category: str
    pattern: str
    weight: float
    # A literal that any match must contain: tested first, so most texts never reach the regex.
    needle: str | None = None


@dataclass(frozen=True)
class RulePack:
    rules: tuple[Rule, ...]
    caps: dict[str, float]

    @property
    def categories(self) -> list[str]:
        return list(self.caps)

    @classmethod
    def from_frames(cls, rules: DataFrame, caps: DataFrame) -> "RulePack":
        """Pack kept as tables ``(category, pattern, weight)`` and ``(category, max_score)``.

        Rules become part of the plan, so a pack is as large as plans may be. Each category needs a cap.
        """
        found = rules.select("category", "pattern", "weight").orderBy("category", "pattern").collect()
        limits = caps.select("category", "max_score").orderBy("category").collect()
        if missing := sorted({str(r.category) for r in found} - {str(c.category) for c in limits}):
            raise ValueError(f"no cap for the categories {missing}")
        return cls(
            tuple(Rule(r.category, r.pattern, float(r.weight)) for r in found),
            {c.category: float(c.max_score) for c in limits},
        )


# The default rule pack. Patterns are tried on lower-cased text.
DEFAULT_PACK = RulePack(
    rules=(
        Rule("financial", r"\btransfer\b", 0.4, "transfer"),
        Rule("financial", r"\baccount\b", 0.3, "account"),
        Rule("financial", r"\$\d[\d,]*", 0.5, "$"),
        Rule("financial", r"\bpayment\b", 0.3, "payment"),
        Rule("financial", r"\bmoney\b", 0.4, "money"),
        Rule("financial", r"\bbank\b", 0.3, "bank"),
        Rule("urgency", r"\burgen(t|cy)\b", 0.5, "urgen"),
        Rule("urgency", r"\bimmediately\b", 0.4, "immediately"),
        Rule("urgency", r"\blimited time\b", 0.4, "limited time"),
        Rule("urgency", r"\bexpire[sd]?\b", 0.4, "expire"),
        Rule("urgency", r"\bquick(ly)?\b", 0.3, "quick"),
        Rule("suspicious", r"\bverify\b", 0.5, "verify"),
        Rule("suspicious", r"\bclick\b", 0.4, "click"),
        Rule("suspicious", r"\bsecure\b", 0.3, "secure"),
        Rule("suspicious", r"\bconfirm\b", 0.4, "confirm"),
        Rule("suspicious", r"\bvalidate\b", 0.4, "validate"),
    ),
    caps={"financial": 0.7, "urgency": 0.6, "suspicious": 0.6},
)


def _unicode(pattern: str) -> str:
    return pattern.replace(r"\b", BOUNDARY).replace(r"\d", r"\p{Nd}")


def _fires(rule: Rule) -> Column:
    lowered = F.col("_lowered")
    found = lowered.rlike(_unicode(rule.pattern))
    return F.coalesce(lowered.contains(rule.needle) & found if rule.needle else found, F.lit(False))


def _lowered(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_lowered", F.lower(F.col(column)))


def _of(pack: RulePack, category: str) -> list[Rule]:
    return [rule for rule in pack.rules if rule.category == category]


def _score_of(pack: RulePack, category: str) -> Column:
    weights = [F.when(_fires(r), F.lit(float(r.weight))).otherwise(F.lit(0.0)) for r in _of(pack, category)]
    best = F.greatest(F.lit(0.0), *weights) if weights else F.lit(0.0)
    return F.least(best, F.lit(float(pack.caps[category])))


def _fired(values: list[Column], kind: str) -> Column:
    """The distinct non-null values, in order. Unlike a lambda filter this stays in generated code."""
    return F.array_except(F.array(*values), F.array(F.lit(None).cast(kind)))


def _patterns_of(pack: RulePack, category: str) -> Column:
    shown = [F.when(_fires(r), F.lit(r.pattern)) for r in _of(pack, category)]
    if not shown:
        return F.array().cast("array<string>")
    return F.sort_array(_fired(shown, "string"))


def match_rules(df: DataFrame, pack: RulePack = DEFAULT_PACK, column: str = "text") -> DataFrame:
    """Long form: one row per message and matching rule, with ``category, pattern, weight``."""
    fired = [
        F.when(
            _fires(rule),
            F.struct(
                F.lit(rule.category).alias("category"),
                F.lit(rule.pattern).alias("pattern"),
                F.lit(float(rule.weight)).alias("weight"),
            ),
        )
        for rule in pack.rules
    ]
    # Outer, then filtered: for an inner one the optimizer tests "any match" first, which runs all rules twice.
    hits = _fired(fired, "struct<category:string,pattern:string,weight:double>")
    return _lowered(df, column).select(*df.columns, F.inline_outer(hits)).where(F.col("category").isNotNull())


def category_scores(df: DataFrame, pack: RulePack = DEFAULT_PACK, column: str = "text") -> DataFrame:
    """``score_<category>``: the highest weight matched, at most the cap of the category."""
    scores = {f"score_{c}": _score_of(pack, c) for c in pack.categories}
    return _lowered(df, column).withColumns(scores).drop("_lowered")


def _total(pack: RulePack) -> Column:
    parts = [F.col(f"score_{c}") for c in pack.categories]
    # Never null, which the optimizer can tell only from the coalesce: a null test on it costs nothing.
    return F.coalesce(F.round(reduce(lambda a, b: a + b, parts) / len(parts), 4), F.lit(0.0))


def pattern_score(df: DataFrame, pack: RulePack = DEFAULT_PACK, column: str = "text") -> DataFrame:
    """Category scores plus ``total_score``, their mean to 4 places."""
    return category_scores(df, pack, column).withColumn("total_score", _total(pack))


def matched_patterns(df: DataFrame, pack: RulePack = DEFAULT_PACK, column: str = "text") -> DataFrame:
    """``patterns_<category>`` arrays, sorted, and ``patterns`` over all categories in pack order."""
    listed = _lowered(df, column).withColumns({f"patterns_{c}": _patterns_of(pack, c) for c in pack.categories})
    every = F.flatten(F.array(*[F.col(f"patterns_{c}") for c in pack.categories]))
    return listed.withColumn("patterns", every).drop("_lowered")


def analyse(df: DataFrame, pack: RulePack = DEFAULT_PACK, column: str = "text") -> DataFrame:
    """Scores, total and patterns from one matching pass."""
    out = _lowered(df, column).withColumns(
        {f"score_{c}": _score_of(pack, c) for c in pack.categories}
        | {f"patterns_{c}": _patterns_of(pack, c) for c in pack.categories}
    )
    return out.withColumn("total_score", _total(pack)).drop("_lowered")


def pattern_summary(df: DataFrame, pack: RulePack = DEFAULT_PACK, out: str = "summary") -> DataFrame:
    """One line per category that scored: ``category: pattern, pattern``. Needs the columns of ``analyse``."""
    # Null where the category did not score. The patterns stand outside the condition so that they share
    # their rule tests with the score.
    lines = [
        F.concat(F.when(F.col(f"score_{c}") > 0, f"{c}: "), F.array_join(f"patterns_{c}", ", "))
        for c in pack.categories
    ]
    return df.withColumn(out, F.concat_ws("\n", *lines))


def pattern_analysis(df: DataFrame, pack: RulePack = DEFAULT_PACK, out: str = "categories") -> DataFrame:
    """Nested result: a map from category to score and matched patterns."""
    entries = []
    for c in pack.categories:
        entries += [
            F.lit(c),
            F.struct(F.col(f"score_{c}").alias("score"), F.col(f"patterns_{c}").alias("matched_patterns")),
        ]
    return df.withColumn(out, F.create_map(*entries))


def rule_coverage(df: DataFrame, pack: RulePack = DEFAULT_PACK, column: str = "text") -> DataFrame:
    """Messages hit by each rule and by its category; rules that never fire are listed with 0.

    The sums collapse to one row per task before anything is shuffled.
    """
    sums = [F.count_if(_fires(rule)).alias(f"r{at}") for at, rule in enumerate(pack.rules)]
    for c in pack.categories:
        any_of = reduce(lambda a, b: a | b, [_fires(rule) for rule in _of(pack, c)], F.lit(False))
        sums.append(F.count_if(any_of).alias(f"c_{c}"))
    totals = _lowered(df, column).agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(rule.category).alias("category"),
                F.lit(rule.pattern).alias("pattern"),
                F.col(f"r{at}").alias("rule_hits"),
                F.col(f"c_{rule.category}").alias("category_hits"),
            )
            for at, rule in enumerate(pack.rules)
        ]
    )
    return totals.select(F.inline(rows))
