"""Synthetic spam messages from slot templates.

Every choice is drawn from a hash of (seed, message id): no random state, so a retried task writes the same
rows. One md5 gives five draws, and the few md5 of a row are computed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.operators.ranking import seeded_hash
from riskloom.operators.risk import stable_uuid

# Templates and the choices for their slots.
TEMPLATES = {
    "government": "[{agency}] {username}: {status} {benefit} of {amount}. {action} {deadline}: {link}",
    "financial": "{alert_type}: {amount} {transaction_type} from {account}. {instruction} {link}",
    "shipping": "{courier}: Package #{id} requires {action}. {instruction} {link}",
}
CHOICES = {
    ("government", "status"): ["Unclaimed", "Pending", "Approved", "Overdue"],
    ("government", "action"): ["Claim by", "Respond before", "Validate until", "Secure your"],
    ("government", "agency"): ["GOV", "Department of Treasury", "Social Security Administration",
                               "[IRS Alert]", "[State Tax Office]", "Medicare Services"],
    ("government", "benefit"): ["tax refund", "stimulus check", "child tax credit",
                                "energy subsidy", "housing grant", "pandemic relief"],
    ("financial", "alert_type"): ["Urgent", "Security Alert", "Fraud Warning", "Account Notification"],
    ("financial", "transaction_type"): ["transfer", "withdrawal", "payment", "charge"],
    ("shipping", "action"): ["customs clearance", "address confirmation", "payment verification"],
    ("shipping", "instruction"): ["Track at", "Confirm via", "Update information at"],
}
SYNONYMS = [("claim", ["collect", "access", "secure"]), ("verify", ["confirm", "validate", "authenticate"])]
COLON_SWAPS = [" -", "!", " =>"]
SCHEMES = ["https://", "http://", ""]
OPEN_TLDS = ["com", "net", "org", "info"]
TLDS = ["com", "net"]
MISSPELT = ("oiea", "0134")
# Stand-ins for dictionary words.
WORDS = [
    "account", "claim", "delivery", "evening", "form", "garden", "house", "invoice", "market", "notice",
    "office", "parcel", "river", "season", "verify", "window",
]


# Draws of a message, in order: five per hash, six hex digits each.
DRAWS = [
    "category", "kind", "scheme", "host", "open_tld", "tld", "tagged", "amount", "id", "account",
    "agency", "username", "status", "benefit", "action", "deadline", "alert_type", "transaction_type",
    "instruction", "courier", "claim", "verify", "dollars", "colon", "blank", "shout",
]
_PER_HASH = 5


def with_draws(df: DataFrame, id_column: str, seed: int) -> DataFrame:
    """Add the hashes all choices of a message are read from; ``drop_draws`` removes them."""
    blocks = range(-(-len(DRAWS) // _PER_HASH))
    return df.withColumns({f"_draw{b}": seeded_hash(seed, id_column, F.lit(str(b))) for b in blocks})


def drop_draws(df: DataFrame) -> DataFrame:
    return df.drop(*[name for name in df.columns if name.startswith("_draw")])


def _number(slot: str, below: int) -> Column:
    """A number in 0..below-1 for this message and slot."""
    block, place = divmod(DRAWS.index(slot), _PER_HASH)
    digits = F.substring(f"_draw{block}", 1 + 6 * place, 6)
    return (F.conv(digits, 16, 10).cast("bigint") % below).cast("int")


def _pick(slot: str, choices: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), _number(slot, len(choices)) + 1)


def _chance(slot: str, percent: int) -> Column:
    return _number(slot, 100) < percent


def _replace_first(text: Column, old: str, new: Column) -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, new, at, F.lit(len(old)))).otherwise(text)


def link() -> Column:
    """A defanged, misspelt or redirecting address."""
    defanged = _replace_first(
        F.concat(
            _pick("scheme", SCHEMES), _pick("host", WORDS), F.lit("."),
            _pick("open_tld", OPEN_TLDS),
        ),
        ".", F.lit("[.]"),
    )
    host, tld = _pick("host", WORDS), _pick("tld", TLDS)
    misspelt = F.concat(
        F.translate(F.substring(host, 1, 4), *MISSPELT), F.substr(host, F.lit(5)), F.lit("."), tld
    )
    tag = F.when(
        _chance("tagged", 50), F.concat(F.lit("?id="), stable_uuid(F.col("_draw0"), F.lit("uuid")))
    ).otherwise("")
    redirect = F.concat(host, F.lit("-redirect."), tld, tag)
    kind = _number("kind", 3)
    return F.when(kind == 0, defanged).when(kind == 1, misspelt).otherwise(redirect)


def _slot(name: str, category: str) -> Column:
    if (category, name) in CHOICES:
        return _pick(name, CHOICES[category, name])
    if name == "link":
        return link()
    if name == "amount":
        return F.concat(F.lit("$"), (_number(name, 900) + 100).cast("string"))
    if name == "id":
        return F.concat(F.lit("#"), (_number(name, 900_000) + 100_000).cast("string"))
    if name == "account":
        return F.concat(F.lit("Account ****"), (_number(name, 9000) + 1000).cast("string"))
    return _pick(name, WORDS)


def _filled(category: str) -> Column:
    parts = []
    for piece in TEMPLATES[category].replace("{", "\0{").replace("}", "\0").split("\0"):
        if piece.startswith("{"):
            parts.append(_slot(piece[1:], category))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def template_text() -> Column:
    """A message straight from one of the templates."""
    kind = _number("category", len(TEMPLATES))
    filled = [_filled(category) for category in TEMPLATES]
    first, *rest = list(enumerate(filled))
    return reduce(lambda chain, at: chain.when(kind == at[0], at[1]), rest, F.when(kind == first[0], first[1]))


def rewrites(df: DataFrame, column: str) -> DataFrame:
    """Synonyms (the word is looked for in lower case but replaced as written), '$' before digit runs in half
    of the messages, and another sign for the first colon."""
    text = F.col(column)
    for word, others in SYNONYMS:
        swap = F.lower(text).contains(word)
        df = df.withColumn(
            column, F.when(swap, _replace_first(text, word, _pick(word, others))).otherwise(text)
        )
    dollars = F.when(_chance("dollars", 50), F.regexp_replace(text, r"(\d+)", r"\$$1")).otherwise(text)
    df = df.withColumn(column, dollars)
    return df.withColumn(column, _replace_first(text, ":", _pick("colon", COLON_SWAPS)))


def noise(df: DataFrame, column: str) -> DataFrame:
    """A doubled first blank in 20 %, upper then lower case halves in 10 % of the messages."""
    text = F.col(column)
    df = df.withColumn(
        column, F.when(_chance("blank", 20), _replace_first(text, " ", F.lit("  "))).otherwise(text)
    )
    half = F.floor(F.length(text) / 2).cast("int")
    shouted = F.concat(F.upper(F.substr(text, F.lit(1), half)), F.lower(F.substr(text, half + 1)))
    return df.withColumn(column, F.when(_chance("shout", 10), shouted).otherwise(text))


def generate_for(df: DataFrame, id_column: str, seed: int = 42, out: str = "message") -> DataFrame:
    """One spam message per row of ``df``: ``(id, type, message)``."""
    drawn = with_draws(df.select(id_column), id_column, seed)
    drafted = drawn.withColumns({"type": F.lit("spam"), out: template_text()})
    return drop_draws(noise(rewrites(drafted, out), out))


def generate_messages(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Distinct messages out of ``n`` drawn: ``(type, message)``."""
    return generate_for(spark.range(n), "id", seed).select("type", "message").distinct()
