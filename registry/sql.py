"""Shared pieces of the SQL that DuckDB runs."""

from __future__ import annotations

from riskloom.functions.text import SPACE, WHITE_SPACE, WORD
from registry.views import MESSAGES_SQL

WS = WHITE_SPACE
EDGE_L, EDGE_R = f"(^|[^{WORD}])", f"([^{WORD}]|$)"


def with_messages(body: str, *ctes: str) -> str:
    """``body`` with ``messages`` (and further common table expressions) in front."""
    return "with " + ",\n".join([f"messages as ({MESSAGES_SQL})", *ctes]) + "\n" + body


def strip(x: str) -> str:
    return f"trim({x}, '{WS}')"


def normal(x: str) -> str:
    return f"lower({strip(x)})"


def masked(x: str) -> str:
    x = f"regexp_replace({x}, '\\p{{Nd}}{{10,}}', '[PHONE]', 'g')"
    x = f"regexp_replace({x}, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b', '[EMAIL]', 'g')"
    return f"regexp_replace({x}, '(http|https)://[^{SPACE}]+', '[URL]', 'g')"


def cleaned(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '[\\r\\n\\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, 'http[^{SPACE}]+', '[URL]', 'g')"
    x = f"replace(replace(replace({x}, 'won''t', 'will not'), 'can''t', 'cannot'), 'n''t', ' not')"
    x = f"regexp_replace({x}, '[^{WORD}{SPACE}.,!?@$%-]', ' ', 'g')"
    x = f"regexp_replace({x}, '([!?.]){{2,}}', '\\1', 'g')"
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{SPACE}]+'))"


def english(x: str, lang: str) -> str:
    letters = f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))::double / nullif(length({x}), 0)"
    digits = f"length(regexp_replace({x}, '\\P{{Nd}}', '', 'g'))::double / nullif(length({x}), 0)"
    return f"coalesce({tokens(x)} >= 3 and {letters} >= 0.5 and {digits} <= 0.3 and {lang} = 'en', false)"


def round4(x: str) -> str:
    """Half-up on the printed digits, as Spark rounds doubles (DuckDB scales the binary value first)."""
    return f"round(cast(cast({x} as varchar) as decimal(38, 20)), 4)::double"
