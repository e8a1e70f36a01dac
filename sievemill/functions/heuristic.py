"""Whether a message reads like a financial transaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.regexes import squeezed

ACTIONS = tuple(sorted("atm cashout credited debited deposit paid payment purchase received sent spent transaction transfer transferred trx txn withdraw withdrawal".split() + ["cash out"]))
SUPPORT = tuple(sorted("a/c ac account amount amt balance birr br card etb merchant pos ref reference wallet".split() + ["available balance"]))
_UNIT = "(?:birr|br|etb)"
MONEY = f"(?i)(?:{_UNIT}[\\s]*[0-9]|[0-9][0-9,]*(?:[.][0-9]{{1,2}})?[\\s]*{_UNIT})"


def _shortest(words: tuple[str, ...]) -> list[str]:
    """Without words that hold another one."""
    return [w for w in words if not any(o != w and o in w for o in words)]


def looks_like_transaction(body: Column) -> Column:
    """A word of ACTIONS anywhere in the text, and a word of SUPPORT or an amount of money."""
    text = squeezed(F.lower(body))
    any_of = lambda words: text.rlike("|".join(_shortest(words)))
    return F.coalesce(any_of(ACTIONS) & (any_of(SUPPORT) | body.rlike(MONEY)), F.lit(False))


def sql(body: str) -> str:
    text = f"lower({body})"
    return f"(regexp_matches({text}, '{'|'.join(_shortest(ACTIONS))}') AND (regexp_matches({text}, '{'|'.join(_shortest(SUPPORT))}') OR regexp_matches({body}, '{MONEY}')))"
