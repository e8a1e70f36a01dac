"""Action verbs of templates: which way money goes, by the words a template holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: direction: lemma=further forms; a lemma in brackets isn't itself a form.
_WORDS = {
    "incoming": "collect=collected credit=credited deposit=deposited disburse=disbursed,disbursement earn=earned receive=received redeem=redeemed refund=refunded return=returned reverse=reversal,reversed",
    "outgoing": "bill=billed (cash)=cashed,cashout charge=charged debit=debited deduct=deducted,deduction pay=paid,payment purchase=purchased recharge=recharged remit=remittance,remitted send=sent settle=settled,settlement spend=spent topup=topped transfer=transfered,transferred withdraw=withdrawal,withdrawn,withdrew",
    "neutral": "(approve)=approved (cancel)=cancelled (complete)=completed (confirm)=confirmed convert=converted (decline)=declined exchange=exchanged (fail)=failed load=loaded (occur)=occurred pending= (post)=posted (process)=processed (reject)=rejected (success)=successful,successfully transaction=",
}


def lexicon() -> list[tuple[str, str, str]]:
    """(lemma, direction, form) of every form."""
    out = []
    for direction, words in _WORDS.items():
        for entry in words.split():
            lemma, forms = entry.split("=")
            name = lemma.strip("()")
            out += [(name, direction, f) for f in ([] if lemma[0] == "(" else [name]) + [f for f in forms.split(",") if f]]
    return out


def annotation(template: Column) -> Column:
    """(verb, direction): the first word with a direction, else the first neutral one, else null."""
    forms = F.expr("map(" + ", ".join(f"'{form}', '{lemma}:{direction}'" for lemma, direction, form in lexicon()) + ")")
    found = F.filter(F.transform(F.regexp_extract_all(F.lower(template), F.lit("[a-z]+"), F.lit(0)), lambda w: F.element_at(forms, w)), lambda x: x.isNotNull())
    moving = F.filter(found, lambda x: ~F.endswith(x, F.lit(":neutral")))
    parts = F.split(F.coalesce(F.get(moving, F.lit(0)), F.get(found, F.lit(0))), ":")
    return F.struct(F.get(parts, F.lit(0)).alias("verb"), F.get(parts, F.lit(1)).alias("direction"))


def label(verb: Column, direction: Column) -> Column:
    """What a family of this verb is called; null without a verb."""
    noun = F.concat(verb, F.lit("s"))
    return F.when(verb.isNull(), F.lit(None)).when(direction == "neutral", F.initcap(noun)).otherwise(F.concat(F.initcap(direction), F.lit(" "), noun))


def missing_words(words: list[str]) -> list[str]:
    """Those of some words that the lexicon lacks."""
    forms = {f for _, _, f in lexicon()}
    return sorted(w for w in set(words) if w not in forms)
