"""Matching messages against a catalog of per-sender patterns, and simulating what an application extracts.

The catalog is small and is compiled into the plan: each pattern is a branch with literal expressions, so the JVM
compiles each expression once, a message runs only its own sender's patterns, and of these only those whose fixed words it
holds; no join or shuffle is needed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.regexes import ascii_edges, compiles, literals, once, positional, some, trimmed

FLAGS = "(?ims)"
FLAG_COLUMNS = ("type_valid", "amount_parsed", "balance_expected", "balance_captured", "balance_parsed", "counterparty", "ref_real", "ref_synth", "account_expected", "account_captured", "fees_expected", "fees_captured")
PARTY_GROUPS = ("sender", "source", "agent", "payer", "from")
FEE_GROUPS = (("serviceCharge", "ServiceCharge", "servicecharge", "service_charge"), ("vat", "VAT"))
_STOPS = {"from": "at|balance|on|ref|reference|to|transaction", "by": "balance|on|ref|reference|through|transaction", r"with[\s]+agent": "at|balance|on|ref|reference|transaction"}
#: How a counterparty is sought in a body when no group gives it.
PARTY_SEARCHES = tuple(rf"(?i){lead}[\s]+(.+?)[\s]+(?:{stops})" for lead, stops in _STOPS.items())
OWN = ("your account", "your mpesa", "your telebirr")


@dataclass(frozen=True)
class Bank:
    id: int
    name: str
    short_name: str | None = None
    codes: tuple[str, ...] = ()
    mask_pattern: int | None = None
    uniform_masking: bool | None = None

    @property
    def shown(self) -> str:
        return self.short_name or self.name


@dataclass(frozen=True)
class Pattern:
    bank_id: int
    regex: str
    type: str = ""
    description: str = ""
    sender_id: str | None = None
    ref_required: bool | None = None
    has_account: bool | None = None
    has_fees: bool | None = None


@dataclass
class Compiled:
    """A pattern as the JVM takes it, with the numbers of its groups."""

    ord: int
    source: Pattern
    regex: str
    groups: dict[str, int] = field(default_factory=dict)


@dataclass
class Catalog:
    banks: list[Bank]
    patterns: list[Pattern]
    compiled: list[Compiled] = field(default_factory=list)
    invalid: int = 0

    @classmethod
    def build(cls, spark: SparkSession, banks: list[Bank], patterns: list[Pattern]) -> "Catalog":
        """Compile what compiles; an invalid pattern is counted and left out."""
        made = cls(banks, patterns)
        for i, p in enumerate(patterns):
            plain, names = positional(p.regex)
            regex = FLAGS + ascii_edges(plain)
            if compiles(spark, regex):
                made.compiled.append(Compiled(i, p, regex, names))
            else:
                made.invalid += 1
        return made

    def bank(self, bank_id: int) -> Bank | None:
        return next((b for b in self.banks if b.id == bank_id), None)



def token(value: Column) -> Column:
    """A sender or code without case and anything but letters and digits."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def _token(value: str) -> str:
    return "".join(c for c in value.lower() if c.isascii() and c.isalnum())


def sender_bank(address: Column, banks: list[Bank]) -> Column:
    """Id of the first bank with a code that the sender's token holds; null without one."""
    codes = {b.id: [c for c in map(_token, b.codes) if c] for b in banks}

    def first(norm: Column) -> Column:
        out = F
        for bank, cs in codes.items():
            if cs:
                hit = F.contains(norm, F.lit(cs[0]))
                for c in cs[1:]:
                    hit = hit | F.contains(norm, F.lit(c))
                out = out.when(hit, F.lit(bank))
        return out

    if not any(codes.values()):
        return F.lit(None).cast("int")
    return F.get(F.transform(F.array(token(address)), first), F.lit(0))  # the token is made once, not once a code


def clean_number(value: Column) -> Column:
    """Without commas, one last odd character and final dots; null stays null."""
    v = F.regexp_replace(F.trim(F.regexp_replace(value, ",", "")), "[^0-9.]$", "")
    return F.regexp_replace(v, "[.]+$", "")


def parses(value: Column) -> Column:
    return F.coalesce(value.try_cast("double").isNotNull(), F.lit(False))


def masked_account(value: Column, bank: Bank | None) -> Column:
    """The last digits that the bank shows, of the whole account if it masks none."""
    if bank is not None and bank.uniform_masking and bank.mask_pattern is not None:
        return F.when(F.length(value) >= bank.mask_pattern, F.right(value, F.lit(bank.mask_pattern))).otherwise(value)
    return value


def _holds(low: Column, texts: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds all of some."""
    out = F.lit(True)
    for t in texts:
        out = out & F.contains(low, F.lit(t))
    return out


def searched_party(body: Column, low: Column) -> Column:
    """A counterparty from the text itself (low: in lower case): each search's first match, unless it is the reader's own account."""
    tries = []
    for search in PARTY_SEARCHES:
        v = F.when(_holds(low, literals(search)), some(trimmed(F.regexp_extract(body, search, 1))))
        low = F.lower(v)
        own = F.contains(low, F.lit(OWN[0]))
        for o in OWN[1:]:
            own = own | F.contains(low, F.lit(o))
        tries.append(F.when(~own, v))
    return F.coalesce(*tries)


def _captured(p: Compiled, body: Column, bank: Bank | None) -> Column:
    """What a match captures, and as literals what its pattern declares: one struct of the same fields for every pattern."""
    s, lit = p.source, F.lit
    none = lit(None).cast("string")
    got = lambda name: some(F.regexp_extract(body, p.regex, p.groups[name])) if name in p.groups else none
    has = lambda name: lit(name in p.groups)
    # of the spellings of a fee only the first that the pattern declares is looked at
    fee = lambda names: got(next((n for n in names if n in p.groups), ""))
    party = [got(n) for n in (*PARTY_GROUPS, "creditor", "receiver") if n in p.groups]
    return F.struct(
        lit(p.ord).alias("ord"),
        lit(s.bank_id).alias("bank_id"),
        lit(catalog_name(bank, s.bank_id)).alias("bank_name"),
        lit(s.type).alias("type"),
        lit(s.description).alias("description"),
        lit(s.ref_required).cast("boolean").alias("ref_required"),
        lit(s.has_account is True).alias("needs_account"),
        lit(s.has_fees is True).alias("fees_expected"),
        has("balance").alias("balance_expected"),
        has("account").alias("account_expected"),
        got("amount").alias("amount"),
        got("balance").alias("balance"),
        (masked_account(got("account"), bank) if "account" in p.groups else none).alias("account"),
        got("reference").alias("reference"),
        got("type").alias("said_type"),
        (F.array(*party) if party else F.array(none)).alias("parties"),
        fee(FEE_GROUPS[0]).alias("fee"),
        fee(FEE_GROUPS[1]).alias("vat"),
    )


def catalog_name(bank: Bank | None, bank_id: int) -> str:
    return bank.shown if bank else f"Bank #{bank_id}"


def _judged(c: Column, party_in_text: Column) -> Column:
    """A captured struct with its acceptance, whose order in the catalog decides among equals."""
    low = F.lower(c["said_type"])
    kind = F.when(F.contains(low, F.lit("debit")), "DEBIT").when(F.contains(low, F.lit("credit")), "CREDIT").otherwise(c["type"])
    amount, balance, real = parses(clean_number(c["amount"])), c["balance"].isNotNull(), c["reference"].isNotNull()
    synth = ~real & F.coalesce(~c["ref_required"], F.lit(False))
    party = F.exists(c["parties"], lambda v: F.coalesce(trimmed(v) != "", F.lit(False))) | (F.contains(F.upper(kind), F.lit("CREDIT")) & party_in_text)
    reason = (
        F.when(~amount, "amountMissing")
        .when(c["balance_expected"] & ~balance, "balanceMissing")
        .when(F.coalesce(c["ref_required"], F.lit(False)) & ~real, "refMissing")
        .when(c["needs_account"] & c["account_expected"] & c["account"].isNull(), "accountMissing")
        .otherwise("none")
    )
    flags = (kind.isin("CREDIT", "DEBIT"), amount, c["balance_expected"], balance, parses(clean_number(c["balance"])), party, real, synth, c["account_expected"], c["account"].isNotNull(), c["fees_expected"], parses(clean_number(c["fee"])) | parses(clean_number(c["vat"])))
    return F.struct(reason.alias("reason"), c["ord"].alias("ord"), c["bank_id"].alias("bank_id"), c["bank_name"].alias("bank_name"), c["type"].alias("type"), c["description"].alias("description"), *(v.alias(k) for k, v in zip(FLAG_COLUMNS, flags)))


def parse(messages: DataFrame, catalog: Catalog, body: str = "body", address: str = "address") -> DataFrame:
    """messages with the result of the catalog.

    Adds sender_bank, matched, bank_id, bank_name, tx_type, pattern_desc, pattern_ord, parse_error (there is no body; the message counts as unmatched) and
    the struct extraction (accepted, reason and flags; null if unmatched). Of the patterns that match, the first whose extraction is accepted wins, else the first. A
    sender whose bank has patterns is matched against those, any other sender against all."""
    with_patterns = [b.id for b in catalog.banks if any(p.bank_id == b.id for p in catalog.patterns)]
    clean, low = F.col("_clean"), F.col("_low")
    df = messages.withColumn("_clean", trimmed(F.col(body))).withColumn("sender_bank", sender_bank(F.col(address), catalog.banks))
    df = df.withColumn("_scope", F.when(F.col("sender_bank").isin(with_patterns), F.col("sender_bank")) if with_patterns else F.lit(None).cast("int"))
    df = df.withColumn("_low", F.lower(clean)).withColumn("_party", searched_party(clean, low).isNotNull())
    # patterns of one bank that begin with the same fixed words are looked at, or left, together
    groups: dict[tuple[int, tuple[str, ...]], list[Column]] = {}
    for p in catalog.compiled:
        b, words = p.source.bank_id, literals(p.regex)
        groups.setdefault((b, words[:1]), []).append(F.when(_holds(low, words[1:]) & clean.rlike(p.regex), _captured(p, clean, catalog.bank(b))))
    if not groups:
        raise ValueError("the catalog has no valid pattern")
    of_group = [F.when((F.col("_scope").isNull() | (F.col("_scope") == b)) & _holds(low, word), F.filter(F.array(*branches), lambda c: c.isNotNull())) for (b, word), branches in groups.items()]
    in_order = F.array_sort(F.flatten(F.filter(F.array(*of_group), lambda g: g.isNotNull())))  # by ord, which comes first
    df = df.withColumn("_found", in_order)
    df = df.withColumn("_judged", F.transform("_found", lambda c: _judged(c, F.col("_party"))))
    accepted = F.filter("_judged", lambda j: j["reason"] == "none")
    df = df.withColumn("_hit", once(F.coalesce(F.get(accepted, F.lit(0)), F.get("_judged", F.lit(0)))))
    names = F.create_map(*(x for b in catalog.banks for x in (F.lit(b.id), F.lit(b.shown)))) if catalog.banks else None
    hit = F.col("_hit")
    df = df.withColumns(
        {
            "matched": hit.isNotNull(),
            "bank_id": once(F.when(hit.isNotNull(), hit["bank_id"]).otherwise(F.col("sender_bank"))),
            "bank_name": F.when(hit.isNotNull(), hit["bank_name"]).otherwise(F.element_at(names, F.col("sender_bank")) if names is not None else F.lit(None)),
            "tx_type": hit["type"],
            "pattern_desc": hit["description"],
            "pattern_ord": hit["ord"],
            "parse_error": F.col(body).isNull(),
            "extraction": F.when(hit.isNotNull(), F.struct((hit["reason"] == "none").alias("accepted"), hit["reason"].alias("reason"), *(hit[c].alias(c) for c in FLAG_COLUMNS))),
        }
    )
    return df.drop("_clean", "_low", "_scope", "_party", "_found", "_judged", "_hit")
