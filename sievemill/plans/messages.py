"""Messages made from the tables of orders and customers, and the catalog that comes with the package."""

from __future__ import annotations

from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.normalize import with_spans, with_template
from sievemill.functions.regexes import spread
from sievemill.operators.match import Catalog, Pattern, parse
from sievemill.sources import catalog as catalogs

FIXTURES = Path(__file__).resolve().parent.parent / "fixtures"
SENDERS = ("ALPHA", "Alpha-Bank Info", "BETA", "9001", "DELTA", "Corner Shop", None, "GammaPay")
#: Placeholders in braces are columns of `parts`.
BODIES = (
    "Dear Customer, your account 1****{cust} has been credited with ETB {amount} on {day}. Your balance is ETB {balance}. https://pay.example/r?id={ref}",
    "You have transferred ETB {amount} to Abel Kebede on {day}. Ref {ref}. Balance ETB {balance}",
    "Account 1****{cust} debited ETB {amount} on {minute} service charge 5.00 VAT 0.75. Balance ETB {balance}.",
    "POS purchase of ETB {amount} at SUPER MARKET on {minute}. Card ****{cust}.",
    "You have received ETB {amount} from 0911{six}. Transaction number {ref}.",
    "Salary payment of {amount} Birr has reached your wallet effective {day}.",
    "Your verification code is {six}. Do not share it with anyone.",
    "Account 100000{six} debited amount ETB {amount}.",
    "You have withdrawn ETB {amount} cash (Abebe Bekele) ref {ref}",
    "Your credit of ETB {amount} failed; please retry at {hour}",
    "Promo! Win {two} prizes today only. Dial *{cust}#",
    "You have paid ETB {amount} for bill {ref}. New balance: ETB {balance}\nThank you",
)
BLANK = "  "
#: Varied messages: a start, an amount, one of the parts by name, an end; hundreds of templates a bank.
STARTS = (("Paid", "DEBIT"), ("You have received", "CREDIT"), ("Transferred", "DEBIT"), ("Account debited", "DEBIT"), ("Refund of", "CREDIT"), ("Purchase of", "DEBIT"), ("Reminder:", "NOTICE"))
ENDS = {"F": "completed", "O": "pending"}


def catalog(spark: SparkSession) -> Catalog:
    return catalogs.load(spark, *(str(FIXTURES / f) for f in catalogs.FILES))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, address, body, date_ms): one message an order; some bodies are blank."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    m = o.join(c, o["o_custkey"] == c["c_custkey"])
    key, pad = F.col("o_orderkey"), lambda v, n: F.lpad(v.cast("string"), n, "0")
    parts = {
        "cust": pad(F.pmod("o_custkey", F.lit(10000)), 4),
        "amount": F.format_number("o_totalprice", 2),
        "day": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "minute": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"),
        "hour": F.date_format("o_orderdate", "HH:mm"),
        "balance": F.format_string("%.2f", F.abs("c_acctbal")),
        "ref": F.concat(F.lit("FT"), pad(key, 8), F.lit("K")),
        "six": pad(F.pmod(key * 7, F.lit(1000000)), 6),
        "two": pad(F.pmod(key, F.lit(97)), 2),
    }
    bodies = []
    for b in BODIES:
        pieces = [F.lit("")]
        for text in b.replace("}", "{").split("{"):
            pieces.append(parts[text] if text in parts else F.lit(text))
        bodies.append(F.concat(*pieces))
    which, who = F.pmod(key, F.lit(len(BODIES))), F.pmod(F.floor(key / len(BODIES)), F.lit(len(SENDERS)))
    body, sender = F, F
    for i, b in enumerate(bodies):
        body = body.when(which == i, b)
    for i, s in enumerate(SENDERS):
        sender = sender.when(who == i, F.lit(s))
    body = F.when(F.pmod(key, F.lit(50)) == 11, BLANK).otherwise(body)
    return m.select(key.alias("seq"), sender.alias("address"), body.alias("body"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("date_ms"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_messages without blank bodies."""
    return spread(raw_messages(spark, sf_dir).where(F.trim("body") != ""), "seq")


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, address, body, date_ms): one message a line of an order, about the part that it sells."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_shipdate")  # noqa: E741
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    m = l.join(part, l["l_partkey"] == part["p_partkey"])
    which, who = F.pmod("l_suppkey", F.lit(len(STARTS))), F.pmod("l_partkey", F.lit(len(SENDERS)))
    start, sender, end = F, F, F
    for i, (s, _) in enumerate(STARTS):
        start = start.when(which == i, F.lit(s))
    for i, s in enumerate(SENDERS):
        sender = sender.when(who == i, F.lit(s))
    for status, s in ENDS.items():
        end = end.when(F.col("l_linestatus") == status, F.lit(s))
    ref = F.concat(F.lit("FT"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("K"))
    body = F.concat(start, F.lit(" ETB "), F.format_number("l_extendedprice", 2), F.lit(" for "), "p_name", F.lit(" "), end, F.lit(", ref "), ref)
    rows = m.select((((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("seq"), sender.alias("address"), body.alias("body"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("date_ms"))
    return spread(rows, "seq")


def large_patterns() -> list[Pattern]:
    """95 patterns: by start, kind of part and end; some ask for what a message lacks, some match what others do."""
    kinds = "blue cold hot large new old red small".split()
    out = []
    for i in range(95):
        (start, kind), end = STARTS[i % len(STARTS)], tuple(ENDS.values())[i // 7 % 2]
        regex = rf"{start} ETB (?<amount>[\d,.]+) for {kinds[i % 8]} \w+ {end}, ref (?<reference>\w+)" if i % 5 else rf"{start} ETB (?<amount>[\d,.]+) for {kinds[i // 5 % 8]}(?: balance (?<balance>[\d.]+))?"
        out.append(Pattern(1 + i % 4, regex, kind, f"pattern {i}", ref_required=i % 3 == 0 or None))
    return out


def large_catalog(spark: SparkSession) -> Catalog:
    return Catalog.build(spark, catalogs.read_banks(str(FIXTURES / catalogs.FILES[0])), large_patterns())


def kept(rows: DataFrame) -> DataFrame:
    """rows, kept while the session needs them, for several results that read them: the regular expressions should run once. What one
    result reads isn't kept. What doesn't fit in memory goes to local disks, and what an executor loses is computed again from its part of the input."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(messages(spark, sf_dir), catalog(spark)).drop("address", "date_ms")


def templates(spark: SparkSession, sf_dir: str, spans: bool = False) -> DataFrame:
    """Messages with their templates, without a catalog."""
    return (with_spans if spans else with_template)(messages(spark, sf_dir), "body")


def parsed_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed messages with their templates."""
    return with_template(parse(messages(spark, sf_dir), catalog(spark)).drop("address", "date_ms", "sender_bank", "pattern_ord"), "body")
