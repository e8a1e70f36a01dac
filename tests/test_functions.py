import random
import re

import pytest
from pyspark.sql import functions as F

from sievemill.functions import heuristic, lexicon, normalize, regexes
from sievemill.operators import cluster, families, shapes

TEMPLATES = {
    "Transferred ETB 500 to account 100234567890 on success": "Transferred <AMOUNT> to account <ACCOUNT> on success",
    "POS ETB 350.00 at 2024-06-10 13:45 Card ****4321 from 0912345678": "POS <AMOUNT> at <DATE> <TIME>Card <CARD> from <PHONE>",
    "VAT(15%) and Disaster Recovery(5%) applied": "VAT(<NUM>%) and Disaster Recovery(<NUM>%) applied",
    "transferred ETB 420.00 to account 1**6548 (Abdurezak Mehabuba Bushira).": "transferred <AMOUNT> to account <ACCOUNT> (<NAME>).",
    "You have transfered ETB 255.00 to Demis Zeleke on 2026-06-15": "You have transfered <AMOUNT> to <NAME> on <DATE>",
    "Dear Dechasa Teshome Gemechu You have successfully transferred ETB420.00": "Dear <NAME> have successfully transferred <AMOUNT>",
    "a    b\n\tc": "a b c",
    "paid at 9:05 PM 31-Jan-2024, ETB 500, then USD 7.": "paid at <TIME> <DATE>, <AMOUNT> then <AMOUNT>.",
    "é5 abcé12345 x": "é<NUM> abcé<NUM> x",
    "see https://a.example/x?id=FT1 now id=AB12CD": "see <URL> now id=<REFERENCE>",
}


def test_templates(spark):
    df = spark.createDataFrame([(b,) for b in TEMPLATES], "body string")
    assert {r.body: r.template for r in normalize.with_template(df, "body").collect()} == TEMPLATES
    assert {r.body: r.template for r in normalize.with_spans(df, "body").collect()} == TEMPLATES


def test_spans(spark):
    df = spark.createDataFrame([("Dear Mr Dechasa transferred ETB 500 to account 100234567890 on 2024-01-31",)], "body string")
    found = {s.field: s["values"] for s in normalize.with_spans(df, "body").first().spans}
    assert found == {"AMOUNT": ["ETB 500"], "ACCOUNT": ["100234567890"], "DATE": ["2024-01-31"], "NAME": ["Mr Dechasa"]}


@pytest.mark.parametrize(
    "body, is_one",
    [("transferred ETB 200", True), ("Amount credited; new balance available.", True), ("POS purchase of ETB 350 at MERCHANT.", True), ("Your transfer is being processed.", False), ("", False), ("Your verification code is 884512. Do not share it with anyone.", False), (None, False)],
)
def test_heuristic(spark, body, is_one):
    df = spark.createDataFrame([(body,)], "body string")
    assert df.select(heuristic.looks_like_transaction(F.col("body"))).first()[0] is is_one


def test_annotation_and_labels(spark):
    said = {"You have successfully transferred <AMOUNT>": ("transfer", "outgoing"), "debited then charged <AMOUNT>": ("debit", "outgoing"), "Transaction confirmed": ("transaction", "neutral"), "Your OTP is <NUM> valid for <NUM> minutes": (None, None)}
    df = spark.createDataFrame([(t,) for t in said], "t string").withColumn("a", lexicon.annotation(F.col("t")))
    rows = df.select("t", "a.verb", "a.direction", lexicon.label(F.col("a.verb"), F.col("a.direction")).alias("label")).collect()
    assert {r.t: (r.verb, r.direction) for r in rows} == said
    labels = {r.verb: r.label for r in rows}
    assert labels["transfer"] == "Outgoing transfers" and labels["debit"] == "Outgoing debits" and labels["transaction"] == "Transactions" and labels[None] is None
    assert len({x[0] for x in lexicon.lexicon()}) == 41 and lexicon.missing_words(["sent", "beamed"]) == ["beamed"]


@pytest.mark.parametrize(
    "values, regex",
    [
        (["500", "250", "1000"], r"\d{3,4}"),
        (["1,234.56", "2,000.00", "9,999.99"], r"\d,\d{3}\.\d{2}"),
        (["1****6843", "1**6843", "2***0315"], r"\d\*{2,4}\d{4}"),
        (["500", "12,000.00", "9.99"], r"(?:\d\.\d{2}|\d{2},\d{3}\.\d{2}|\d{3})"),
        (["FT26174513JK"], r"[\dA-Za-z]+"),
        (["a1", "bb22", "c3c3", "d-4", "e.5.", "ffff"], r"[\dA-Za-z\-.]{2,4}"),
    ],
)
def test_shapes(spark, values, regex):
    df = spark.createDataFrame([("t", "F", v) for v in values], "template string, field string, value string")
    row = shapes.field_shapes(df, "template").first()
    assert (row.regex, row.samples) == (regex, len(values))


def test_distance_and_greedy(spark):
    df = spark.createDataFrame([("kitten", "sitting", 1 - 3 / 7), ("", "", 1.0), ("abc", "xyz", 0.0)], "a string, b string, s double")
    for r in df.select("s", families.similarity(F.col("a"), F.col("b")).alias("x")).collect():
        assert abs(r.s - r.x) < 1e-12
    close = ["Account credited with <AMOUNT> balance <AMOUNT>", "Account credited with <AMOUNT> balances <AMOUNT>"]
    assert families.greedy(close, 0.9) == [0, 0] and families.greedy(close, 1.0) == [0, 1]


def test_readiness_and_priority(spark):
    df = spark.createDataFrame([("You have paid <AMOUNT> for the bill now today", 600), ("paid <AMOUNT> for it", 20), ("<NUM> <NUM>", 1)], "t string, n long")
    rows = df.select(cluster.readiness(F.col("t")), cluster.priority(F.col("n")), cluster.priority_rank(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("High", "Very High", 5), ("Medium", "Medium", 3), ("Low", "Very Low", 1)]


def test_named_groups_become_positional():
    plain, names = regexes.positional(r"(?<a_b>x)(?:y)(z)[(?<no>](?<c>\(w)")
    assert plain == r"(x)(?:y)(z)[(?<no>](\(w)" and names == {"a_b": 1, "c": 3}


def odd_texts(n: int = 1500) -> list[str | None]:
    """Texts of what rules look for, whole, cut and glued together, with odd spaces, letters and digits."""
    rng = random.Random(7)
    bits = ["Dear Mr", "Dear ", "Dear Abel", "Abel Kebede", "A.B O'Neil", "from ", "to ", " on ", "at ", "SUPER MARKET", "(Abebe Bekele)", "( x)", "https://a.b/?id=FT12", "HTTP://", "id=", "Receipt/", "ID=Ab12&", "2024-01-31", "1/2/24", "31-Jan-2024", "3 sept 99", "13:45", "9:05 PM", "9:05pm", "1****4321", "****12", "+251912345678", "0912345678", "912345678", "812345678", "251812345678", "1234567890123", "ETB 5", "etb1,000.50", "Br.", "$7", "7.00 Br", "FT00012345K", "AB12CD", "12ab", "1a2b3c", "5", "0", "x9", "9x", "é5", "٣", "K", "ſ", "İ", " ", "　", " ", "\t", "\n", "\x0b", "\x1c", "\x85", ".", ",", "-", "_", "<NAME>", "<NUM>", "😀", "#", "'"]
    join = lambda: rng.choice(("", " ", " ", "  "))
    return [None, "", " ", "x" * 9000 + " 5"] + ["".join(rng.choice(bits) + join() for _ in range(rng.randrange(1, 12))) for _ in range(n)] + ["".join(rng.choice(bits) + join() for _ in range(400)) for _ in range(20)]


def test_batches_say_what_the_jvm_says(spark, monkeypatch):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(odd_texts())], "seq long, body string")
    both = {}
    for fast in (True, False):
        if not fast:
            monkeypatch.setattr(normalize, "_in_python", lambda rules, usable: False)
        t = {r.seq: r.template for r in normalize.with_template(df, "body").collect()}
        s = {r.seq: (r.template, r.spans) for r in normalize.with_spans(df, "body").collect()}
        assert {k: v[0] for k, v in s.items()} == t
        both[fast] = s
    for k, v in both[False].items():
        assert both[True][k] == v


def test_texts_that_differ_in_digits_are_normalized_once(monkeypatch):
    ran = []
    monkeypatch.setattr(normalize, "_known", {})
    monkeypatch.setattr(normalize, "found", lambda t, f=normalize.found: ran.append(t) or f(t))
    texts = [f"Paid ETB {a}.00 for x{b} from 09{c:08} ref FT{a:08}K" for a in range(100, 130) for b in range(3) for c in range(5)]
    got = [normalize.template_of(t) for t in texts]
    assert len(ran) == 1 and {g for g in got} == {f"Paid <AMOUNT> for x{b} from <PHONE> ref <REFERENCE>" for b in range(3)}
    assert normalize.template_of("Paid ETB 1.00 for x0 from 0812345678 ref FT00000001K") == "Paid <AMOUNT> for x0 from <ACCOUNT> ref <REFERENCE>"


@pytest.mark.parametrize(
    "pattern, words",
    [
        (r"(?ims)Paid ETB ([\d,.]+) for blue \w+, ref (\w+)", ("paid etb ", " for blue ", ", ref ")),
        (r"a|b", ()),
        (r"(?:x|y) of (z)?", (" of ",)),
        (r"paids? up+s{0,2}to", ("paid", " up", "to")),
        (r"\$5 [^\]x]+\.end", ("$5 ", ".end")),
        (r"a[b[c]]d", ()),
        (r"a(?x) b c", ()),
        (r"a\x41b", ()),
        (r"\Qa|b\E", ()),
        (r"é?ab", ("ab",)),
        (r"ab*?c", ("a", "c")),
    ],
)
def test_literals(pattern, words):
    assert regexes.literals(pattern) == words


def test_spread_follows_the_input(spark, tmp_path):
    """Many tasks for a large input, also where a few files or a join would make few."""
    path = str(tmp_path / "t.parquet")
    spark.range(400_000).selectExpr("id", "sha2(cast(id as string), 256) as v").coalesce(1).write.parquet(path)
    few, many = (regexes.spread(spark.read.parquet(path), "id", mb).rdd.getNumPartitions() for mb in (1000, 1))
    assert few == 2 * spark.sparkContext.defaultParallelism and many > 2 * few


def test_trimmed_takes_all_white_space_and_nothing_else(spark):
    spaces = [c for c in map(chr, range(0x3100)) if re.fullmatch(r"[ \t\n\x0b\f\r ﻿  -     　]", c)] + ["﻿"]
    rows = [(f"{c}{c}a b{c}", "a b") for c in spaces] + [("a  \x85", "a  \x85"), (" \n", ""), ("", ""), (None, None), ("\x85a", "\x85a")]
    got = spark.createDataFrame(rows, "t string, x string").select(regexes.trimmed(F.col("t")).alias("t"), "x").collect()
    assert len(rows) > 25 and all(r.t == r.x for r in got)


def test_once_keeps_filters_out(spark):
    """A filter above isn't written into what is computed once."""
    df = spark.range(3).select(regexes.once(F.sha2(F.col("id").cast("string"), 256)).alias("h"))
    plan = df.where("h is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Project") and plan.count("sha2") == 1
