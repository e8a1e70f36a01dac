import json
import random

import pytest
from pyspark.sql import functions as F

from sievemill.functions import normalize
from sievemill.functions.normalize import with_template
from sievemill.operators import baseline, cluster, corpus, coverage, export, families, health
from sievemill.operators.match import Bank, Catalog, Pattern, parse
from sievemill.plans import report
from sievemill.sources import catalog as catalogs
from sievemill.sources import load

MESSAGES = "seq long, address string, body string, date_ms long"


def outcome(spark, regex, body, **options):
    cat = Catalog.build(spark, [Bank(1, "One", codes=("one",))], [Pattern(1, regex, options.pop("type", "DEBIT"), "d", **options)])
    return parse(spark.createDataFrame([(1, "one", body, None)], MESSAGES), cat).first()


@pytest.mark.parametrize(
    "regex, body, options, reason",
    [
        (r"hello (?<foo>\w+)", "hello world", {}, "amountMissing"),
        (r"amt (?<amount>\d+)(?: bal (?<balance>\d+))?", "amt 100", {}, "balanceMissing"),
        (r"amt (?<amount>\d+)", "amt 100", {"ref_required": True}, "refMissing"),
        (r"amt (?<amount>\d+)(?: acct (?<account>\d+))?", "amt 100", {"has_account": True}, "accountMissing"),
        (r"amt (?<amount>\d+)", "amt 100", {"ref_required": False}, "none"),
        (r"(?<amount>[\d.]+)", "100.", {}, "none"),
    ],
)
def test_gate(spark, regex, body, options, reason):
    e = outcome(spark, regex, body, **options).extraction
    assert e.reason == reason and e.accepted == (reason == "none")
    assert e.ref_synth == (options.get("ref_required") is False)


def test_types_parties_and_fees(spark):
    assert outcome(spark, r"amt (?<amount>\d+)", "amt 100", type="credit").extraction.type_valid is False
    assert outcome(spark, r"received (?<amount>\d+)", "received 100 from Abebe Kebede on 2024", type="CREDIT").extraction.counterparty is True
    assert outcome(spark, r"received (?<amount>\d+)", "received 100 from your account on 2024", type="CREDIT").extraction.counterparty is False
    assert outcome(spark, r"debited (?<amount>\d+).*?charge (?<service_charge>\d+)", "debited 100 charge 5", has_fees=True).extraction.fees_captured is True


def test_first_accepted_wins_and_scopes(spark):
    banks = [Bank(1, "One", codes=("one",)), Bank(2, "Two", "II", ("tw-o",)), Bank(3, "Three", codes=("three",))]
    patterns = [Pattern(1, r"x", "DEBIT", "no amount"), Pattern(1, r"x (?<amount>\d+)", "DEBIT", "amount"), Pattern(2, r"y (?<amount>\d+)", "DEBIT", "y"), Pattern(2, "broken (", "DEBIT", "broken")]
    cat = Catalog.build(spark, banks, patterns)
    assert cat.invalid == 1
    rows = [(1, "ONE bank", "x 5", None), (2, "one", "x", None), (3, "one", "y 5", None), (4, "TW/O", "y 5", None), (5, "three", "y 5", None), (6, None, "x 1", None), (7, "zzz", "q", None), (8, "three", "q", None)]
    got = {r.seq: (r.matched, r.bank_id, r.pattern_desc) for r in parse(spark.createDataFrame(rows, MESSAGES), cat).collect()}
    assert got == {1: (True, 1, "amount"), 2: (True, 1, "no amount"), 3: (False, 1, None), 4: (True, 2, "y"), 5: (True, 2, "y"), 6: (True, 1, "amount"), 7: (False, None, None), 8: (False, 3, None)}


HEALTH = "members long, accepted long, type_valid long, amount_parsed long, balance_expected long, balance_captured long, balance_parsed long, counterparty long, ref_real long, ref_synth long, account_expected long, account_captured long, fees_expected long, fees_captured long"


@pytest.mark.parametrize(
    "row, score",
    [((2, 2, 2, 2, 2, 2, 2, 2, 2, 0, 2, 2, 2, 2), 100), ((2, 0, 2, 2, 2, 2, 2, 2, 2, 0, 2, 2, 2, 2), 0), ((2, 2, 2, 2, 0, 0, 0, 2, 2, 0, 2, 2, 2, 2), 75), ((2, 2, 2, 2, 2, 2, 2, 2, 2, 0, 2, 0, 2, 2), 92), ((2, 2, 0, 2, 2, 2, 2, 2, 2, 0, 2, 2, 2, 2), 70)],
)
def test_health_score(spark, row, score):
    assert health.with_rates(spark.createDataFrame([row], HEALTH)).first().health_score == score


def clusters_of(spark, rows):
    schema = "template string, occurrences long, bank_id int, verb string, direction string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"bank_name": F.lit("B"), "readiness": F.lit("Low"), "degraded": F.lit(False), "examples": F.array("template"), "matched": F.lit(False)})


def test_verb_families_partition_and_never_cross_banks(spark):
    c = clusters_of(spark, [("Transferred <AMOUNT>", 5, 1, "transfer", "outgoing"), ("Transfer of <AMOUNT>", 3, 1, "transfer", "outgoing"), ("Transferred <AMOUNT>", 2, 2, "transfer", "outgoing"), ("OTP", 1, 1, None, None), ("Code", 1, 1, None, None)])
    f = families.families(families.by_verb(c)).collect()
    assert sorted((r.template, r.bank_id, r.member_count, r.total) for r in f) == [("Code", 1, 1, 1), ("OTP", 1, 1, 1), ("Transferred <AMOUNT>", 1, 2, 8), ("Transferred <AMOUNT>", 2, 1, 2)]
    assert {r.label for r in f if r.verb} == {"Outgoing transfers"} and {r.label for r in f if not r.verb} == {None}
    refined = families.families(families.by_distance(c, 0.99, within_verbs=True)).collect()
    assert sum(r.total for r in refined) == 12 and len(refined) == 5


def test_distance_families_keep_streams_apart(spark):
    """One template in two streams is two members; a success template doesn't join what is unmatched."""
    near = ["Paid <AMOUNT> for a loan", "Paid <AMOUNT> for a moan", "Paid <AMOUNT> for a moat"]
    rows = [(near[0], 9, 1, "success"), (near[0], 5, 1, "attributed"), (near[1], 8, 1, "success"), (near[2], 4, 1, "attributed"), (near[1], 3, None, "candidate"), (near[1], 2, 2, "attributed")]
    c = clusters_of(spark, [(t, n, b, "pay", "outgoing") for t, n, b, _ in rows])
    streams = spark.createDataFrame([(t, n, s) for t, n, _, s in rows], "template string, occurrences long, stream string")
    c = c.join(streams, ["template", "occurrences"]).withColumn("matched", F.col("stream") == "success")
    for within in (False, True):
        f = families.families(families.by_distance(c, 0.95, within), "stream").collect()
        got = sorted((r.stream, r.template, r.bank_id or 0, r.member_count, r.total) for r in f)
        assert got == [("attributed", near[0], 1, 1, 5), ("attributed", near[1], 2, 1, 2), ("attributed", near[2], 1, 1, 4), ("candidate", near[1], 0, 1, 3), ("success", near[0], 1, 2, 17)]
    plain = families.families(families.by_distance(c.drop("stream"), 0.95)).collect()
    assert sum(r.total for r in plain) == 31 and {r.total for r in plain if r.template == near[0]} == {5, 17}


def test_edit_distance_is_exact():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        for most in (0, 1, 2, 5, 20):
            got = families.edit_distance(a, b, most)
            assert got == row[-1] if row[-1] <= most else got > most


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    texts = {"".join(rng.choice("ab ") for _ in range(rng.randrange(3, 14))) for _ in range(60)} | {"", "a"}
    c = spark.createDataFrame([(rng.choice((1, 2, None)), t) for t in sorted(texts)], "bank_id int, template string")
    rows = c.collect()
    for threshold in (0.5, 0.75, 0.9):
        expected = set()
        for r in rows:
            for q in rows:
                n = max(len(r.template), len(q.template))
                if r.bank_id == q.bank_id and r.template < q.template and n and 1 - families.edit_distance(r.template, q.template, n) / n >= threshold:
                    expected.add((r.bank_id, r.template, q.template))
        got = families.similar_pairs(c, threshold).collect()
        assert {(r.bank_id, r.a, r.b) for r in got} == expected and len(got) == len(expected) and (expected or threshold > 0.8)


BROKEN = normalize.Rule("CODE", "(", "(", "<CODE>", "<CODE>", "(", 1)


def test_degraded_units_hold_no_content(spark):
    """A rule that fails leaves values in a template; such a unit keeps its counts only, and the counters say so."""
    cat = Catalog.build(spark, [Bank(1, "One", codes=("one",))], [Pattern(1, r"paid ETB (?<amount>[\d.]+)", "DEBIT", "paid")])
    m = spark.createDataFrame([(1, "one", "Transferred RAWNAME ETB 5", None), (2, "one", None, None), (3, "one", "paid ETB 7 RAWNAME", None)], MESSAGES)
    for normal in (normalize.with_template, normalize.with_spans):
        rows = normal(parse(m, cat), "body", rules=(*normalize.RULES, BROKEN))
        assert {r.degraded for r in rows.collect()} == {True}
        c = coverage.with_stream(cluster.clusters(rows))
        f = families.families(families.by_verb(c), "stream")
        units = export.unmatched_units(f)
        (u,) = units.collect()
        assert (u.normalized_text, u.verb, u["count"], u.bank, u.degraded) == (None, None, 1, "One", True)
        doc = export.document({}, [u.asDict()], [])
        assert doc["unmatchedUnits"][0]["redacted"] and "RAWNAME" not in json.dumps(doc)
        q = coverage.quality(m, rows, units).first()
        assert (q.normalization_degraded, q.units_redacted, q.units_exported, q.parse_errors, q.clustering_skipped, q.dataset_empty_bodies, q.messages_loaded, q.clean) == (3, 1, 0, 1, 1, 1, 3, False)
    good = normalize.with_template(parse(m.where("seq <> 2"), cat), "body")
    assert coverage.quality(m.where("seq <> 2"), good).first().clean and not good.first().degraded


def test_parse_counts_messages_without_a_body(spark):
    cat = Catalog.build(spark, [Bank(1, "One", codes=("one",))], [Pattern(1, "x", "DEBIT", "x")])
    rows = parse(spark.createDataFrame([(1, "one", None, None), (2, "one", "x", None)], MESSAGES), cat)
    o = coverage.overall(rows).first()
    assert (o.total, o.matched, o.parse_errors) == (2, 1, 1) and export.message_totals(coverage.overall(rows)).first().parse_errors == 1


def test_fingerprints_tell_rows_apart(spark):
    def of(*rows):
        return corpus.fingerprint(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["id"]

    odd = [("x\u0001y", "z"), ("x", "y\u0001z"), (None, "x"), ("", "x"), ("-", "x"), ("1:x", ""), ("", "1:x"), ("x", None), (None, None), ("", "")]
    assert len({of(r) for r in odd}) == len(odd) and of(*odd) == of(*reversed(odd), odd[0])


def test_application_tables(spark):
    p = spark.createDataFrame([("2", None, "b", "T", "second", 2), ("1", "S", "a", "T", "first", 1), (None, "S", "c", "T", "none", 3), ("x", "S", "c", "T", "none", 4)], "bankId string, senderId string, regex string, type string, description string, id int")
    assert [tuple(r) for r in load.application_patterns(p).orderBy("pattern_ord").collect()] == [(0, 1, "S", "a", "T", "first"), (1, 2, None, "b", "T", "second")]
    f = spark.createDataFrame([("s", "b", "5"), ("s", " ", "6"), (None, "c", "x")], "address string, body string, date string")
    assert [tuple(r) for r in load.failed_parses(f).collect()] == [("s", "b", 5), (None, "c", None)]


def test_lines_are_read_in_parallel(spark, tmp_path):
    """Records per line aren't read as one value; documents are, also those over several lines."""
    for name, text, whole in (("l", '{"body": "a"}\n{"body": "b"}', False), ("a", '[{"body": "a"},\n {"body": "b"}]', True), ("o", '{"sms": [{"body": "a"}, {"body": "b"}]}', True), ("p", '{\n"data": [{"body": "a"}, {"body": "b"}]}', True), ("e", "\n \n", False), ("t", "body\nmore", False)):
        (tmp_path / name).write_text(text)
        assert load.is_document(spark, str(tmp_path / name)) is whole, name
        if name in "laop":
            assert [r.body for r in load.load_json(spark, str(tmp_path / name)).messages.orderBy("seq").collect()] == ["a", "b"]


def test_clusters_vote_and_order(spark):
    rows = [(i, "s", f"Paid ETB {i} now", None, i % 2 == 0, {0: 7, 1: 8}.get(i % 2), "n", None, None) for i in range(8)]
    df = spark.createDataFrame(rows, "seq long, address string, body string, date_ms long, matched boolean, bank_id int, bank_name string, pattern_desc string, tx_type string")
    df = with_template(df.withColumn("matched", F.lit(False)), "body")
    for d in (df.repartition(1), df.repartition(8)):
        r = cluster.clusters(d).collect()
        assert [(x.occurrences, x.bank_id, x.examples[0], len(x.examples), x.verb) for x in r] == [(8, 7, "Paid ETB 0 now", 5, "pay")]


def test_corpus_is_order_free(spark):
    a = spark.createDataFrame([(1, "x", "one", None), (2, None, "one", None)], MESSAGES)
    b = spark.createDataFrame([(1, "x", "one", None), (2, "y", "two", None)], MESSAGES)
    u, v = corpus.union(("a", a), ("b", b)), corpus.union(("b", b), ("a", a))
    assert corpus.merge_counts(u).first().asDict() == {"total_input": 4, "unique_count": 3, "duplicates_removed": 1}
    assert corpus.deduplicated(u).count() == 3
    ids = [corpus.fingerprint(d, "address", "body").first()["id"] for d in (u, v, a)]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 16


def test_baseline(spark, tmp_path):
    cur = catalogs.as_table(spark, [Pattern(1, "a", "T", "same"), Pattern(1, "b", "T", "gone"), Pattern(2, "c", "T", "edit")])
    src = catalogs.as_table(spark, [Pattern(2, "d", "T", "edit"), Pattern(1, "a", "T", "same"), Pattern(3, "e", "T", "new")])
    assert sorted(tuple(r) for r in baseline.difference(cur, src).collect()) == [("added", 3, "new", [], ["e"]), ("changed", 2, "edit", ["c"], ["d"]), ("removed", 1, "gone", ["b"], [])]
    led = baseline.Ledger()
    assert [led.record({"signature": s}) for s in ("aaa", "aaa", "bbb")] == [True, False, True]
    led.save(str(tmp_path / "l.json"))
    assert len(baseline.Ledger.load(str(tmp_path / "l.json")).entries) == 2
    (tmp_path / "x.src").write_text("fn f(a) { if (a) { b } }")
    sign, hashes = baseline.probe(str(tmp_path), {"f": ("x.src", "f(a)"), "g": ("x.src", "g()")})
    assert hashes["g"] == baseline.MISSING and len(sign) == 16 and baseline.drifted(hashes, {**hashes, "f": "0"}) == ["f"]
    assert baseline.probe(str(tmp_path / "none"), {"f": ("x.src", "f")}) is None


@pytest.mark.parametrize(
    "text, bodies, malformed, empty",
    [
        ('[{"body": "a", "sender": "s", "date": "1719000000000"}, 5, {"message": " "}]', ["a"], 1, 1),
        ('{"sms": [{"text": "b", "timestamp": 7}]}', ["b"], 0, 0),
        ('{"body": "c"}\nnot json\n\n{"body": "d"}', ["c", "d"], 1, 0),
        ("", [], 0, 0),
    ],
)
def test_load(spark, tmp_path, text, bodies, malformed, empty):
    (tmp_path / "m.json").write_text(text)
    got = load.load_json(spark, str(tmp_path / "m.json"))
    assert [r.body for r in got.messages.orderBy("seq").collect()] == bodies
    s = got.skipped.first()
    assert (s.dataset_malformed, s.dataset_empty_bodies) == (malformed, empty)


def test_content_rows_and_chat(spark):
    dump = spark.createDataFrame([("Row: 0 address=CBE, date=1, body=paid ETB 4, total=5, body=x\nRow: 1 address=null, date=2, body=b",)], "text string")
    assert [(r.address, r.body, r.date_ms) for r in load.content_rows(dump).orderBy("seq").collect()] == [("CBE", "x", 1), (None, "b", 2)]
    chat = spark.createDataFrame([("[1/2/24, 10:00] Ann: Dear A paid\n1. Dear B\ngot 2",)], "text string")
    assert [r.body for r in load.chat_messages(chat, "Dear", "S").orderBy("seq").collect()] == ["Dear A paid 1.", "Dear B got 2"]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(1, "one", "Transferred ETB 5 to account 100234567890 on success", None), (2, "one", "paid ETB 77.50 now", None), (3, "zz", "You received ETB 12.00 balance 4", None), (4, "zz", "Hello friend", None)]
    return spark.createDataFrame(rows, MESSAGES), Catalog.build(spark, [Bank(1, "One", codes=("one",))], [Pattern(1, r"paid ETB (?<amount>[\d.]+)", "DEBIT", "paid")])


def test_report(sample):
    m, cat = sample
    r = report.analyze(m, cat, "verb")
    assert r.overall["total"] == 4 and r.overall["matched"] == 1 and (r.n_gaps, r.n_candidates, r.noise) == (1, 1, 1)
    page = report.html(r)
    assert page == report.html(r) and "<script" not in page and "http" not in page.replace("http://www.w3.org", "")
    assert "50.0%" in report.markdown(r)
    assert report.gate(r, 25.0) == 0 and report.gate(r, 25.1) == 4


def test_export_holds_no_value(sample):
    m, cat = sample
    doc = report.export_document(m, cat, {"datasetId": "x"}, "verb")
    text = json.dumps(doc)
    assert doc["metadata"]["version"] == 4 and doc["metadata"]["messages"]["app_accepted"] == 1
    assert not [v for v in ("100234567890", "77.50", "12.00", "Hello") if v in text]
    assert len(doc["unmatchedUnits"]) == 2 and doc["successUnits"][0]["patternDescription"] == "paid"
    assert "<AMOUNT>" in report.preview(doc)


def test_empty_corpus(spark, sample):
    rows = parse(spark.createDataFrame([], MESSAGES), sample[1])
    assert coverage.overall(rows).first().coverage_pct == 0
    assert cluster.clusters(with_template(rows, "body")).count() == 0


def test_streams(spark, tmp_path):
    from sievemill.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"address": "a", "body": "x", "date": 1000}\n{"address": "a", "body": "x", "date": 2000}\n{"address": "b", "body": " ", "date": 1}\n')
    got = []
    q = ingest.each_batch(ingest.deduplicated(ingest.read_lines(spark, str(tmp_path / "in"))), lambda df, i: got.extend(df.collect()), str(tmp_path / "c"))
    q.awaitTermination()
    assert [(r.address, r.body) for r in got] == [("a", "x")]


def test_messages_are_counted_before_they_meet_families(spark):
    """No join holds messages: a family's few keys would put them all in a few tasks."""
    rows = spark.createDataFrame([(i, "t" if i % 3 else "u", i % 4 > 0, "p" if i % 2 else "q") for i in range(60)], "seq long, template string, matched boolean, pattern_desc string")
    own = spark.createDataFrame([("t", "f"), ("u", "g")], "template string, family string")
    top = cluster.top_description(rows, own, "family")
    assert {r.family: r.pattern_desc for r in top.collect()} == {"f": "p", "g": "p"}
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [template" in plan[plan.index("Join") :]


def test_bank_names_are_aggregated_by_hash(spark):
    """Names as aggregates, not keys, would sort all messages."""
    rows = spark.createDataFrame([(i, "t", 1 + i % 2, "ab"[i % 2], i % 3 == 0) for i in range(30)], "seq long, template string, bank_id int, bank_name string, matched boolean")
    for df, key in ((cluster.mode_bank(rows), "template"), (coverage.by_bank(rows), "bank_id")):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        nearest = [line for line in plan if "Aggregate" in line][-1]
        assert "HashAggregate" in nearest and "Sort" not in nearest, nearest
    assert [tuple(r) for r in cluster.mode_bank(rows).collect()] == [("t", 1, "a")]
    assert sorted((r.bank_id, r.bank_name, r.total, r.matched) for r in coverage.by_bank(rows).collect()) == [(1, "a", 15, 5), (2, "b", 15, 5)]


def test_messages_are_parsed_once_a_query(spark, monkeypatch):
    """Clusters, health, descriptions and counters come from one kept table; spans need no catalog."""
    from sievemill.plans import messages, queries

    parsed = []
    monkeypatch.setattr(messages, "parse", lambda *a, f=messages.parse: parsed.append(1) or f(*a))
    for name, times in (("reconciliation", 1), ("quality_rollup", 1), ("field_shapes", 0)):
        parsed.clear()
        queries.ALL[name](spark, "/root/testdata/sf0.001")
        assert len(parsed) == times, name
    spark.catalog.clearCache()
