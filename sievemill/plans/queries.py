"""The registered queries on the reference's operators; oracle.py has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import heuristic, lexicon, normalize
from sievemill.functions.regexes import spread, trimmed
from sievemill.operators import baseline, cluster, corpus, coverage, export, families, health, shapes
from sievemill.operators.match import FLAG_COLUMNS, parse, sender_bank
from sievemill.plans import messages as M
from sievemill.sources import catalog as catalogs
from sievemill.sources import load

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    ALL[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of their source."""
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("source").alias("address"), F.coalesce("text", F.lit("")).alias("body"), F.lit(None).cast("long").alias("date_ms"))


@query
def normalize_messages(spark, sf_dir):
    return M.templates(spark, sf_dir).select("seq", "template")


@query
def normalize_documents(spark, sf_dir):
    d = spread(_documents(spark, sf_dir), "seq")
    return normalize.with_template(d, "body").select("seq", F.md5(F.col("template").cast("binary")).alias("template_md5"), F.length("template").cast("long").alias("n_chars"))


@query
def template_clusters(spark, sf_dir):
    c = cluster.counts(M.templates(spark, sf_dir))
    n = F.col("occurrences")
    return c.select("template", "occurrences", cluster.priority(n).alias("priority"), cluster.priority_rank(n).alias("priority_rank"), cluster.readiness(F.col("template")).alias("readiness")).orderBy(F.col("priority_rank").desc(), n.desc(), "template")


@query
def cluster_examples(spark, sf_dir):
    rows = M.templates(spark, sf_dir)
    return cluster.first_examples(rows).select("template", F.array_join("examples", " ¶ ").alias("examples"))


@query
def cluster_mode_bank(spark, sf_dir):
    return cluster.mode_bank(M.parsed_templates(spark, sf_dir), "matched")


@query
def span_counts(spark, sf_dir):
    rows = M.templates(spark, sf_dir, spans=True)
    long = rows.select(F.explode("spans").alias("s")).select("s.rule", "s.field", F.size("s.values").alias("n"))
    return long.groupBy("rule", "field").agg(F.sum("n").alias("spans"))


@query
def capped_spans(spark, sf_dir):
    values = cluster.span_values(M.templates(spark, sf_dir, spans=True))
    return values.groupBy("template", "field").agg(F.count(F.lit(1)).alias("spans"))


@query
def truncation_flags(spark, sf_dir):
    return _documents(spark, sf_dir).select("seq", normalize.truncated(F.col("body")).alias("truncated"))


@query
def record_mapping(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    record = F.when(F.pmod("turn", F.lit(3)) == 0, F.to_json(F.struct(F.col("role").alias("from"), F.col("text").alias("message"), F.col("conv_id").cast("string").alias("timestamp"))))
    record = record.when(F.pmod("turn", F.lit(3)) == 1, F.to_json(F.struct(F.col("role").alias("sender"), F.col("text"), F.lit("x").alias("date")))).otherwise(F.to_json(F.struct(F.col("role").alias("address"), F.col("text").alias("body"), F.col("conv_id").alias("dateMillis"))))
    rows = load.mapped(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), record.alias("record")))
    return rows.select("seq", "address", "body", "date_ms", "malformed", "empty")


@query
def empty_body_filter(spark, sf_dir):
    raw = M.raw_messages(spark, sf_dir)
    return raw.agg(F.count(F.lit(1)).alias("total"), F.count_if(trimmed(F.col("body")) == "").alias("empty_bodies"))


@query
def sender_filter(spark, sf_dir):
    return load.only_senders(M.messages(spark, sf_dir), ["alpha", "BETA"]).groupBy("address").agg(F.count(F.lit(1)).alias("messages"))


@query
def content_rows(spark, sf_dir):
    m = M.messages(spark, sf_dir)
    text = F.concat(F.lit("Row: "), F.col("seq").cast("string"), F.lit(" address="), F.coalesce("address", F.lit("null")), F.lit(", date="), F.col("date_ms").cast("string"), F.lit(", body="), "body")
    rows = load.content_rows(m.select(F.col("seq").alias("key"), text.alias("text")))
    return rows.groupBy("address").agg(F.count(F.lit(1)).alias("messages"), F.sum("date_ms").alias("date_sum"), F.sum(F.length("body")).alias("body_chars"))


@query
def sender_resolution(spark, sf_dir):
    m = M.messages(spark, sf_dir)
    return m.select("address", sender_bank(F.col("address"), M.catalog(spark).banks).alias("bank_id")).groupBy("address", "bank_id").agg(F.count(F.lit(1)).alias("messages"))


@query
def candidate_scope(spark, sf_dir):
    cat = M.catalog(spark)
    m = M.messages(spark, sf_dir).select("seq", sender_bank(F.col("address"), cat.banks).alias("b"))
    sizes = {b.id: sum(p.bank_id == b.id for p in cat.patterns) for b in cat.banks}
    n = F
    for b, k in sizes.items():
        if k:
            n = n.when(F.col("b") == b, F.lit(k))
    return m.select("seq", n.otherwise(F.lit(len(cat.patterns))).cast("long").alias("candidates"))


@query
def pattern_match(spark, sf_dir):
    return M.parsed(spark, sf_dir).select("seq", "matched", "bank_id", "bank_name", "tx_type", "pattern_desc", "pattern_ord")


@query
def field_extraction(spark, sf_dir):
    return M.parsed(spark, sf_dir).where("matched").select("seq", *(F.col(f"extraction.{c}") for c in FLAG_COLUMNS))


@query
def accept_gate(spark, sf_dir):
    return M.parsed(spark, sf_dir).where("matched").groupBy("pattern_ord", F.col("extraction.reason").alias("reason")).agg(F.count(F.lit(1)).alias("messages"))


@query
def transaction_heuristic(spark, sf_dir):
    both = M.messages(spark, sf_dir).select(F.lit("message").alias("kind"), "seq", "body").union(_documents(spark, sf_dir).select(F.lit("document").alias("kind"), "seq", "body"))
    return both.select("kind", "seq", heuristic.looks_like_transaction(F.col("body")).alias("transactional"))


@query
def coverage_overall(spark, sf_dir):
    return coverage.overall(M.parsed(spark, sf_dir))


@query
def coverage_by_bank(spark, sf_dir):
    return coverage.worst_first(coverage.by_bank(M.parsed(spark, sf_dir)))


#: What clusters are made of, and what the health of families takes besides.
CLUSTERED = ("seq", "body", "matched", "bank_id", "bank_name", "template", "degraded")
JUDGED = (*CLUSTERED, "pattern_desc", "extraction")


def _rows(spark, sf_dir, columns=CLUSTERED):
    return M.kept(M.parsed_templates(spark, sf_dir).select(*columns))


def _clustered(rows):
    return M.kept(coverage.with_stream(cluster.clusters(rows)))


def _clusters(spark, sf_dir):
    return _clustered(_rows(spark, sf_dir))


@query
def largest_missing(spark, sf_dir):
    return coverage.largest_missing(cluster.clusters(_rows(spark, sf_dir)))


@query
def dataset_stats_type(spark, sf_dir):
    return coverage.messages_by_type(M.parsed(spark, sf_dir))


@query
def dataset_stats_bank(spark, sf_dir):
    return coverage.messages_by_bank(M.parsed(spark, sf_dir))


@query
def candidate_vs_noise(spark, sf_dir):
    return _clusters(spark, sf_dir).select("stream", "template", "occurrences", "bank_id")


@query
def top_gaps(spark, sf_dir):
    """The report's list: the 25 highest of the clusters that no pattern matches."""
    c = _clusters(spark, sf_dir).where("not matched")
    return c.select("template", "occurrences", "priority", "stream").orderBy(F.col("priority_rank").desc(), F.col("occurrences").desc(), "template").limit(25)


@query
def verb_annotation(spark, sf_dir):
    t = M.templates(spark, sf_dir).select("template").distinct()
    return t.select("template", lexicon.annotation(F.col("template")).alias("a")).select("template", "a.verb", "a.direction")


def _families(spark, sf_dir, grouper=families.by_verb):
    return families.families(grouper(_clusters(spark, sf_dir)), "stream")


@query
def families_verb(spark, sf_dir):
    return _families(spark, sf_dir).select("stream", "template", "bank_id", "verb", "direction", "label", "member_count", "total", "priority", F.size("variants").cast("long").alias("n_variants"), F.array_join("variants", " ¶ ").alias("variants"), F.array_join("examples", " ¶ ").alias("examples"))


@query
def families_identity(spark, sf_dir):
    return _families(spark, sf_dir, families.identity).select("stream", "template", "bank_id", "member_count", "total", "priority", "readiness")


@query
def similar_template_pairs(spark, sf_dir):
    return families.similar_pairs(M.kept(_clusters(spark, sf_dir).select("bank_id", "template").distinct()), 0.4)


@query
def families_levenshtein(spark, sf_dir):
    return _families(spark, sf_dir, lambda c: families.by_distance(c, 0.6)).select("stream", "template", "bank_id", "member_count", "total")


def _success(rows, clusters):
    """Success families by verb, with their counts of health and the pattern behind most of them."""
    members = M.kept(families.by_verb(clusters.where("matched")))
    f = families.families(members)
    own = members.select("template", "family")
    counts = health.merged(cluster.health_counts(rows).join(own, "template"), "family")
    top = cluster.top_description(rows, own, "family")
    return f.join(counts, "family").join(top, "family", "left")


def _success_of(spark, sf_dir):
    rows = _rows(spark, sf_dir, JUDGED)
    return _success(rows, _clustered(rows))


@query
def health_rates(spark, sf_dir):
    h = health.with_rates(cluster.health_counts(M.parsed_templates(spark, sf_dir)))
    return h.select("template", "members", *(f"{c}_rate" for c in health.COUNTS[1:]))


@query
def health_score(spark, sf_dir):
    f = health.best_first(health.with_rates(_success_of(spark, sf_dir)))
    return f.select("template", "bank_id", "members", "pattern_desc", "health_score", "app_accepted")


@query
def reconciliation(spark, sf_dir):
    return health.reconciliation(_success_of(spark, sf_dir))


def _spans(spark, sf_dir):
    """The first values of each template's fields: they are few, and a shape reads them several times."""
    return M.kept(cluster.span_values(M.templates(spark, sf_dir, spans=True)))


@query
def field_shape_quantifiers(spark, sf_dir):
    v = _spans(spark, sf_dir).groupBy("template", "field").agg(F.min(F.length("value")).alias("low"), F.max(F.length("value")).alias("high"))
    return v.select("template", "field", shapes.quantifier(F.col("low"), F.col("high")).alias("quantifier"))


@query
def field_shapes(spark, sf_dir):
    return shapes.field_shapes(_spans(spark, sf_dir), "template")


def _merged(spark, sf_dir):
    docs, m = _documents(spark, sf_dir), M.messages(spark, sf_dir)
    return corpus.union(("documents", docs), ("messages", m), ("again", m))


@query
def corpus_dedup(spark, sf_dir):
    return corpus.deduplicated(_merged(spark, sf_dir)).select("source", "seq", "address")


@query
def corpus_counts(spark, sf_dir):
    return corpus.merge_counts(_merged(spark, sf_dir))


@query
def corpus_sources(spark, sf_dir):
    return corpus.source_counts(_merged(spark, sf_dir))


@query
def dataset_id(spark, sf_dir):
    return corpus.fingerprint(_merged(spark, sf_dir), "address", "body").withColumnRenamed("id", "dataset_id")


def _current(spark):
    return catalogs.as_table(spark, M.catalog(spark).patterns)


@query
def baseline_signature(spark, sf_dir):
    return baseline.signature(_current(spark)).withColumnRenamed("id", "signature")


def newer(current: DataFrame) -> DataFrame:
    """The catalog's next version: one pattern gone, one changed, one new."""
    changed = current.where("pattern_ord <> 4").withColumn("regex", F.when(F.col("pattern_ord") == 5, F.concat("regex", F.lit(" [0-9]"))).otherwise(F.col("regex")))
    new = current.where("pattern_ord = 0").withColumns({"description": F.lit("Alpha new"), "pattern_ord": F.lit(99)})
    return changed.unionByName(new)


@query
def baseline_diff(spark, sf_dir):
    d = baseline.difference(_current(spark), newer(_current(spark)))
    return d.select("kind", "bank_id", "description", F.array_join("old", " ¶ ").alias("old"), F.array_join("new", " ¶ ").alias("new"))


@query
def patterns_per_bank(spark, sf_dir):
    return baseline.per_bank(_current(spark)).orderBy(F.col("patterns").desc(), "bank_id")


@query
def ledger_delta(spark, sf_dir):
    """A log made of the days of orders: its signature changes with the number of statuses."""
    o = _table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.countDistinct("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("pattern_count"))
    log = o.select((F.year("m") * 12 + F.month("m")).cast("long").alias("idx"), F.concat(F.lit("s"), F.floor(F.col("pattern_count") / 20).cast("string")).alias("signature"), "pattern_count")
    return baseline.ledger_delta(log)


def words() -> list[str]:
    """Words that a lexicon of this trade should know, and some that it shouldn't."""
    return (M.FIXTURES / "words.txt").read_text().split()


@query
def lexicon_sync(spark, sf_dir):
    table = spark.createDataFrame([(w,) for w in words()], "word string")
    forms = spark.createDataFrame([(f,) for _, _, f in lexicon.lexicon()], "word string")
    return table.join(forms, "word", "left_anti")


@query
def catalog_table(spark, sf_dir):
    return _current(spark).select("pattern_ord", "bank_id", "type", "description", "regex")


@query
def application_patterns(spark, sf_dir):
    """The catalog as an application keeps it: all text, in any order, with rows of no bank."""
    t = _current(spark).select(F.col("pattern_ord").alias("id"), F.col("bank_id").cast("string").alias("bankId"), F.col("sender_id").alias("senderId"), "regex", "type", "description")
    extra = t.where("id = 0").withColumns({"id": F.lit(-1), "bankId": F.lit("x")})
    return load.application_patterns(t.orderBy(F.rand(1)).union(extra)).select("pattern_ord", "bank_id", "sender_id", "type", "description")


@query
def rule_drift(spark, sf_dir):
    """Which of the engine's rules differ from those a catalog was made with."""
    now = baseline.own_rules()
    then = {k: v for k, v in now.items() if k != "party"} | {"flags": "0"}
    return spark.createDataFrame([(k,) for k in baseline.drifted(now, then)], "rule string")


@query
def json_containers(spark, sf_dir):
    """A JSON text for each conversation: a list, an object with a list under either of two names, or a record per line."""
    c = _table(spark, sf_dir, "conversations")
    record = F.struct(F.col("role").alias("sender"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp"))
    docs = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", record.alias("r")))), lambda x: x["r"]).alias("rs"))
    kind, rs = F.pmod("conv_id", F.lit(4)), F.col("rs")
    text = F.when(kind == 0, F.to_json("rs")).when(kind == 1, F.to_json(F.struct(rs.alias("messages")))).when(kind == 2, F.to_json(F.struct(F.lit(7).alias("data"), rs.alias("items")))).otherwise(F.array_join(F.transform(rs, lambda r: F.to_json(r)), "\n"))
    records = load.records_of(docs.select("conv_id", text.alias("value")), key="conv_id")
    return load.mapped(records.select((F.col("conv_id") * 1000 + F.col("seq")).alias("seq"), "record")).select("seq", "address", "body", "date_ms", "malformed")


@query
def chat_ingest(spark, sf_dir):
    """Messages pasted from a chat, a hundred chats of them."""
    m = M.messages(spark, sf_dir).where(F.startswith("body", F.lit("Dear ")))
    line = F.concat(F.lit("[1/2/24, 10:00] Ann: "), F.col("body"))
    chats = m.groupBy(F.pmod("seq", F.lit(100)).alias("chat")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return load.chat_messages(chats, "Dear", "ALPHA").groupBy("seq", "address").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("body")).alias("body_chars"))


@query
def export_coverage_map(spark, sf_dir):
    return coverage.by_bank(M.parsed(spark, sf_dir)).select("bank_name", F.round("coverage_pct", 2).alias("percent"))


#: A rule that no engine takes: what is normalized with it is degraded.
BROKEN = normalize.Rule("CODE", "(", "(", "<CODE>", "<CODE>", "(", 1)


@query
def export_units_degraded(spark, sf_dir):
    """Units of messages of which a rule failed keep their counts and lose their content."""
    rows = M.kept(normalize.with_template(M.parsed(spark, sf_dir), "body", rules=(*normalize.RULES, BROKEN)).select(*CLUSTERED))
    c = coverage.with_stream(cluster.clusters(rows))
    return export.unmatched_units(families.families(families.by_verb(c), "stream")).drop("stream")


@query
def export_units_unmatched(spark, sf_dir):
    return export.unmatched_units(_families(spark, sf_dir)).drop("stream")


@query
def export_units_success(spark, sf_dir):
    return export.success_units(_success_of(spark, sf_dir))


@query
def export_metadata(spark, sf_dir):
    return export.message_totals(coverage.overall(M.parsed(spark, sf_dir)))


@query
def quality_rollup(spark, sf_dir):
    rows = _rows(spark, sf_dir, (*JUDGED, "parse_error"))
    c = _clustered(rows)
    unmatched = export.unmatched_units(families.families(families.by_verb(c), "stream"))
    units = unmatched.select("normalized_text", "degraded").union(export.success_units(_success(rows, c)).select("normalized_text", "degraded"))
    found = shapes.field_shapes(_spans(spark, sf_dir), "template")
    return coverage.quality(M.raw_messages(spark, sf_dir), rows, units, found, M.catalog(spark).invalid)


@query
def quality_rollup_documents(spark, sf_dir):
    """Documents taken as messages, some null, blank or long, normalized with a rule that fails."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("address"), F.when(F.pmod("doc_id", F.lit(97)) != 5, F.col("text")).alias("body"))
    rows = parse(spread(d, "seq"), M.catalog(spark))
    return coverage.quality(d, normalize.with_template(rows, "body", rules=(*normalize.RULES, BROKEN)))


def _varied(spark, sf_dir):
    """Clusters of the varied messages under the large catalog."""
    rows = normalize.with_template(parse(M.varied(spark, sf_dir), M.large_catalog(spark)), "body")
    return _clustered(M.kept(rows.select(*CLUSTERED)))


@query
def varied_pattern_match(spark, sf_dir):
    rows = parse(M.varied(spark, sf_dir), M.large_catalog(spark))
    return rows.groupBy("pattern_ord", "bank_id", "tx_type").agg(F.count(F.lit(1)).alias("messages"), F.count_if("extraction.accepted").alias("accepted"))


@query
def varied_clusters(spark, sf_dir):
    return _varied(spark, sf_dir).select("stream", "template", "bank_id", "occurrences", "priority", "verb", "direction")


@query
def varied_examples(spark, sf_dir):
    return _varied(spark, sf_dir).select("matched", "template", F.array_join("examples", " ¶ ").alias("examples"))


@query
def varied_families_verb(spark, sf_dir):
    f = families.families(families.by_verb(_varied(spark, sf_dir)), "stream")
    return f.select("stream", "template", "bank_id", "verb", "member_count", "total", F.array_join("variants", " ¶ ").alias("variants"), F.array_join("examples", " ¶ ").alias("examples"))


@query
def varied_families_levenshtein(spark, sf_dir):
    f = families.families(families.by_distance(_varied(spark, sf_dir), 0.85), "stream")
    return f.select("stream", "template", "bank_id", "member_count", "total")


@query
def varied_similar_pairs(spark, sf_dir):
    return families.similar_pairs(_varied(spark, sf_dir).select("bank_id", "template"), 0.92)


@query
def varied_largest_missing(spark, sf_dir):
    return coverage.largest_missing(_varied(spark, sf_dir))
