"""Loading messages from JSON in its many forms, and from captured text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.functions.regexes import some, squeezed, trimmed

CONTAINERS = ("messages", "sms", "data", "items")
BODY, ADDRESS, DATE = ("body", "message", "text"), ("address", "sender", "from"), ("date", "dateMillis", "timestamp")


@dataclass
class Loaded:
    """Messages (seq, address, body, date_ms, source) and one row of what was skipped."""

    messages: DataFrame
    skipped: DataFrame


def _field(record: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_variant_get(record, f"$.{n}", "string") for n in names))


def mapped(records: DataFrame) -> DataFrame:
    """(seq, record: a JSON text or null) as messages, with a flag for malformed and for empty ones."""
    v = F.try_parse_json(F.col("record"))
    is_map = F.schema_of_variant(v).startswith("OBJECT")
    out = records.withColumn("v", v).withColumn("ok", F.coalesce(is_map, F.lit(False)))
    out = out.select("seq", "ok", _field(F.col("v"), ADDRESS).alias("address"), F.coalesce(_field(F.col("v"), BODY), F.lit("")).alias("body"), _field(F.col("v"), DATE).try_cast("long").alias("date_ms"))
    return out.withColumns({"malformed": ~F.col("ok"), "empty": F.col("ok") & (trimmed(F.col("body")) == "")}).drop("ok")


def _split(rows: DataFrame, source: str) -> Loaded:
    kept = rows.where("not malformed and not empty").select("seq", "address", "body", "date_ms", F.lit(source).alias("source"))
    return Loaded(kept, rows.agg(F.count_if("malformed").alias("dataset_malformed"), F.count_if("empty").alias("dataset_empty_bodies")))


def records_of(docs: DataFrame, text: str = "value", key: str | None = None) -> DataFrame:
    """(key, seq, record) of JSON texts, each a list of records, an object with a list of them, or a record per line."""
    doc = docs.withColumn("v", F.try_parse_json(text))
    lists = [F.try_variant_get("v", "$", "array<variant>"), *(F.try_variant_get("v", f"$.{c}", "array<variant>") for c in CONTAINERS)]
    doc = doc.withColumn("list", F.coalesce(*lists))
    own = [key] * bool(key)
    whole = doc.where("list is not null").select(*own, F.posexplode("list").alias("seq", "r")).select(*own, "seq", F.to_json("r").alias("record"))
    lines = doc.where("list is null").select(*own, F.posexplode(F.split(text, "\r?\n")).alias("seq", "record")).where(trimmed(F.col("record")) != "")
    return whole.union(lines).withColumn("seq", F.col("seq").cast("long"))


def is_document(spark: SparkSession, path: str) -> bool:
    """Whether the file is one JSON value: its first characters open one, and its first line doesn't close it as a record of lines does.

    Only the beginning is read."""
    head = spark.read.format("text").load(path).where(trimmed(F.col("value")) != "").select(trimmed(F.col("value")).alias("v"))
    first = head.select("v", F.try_parse_json("v").isNotNull().alias("whole"), F.schema_of_variant(F.try_parse_json("v")).alias("kind"), *(F.try_variant_get(F.try_parse_json("v"), f"$.{c}", "array<variant>").isNotNull().alias(c) for c in CONTAINERS)).first()
    if first is None or not first.v.startswith(("{", "[")):
        return False
    return not first.whole or first.kind.startswith("ARRAY") or any(first[c] for c in CONTAINERS)


def load_json(spark: SparkSession, path: str, source: str | None = None) -> Loaded:
    """A JSON array of records, an object with a list of them, or a record per line; what fits none is skipped and counted.

    Lines are read in parallel, whatever the size of the files. A document is one value and read whole, as its format demands."""
    if not is_document(spark, path):
        return load_lines(spark, path, source)
    return _split(mapped(records_of(spark.read.text(path, wholetext=True))), source or path)


def load_lines(spark: SparkSession, path: str, source: str | None = None) -> Loaded:
    """A record per line of any number of files, read in parallel; seq grows with file and place."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("record")).where(trimmed(F.col("record")) != "")
    return _split(mapped(lines), source or path)


def only_senders(messages: DataFrame, senders: list[str] | None) -> DataFrame:
    """Messages whose address is one of the senders, whatever the case; all without senders."""
    return messages.where(F.lower("address").isin([s.lower() for s in senders])) if senders else messages


def content_rows(dump: DataFrame, text: str = "text") -> DataFrame:
    """(seq, address, body, date_ms) from the output of a device's content query.

    The body is all after the row's last `body=`; an address of `null` is none; rows without a body go."""
    rows = dump.select(F.posexplode(F.split(F.col(text), r"Row:\s*\d+\s")).alias("seq", "row"))
    until = r"(?s)(?:^|[\s,]){}=(.*?)(?:,\s[a-z_]+=|$)"
    address = some(trimmed(F.regexp_extract("row", until.format("address"), 1)))
    out = rows.where(F.contains("row", F.lit("body="))).select(
        F.col("seq").cast("long").alias("seq"),
        F.when(address != "null", address).alias("address"),
        trimmed(F.substring_index("row", "body=", -1)).alias("body"),
        F.regexp_extract("row", until.format("date"), 1).try_cast("long").alias("date_ms"),
    )
    return out.where("body <> ''")


def device_ids(listing: str) -> list[str]:
    """Ids of the devices that a listing says are ready."""
    return [line.split()[0] for line in listing.splitlines()[1:] if line.strip().endswith("device") and len(line.split()) > 1]


def chat_messages(blobs: DataFrame, start: str, address: str, text: str = "text") -> DataFrame:
    """(seq, address, body): messages that begin with the word `start` in text copied from a chat.

    Marks such as `[1/2/24, 10:00] name:` go, white space is settled, other text before a first start goes."""
    flat = squeezed(F.regexp_replace(F.col(text), r"\[\d{1,2}/\d{1,2}/\d{2,4}[^\]]*\][^:]*:", " "))
    parts = blobs.select(F.posexplode(F.split(flat, rf"(?={start}\b)")).alias("seq", "body")).withColumn("body", F.trim("body"))
    return parts.where(F.startswith("body", F.lit(start))).select(F.col("seq").cast("long").alias("seq"), F.lit(address).alias("address"), "body")


def failed_parses(rows: DataFrame) -> DataFrame:
    """An application's table of failed parses, read through any source, as messages."""
    out = rows.select(F.col("address").cast("string").alias("address"), F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"), F.col("date").try_cast("long").alias("date_ms"))
    return out.where(trimmed(F.col("body")) != "")


def application_patterns(rows: DataFrame) -> DataFrame:
    """An application's table of live patterns, read through any source, as a catalog's table; rows without a bank go.

    Patterns keep the table's order: by id, if there is one, else by bank, description and expression."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = [F.col("id")] if "id" in rows.columns else ["bank_id", "description", "regex"]
    out = rows.select(*[F.col(c) for c in rows.columns if c == "id"], F.col("bankId").try_cast("int").alias("bank_id"), F.col("senderId").cast("string").alias("sender_id"), text("regex").alias("regex"), text("type").alias("type"), text("description").alias("description")).where("bank_id is not null")
    ranked = out.withColumn("pattern_ord", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))  # a catalog, not a corpus
    return ranked.select("pattern_ord", "bank_id", "sender_id", "regex", "type", "description")
