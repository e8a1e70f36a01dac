"""python -m sievemill COMMAND: the analyses from a shell."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sievemill.operators import baseline, corpus
from sievemill.plans import report as R
from sievemill.sources import catalog as catalogs
from sievemill.sources import load


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievemill")
    p.add_argument("command", choices=("analyze", "report", "stats", "templates", "discover", "baseline", "diff", "history", "corpus", "export", "pull", "devices", "version"))
    p.add_argument("inputs", nargs="*")
    p.add_argument("--banks")
    p.add_argument("--patterns")
    p.add_argument("--against", help="patterns to compare with")
    p.add_argument("--sender", action="append", help="only these senders")
    p.add_argument("--group", default="identity")
    p.add_argument("--similarity", type=float)
    p.add_argument("--top", type=int, default=R.TOP)
    p.add_argument("--no-filter", action="store_true")
    p.add_argument("--min-coverage", type=float)
    p.add_argument("--html", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--preview", action="store_true")
    p.add_argument("--record", metavar="LEDGER")
    p.add_argument("--out")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = arguments().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 64
    if a.command == "version":
        print("sievemill 1")
        return 0
    if a.command == "devices":
        print("\n".join(load.device_ids(Path(a.inputs[0]).read_text())))
        return 0
    if a.command == "history":
        for e in baseline.Ledger.load(a.inputs[0]).entries:
            print(e["signature"], e.get("recordedAt", ""), e.get("patternCount", ""))
        return 0
    spark = spark or SparkSession.builder.appName("sievemill").getOrCreate()

    def say(text: str) -> None:
        Path(a.out).write_text(text) if a.out else print(text, end="")

    try:
        if a.command == "pull":
            rows = load.content_rows(spark.read.text(a.inputs[0], wholetext=True), "value")
            load.only_senders(rows, a.sender).write.json(a.out or "messages.json")
            return 0
        files = catalogs.locate(a.banks, a.patterns)
        if a.command in ("baseline", "diff"):
            own = catalogs.as_table(spark, catalogs.read_patterns(files[1]))
            sign = baseline.signature(own).first()["id"]
            if a.command == "diff":
                found = [r.asDict() for r in baseline.difference(own, catalogs.as_table(spark, catalogs.read_patterns(a.against))).orderBy("bank_id", "description").collect()]
                say(json.dumps(found, indent=2, ensure_ascii=False) + "\n")
                return 3 if found else 0
            if a.record:
                ledger = baseline.Ledger.load(a.record)
                ledger.record({"signature": sign, "patternCount": own.count(), "patternsPerBank": {str(r["bank_id"]): r["patterns"] for r in baseline.per_bank(own).collect()}})
                ledger.save(a.record)
            say(sign + "\n")
            return 0
        loaded = [load.load_json(spark, p) for p in a.inputs]
        if not loaded:
            return 64
        all_ = corpus.union(*((p, x.messages.drop("source")) for p, x in zip(a.inputs, loaded)))
        if a.command == "corpus":
            unique = corpus.deduplicated(all_)
            unique.select("address", "body", "date_ms", "source").write.mode("overwrite").json(a.out or "corpus.json")
            print(json.dumps({**corpus.merge_counts(all_).first().asDict(), "dataset_id": corpus.fingerprint(all_, "address", "body").first()["id"]}))
            return 0
        messages = load.only_senders(all_.drop("source", "source_ord"), None if a.command == "discover" else a.sender)
        cat = catalogs.load(spark, *files)
        if a.command == "export":
            meta = {"baselineSignature": baseline.signature(catalogs.as_table(spark, cat.patterns)).first()["id"], "datasetId": corpus.fingerprint(messages, "address", "body").first()["id"]}
            doc = R.export_document(messages, cat, meta, a.group)
            say(R.preview(doc) if a.preview else json.dumps(doc, indent=2, ensure_ascii=False) + "\n")
            return 0
        r = R.analyze(messages, cat, a.group, a.similarity, a.top, a.no_filter)
        if a.command == "stats":
            say(json.dumps({**r.overall, "byType": r.by_type, "byBank": r.by_bank}, indent=2) + "\n")
        elif a.command == "templates" or a.json:
            say(json.dumps(r.candidates + r.gaps, indent=2, ensure_ascii=False) + "\n")
        else:
            say(R.html(r) if a.html else R.markdown(r))
        return R.gate(r, a.min_coverage)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
