"""Catalogs of banks and patterns in JSON files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sievemill.operators.match import Bank, Catalog, Pattern

FILES = ("banks.json", "patterns.json")
PATTERN_SCHEMA = "pattern_ord int, bank_id int, sender_id string, regex string, type string, description string"
LEVELS = 6


def _rows(path: Path, key: str) -> list[dict]:
    doc = json.loads(path.read_text())
    found = doc.get(key) or [] if isinstance(doc, dict) else doc
    return [r for r in found if isinstance(r, dict)]


def _int(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def read_banks(path: str) -> list[Bank]:
    """Banks of a list or of an object's `banks`; what has no integer id is skipped."""
    return [Bank(r["id"], str(r.get("name", "")), r.get("shortName"), tuple(map(str, r.get("codes") or ())), r.get("maskPattern"), r.get("uniformMasking")) for r in _rows(Path(path), "banks") if _int(r.get("id"))]


def read_patterns(path: str) -> list[Pattern]:
    """Patterns of a list or of an object's `patterns`; what has no integer bank id is skipped."""
    return [Pattern(r["bankId"], str(r.get("regex", "")), str(r.get("type", "")), str(r.get("description", "")), r.get("senderId"), r.get("refRequired"), r.get("hasAccount"), r.get("hasFees")) for r in _rows(Path(path), "patterns") if _int(r.get("bankId"))]


def locate(banks: str | None = None, patterns: str | None = None, vendored: str | None = None, start: str = ".") -> tuple[str, str]:
    """Paths of the catalog: those given, else a vendored folder, else the nearest folder above with both files."""
    if (banks is None) != (patterns is None):
        raise ValueError("give both files of a catalog or none")
    if banks is not None and patterns is not None:
        return banks, patterns
    at = Path(start).resolve()
    for folder in ([Path(vendored)] if vendored else []) + [at, *at.parents][: LEVELS + 1]:
        if all((folder / f).exists() for f in FILES):
            return tuple(str(folder / f) for f in FILES)
    raise FileNotFoundError(f"no folder with {' and '.join(FILES)} from {at} upwards")


def load(spark: SparkSession, banks: str, patterns: str) -> Catalog:
    return Catalog.build(spark, read_banks(banks), read_patterns(patterns))


def as_table(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    return spark.createDataFrame([(i, p.bank_id, p.sender_id, p.regex, p.type, p.description) for i, p in enumerate(patterns)], PATTERN_SCHEMA)
