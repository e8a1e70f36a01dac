"""Versions of a catalog: signature, difference, ledger, and drift of the engine's own rules."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.corpus import fingerprint

VERSION = 1


def signature(patterns: DataFrame) -> DataFrame:
    """(id) of the catalog; any change of a pattern changes it, order doesn't."""
    return fingerprint(patterns, "bank_id", "sender_id", "regex", "type", "description")


def per_bank(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("bank_id").agg(F.count(F.lit(1)).alias("patterns"))


def difference(current: DataFrame, source: DataFrame) -> DataFrame:
    """(kind, bank_id, description, old, new): patterns added to, removed from or changed in the source.

    Patterns are the same by bank and description; changed ones list the expressions that go and come, in order."""
    key = ["bank_id", "description"]
    side = lambda df, name: df.groupBy(*key).agg(F.sort_array(F.collect_set("regex")).alias(name))
    both = side(current, "cur").join(side(source, "src"), key, "full_outer")
    none = F.array().cast("array<string>")
    kind = F.when(F.col("cur").isNull(), "added").when(F.col("src").isNull(), "removed").otherwise("changed")
    old, new = F.array_except(F.coalesce("cur", none), F.coalesce("src", none)), F.array_except(F.coalesce("src", none), F.coalesce("cur", none))
    return both.select(kind.alias("kind"), *key, F.sort_array(old).alias("old"), F.sort_array(new).alias("new")).where("size(old) + size(new) > 0")


def ledger_delta(log: DataFrame) -> DataFrame:
    """The entries of a log (idx, signature, pattern_count) that a ledger keeps, each with its change in patterns."""
    w = Window.orderBy("idx")
    kept = log.withColumn("before", F.lag("signature").over(w)).where("before is null or before <> signature").drop("before")
    return kept.withColumn("delta", F.col("pattern_count") - F.lag("pattern_count").over(w))


class Ledger:
    """An append-only JSON file of catalog versions."""

    def __init__(self, entries: list[dict] | None = None):
        self.entries = list(entries or [])

    @classmethod
    def load(cls, path: str) -> "Ledger":
        p = Path(path)
        text = p.read_text().strip() if p.exists() else ""
        if not text:
            return cls()
        found = json.loads(text)
        found = found.get("entries") or [] if isinstance(found, dict) else found
        return cls([e for e in found if isinstance(e, dict)])

    @property
    def head(self) -> str | None:
        return self.entries[-1]["signature"] if self.entries else None

    def record(self, entry: dict) -> bool:
        """Append unless the newest entry has the same signature."""
        if entry["signature"] == self.head:
            return False
        self.entries.append(entry)
        return True

    def save(self, path: str) -> None:
        doc = {"version": VERSION, "current": self.head, "count": len(self.entries), "entries": self.entries}
        Path(path).write_text(json.dumps(doc, indent=2, ensure_ascii=False) + "\n")


MISSING = "MISSING"


def braces(source: str, anchor: str) -> str | None:
    """The text from the first brace after the anchor to the one that closes it; null if there is none."""
    at = source.find(anchor)
    start = source.find("{", at) if at >= 0 else -1
    depth = 0
    for i in range(start, len(source)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(source[i], 0)
        if not depth:
            return source[start : i + 1]
    return None


def _hash(text: str) -> str:
    return hashlib.sha256(" ".join(text.split()).encode()).hexdigest()[:16]


def probe(folder: str, probes: dict[str, tuple[str, str]]) -> tuple[str, dict[str, str]] | None:
    """Signature and hash of each probe (name: file, anchor) of a source folder; null if it has none of the files."""
    sources = {f: p.read_text() for f, _ in probes.values() if (p := Path(folder, f)).exists()}
    if not sources:
        return None
    hashes = {}
    for name, (file, anchor) in probes.items():
        snippet = braces(sources[file], anchor) if file in sources else None
        hashes[name] = MISSING if snippet is None else _hash(snippet)
    return _hash(" ".join(sorted(f"{k}={v}" for k, v in hashes.items()))), hashes


def own_rules() -> dict[str, str]:
    """Hashes of this engine's rules, to be kept beside a catalog."""
    from sievemill.functions import heuristic, lexicon, normalize
    from sievemill.operators import match

    parts = {"normalizer": repr(normalize.RULES), "heuristic": repr((heuristic.ACTIONS, heuristic.SUPPORT, heuristic.MONEY)), "lexicon": repr(lexicon.lexicon()), "flags": match.FLAGS, "party": repr(match.PARTY_SEARCHES)}
    return {k: _hash(v) for k, v in parts.items()}


def drifted(now: dict[str, str], then: dict[str, str]) -> list[str]:
    return sorted(k for k, v in now.items() if then.get(k) != v)
