"""Reports of small results: Markdown, a page of HTML, figures, a preview of what would be shared."""

from __future__ import annotations

from dataclasses import dataclass, field
from html import escape
from math import pi

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions.normalize import with_spans, with_template
from sievemill.operators import cluster, coverage, export, families, health, shapes
from sievemill.operators.match import Catalog, parse

TOP = 25
COLORS = {"Very High": "#b3261e", "High": "#d9622b", "Medium": "#c9a227", "Low": "#5f8a4f", "Very Low": "#8a8f98"}


@dataclass
class Report:
    """The collected heads of an analysis; only these leave the cluster."""

    overall: dict
    banks: list[dict]
    missing: dict[int, dict]
    gaps: list[dict]
    candidates: list[dict]
    noise: int
    success: list[dict] = field(default_factory=list)
    by_type: dict[str, int] = field(default_factory=dict)
    by_bank: dict[str, int] = field(default_factory=dict)
    n_gaps: int = 0
    n_candidates: int = 0
    n_templates: int = 0


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def grouped(clusters: DataFrame, grouping: str = "identity", similarity: float | None = None) -> DataFrame:
    """clusters with families; an unknown grouping is identity."""
    if grouping in ("levenshtein", "lev"):
        return families.by_distance(clusters, similarity or families.SIMILARITY)
    if grouping in ("verb", "semantic") and similarity is not None:
        return families.by_distance(clusters, similarity, within_verbs=True)
    return families.GROUPERS.get(grouping, families.identity)(clusters)


def analyze(messages: DataFrame, catalog: Catalog, grouping: str = "identity", similarity: float | None = None, top: int = TOP, with_noise: bool = False) -> Report:
    """Run everything a report shows and collect its head."""
    rows = with_template(parse(messages, catalog), "body").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        c = coverage.with_stream(cluster.clusters(rows)).persist(StorageLevel.MEMORY_AND_DISK)
        f = families.families(grouped(c, grouping, similarity), "stream").persist(StorageLevel.MEMORY_AND_DISK)
        ranked = lambda streams: f.where(F.col("stream").isin(streams)).orderBy(F.col("priority_rank").desc(), F.col("total").desc(), "template")
        unknown = ["candidate", "noise"] if with_noise else ["candidate"]
        per = {r["stream"]: r["n"] for r in _rows(f.groupBy("stream").agg(F.count(F.lit(1)).alias("n")))}
        out = Report(
            overall=_rows(coverage.overall(rows))[0],
            banks=_rows(coverage.worst_first(coverage.by_bank(rows))),
            missing={r["bank_id"]: r for r in _rows(coverage.largest_missing(c))},
            gaps=_rows(ranked(["attributed"]).limit(top)),
            candidates=_rows(ranked(unknown).limit(top)),
            noise=c.where("stream = 'noise'").count(),
            by_type={r["tx_type"]: r["messages"] for r in _rows(coverage.messages_by_type(rows))},
            by_bank={r["bank_name"]: r["messages"] for r in _rows(coverage.messages_by_bank(rows))},
            n_gaps=per.get("attributed", 0),
            n_candidates=sum(per.get(s, 0) for s in unknown),
            n_templates=c.where("not matched").count(),
        )
        c.unpersist(), f.unpersist()
        return out
    finally:
        rows.unpersist()


def export_document(messages: DataFrame, catalog: Catalog, metadata: dict, grouping: str = "identity") -> dict:
    """The export document; its units are as many as there are families."""
    rows = with_spans(parse(messages, catalog), "body").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        c = coverage.with_stream(cluster.clusters(rows))
        members = grouped(c, grouping).persist(StorageLevel.MEMORY_AND_DISK)
        key = ["stream", "family"]
        own = members.select("matched", "template", *key)
        spans = cluster.span_values(rows, "matched").join(own, ["matched", "template"])
        f = families.families(members, "stream").join(export.shape_maps(shapes.field_shapes(spans, *key), *key), key, "left")
        counts = health.merged(cluster.health_counts(rows).join(own.where("matched"), "template"), *key)
        top = cluster.top_description(rows, own.where("matched").select("template", "family"), "family")
        success = f.where("stream = 'success'").join(counts, key).join(top, "family", "left")
        overall = _rows(export.message_totals(coverage.overall(rows)))[0]
        recon = _rows(health.reconciliation(success))[0]
        banks = {r["bank_name"]: round(r["coverage_pct"], 2) for r in _rows(coverage.by_bank(rows))}
        gaps = _rows(export.unmatched_units(f.orderBy("stream", F.col("priority_rank").desc(), F.col("total").desc(), "template")))
        good = _rows(health.best_first(health.with_rates(success).withColumn("matched", F.lit(True))).transform(export.success_units))
        meta = {**metadata, "grouping": grouping, "messages": overall, "categories": len(gaps), "successCategories": len(good), "coverage": {"overallPercent": overall["parsed_percent"], "perBank": banks}, "reconciliation": recon}
        return export.document(meta, gaps, good)
    finally:
        rows.unpersist()


def _inline(text: str) -> str:
    return text.replace("`", "'").replace("\n", " ")


def markdown(r: Report, title: str = "Coverage of message patterns") -> str:
    o = r.overall
    out = [f"# {title}", "", "| | |", "|---|---:|"]
    for name, value in (("Messages", o["total"]), ("Matched", o["matched"]), ("Unmatched", o["total"] - o["matched"]), ("Without a bank", o["unattributed"]), ("Coverage", f"{o['coverage_pct']:.1f}%"), ("Templates without a pattern", r.n_templates), ("Candidates for new formats", r.n_candidates), ("Noise", r.noise)):
        out.append(f"| {name} | {value} |")
    out += ["", "## Banks", ""]
    if r.banks:
        out += ["| Bank | Coverage | Matched | Unmatched | Total |", "|---|---:|---:|---:|---:|"]
        out += [f"| {b['bank_name']} | {b['coverage_pct']:.1f}% | {b['matched']} | {b['unmatched']} | {b['total']} |" for b in r.banks]
        for b in r.banks:
            m = r.missing.get(b["bank_id"])
            if m:
                out += ["", f"**{b['bank_name']}** lacks most: `{_inline(m['template'])}` ({m['occurrences']} times, {m['priority']})"]
    else:
        out.append("No message could be attributed to a bank.")
    for heading, found, n in (("Candidates for new formats", r.candidates, r.n_candidates), ("Gaps of known banks", r.gaps, r.n_gaps)):
        out += ["", f"## {heading}", ""]
        if n > len(found):
            out += [f"The first {len(found)} of {n}.", ""]
        if not found:
            out.append("None.")
        for i, f in enumerate(found, 1):
            out += [f"{i}. **{f['priority']}**, {f['total']} messages, readiness {f['readiness']}, {f['bank_name'] or 'unknown sender'}" + (f", {f['label']}" if f["label"] else ""), f"   `{_inline(f['template'])}`"]
            out += [f"   - variant `{_inline(v)}`" for v in f["variants"]] + [f"   - example `{_inline(e)}`" for e in f["examples"]]
    return "\n".join(out) + "\n"


def _shade(percent: float) -> str:
    return "#2e7d32" if percent >= 95 else "#c98a00" if percent >= 80 else "#b3261e"


def bar(percent: float, width: int = 240) -> str:
    p = min(100.0, max(0.0, percent))
    return f'<svg width="{width}" height="14" role="img" aria-label="{p:.1f}%"><rect width="{width}" height="14" fill="#e4e6ea"/><rect width="{p / 100 * width:.1f}" height="14" fill="{_shade(p)}"/></svg>'


def donut(percent: float, size: int = 120) -> str:
    p, radius = min(100.0, max(0.0, percent)), size / 2 - 10
    around = 2 * pi * radius
    circle = lambda color, extra: f'<circle cx="{size / 2}" cy="{size / 2}" r="{radius}" fill="none" stroke="{color}" stroke-width="14"{extra}/>'
    turn = f' stroke-dasharray="{p / 100 * around:.2f} {around:.2f}" transform="rotate(-90 {size / 2} {size / 2})"'
    return f'<svg width="{size}" height="{size}" role="img">{circle("#e4e6ea", "")}{circle(_shade(p), turn)}<text x="50%" y="54%" text-anchor="middle">{p:.1f}%</text></svg>'


def html(r: Report, title: str = "Coverage of message patterns") -> str:
    """One page without scripts or anything from elsewhere; the same report gives the same bytes."""
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{v}</{tag}>" for v in values) + "</tr>"
    banks = "".join(cells("td", (escape(b["bank_name"] or ""), bar(b["coverage_pct"]), f"{b['coverage_pct']:.1f}%", b["matched"], b["unmatched"], b["total"])) for b in r.banks)
    units = lambda found: "".join(f'<li><b style="color:{COLORS[f["priority"]]}">{f["priority"]}</b> {f["total"]} {escape(f["bank_name"] or "unknown sender")} <code>{escape(f["template"])}</code></li>' for f in found)
    o = r.overall
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>body{{font:15px sans-serif;max-width:60em;margin:2em auto}}td,th{{padding:.2em .8em;text-align:left}}</style></head><body>'
        f"<h1>{escape(title)}</h1>{donut(o['coverage_pct'])}<p>{o['matched']} of {o['total']} messages match a pattern; {o['app_accepted']} would be accepted.</p>"
        f"<h2>Banks</h2><table>{cells('th', ('Bank', '', 'Coverage', 'Matched', 'Unmatched', 'Total'))}{banks}</table>"
        f"<h2>Candidates for new formats</h2><ol>{units(r.candidates)}</ol><h2>Gaps of known banks</h2><ol>{units(r.gaps)}</ol></body></html>\n"
    )


def preview(doc: dict) -> str:
    """What an export would share, for reading before it leaves."""
    meta, out = doc["metadata"], []
    m = meta["messages"]
    out.append(f"{m['regex_matched']} of {m['total']} messages matched, {m['app_accepted']} accepted; {meta['categories']} gaps, {meta['successCategories']} kinds of success.")
    for u in doc["unmatchedUnits"] + doc["successUnits"]:
        if u.get("redacted"):
            out.append(f"- withheld ({u['reason']}): {u['count']} messages")
            continue
        score = f", score {u['healthScore']}" if u["matched"] else ""
        out.append(f"- {u['normalizedText']}: {u['count']} messages, {u['bank'] or 'new sender'}, {u['actionVerb'] or 'no verb'}{score}")
        out += [f"    <{f}> {s['regex']} ({s['samples']})" for f, s in u["shapeProfile"].items()]
    return "\n".join(out) + "\n"


def gate(r: Report, least: float | None) -> int:
    """Exit code: 4 if coverage is below what is demanded."""
    return 4 if least is not None and r.overall["coverage_pct"] < least - 1e-9 else 0
