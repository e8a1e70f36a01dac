"""Message bodies as templates: placeholders in place of what varies, by ordered rules.

Each rule sees what the rules before it made. A rule holds spellings for the JVM, for Python, and one without look-around for
engines on RE2, with which the results are checked. RULES run in Arrow batches, once for all texts that differ in digits only; other rules run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.regexes import EDGE, SPACES, ascii_edges, compiles, once, squeezed

MOST_CHARS = 8000
_D, _L, _A = "[0-9]", "[A-Za-z]", "[A-Za-z0-9]"
_CAP, _NAMEPART = "[A-Z]", "[A-Za-z'.-]"
_MONTH = "(?:" + "|".join(sorted("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())) + ")[a-z]*"
_MONEY = "(?:" + "|".join(sorted(("ETB", "Br", "USD", r"\$"))) + ")"
_NUMBER = f"{_D}[0-9,]*"


@dataclass(frozen=True)
class Rule:
    field: str
    jvm: str
    re2: str
    put: str  # replacement
    re2_put: str  # replacement with the groups that stand for look-around
    value: str  # the RE2 spelling with the value in group value_group
    value_group: int
    #: a text that holds none of these has no match; a digit stands for any
    needs: tuple[str, ...] = ()
    python: str = ""


def _behind(before: str) -> str:
    """A look behind of any of some texts, one for each: Python wants fixed lengths."""
    some = re.fullmatch(r"(.*)\(\?:(.*)\)(.*)", before)
    each = [some[1] + x + some[3] for x in some[2].split("|")] if some else before.split("|")
    return "(?:" + "|".join(f"(?<={x})" for x in each) + ")"


def _rule(field: str, pattern: str, before: str = "", after: str = "", around: str = "", needs: tuple[str, ...] = ("0",)) -> Rule:
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    core = pattern[len(flags) :]
    put = f"<{field}>"
    shown = f"({put})" if around else put
    jvm = flags + (f"(?<={before})" if before else "") + core + (f"(?={after})" if after else "")
    groups = [f"({before})" if before else "", core, f"({after})" if after else ""]
    back = ("\\1" if before else "") + shown + (("\\2" if before else "\\1") if after else "")
    value = flags + f"{groups[0]}({core}){groups[2]}"
    python = flags + (_behind(before) if before else "") + core + (f"(?={after})" if after else "")
    return Rule(field, ascii_edges(jvm), flags + "".join(groups), shown, back, value, 2 if before else 1, needs, python)


_NAME_RUN = f"{_CAP}{_NAMEPART}*(?:\\s+{_CAP}{_NAMEPART}*)*"
_MIXED = "|".join(("D" + "L" + "A{3,}", "D{2}LA{2,}", "D{3}LA+", "D{4,}LA*", "LDA{3,}", "L{2}DA{2,}", "L{3}DA+", "L{4,}DA*")).replace("D", _D).replace("L", "#").replace("A", _A).replace("#", _L)
RULES: tuple[Rule, ...] = (
    _rule("URL", r"(?i)https?://[^\s]+", needs=("://",)),
    _rule("REFERENCE", r"(?i)[A-Z0-9&]{4,}", before="id=|Receipt/", needs=("=", "/")),
    _rule("NAME", rf"(?:(?:{'|'.join(sorted(('Mr', 'Mrs', 'Ms', 'Dr'), reverse=True))})\.?\s+)?{_NAME_RUN}", before=r"\bDear\s", needs=("Dear",)),
    _rule("NAME", rf"\({_CAP}[-A-Za-z .']+\)", around="()", needs=("(",)),
    _rule("NAME", rf"{_CAP}[a-z]+(?:\s+{_CAP}{_NAMEPART}+){{1,3}}", before=r"\b(?:from|to)\s", after=r"\s+on\b", needs=()),
    _rule("MERCHANT", rf"{_L}[-A-Za-z0-9 &'.]*?", before=r"\bat\s", after=r"\s+on\b", needs=()),
    _rule("DATE", rf"\b{_D}{{4}}[-/]{_D}{{1,2}}[-/]{_D}{{1,2}}\b"),
    _rule("DATE", rf"\b{_D}{{1,2}}[-/]{_D}{{1,2}}[-/]{_D}{{2,4}}\b"),
    _rule("DATE", rf"(?i)\b{_D}{{1,2}}[- ]{_MONTH}[- ]{_D}{{2,4}}\b"),
    _rule("TIME", rf"(?i)\b{_D}{{1,2}}:{_D}{{2}}(?::{_D}{{2}})?\s?(?:[AP]M)?\b", needs=(":",)),
    _rule("ACCOUNT", rf"\b{_D}[*]+{_D}+\b", needs=("*",)),
    _rule("CARD", rf"[*]{{2,}}{_D}{{2,4}}\b", needs=("*",)),
    _rule("PHONE", rf"\b(?:0|[+]?251)?9{_D}{{8}}\b"),
    _rule("AMOUNT", rf"(?i){_MONEY}\s?{_NUMBER}(?:[.]{_D}+)?"),
    _rule("AMOUNT", rf"(?i)\b{_NUMBER}[.]{_D}{{2}}\s?(?:Br|ETB)\b"),
    _rule("REFERENCE", rf"\b(?:{_MIXED})\b"),
    _rule("ACCOUNT", rf"\b{_D}{{10,16}}\b"),
    _rule("NUM", rf"\b{_NUMBER}(?:[.]{_D}+)?\b"),
)
FIELDS = tuple(sorted({r.field for r in RULES}))


def _possible(rule: Rule, text: Column) -> Column:
    """Whether the text may hold a match: a look for a few characters, far cheaper than the rule."""
    out: Column | None = None
    for n in rule.needs:
        found = text.rlike("[0-9]") if n == "0" else F.contains(text, F.lit(n))
        out = found if out is None else out | found
    return F.lit(True) if out is None else out


def _with(text: Column, f: Callable[[Column], Column]) -> Column:
    """f(text) with one reference to the text: were there more, inlining a chain of rules would multiply it."""
    return F.get(F.transform(F.array(text), f), F.lit(0))


def _replaced(rule: Rule) -> Callable[[Column], Column]:
    return lambda t: F.when(_possible(rule, t), F.regexp_replace(t, rule.jvm, rule.put)).otherwise(t)


def _split(rule: Rule) -> Callable[[Column], Column]:
    """What the rule finds, and the text with its placeholders."""

    def split(t: Column) -> Column:
        found = F.struct(F.regexp_extract_all(t, F.lit(rule.jvm), F.lit(0)).alias("values"), F.regexp_replace(t, rule.jvm, rule.put).alias("text"))
        return F.when(_possible(rule, t) & t.rlike(rule.jvm), found).otherwise(F.struct(F.array().cast("array<string>").alias("values"), t.alias("text")))

    return split


_PYTHON = tuple(re.compile(r.python, re.ASCII) for r in RULES)  # words, white space and case are ASCII's, as in the JVM
_BLANKS = re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", SPACES), re.ASCII)
_DIGIT = re.compile("[0-9]")
_ZEROS = bytes.maketrans(b"123456789", b"000000000")
#: Digit runs from this length on may be phone numbers, which their first digits tell.
_LONG_RUN, _TOLD_BY = 9, 4
#: Texts up to this length are looked up, among so many.
_SHORT, _MOST_KNOWN = 1000, 20_000


@dataclass
class Found:
    """What the rules make of a text and of all that differ from it in digits only."""

    template: str
    #: where in the text the template's digits are: no rule took them
    digits: list[int]
    #: of each rule that matches, its number and its values' places
    spans: list[tuple[int, list[tuple[int, int]]]]

    def of(self, text: str) -> str:
        if not self.digits:
            return self.template
        pieces = _DIGIT.split(self.template)
        return "".join(x for p, i in zip(pieces, self.digits) for x in (p, text[i])) + pieces[-1]


_known: dict[str, Found] = {}


def _may(rule: Rule, text: str) -> bool:
    return not rule.needs or any((_DIGIT.search(text) is not None) if n == "0" else n in text for n in rule.needs)


def shape(text: str) -> str:
    """The text with a zero for each digit, but for the first ones of long runs: no rule tells two texts of one shape apart."""
    zeros = text.encode().translate(_ZEROS).decode()
    if "0" * _LONG_RUN not in zeros:
        return zeros
    return re.sub("0+", lambda m: text[m.start() : m.start() + _TOLD_BY] + m[0][_TOLD_BY:] if len(m[0]) >= _LONG_RUN else m[0], zeros)


def found(text: str) -> Found:
    """Runs the rules, keeping for each character where it was; placeholders, which no later rule takes, were nowhere."""
    at, spans = list(range(len(text))), []
    for i, (rule, rx) in enumerate(zip(RULES, _PYTHON)):
        if not _may(rule, text):
            continue
        pieces, places, values, end = [], [], [], 0
        for m in rx.finditer(text):
            a, b = m.span()
            pieces += text[end:a], rule.put
            places += at[end:a] + [-1] * len(rule.put)
            values.append((at[a], at[b - 1] + 1))
            end = b
        if values:
            text, at = "".join(pieces) + text[end:], places + at[end:]
            spans.append((i, values))
    return Found(_BLANKS.sub(" ", text).strip(" "), [at[m.start()] for m in _DIGIT.finditer(text)], spans)


def _known_shape(key: str) -> Found:
    out = _known.get(key)
    if out is None:
        if len(_known) >= _MOST_KNOWN:
            _known.clear()
        out = _known[key] = found(key)
    return out


def _lookup(text: str) -> Found:
    return found(text) if len(text) > _SHORT else _known_shape(shape(text))


def _looked_up(bodies: pa.Array) -> tuple[pa.Array, list[Found | None]]:
    """For each text a number (null for null), and of each number what is found; None where each text has to be looked at."""
    valid, offsets, data = bodies.buffers()
    zeros = pa.py_buffer(data.to_pybytes().translate(_ZEROS) if data else b"")
    keys = pa.Array.from_buffers(bodies.type, len(bodies), [valid, offsets, zeros], offset=bodies.offset).dictionary_encode()
    return keys.indices, [None if len(k) > _SHORT or "0" * _LONG_RUN in k else _known_shape(k) for k in keys.dictionary.to_pylist()]


def template_of(text: str) -> str:
    if len(text) <= _SHORT:
        return _lookup(text).of(text)
    for rule, rx in zip(RULES, _PYTHON):
        if _may(rule, text):
            text = rx.sub(rule.put, text)
    return _BLANKS.sub(" ", text).strip(" ")


def _templates(bodies: pa.Array) -> pa.Array:
    at, whole = _looked_up(bodies)
    out = pa.array([w.template if w and not w.digits else None for w in whole], pa.string()).take(at)
    if out.null_count == bodies.null_count:
        return out
    texts, out = (x.to_numpy(zero_copy_only=False) for x in (bodies, out))
    return pa.array([template_of(t) if o is None and t is not None else o for t, o in zip(texts, out)], pa.string())


_FIELD_NAMES = [r.field for r in RULES]
_SPANS_TYPE = "template string, spans array<struct<rule: int, field: string, values: array<string>>>"


def _with_spans(bodies: pa.Array) -> pa.Array:
    templates, per_text, rules, per_rule, values = [], [], [], [], []
    at, whole = _looked_up(bodies)
    for t, k in zip(bodies.to_numpy(zero_copy_only=False), at.to_pylist()):
        got = None if t is None else whole[k] or _lookup(t)
        templates.append(None if got is None else got.of(t))
        spans = got.spans if got else ()
        per_text.append(len(spans))
        for i, places in spans:
            rules.append(i)
            per_rule.append(len(places))
            values += [t[a:b] for a, b in places]
    offsets = lambda sizes: pa.array(accumulate(sizes, initial=0), pa.int32())
    lists = pa.ListArray.from_arrays(offsets(per_rule), pa.array(values, pa.string()))
    each = pa.StructArray.from_arrays([pa.array(rules, pa.int32()), pa.array([_FIELD_NAMES[i] for i in rules], pa.string()), lists], ["rule", "field", "values"])
    return pa.StructArray.from_arrays([pa.array(templates, pa.string()), pa.ListArray.from_arrays(offsets(per_text), each)], ["template", "spans"])


def _in_python(rules: tuple[Rule, ...], usable: list[bool]) -> bool:
    return tuple(r for r, ok in zip(rules, usable) if ok) == RULES == rules[: len(RULES)]


def _cut(body: str) -> Column:
    return F.make_valid_utf8(F.substring(F.col(body), 1, MOST_CHARS))


def _usable(df: DataFrame, rules: tuple[Rule, ...]) -> list[bool]:
    return [r in RULES or compiles(df.sparkSession, r.jvm) for r in rules]


def with_template(df: DataFrame, body: str, template: str = "template", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the template of a body, and whether it is degraded: a rule that the JVM doesn't take is left out, so values may remain.

    In the JVM, one projection a rule keeps each rule's input a plain column. A null body has a null template."""
    usable = _usable(df, rules)
    if _in_python(rules, usable):
        run = F.arrow_udf(_templates, "string").asNondeterministic()  # so that no filter repeats it
        return df.withColumns({template: run(_cut(body)), "degraded": F.lit(not all(usable))})
    df = df.withColumn(template, F.substring(F.col(body), 1, MOST_CHARS))
    for rule in (r for r, ok in zip(rules, usable) if ok):
        df = df.withColumn(template, _with(F.col(template), _replaced(rule)))
    return df.withColumns({template: once(squeezed(F.col(template))), "degraded": F.lit(not all(usable))})


def with_spans(df: DataFrame, body: str, template: str = "template", spans: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """with_template and the raw text behind each placeholder: an array of (rule, field, values) in rule order."""
    usable = _usable(df, rules)
    if _in_python(rules, usable):
        run = F.arrow_udf(_with_spans, _SPANS_TYPE).asNondeterministic()
        df = df.withColumn("_found", run(_cut(body)))
        return df.withColumns({template: F.col("_found.template"), spans: F.col("_found.spans"), "degraded": F.lit(not all(usable))}).drop("_found")
    text, one = F.substring(F.col(body), 1, MOST_CHARS), []
    for i, rule in ((i, r) for i, (r, ok) in enumerate(zip(rules, usable)) if ok):
        df = df.withColumn(f"_rule{i}", _with(text, _split(rule)))
        text = F.col(f"_rule{i}")["text"]
        one.append(F.struct(F.lit(i).alias("rule"), F.lit(rule.field).alias("field"), F.col(f"_rule{i}")["values"].alias("values")))
    df = df.withColumns({template: once(squeezed(text)), spans: once(F.filter(F.array(*one), lambda s: F.size(s["values"]) > 0)), "degraded": F.lit(not all(usable))})
    return df.drop(*(f"_rule{i}" for i in range(len(rules))))


def truncated(body: Column) -> Column:
    return F.length(body) > MOST_CHARS


def sql(body: str, spaces: str) -> str:
    """The same rules as nested SQL calls for engines on RE2."""
    text = f"substr({body}, 1, {MOST_CHARS})"
    for r in RULES:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, r.re2.replace("'", "''"), r.re2_put)
    return f"trim(regexp_replace({text}, '{spaces}', ' ', 'g'))"


__all__ = ["EDGE", "FIELDS", "MOST_CHARS", "RULES", "Rule", "sql", "truncated", "with_spans", "with_template"]
