"""Regular expressions with the semantics the engine needs, for the JVM and for checking in other dialects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The JVM's word boundary is Unicode-aware; this one knows ASCII words only.
_W = "[A-Za-z0-9_]"
EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
#: White space including no-break and other Unicode spaces.
SPACES = "[\\s\\x0B\\x{00A0}\\x{FEFF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_BLANKS = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NAMED = re.compile(r"\(\?P?<([A-Za-z][A-Za-z0-9_]*)>")


def ascii_edges(pattern: str) -> str:
    """The pattern with each word boundary outside escapes replaced by an ASCII one."""
    return re.sub(r"\\(.)", lambda m: EDGE if m[1] == "b" else m[0], pattern, flags=re.S)


def positional(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with plain groups in place of named ones, and each name's number.

    The JVM refuses names with an underscore; extraction by number needs no names."""
    names: dict[str, int] = {}
    out, n, i, inside = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            named = _NAMED.match(pattern, i)
            if named:
                n += 1
                names.setdefault(named[1], n)
                out.append("(")
                i = named.end()
                continue
            if not pattern.startswith("(?", i):
                n += 1
        out.append(c)
        i += 1
    return "".join(out), names


def _group_end(pattern: str, i: int) -> int | None:
    """Past the group or class that opens at i; None if it isn't plain."""
    depth, inside = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2] in ("", "Q"):
                return None
            i += 2
            continue
        if inside:
            if c == "[" or pattern.startswith("&&", i):
                return None  # the JVM nests classes
            inside = c != "]"
        elif c == "[":
            inside = True
            i += pattern.startswith("^", i + 1)
            if pattern.startswith("]", i + 1):
                return None
        depth += (c == "(") - (c == ")") if not inside and c != "]" else 0
        i += 1
        if depth == 0 and not inside:
            return i
    return None


def literals(pattern: str) -> tuple[str, ...]:
    """Texts in lower case that the lower case of each text with a match of the pattern holds, whatever case the pattern minds.

    None where the pattern is of a kind that this doesn't read: a text without them can't match, one with them may."""
    out, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c in "([":
            flags = re.match(r"\(\?(\w*)-?\w*[:)]", pattern[i:])
            end = _group_end(pattern, i)
            if end is None or (flags and set(flags[1]) - set("ims")):
                return ()
            out, run, i = [*out, run], "", end
            continue
        if c in "|)":
            return ()
        if c == "{":
            times = re.match(r"\{[0-9]+(?:,[0-9]*)?\}", pattern[i:])
            if not times:
                return ()
            out, run, i = [*out, run[:-1]], "", i + times.end()
            continue
        i += 1
        if c in "*?":
            out, run = [*out, run[:-1]], ""
        elif c in "+.^$":
            out, run = [*out, run], ""
        elif c == "\\":
            d = pattern[i : i + 1]
            i += 1
            if d in "sSdDwWbB" and d:
                out, run = [*out, run], ""
            elif d and d.isascii() and not d.isalnum():
                run += d
            else:
                return ()
        elif c.isascii():
            run += c.lower()
        else:
            out, run = [*out, run], ""
    return tuple(dict.fromkeys(x for x in (*out, run) if x.strip()))


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM takes the pattern; one that it doesn't take would fail a whole query."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def trimmed(text: Column) -> Column:
    """Without white space at the ends: of the same characters as SPACES."""
    return F.btrim(text, F.lit(_BLANKS))


def some(text: Column) -> Column:
    """null for an empty string: a group that took no part in a match is one."""
    return F.nullif(text, F.lit(""))


def once(value: Column) -> Column:
    """The value itself, as a column that the optimizer computes where it stands.

    It moves filters and null checks through projections by writing the column's expression into them; for a chain of
    regular expressions that repeats the work and, link by link, multiplies the plan. It doesn't for what isn't deterministic.
    The sum stays: a random number itself compared with a bound is known to the optimizer."""
    return F.when(F.rand(0) + 1 > 0, value)


def spread(rows: DataFrame, key: str, mb: int = 4) -> DataFrame:
    """rows over at least two tasks a core, and one for each so many MB of input: for work that costs far more than moving them.

    Files and joins alone make as few tasks as their own sizes ask for, however much work a row is."""
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))  # a join's own estimate is a product
    return rows.repartition(max(parts, min(size // (mb << 20), MOST_PARTS)), key)


#: An input whose size isn't known counts as endless.
MOST_PARTS = 20_000
