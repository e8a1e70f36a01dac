"""Statistics of texts, lines and their words, for whole slices of texts at once."""

from __future__ import annotations

import numpy as np

from sievemill.llm.text import FIRST, SEPARATOR, Texts, Words, _mix


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


NEWLINE = _class("\n")
RULE_SYMBOL = _class("#*$%&|<>")
SYMBOL = _class("#*$%&|<>{}[]=_~^@\\/+")
STOP = _class(".,;:?")
END = _class(".!?:;\"')")
SHOUT = _class("!")
DIGIT = _class("0123456789")
PIPE = _class("|")
UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _class("abcdefghijklmnopqrstuvwxyz")
#: First bytes of UTF-8 characters.
CHAR = np.array([b & 0xC0 != 0x80 for b in range(256)])


def sums(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of mask are set from each offset to the next."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offs])


def span_sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[ends] - total[starts]


def upper_mask(buf: np.ndarray) -> np.ndarray:
    """Capital letters of ASCII and, by their last byte, of Latin-1."""
    mask = UPPER[buf]
    if len(buf) > 1:
        mask[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    return mask


def lower_mask(buf: np.ndarray) -> np.ndarray:
    mask = LOWER[buf]
    if len(buf) > 1:
        mask[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x9F)
    return mask


def keyed(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Hashes told apart by group."""
    return _mix(hashes ^ ((group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        out[order[1:]] = k[1:] == k[:-1]
    return out


def in_copies(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def in_repeats(words: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words a window of n words covers that its text has twice or more."""
    starts = words.window_starts(n)
    cover = np.zeros(len(words) + 1, np.int32)
    if len(starts):
        again = starts[in_copies(keyed(FIRST.windows(hashes, n)[starts], words.text_of[starts]))]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + n, -1)
    return np.cumsum(cover)[:-1] > 0


def lines(part: Texts) -> Words:
    """Lines that hold a word."""
    all_ = part.words(NEWLINE)
    full = span_sums(~SEPARATOR[part.buf], all_.starts, all_.ends) > 0
    starts = all_.starts[full]
    return Words(part, starts, all_.ends[full], np.searchsorted(starts, part.offs))


def duplicate_lines(rows: Words) -> np.ndarray:
    """Which lines equal an earlier one of their text."""
    return later_copies(keyed(rows.hashes(), rows.text_of))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


STATISTICS = ("words", "word_chars", "upper", "symbols", "digits", "stops", "shouts", "pipes", "distinct", "adjacent", "repeats", "copied_lines", "line_words", "open_lines", "capitals", "marked_words", "long_words", "short_words", "letters", "lines")


def statistics(part: Texts) -> np.ndarray:
    """A row of STATISTICS for each text; none of them depends on the language's words."""
    buf, words = part.buf, part.words()
    h, n, of = words.hashes(), words.counts, words.text_of
    sizes = span_sums(CHAR[buf], words.starts, words.ends)
    chars = sums(~SEPARATOR[buf] & CHAR[buf], part.offs)
    upper, lower = upper_mask(buf), lower_mask(buf)
    n_upper, n_lower = sums(upper, part.offs), sums(lower, part.offs)
    last = buf[np.maximum(words.ends - 1, 0)] if len(words) else buf[:0]
    rows = lines(part)
    ends = buf[np.maximum(rows.ends - 1, 0)] if len(rows) else buf[:0]
    per = lambda mask: ratio(sums(mask, words.offs), n)
    adjacent = np.zeros(len(words), bool)
    if len(words):
        adjacent[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    columns = (
        np.log1p(n),
        ratio(chars, n),
        ratio(n_upper, n_upper + n_lower),
        ratio(sums(SYMBOL[buf], part.offs), chars),
        ratio(sums(DIGIT[buf], part.offs), chars),
        ratio(sums(STOP[buf], part.offs), n),
        ratio(sums(SHOUT[buf], part.offs), n),
        ratio(sums(PIPE[buf], part.offs), n),
        1 - per(later_copies(keyed(h, of))),
        per(adjacent),
        per(in_repeats(words, h, 5)),
        ratio(sums(duplicate_lines(rows), rows.offs), rows.counts),
        np.log1p(ratio(n, rows.counts)),
        ratio(sums(~END[ends], rows.offs), rows.counts),
        per(upper[words.starts] | (upper[np.minimum(words.starts + 1, max(len(buf) - 1, 0))] & (buf[words.starts] == 0xC3)) if len(words) else np.zeros(0, bool)),
        per((SYMBOL | SHOUT)[last]),
        per(sizes > 12),
        per(sizes <= 3),
        ratio(n_upper + n_lower, chars),
        np.log1p(rows.counts),
    )
    return np.column_stack(columns).astype(np.float32)
