"""Personal data in whole texts: e-mail addresses, IPv4 addresses, card and phone numbers, secrets and identity numbers.

Patterns give the base spans. A linear-chain conditional random field over word shapes, trained on a small
labelled table made by `labelled_words`, adds what the patterns don't know: numbers that run into one
another, phone numbers without a country code, keys and tokens, identity and account numbers. Its labels decide; no pattern
has to agree. Every word is labelled, one of letters only like any other. What a word looks like is worked out once for each
distinct word, and words that are "other" on every best path, whatever their neighbours are, cut the chain: Viterbi
over the stretches between them finds the best labelling of the whole text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievemill.llm import crf
from sievemill.llm.shared import own_columns
from sievemill.llm.stats import CHAR, DIGIT, LOWER, UPPER, _class, span_sums
from sievemill.llm.text import SEPARATOR, Texts, Words, slices, texts

#: Kinds that the patterns find, and those that only the model does.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id")
EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_CHAR = LOWER | UPPER | DIGIT | _class("._%+-@")
_PHONE_CHAR = DIGIT | _class(" ().-")
_ASCII_WORD = LOWER | UPPER | DIGIT
#: Spans as rows: text, kind, first byte, one past the last, base or added.
Spans = np.ndarray
LABELS = 1 + 2 * len(KINDS)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(digits: bytes) -> bool:
    digits = digits.lstrip(b"0")
    return len(digits) <= 3 and int(digits or b"0") <= 255


def _digits(b: bytes) -> bytes:
    return bytes(c for c in b if 48 <= c <= 57)


def _runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of mask, cut between texts."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    cut = np.diff(at) > 1
    inner = offs[1:-1]
    cut |= np.searchsorted(inner, at[1:], "right") > np.searchsorted(inner, at[:-1], "right")
    return np.r_[at[0], at[1:][cut]], np.r_[at[:-1][cut], at[-1]] + 1


def base_spans(part: Texts) -> list[tuple[int, int, int, int]]:
    """(text, kind, first byte, one past the last) of every match of the patterns that holds."""
    buf, offs, found = part.buf, part.offs, []
    text_of = lambda p: int(np.searchsorted(offs, p, "right")) - 1
    done = -1
    for at in np.flatnonzero(buf == ord("@")).tolist():
        if at < done:
            continue
        t = text_of(at)
        lo = hi = at
        while lo > offs[t] and _EMAIL_CHAR[buf[lo - 1]]:
            lo -= 1
        while hi < offs[t + 1] and _EMAIL_CHAR[buf[hi]]:
            hi += 1
        done = hi
        # each sign is tried once, with all that may stand before it: the time grows with the run, not with its square
        run, start, sign = buf[lo:hi].tobytes(), 0, at - lo
        while sign >= 0:
            m = _DOMAIN.match(run, sign + 1) if sign > start else None
            if m:
                found.append((t, 0, lo + start, lo + m.end()))
            start = m.end() if m else sign + 1
            sign = run.find(b"@", start)
    # runs of digits, and what joins each to the next
    a, b = _runs(DIGIT[buf], offs)
    if len(a):
        joint = np.zeros(len(a), np.uint8)
        one = (a[1:] - b[:-1] == 1) & (np.searchsorted(offs, a[1:], "right") == np.searchsorted(offs, a[:-1], "right"))
        joint[:-1][one] = buf[b[:-1][one]]
        # four runs joined by dots: always the next four from the left
        group = np.flatnonzero((joint != ord(".")) | (np.arange(len(a)) == len(a) - 1))
        first = np.r_[0, group[:-1] + 1]
        for f, g in zip(first[group - first >= 3].tolist(), group[group - first >= 3].tolist()):
            for k in range(f, g - 2, 4):
                if all(_octet(buf[a[i] : b[i]].tobytes()) for i in range(k, k + 4)):
                    found.append((text_of(a[k]), 1, int(a[k]), int(b[k + 3])))
        group = np.flatnonzero(((joint != ord(" ")) & (joint != ord("-"))) | (np.arange(len(a)) == len(a) - 1))
        first = np.r_[0, group[:-1] + 1]
        n = np.r_[0, np.cumsum(b - a)]
        n = n[group + 1] - n[first]
        for f, g in zip(first[(n >= 12) & (n <= 19)].tolist(), group[(n >= 12) & (n <= 19)].tolist()):
            if luhn(_digits(buf[a[f] : b[g]].tobytes())):
                found.append((text_of(a[f]), 2, int(a[f]), int(b[g])))
    plus = np.flatnonzero(buf[:-1] == ord("+")) if len(buf) > 1 else np.zeros(0, int)
    for at in plus[DIGIT[buf[plus + 1]]].tolist():
        t = text_of(at)
        hi = at + 1
        while hi < offs[t + 1] and _PHONE_CHAR[buf[hi]]:
            hi += 1
        while hi > at + 1 and not DIGIT[buf[hi - 1]]:
            hi -= 1
        if hi - at >= 4 and 9 <= len(_digits(buf[at:hi].tobytes())) <= 15:
            found.append((t, 3, at, hi))
    return found


def eligible(part: Texts, words: Words) -> np.ndarray:
    """Words that may be personal data: all."""
    return np.arange(len(words))


_GROUPS = ((3, 4), (3, 3, 4), (4, 4, 4, 4), (3, 2, 4), (2, 3, 3), (3, 3, 3))
#: Words that announce a kind: a secret, a phone number, an identity number, a card.
_CUES = ("token key secret password passwd api apikey bearer auth credential access", "call phone tel telephone fax mobile cell sms", "ssn social passport iban id tax security account licence license", "card visa mastercard credit debit")
_CUE = {w.encode(): i for i, ws in enumerate(_CUES) for w in ws.split()}
_MARKS = b".,;:!?\"'#$%&*|=<>[]{}`"


def _shape(w: bytes) -> tuple:
    core = w.strip(_MARKS)
    digits = _digits(core)
    n, size, dots = len(digits), len(core), core.count(b".")
    letters = any(65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in core)
    plain = core.isdigit()
    parts = tuple(len(x) for x in re.split(rb"[-.]", core.strip(b"()"))) if size < 40 and not letters else ()
    one = core.isalnum() and letters
    hexed = size >= 24 and all(c in b"0123456789abcdefABCDEF" for c in core)
    # letters in no order: unlike in names of many words, capitals stand close together
    mixed = not n and size >= 16 and not core.isupper() and len(re.findall(rb"[A-Z](?=[A-Z]|[a-z][A-Z])", core[:64])) >= 3
    capital = not n and size >= 20 and one and core.isupper()
    changes = sum((48 <= x <= 57) != (48 <= y <= 57) for x, y in zip(core[:64], core[1:64]))
    tagged = re.match(rb"[A-Za-z]{2,6}[_-]", core) is not None
    return (
        1, not n, n in (1, 2), n == 3, n == 4, 5 <= n <= 8, 9 <= n <= 11, 12 <= n <= 14, n == 15, n == 16, 17 <= n <= 19, n > 19,
        letters, plain, b"@" in core, EMAIL.fullmatch(core) is not None, core[:1] == b"+", core[:1] == b"(", core[-1:] == b")", b"-" in core, dots == 3 and not letters, dots in (1, 2) and not letters,
        *(parts == g for g in _GROUPS), re.fullmatch(rb"\(\d{3}\)", core) is not None,
        plain and 12 <= n <= 19 and luhn(digits), b":" in core or b"/" in core or b"=" in core, size < len(w),
        hexed, one and size >= 16, one and size >= 16 and n < 4, one and size >= 16 and core.isupper(), one and size >= 16 and not core.isupper() and not core.islower(), changes >= 5 and size >= 12, tagged and size >= 16,
        re.fullmatch(rb"[A-Z]{2}\d{2}[A-Z0-9]{0,30}", core) is not None and size <= 34, one and 6 <= size <= 12 and core.isupper(), size > 40, dots == 3 and len(parts) == 4 and all(0 < x <= 3 for x in parts) and all(map(_octet, core.split(b"."))),
        n >= 9 and not letters and not plain, mixed and one, mixed and tagged, capital, not n and size >= 16 and not mixed and not capital, size > 0 and w[:1] in b"\"'" and w[-1:] in b"\"'",
    )


SHAPES = len(_shape(b""))


#: Numbers of what words look like (shape and cue), by word and by look.
_look_of: dict[bytes, int] = {}
_number: dict[tuple, int] = {}
_plain: dict[tuple, int] = {}
_HIGH = bytes(range(128, 256))
#: Words whose looks are kept, and their length at most.
KEPT_WORDS, KEPT_LENGTH = 1 << 17, 48


def _look(w: bytes) -> int:
    """Number of a word's look, which is kept."""
    core, kind = w.strip(_MARKS), None
    if len(core) < 16 and core.translate(None, _HIGH).isalpha():
        # letters only: of the shape only this varies
        plain = core.isalpha()
        kind = (_CUE.get(core.lower(), -1) if len(w) < 24 else -1, plain, plain and 6 <= len(core) <= 12 and core.isupper(), len(core) < len(w), w[:1] in b"\"'" and w[-1:] in b"\"'")
    look = _plain.get(kind)
    if look is None:
        cue = _CUE.get(w.lower().strip(_MARKS + b"()"), -1) if len(w) < 24 else -1
        look = _number.setdefault((cue, tuple(map(bool, _shape(w)))), len(_number))
        if kind is not None:
            _plain[kind] = look
    if len(w) <= KEPT_LENGTH:
        if len(_look_of) >= KEPT_WORDS:
            _look_of.clear()
        _look_of[w] = look
    return look


def _looks(part: Texts, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's look; of each look the shape features, and which kind it announces or -1."""
    buf = part.buf.tobytes()
    said = [buf[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
    look = np.array([_look(w) if k is None else k for w, k in zip(said, map(_look_of.get, said))], np.int64)
    # many texts have few looks: number those that occur here
    found, look = np.unique(look, return_inverse=True) if len(look) else (look, look)
    kept = list(_number)
    kept = [kept[k] for k in found.tolist()]
    return look, np.array([x for _, x in kept], np.float64).reshape(-1, SHAPES), np.array([c for c, _ in kept], np.int64)


def _announced(cue: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each word whether one of the three before it in its text announces each kind."""
    out = np.zeros((len(cue), len(_CUES)))
    for back in (1, 2, 3):
        at = np.flatnonzero((cue[:-back] >= 0) & (of[:-back] == of[back:]))
        out[at + back, cue[at]] = 1
    return out


def word_features(part: Texts, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the eligible words `at`, their neighbours' shapes among them, words before them that announce a kind, and the lengths of their
    stretches."""
    of = words.text_of
    n = len(words)
    look, shape, cue = _looks(part, words)

    def beside(step: int) -> np.ndarray:
        out = np.zeros((len(at), shape.shape[1]))
        to = at + step
        ok = (to >= 0) & (to < n)
        ok[ok] = of[to[ok]] == of[at[ok]]
        out[ok] = shape[look[to[ok]]]
        return out

    starts = np.ones(len(at), bool)
    starts[1:] = (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]])
    lengths = np.diff(np.r_[np.flatnonzero(starts), len(at)])
    last = np.r_[starts[1:], True] if len(at) else starts
    cues = _announced(cue[look], of)[at]
    return np.hstack([shape[look[at]], beside(-1), beside(1), cues, starts[:, None], last[:, None]]), lengths


def emissions(part: Texts, words: Words, model: crf.Crf) -> tuple[np.ndarray, np.ndarray]:
    """What word_features of all words make of the model's weights: for each word the row, and the rows, one for each surrounding that occurs."""
    look, shape, cue = _looks(part, words)
    of, n = words.text_of, len(shape) + 1
    same = np.r_[False, of[1:] == of[:-1], False]
    # a word's surroundings as one number: looks before it, its own and after it, from 1 on, and what is announced
    before, after = np.r_[0, look[:-1] + 1] * same[:-1], np.r_[look[1:] + 1, 0] * same[1:]
    told = np.flatnonzero(cue[look] >= 0)
    said = np.zeros(len(look), np.int64)
    near = np.unique((told[:, None] + np.arange(1, 4)).ravel())
    near = near[near < len(look)]
    said[near] = _announced(cue[look], of)[near] @ (1 << np.arange(len(_CUES))) if len(near) else 0
    found, row = np.unique(((before * n + look) * n + after) * (1 << len(_CUES)) + said, return_inverse=True)
    found, said = np.divmod(found, 1 << len(_CUES))
    found, after = np.divmod(found, n)
    before, own = np.divmod(found, n)
    w = np.split(model.emit, np.cumsum([SHAPES, SHAPES, SHAPES, len(_CUES), 1]))
    none = np.zeros((1, LABELS))
    e = (shape @ w[0])[own] + np.vstack([none, shape @ w[1]])[before] + np.vstack([none, shape @ w[2]])[after]
    e += (said[:, None] >> np.arange(len(_CUES)) & 1) @ w[3] + (before == 0)[:, None] * w[4] + (after == 0)[:, None] * w[5]
    return row, e


def labels(part: Texts, words: Words, model: crf.Crf) -> np.ndarray:
    """The best label of every word."""
    out = np.zeros(len(words), np.int8)
    if not len(words):
        return out
    (row, e), of = emissions(part, words, model), words.text_of
    move, begin = model.move + model.forbidden, model.begin + model.forbidden_first
    follows = np.r_[False, of[1:] == of[:-1]]
    goes_on = np.r_[follows[1:], False]
    # The least that a path gains if a word's label becomes 0, whatever stands beside it. If the next word is inside the same span, it then begins one.
    free = np.r_[0, 1 + 2 * np.arange(len(KINDS))]
    alone, with_next = np.full(len(e), np.inf), np.full((len(e), len(KINDS)), np.inf)
    for k in range(1, LABELS):
        kind = (k - 1) // 2
        b, i = 1 + 2 * kind, 2 + 2 * kind
        left = [move[a, 0] - move[a, k] for a in range(LABELS) if move[a, k] > -1e5] + [begin[0] - begin[k]] * bool(begin[k] > -1e5)
        gain = e[:, 0] - e[:, k] + min(left)
        np.minimum(alone, gain + min(0, (move[0, free] - move[k, free]).min()), out=alone)
        right = min(0, min(move[b, c] - move[i, c] for c in range(LABELS) if move[i, c] > -1e5))
        np.minimum(with_next[:, kind], gain + move[0, b] - move[k, i] + right, out=with_next[:, kind])
    begun = e[:, 1::2] - e[:, 2::2]
    open_ = (alone < 1e-6)[row]
    open_[:-1] |= goes_on[:-1] & ((with_next[row[:-1]] + begun[row[1:]]).min(1) < 1e-6)
    at = np.flatnonzero(open_)
    if not len(at):
        return out
    x = e[row[at]]
    first = np.r_[True, (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]])]
    last = np.r_[first[1:], True]
    # a stretch lies between words labelled 0, or at an end of its text
    x[first & follows[at]] += move[0]
    x[first & ~follows[at]] += begin
    x[last & goes_on[at]] += move[:, 0]
    out[at] = crf.viterbi(x, np.diff(np.r_[np.flatnonzero(first), len(at)]), move, np.zeros(LABELS))
    return out


def labelled_words(seed: int = 9, n: int = 1100) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled table: short texts with (kind, first word, one past the last). Made by rule from a seed; a number that could be anything is personal only where a word before it says so."""
    rng = np.random.Generator(np.random.PCG64(seed))
    some = lambda k, chars="abcdefghiklmnoprst": "".join(chars[i] for i in rng.integers(0, len(chars), k))
    num = lambda k: some(k, "0123456789")

    def card(k: int = 16) -> str:
        head = "4" + num(k - 2)
        return next(head + str(c) for c in range(10) if luhn((head + str(c)).encode()))

    def phone() -> str:
        a, b, c = str(rng.integers(200, 999)), num(3), num(4)
        return (f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.integers(20, 99)} {num(2)} {num(4)} {num(4)}", f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}")[rng.integers(8)]

    def cards() -> str:
        c = card(int((16, 16, 16, 15, 13, 19)[rng.integers(6)]))
        return c if rng.random() < 0.6 or len(c) != 16 else ("-", " ")[rng.integers(2)].join(c[i : i + 4] for i in range(0, 16, 4))

    def bad_card() -> str:
        c = card()
        return c[:-1] + str((int(c[-1]) + 1 + rng.integers(8)) % 10)

    hexa = lambda k: some(k, "0123456789abcdef")
    wide = lambda k: some(k, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    letters = lambda k: some(k, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    caps = lambda k: some(k, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    pick = lambda xs: xs[rng.integers(len(xs))]

    def secret() -> str:
        key = pick((lambda: "AKIA" + some(16, "ABCDEFGHIJKLMNOP234567"), lambda: hexa(int(pick((32, 40, 40, 64)))), lambda: f"{pick(('ghp', 'sk', 'pk', 'xoxb', 'glpat'))}{pick('_-')}{wide(int(rng.integers(20, 40)))}", lambda: wide(int(rng.integers(20, 44))), lambda: letters(int(rng.integers(20, 44))), lambda: f"{pick(('ghp', 'sk', 'pk', 'xoxb', 'glpat'))}{pick('_-')}{letters(int(rng.integers(20, 40)))}", lambda: caps(int(rng.integers(20, 40)))))()
        return pick((f'"{key}"', f"'{key}'", key, key))

    def identity() -> str:
        iban = caps(2) + num(int(rng.integers(13, 25)))
        return pick((f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4)), caps(int(rng.integers(1, 3))) + num(int(rng.integers(6, 9)))))

    #: words before a kind that announce it, often or always
    said = {3: "call phone tel: fax mobile".split(), 4: "token key secret password api_key token= key:".split(), 5: "ssn passport iban id SSN: IBAN Passport".split(), 2: "card visa".split()}
    make = (
        lambda: f"{some(rng.integers(2, 9))}.{num(2)}@{some(rng.integers(3, 7))}{num(1)}.example.com",
        lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        cards,
        phone,
        secret,
        identity,
    )
    other = (
        lambda: str(rng.integers(1900, 2100)), lambda: num(int(rng.integers(1, 9))), bad_card, lambda: f"20{num(2)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}", lambda: f"{rng.integers(0, 23)}:{num(2)}",
        lambda: f"{num(2)}.{num(2)}", lambda: f"{rng.integers(1, 9)}.{num(1)}.{num(1)}", lambda: f"{some(5)}{num(3)}", lambda: f"{num(3)}-{num(3)}", lambda: "commit " + hexa(40), lambda: "sha1 " + hexa(40), lambda: "md5 " + hexa(32), lambda: f"{caps(2)}{num(2)}", lambda: f"{caps(3)}-{num(3)}", lambda: f"http://{some(6)}.example/{some(4)}/{num(6)}", lambda: f"{some(4)}{num(2)}{some(3)}",
        lambda: num(int(rng.integers(9, 12))), lambda: num(int(rng.integers(20, 26))), lambda: f"{rng.integers(256, 999)}.{num(2)}.{num(2)}.{num(2)}", lambda: f"@{some(5)}", lambda: f"{num(4)} {num(4)}", lambda: num(3) + " " + num(3), lambda: f"({num(1)})", lambda: f"+{num(2)}%", lambda: f"{num(4)}/{num(2)}", lambda: f"{num(1)},{num(3)}.{num(2)}", lambda: f"${num(2)}.{num(2)}", lambda: f"{pick(('card', 'key', 'phone', 'id', 'account'))} {num(2)}", lambda: f"{num(2)}-{num(2)}-{num(4)}",
    )
    #: words without a digit that look like keys, names of things and the like
    lettered = (
        lambda: some(int(rng.integers(10, 40))), lambda: some(int(rng.integers(1, 12))).title(), lambda: some(int(rng.integers(12, 36))).title(), lambda: caps(int(rng.integers(1, 12))), lambda: caps(int(rng.integers(12, 20))), lambda: "".join(some(int(rng.integers(3, 9))).title() for _ in range(rng.integers(2, 6))), lambda: pick("_-").join(some(int(rng.integers(2, 9))) for _ in range(rng.integers(2, 7))), lambda: "_".join(caps(int(rng.integers(3, 9))) for _ in range(rng.integers(2, 5))),
        lambda: f"https://www.{some(int(rng.integers(4, 12)))}.example/{some(int(rng.integers(4, 20)))}/{some(5)}-{some(8)}", lambda: f"www.{some(9)}.example", lambda: f"{some(6)}.{some(2)}", lambda: f'"{some(int(rng.integers(2, 10)))}"', lambda: f"'{some(int(rng.integers(2, 10))).title()}'", lambda: f"({some(int(rng.integers(2, 9)))})", lambda: pick(("--", "***", "...", "&", "=>", "+", "#" * int(rng.integers(1, 30)), "=" * int(rng.integers(3, 60)), "-" * int(rng.integers(3, 60)))),
        lambda: "é".join(some(int(rng.integers(1, 12))) for _ in range(2)), lambda: "字" * int(rng.integers(1, 30)), lambda: pick(" ".join(_CUES).split()), lambda: pick(("token", "key", "secret", "password", "api", "phone", "id", "card")) + " " + some(int(rng.integers(2, 12))), lambda: f"{some(5)}:{some(6)}", lambda: f"{some(5)}={some(7)}", lambda: f"{some(4)}/{some(6)}", lambda: f"<{some(3)}>",
    )
    table = []
    for _ in range(n):
        out, spans = [], []
        while len(out) < 4 or rng.random() < 0.75:
            r = rng.random()
            if r < 0.35:
                out += [some(rng.integers(1, 9)) + ("", "", "", ".", ",")[rng.integers(5)] for _ in range(rng.integers(1, 4))]
            elif r < 0.5:
                out += other[rng.integers(len(other))]().split(" ")
            elif r < 0.65:
                out += lettered[rng.integers(len(lettered))]().split(" ")
            else:
                kind = int(rng.integers(len(make)))
                words = make[kind]().split(" ")
                short = kind == 5 and len(words) == 1 and words[0].isalnum() and len(words[0]) < 12
                bare = kind == 4 and words[0][0] not in "\"'" and words[0].islower() and words[0].isalnum()
                if kind in said and (short or bare or rng.random() < 0.5):
                    out.append(pick(said[kind]))
                spans.append((kind, len(out), len(out) + len(words)))
                out += words
                if rng.random() < 0.2:
                    out[-1] += (".", ",", ";")[rng.integers(3)]
        table.append((" ".join(out), spans))
    return table


@lru_cache(1)
def trained() -> crf.Crf:
    """The model; its labelled table is fixed, so every fit gives the same one."""
    table = labelled_words()
    part = texts(pa.array([t for t, _ in table]))
    words = part.words()
    y = np.zeros(len(words), int)
    for i, (_, spans) in enumerate(table):
        for kind, a, b in spans:
            y[words.offs[i] + a] = 1 + 2 * kind
            y[words.offs[i] + a + 1 : words.offs[i] + b] = 2 + 2 * kind
    forbidden, first = np.zeros((LABELS, LABELS)), np.zeros(LABELS)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        forbidden[[x for x in range(LABELS) if x not in (inside - 1, inside)], inside] = first[inside] = -1e6
    at = eligible(part, words)
    x, lengths = word_features(part, words, at)
    return crf.train(x, y[at], lengths, LABELS, forbidden, first, steps=220)


def added_spans(part: Texts, model: crf.Crf, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """What the model labels and no base span overlaps."""
    buf, words = part.buf, part.words()
    y, of = labels(part, words, model), words.text_of
    taken = sorted((a, b) for _, _, a, b in base)
    lefts = np.array([a for a, _ in taken])
    found, j, n = [], 0, len(words)
    for i in np.flatnonzero(y).tolist():
        if i < j:
            continue
        kind, j = (int(y[i]) - 1) // 2, i + 1
        while j < n and y[j] == 2 + 2 * kind and of[j] == of[i]:
            j += 1
        lo, hi = int(words.starts[i]), int(words.ends[j - 1])
        # of the words only what may belong to the data: no quotes, stops or names before an equals sign
        edge = _ASCII_WORD | _class("+(") if kind == KINDS.index("phone") else _ASCII_WORD
        if kind == KINDS.index("secret"):
            lo += part.buf[lo:hi].tobytes().rfind(b"=", 0, (hi - lo) // 2) + 1
        while lo < hi and not edge[buf[lo]]:
            lo += 1
        while hi > lo and not _ASCII_WORD[buf[hi - 1]]:
            hi -= 1
        k = int(np.searchsorted(lefts, lo, "right"))
        free = not (k and taken[k - 1][1] > lo) and not (k < len(taken) and taken[k][0] < hi)
        if free and lo < hi:
            found.append((int(of[i]), kind, lo, hi))
    return found


def spans(part: Texts, model: crf.Crf) -> list[tuple[int, int, int, int, bool]]:
    """All spans by text, start and kind; base ones are marked."""
    base = base_spans(part)
    return sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(part, model, base)], key=lambda s: (s[0], s[2], s[1], s[3]))


def _passed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return own_columns(docs, id_col, text_col).toDF("id", "text")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every text.

    Returns id_col and spans: an array of (kind, start, end, base) by start, then kind; offsets count code points, the end
    is exclusive. Base spans of several kinds may overlap; added ones overlap no base span. A null or empty text has none. Null and repeated ids are
    read row by row, equal texts have equal spans; an empty table gives an empty one. Texts are read whole, in time that grows with their length. Other
    columns are ignored, whatever their names. Ids may be of any type."""
    model = trained()
    d = _passed(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in slices(texts(batch.column("text"))):
                out: list[list[dict]] = [[] for _ in range(j - i)]
                found = spans(part, model)
                if found:
                    chars = np.zeros(len(part.buf) + 1, np.int64)
                    np.cumsum(CHAR[part.buf], out=chars[1:])
                    for t, k, a, b, base in found:
                        zero = chars[part.offs[t]]
                        out[t].append({"kind": KINDS[k], "start": int(chars[a] - zero), "end": int(chars[b] - zero), "base": base})
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.array(out, kind)], ["id", "spans"])

    return d.mapInArrow(rows, f"id {dict(d.dtypes)['id']}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by its kind in capitals and angle brackets, as <EMAIL>.

    Of overlapping spans the one that starts first is replaced and takes the others' text with it. Null texts stay
    null; other columns pass unchanged."""
    model = trained()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            column = batch.column(at)
            changed: dict[int, str] = {}
            for i, _, part in slices(texts(column)):
                by_text: dict[int, list[tuple[int, int, int]]] = {}
                for t, k, a, b, _base in spans(part, model):
                    by_text.setdefault(t, []).append((a, b, k))
                for t, found in by_text.items():
                    pieces, done = [], int(part.offs[t])
                    for a, b, k in found:
                        if a >= done:
                            pieces += [part.buf[done:a].tobytes(), f"<{KINDS[k].upper()}>".encode()]
                        done = max(done, b)
                    changed[i + t] = b"".join([*pieces, part.buf[done : int(part.offs[t + 1])].tobytes()]).decode()
            if changed:
                out = column.to_pylist()
                for i, s in changed.items():
                    out[i] = s
                batch = batch.set_column(at, batch.schema.field(at), pa.array(out, column.type))
            yield batch

    return docs.mapInArrow(rows, docs.schema)
