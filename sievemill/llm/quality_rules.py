"""Quality rules: counts that reject a text outright, and a labelling of its lines.

A linear-chain conditional random field, trained on a small labelled table that `labelled_lines`
holds, marks each line as content or boilerplate (Viterbi). The share of a text's word
characters in content lines decides whether it stays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievemill.llm import crf
from sievemill.llm.shared import own_columns
from sievemill.llm.stats import CHAR, DIGIT, END, PIPE, RULE_SYMBOL, SHOUT, STOP, SYMBOL, duplicate_lines, in_repeats, keyed, later_copies, lines, lower_mask, ratio, span_sums, sums, upper_mask
from sievemill.llm.text import SEPARATOR, Texts, Words, slices, texts

#: A text stays if at least this share of its word characters is in content lines.
CONTENT_SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1

_SYLLABLES = ("the on er in ti re an es or ea he nd st ing ly", "der ung ein ch sch en be ver tz keit ü ä", "le que oi eau ment é è ai tre on", "la ción os ra do es ñ í ue ar")
_NAV = "home about contact login menu search next previous share print tags archive help terms privacy cookies".split()


def labelled_lines(seed: int = 5, n: int = 400) -> list[tuple[list[str], list[int]]]:
    """The labelled table: n short texts, each a list of lines and a label per line. Made by rule from a seed."""
    rng = np.random.Generator(np.random.PCG64(seed))

    def word() -> str:
        s = _SYLLABLES[style].split()
        return "".join(s[i] for i in rng.integers(0, len(s), rng.integers(1, 5)))

    def prose(k: int) -> str:
        out, cap = [], True
        for _ in range(k):
            w = word()
            out.append(w.capitalize() if cap else w)
            cap = rng.random() < 0.12
            if cap:
                out[-1] += "."
            elif rng.random() < 0.08:
                out[-1] += ","
            if rng.random() < 0.01:
                out.append(("+1 (555) 555-0100", "name.10@mail.example.com", "10.20.30.40", "token = 'a81b'", "(c) 2020")[rng.integers(5)])
        return " ".join(out).rstrip(".,") + "."

    def junk(kind: int) -> str:
        k = int(rng.integers(4, 60))
        if kind == 0:
            marks = ("###", "$$$", "***", "&&&", "%%%", "@@@", "===")
            return " ".join(word() + marks[rng.integers(len(marks))] for _ in range(k))
        if kind == 1:
            return " ".join(word().upper() + "!!" for _ in range(k))
        if kind == 2:
            return " | ".join(word() for _ in range(k))
        if kind == 3:
            return " ".join(" ".join([word()] * int(rng.integers(8, 30))) for _ in range(1 + k // 12))
        if kind == 4:
            return " ".join(_NAV[i].capitalize() for i in rng.integers(0, len(_NAV), rng.integers(1, 7)))
        if kind == 5:
            return " ".join(f"https://{word()}.example/{word()}?{word()}={i}" for i in range(1 + k // 15))
        if kind == 6:
            return " ".join("".join(map(str, rng.integers(0, 10, rng.integers(2, 9)))) for _ in range(k))
        return "<" + "><".join(word() + "=" + word() for _ in range(k)) + ">"

    table = []
    for _ in range(n):
        style = int(rng.integers(4))
        text, marks, clean, kind = [], [], rng.random() < 0.5, int(rng.integers(8))
        for _ in range(int(rng.integers(1, 14))):
            if rng.random() < (0.96 if clean else 0.25):
                text.append(prose(int(rng.integers(2, 90))))
                marks.append(CONTENT)
            else:
                text.append(text[-1] if text and marks[-1] == BOILERPLATE and rng.random() < 0.3 else junk(kind if rng.random() < 0.8 else int(rng.integers(8))))
                marks.append(BOILERPLATE)
        table.append((text, marks))
    return table


def line_features(part: Texts, rows: Words, words: Words, hashes: np.ndarray) -> np.ndarray:
    """A row for each line. All shares lie between 0 and 1, so no line's length outweighs its kind."""
    buf = part.buf
    n = np.searchsorted(words.starts, rows.ends) - np.searchsorted(words.starts, rows.starts)
    line = np.repeat(np.arange(len(rows)), n)
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    chars = span_sums(~SEPARATOR[buf] & CHAR[buf], rows.starts, rows.ends)
    upper, lower = span_sums(upper_mask(buf), rows.starts, rows.ends), span_sums(lower_mask(buf), rows.starts, rows.ends)
    share = lambda table, of, times=1.0: np.minimum(ratio(span_sums(table[buf], rows.starts, rows.ends), of) * times, 1)
    last = buf[np.maximum(words.ends - 1, 0)] if len(words) else buf[:0]
    adjacent = np.zeros(len(words), bool)
    if len(words):
        adjacent[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    per = lambda mask: ratio(sums(mask, at), n)
    end = buf[np.maximum(rows.ends - 1, 0)] if len(rows) else buf[:0]
    few = n < 8
    ended = END[end]
    return np.column_stack(
        (
            np.ones(len(rows)),
            np.minimum(n, 50) / 50,
            few,
            few & ~ended,
            ended,
            ratio(upper, upper + lower),
            share(SYMBOL, chars, 4),
            share(PIPE, n, 2),
            share(SHOUT, n, 2),
            share(STOP, n, 5),
            share(DIGIT, chars),
            per((SYMBOL | SHOUT)[last]),
            per(later_copies(keyed(hashes, line))) * ~few,
            per(adjacent),
            np.minimum(ratio(upper + lower, chars), 1),
            np.minimum(ratio(chars, n) / 20, 1),
            duplicate_lines(rows) & few,
        )
    ).astype(np.float64)


@lru_cache(1)
def trained() -> crf.Crf:
    """The model; its labelled table is fixed, so every fit gives the same one."""
    table = labelled_lines()
    part = texts(pa.array(["\n".join(t) for t, _ in table]))
    rows, words = lines(part), part.words()
    return crf.train(line_features(part, rows, words, words.hashes()), np.concatenate([m for _, m in table]), rows.counts, 2)


def judge(part: Texts, model: crf.Crf) -> dict[str, np.ndarray]:
    buf, words = part.buf, part.words()
    h, n = words.hashes(), words.counts
    rows = lines(part)
    boilerplate = model.decode(line_features(part, rows, words, h), rows.counts) == BOILERPLATE if len(rows) else np.zeros(0, bool)
    char = ~SEPARATOR[buf] & CHAR[buf]
    of_line = span_sums(char, rows.starts, rows.ends)
    total = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(np.where(boilerplate, 0, of_line), out=total[1:])
    chars, content = sums(char, part.offs), np.diff(total[rows.offs])
    repeats = sums(in_repeats(words, h, 5), words.offs)
    failed = (n < 10) | (100 * repeats > 20 * n)
    share = ratio(content, chars)
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": sums(RULE_SYMBOL[buf], part.offs),
        "n_dup_lines": sums(duplicate_lines(rows), rows.offs),
        "n_repeat_words": repeats,
        "n_lines": rows.counts,
        "n_boilerplate_lines": sums(boilerplate, rows.offs),
        "content_share": share,
        "base_failed": failed,
        "kept": ~failed & (share >= CONTENT_SHARE),
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, line labels and verdict for every text.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word),
    n_boilerplate_lines, content_share, base_failed, kept. A null or empty text has no words and fails; so does
    one of fewer than 10 words. Null and repeated ids are judged row by row; equal texts have equal verdicts. A share of exactly CONTENT_SHARE is
    kept; a text of one line is one label. Texts are read whole, however long. Other columns are ignored, whatever their names; an empty
    table gives an empty one. Ids may be of any type."""
    model = trained()
    d = own_columns(docs, id_col, text_col).toDF("id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in slices(texts(batch.column("text"))):
                found = judge(part, model)
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], *(pa.array(v) for v in found.values())], ["id", *found])

    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_boilerplate_lines"))
    return d.mapInArrow(rows, f"id {dict(d.dtypes)['id']}, {longs}, content_share double, base_failed boolean, kept boolean").withColumnRenamed("id", id_col)
