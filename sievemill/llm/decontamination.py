"""Benchmark passages in documents, also edited ones, by CGK embedding and bit-sampling LSH.

Texts are sequences of words without case and ASCII punctuation. An item of n words leaks if some run of words is
within RATE * n edits (words inserted, deleted, replaced). An item is cut into units of at most LONGEST words, most often one;
k edits leave one of the units within RATE of its own words. For each unit:

1. Windows are hashed only at starts where enough of the unit's runs of q words lie on diagonals within k of the start; k
   edits spoil at most k * q runs, so no leak escapes.
2. A random walk (CGK) over the window, as long as the unit, turns edit distance into Hamming distance. Each repetition samples a
   few steps of its walk; the sample names a bucket, and the buckets' units are the candidates. The repetitions of each length are
   those that reach the target recall on random units edited at random.
3. Candidates are verified by the exact edit distance of the whole item."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.near_dedup import folded
from sievemill.llm.shared import own_columns, stored
from sievemill.llm.text import FIRST, _mix, slices, texts

#: Edits per word of an item, recall of the hashing, sampled steps a repetition.
RATE, RECALL, SAMPLED = 0.2, 0.995, 3
#: Random units by which the recall is counted, lengths between which it isn't counted anew, repetitions tried together.
TRIALS, LENGTHS, TOGETHER = 400, 5, 8
#: Words of a unit; a longer item is cut.
LONGEST = 60
#: A unit in which a run of words occurs more often is filtered by places alone, not by diagonals.
OFTEN = 16
#: Bytes of items sent to tasks at once; a larger benchmark takes several passes over the documents.
ITEM_BYTES = 16 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def edits(n: int) -> int:
    """Edits at which n words still leak."""
    return int(RATE * n + 1e-9)


def walks(h: np.ndarray, starts: np.ndarray, limits: np.ndarray, first: int, times: int, steps: int) -> np.ndarray:
    """CGK: where the walks of some repetitions over windows h[start:limit] are at each step, counted from the start.

    The bit that a repetition's step and the symbol draw says whether the walk moves on."""
    at = np.zeros((times, len(starts)), np.int64)
    out = np.empty((steps, times, len(starts)), np.int16)
    size = (limits - starts)[None]
    draws = (np.arange(first, first + times, dtype=np.uint64) * np.uint64(1_000_003))[:, None]
    top = max(len(h) - 1, 0)
    for j in range(steps):
        out[j] = at
        s = np.where(at < size, h[np.minimum(starts[None] + at, top)], np.uint64(0))
        at += (_mix(s ^ ((draws + np.uint64(j + 1)) * GOLDEN)) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, size, out=at)
    return out


@lru_cache(maxsize=None)
def sampled_steps(repetition: int, n: int) -> tuple[int, ...]:
    """Which steps of the walk over n words a repetition samples: of those that most walks still take within the window."""
    rng = np.random.Generator(np.random.PCG64(repetition))
    return tuple(int(u * max(1, 3 * n // 2)) for u in np.sort(rng.random(SAMPLED)))


def buckets(h: np.ndarray, starts: np.ndarray, limits: np.ndarray, sizes: np.ndarray, first: int, times: int) -> np.ndarray:
    """Bucket of each repetition (rows) for windows h[start:limit] that stand for units of `sizes` words."""
    lengths, place = np.unique(sizes, return_inverse=True)
    steps = np.array([[sampled_steps(first + r, n) for n in lengths.tolist()] for r in range(times)])
    keys = np.empty((times, len(starts)), np.uint64)
    most = max(1, (24 << 20) // (2 * times * (int(steps.max()) + 1)))
    for i in range(0, len(starts), most):
        a, b, which = starts[i : i + most], limits[i : i + most], place[i : i + most]
        seen = walks(h, a, b, first, times, int(steps[:, which].max()) + 1)
        rows, cols = np.arange(times)[:, None], np.arange(len(a))[None]
        key = (lengths[which].astype(np.uint64) * GOLDEN)[None] + np.arange(first + 1, first + times + 1, dtype=np.uint64)[:, None]
        for j in range(SAMPLED):
            at = seen[steps[:, which, j], rows, cols].astype(np.int64)
            s = np.where(a[None] + at < b[None], h[np.minimum(a[None] + at, len(h) - 1)], np.uint64(0))
            key = _mix(key * np.uint64(31) + s + np.uint64(j + 1))
        keys[:, i : i + most] = key
    return keys


def edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """words after k random edits."""
    out = words.tolist()
    for _ in range(k):
        p, new = int(rng.integers(len(out) + 1)), int(rng.integers(1, 1 << 62))
        kind = rng.integers(3)
        if kind == 0 or p == len(out):
            out.insert(p, new)
        elif kind == 1 and len(out) > 1:
            del out[p]
        else:
            out[p] = new
    return np.array(out, np.uint64)


@lru_cache(maxsize=None)
def _counted(n: int) -> int:
    rng = np.random.Generator(np.random.PCG64([3, n]))
    k, rows = edits(n), []
    for _ in range(TRIALS):
        w = rng.integers(1, 1 << 62, n).astype(np.uint64)
        rows += [w, np.concatenate([edited(w, k, rng), rng.integers(1, 1 << 62, n).astype(np.uint64)])[:n]]
    h = np.concatenate(rows)
    starts = np.arange(2 * TRIALS) * n
    open_, times = np.arange(TRIALS), 0
    while True:
        both = np.concatenate([2 * open_, 2 * open_ + 1])
        keys = buckets(h, starts[both], starts[both] + n, np.full(len(both), n), times, TOGETHER)
        met = keys[:, : len(open_)] == keys[:, len(open_) :]
        for r in range(TOGETHER):
            if (~met[: r + 1].any(0)).sum() <= (1 - RECALL) * TRIALS:
                return times + r + 1
        open_, times = open_[~met.any(0)], times + TOGETHER


def repetitions(n: int) -> int:
    """So many that units of n words with RATE * n edits share a bucket in one of them with probability RECALL.

    Counted at the next multiple of LENGTHS, with the very repetitions that an index uses, on random units: so neither edits that spoil
    many repetitions at once nor repetitions unlucky for a length are averaged away. There is no upper limit."""
    return _counted(-(-n // LENGTHS) * LENGTHS) if edits(n) else 1


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of the item to any run of text, and the end of the first such run.

    Columns of the table of distances as bits of one integer (Myers)."""
    m, at = len(item), {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << m - 1
    up, down, score, best, end = mask, 0, m, m, 0
    for j, w in enumerate(text.tolist(), 1):
        same = at.get(w, 0)
        x = same | down
        d = (((same & up) + up) ^ up | same) & mask
        right, left = down | mask & ~(d | up), up & d
        if right & high:
            score += 1
        elif left & high:
            score -= 1
            if score < best:
                best, end = score, j
        right, left = right << 1 & mask, left << 1 & mask
        up, down = left | mask & ~(x | right), right & x
    return best, end


def located(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Distance, first word and number of words of the closest run."""
    d, end = best_match(item, text)
    _, back = best_match(item[::-1], text[:end][::-1])
    return d, end - back, back


@dataclass
class Units:
    """Units of all items, as columns."""

    item: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    need: np.ndarray
    #: a start has `need` shared runs from `before` before it to `after` after it, by diagonal or by place
    before: np.ndarray
    after: np.ndarray


class Index:
    """Items with their units: runs of words by hash, and buckets."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        rows, grams = [], {1: [], 2: [], 3: []}
        for i, w in enumerate(words):
            n = -(-len(w) // LONGEST)
            cuts = [len(w) * j // n for j in range(n + 1)] if n else []
            for a, b in zip(cuts, cuts[1:]):
                size, k = b - a, edits(b - a)
                q = next(q for q in (3, 2, 1) if q <= size and size - q + 1 - k * q >= 1)
                g = FIRST.windows(w[a:b], q)
                names, times = np.unique(g, return_counts=True)
                place = np.arange(len(g)) if times.max() <= OFTEN else np.zeros(len(names), np.int64)
                grams[q].append((g if times.max() <= OFTEN else names, np.full(len(place), len(rows)), place))
                rows.append((i, a, size, size - q + 1 - k * q, *((k, k) if times.max() <= OFTEN else (0, size + k - q))))
        self.units = Units(*(np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 6)
        self.grams = {}
        for q, found in grams.items():
            if found:
                keys, unit, place = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((place, unit, keys))
                bits = np.zeros(1 << 20, bool)
                bits[keys >> np.uint64(44)] = True
                self.grams[q] = (bits, keys[order], unit[order].astype(np.int32), place[order].astype(np.int32))
        u = self.units
        self.times = np.array([repetitions(n) for n in u.size.tolist()], np.int64)
        h = np.concatenate([np.zeros(0, np.uint64), *words])
        base = (np.cumsum([len(w) for w in words]) - [len(w) for w in words]) if words else np.zeros(0, np.int64)
        keys, unit = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for r in range(0, int(self.times.max(initial=0)), TOGETHER):
            own = np.flatnonzero(self.times > r)
            starts = base[u.item[own]] + u.offset[own]
            found = buckets(h, starts, starts + u.size[own], u.size[own], r, TOGETHER)
            used = r + np.arange(TOGETHER)[:, None] < self.times[own][None]
            keys.append(found[used])
            unit.append(np.broadcast_to(own, found.shape)[used])
        keys, unit = np.concatenate(keys), np.concatenate(unit)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_unit = keys[order], unit[order].astype(np.int32)

    def starts(self, h: np.ndarray, of: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, start) of every window worth hashing: those that hold enough of the unit's runs."""
        ends = np.repeat(offs[1:], np.diff(offs))
        found_unit, found_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, (bits, keys, unit, place) in self.grams.items():
            g = FIRST.windows(h, q)
            at = np.flatnonzero(bits[g >> np.uint64(44)])
            at = at[at + q <= ends[at]]
            lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            p = np.repeat(at, n)
            e = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            which, x = unit[e].astype(np.int64), p - place[e]
            text = of[p]
            order = np.lexsort((x, which, text))
            which, x, text = which[order], x[order], text[order]
            u = self.units
            last = np.arange(len(x)) + u.need[which] - 1
            inside = last < len(x)
            first, last = np.flatnonzero(inside), last[inside]
            w = which[first]
            ok = (which[last] == w) & (text[last] == text[first]) & (x[last] - x[first] <= u.before[w] + u.after[w])
            first, last, w = first[ok], last[ok], w[ok]
            # starts from after the last needed run to before the first
            a, b = np.maximum(x[last] - u.after[w], offs[text[first]]), np.minimum(x[first] + u.before[w], offs[text[first] + 1] - 1)
            size = np.maximum(b - a + 1, 0)
            s = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pair = np.unique((np.repeat(w, size) << 40) | s)
            found_unit.append(pair >> 40)
            found_start.append(pair & (1 << 40) - 1)
        return np.concatenate(found_unit), np.concatenate(found_start)

    def collisions(self, h: np.ndarray, ends: np.ndarray, unit: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(text's start, unit) pairs as rows (window, unit) of all windows that share a bucket with a unit of their length.

        A window is tried until it meets a unit; the buckets of all units are looked up, not only those of the unit that chose the window."""
        size = self.units.size[unit]
        window, back = np.unique(np.stack([start, size]), axis=1, return_inverse=True)
        start, size = window
        limit = np.minimum(start + size, ends[start])
        times = np.zeros(len(start), np.int64)
        np.maximum.at(times, back.ravel(), self.times[unit])
        open_, out = np.arange(len(start)), [np.zeros((2, 0), np.int64)]
        r = 0
        while len(open_):
            keys = buckets(h, start[open_], limit[open_], size[open_], r, TOGETHER)
            lo = np.searchsorted(self.keys, keys, "left")
            hit = self.keys[np.minimum(lo, len(self.keys) - 1)] == keys
            if hit.any():
                n = np.searchsorted(self.keys, keys[hit], "right") - lo[hit]
                e = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append(np.stack([np.repeat(open_[np.nonzero(hit)[1]], n), self.key_unit[e]]))
            r += TOGETHER
            open_ = open_[times[open_] > r]
        met = np.unique(np.concatenate(out, 1), axis=1)
        return np.stack([start[met[0]], met[1]])

    def leaks(self, h: np.ndarray, of: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item's place, first word, number of words, distance) of the closest run of each leak."""
        if not len(self.units.size) or not len(h):
            return []
        unit, start = self.starts(h, of, offs)
        if not len(unit):
            return []
        start, unit = self.collisions(h, np.repeat(offs[1:], np.diff(offs)), unit, start)
        item = self.units.item[unit]
        zero = start - self.units.offset[unit]
        order = np.lexsort((zero, item, of[start]))
        text, item, zero = of[start][order], item[order], zero[order]
        found = []
        cut = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1])]) if len(item) else []
        for a, b in zip(cut, np.r_[cut[1:], len(item)] if len(item) else []):
            t, w = int(text[a]), self.words[item[a]]
            n, k = len(w), edits(len(w))
            best = None
            # stretches of starts so near each other that a run may reach over both
            parts = np.flatnonzero(np.r_[True, np.diff(zero[a:b]) > n + 4 * k])
            for c, d in zip(parts, np.r_[parts[1:], b - a]):
                lo, hi = max(int(offs[t]), int(zero[a + c]) - 2 * k), min(int(offs[t + 1]), int(zero[a + d - 1]) + n + 3 * k)
                distance, first, size = located(w, h[lo:hi]) if hi > lo else (n, 0, 0)
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, lo + first - int(offs[t]), size)
            if best is not None:
                found.append((t, int(item[a]), best[1], best[2], best[0]))
        return found


def word_hashes(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for i, _, part in slices(texts(column)):
        words = folded(part).words()
        yield i, words.hashes(), words.text_of, words.offs


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that leaks into it: the closest run of words (the first of equally close ones).

    Returns id_col, item_col, first_word (from 0), n_words, distance (edits in words). Null texts count as empty; an item
    without words leaks nowhere; items of fewer than 5 words allow no edit. Rows are judged one by one, whatever their ids: a null id
    of a document or an item is returned as null, and repeated rows give repeated hits. Texts and items are compared whole, however long. Other
    columns are ignored, whatever their names. Empty tables give none. A benchmark of more than ITEM_BYTES is
    taken in parts of at most that size, one pass over the documents each."""
    items = own_columns(benchmark, item_col, item_text_col).toDF("id", "text").select("id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    parts = int(size // (ITEM_BYTES // 2)) + 1
    d = own_columns(docs, id_col, text_col).toDF("id", "text")
    hit = f"doc {dict(d.dtypes)['id']}, item {dict(items.dtypes)['id']}, first_word long, n_words long, distance long"
    out = None
    for p in range(parts):
        one = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p)
        table = one.toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
        words = []
        for _, h, _, offs in word_hashes(table["text"]):
            words += [h[a:b] for a, b in zip(offs[:-1], offs[1:])]
        index, names = Index(words), table["id"].combine_chunks()

        def rows(batches: Iterator[pa.RecordBatch], index: Index = index, names: pa.Array = names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("id")
                for i, h, of, offs in word_hashes(batch.column("text")):
                    found = index.leaks(h, of, offs)
                    if found:
                        t, item, *rest = zip(*found)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([i + x for x in t])), names.take(pa.array(item)), *(pa.array(c, pa.int64()) for c in rest)], ["doc", "item", "first_word", "n_words", "distance"])

        hits = d.mapInArrow(rows, hit)
        if parts > 1:
            hits = stored(hits, "leaks")
        out = hits if out is None else out.union(hits)
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})
