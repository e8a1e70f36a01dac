"""Near duplicates: ProbMinHash signatures of weighted shingles, banding, verification, groups.

A text's shingles are its runs of SHINGLE words without case and ASCII punctuation, weighted by how often
they occur. Each shingle sends a Poisson process of arrivals at the rate of its weight to random registers; the first
arrival at a register names its shingle. Arrivals are drawn in time order and stop once every register
is filled (early termination), so a long text costs hardly more than a short one. Two texts agree in a register
with the probability of their probability Jaccard similarity.

Texts whose words are the same are one class and compared once. Classes that share a band are candidates.
Whole signatures decide those that agree far more or far less than the threshold; pairs within MARGIN of it are decided
by the exact similarity of all their shingles. A band that many classes share is cut into tiles of two blocks each, spread over
tasks, so no task holds it whole; a pair is counted in the first band it shares. Tasks return counts and a
spanning forest of their links, never the pairs: classes that are near the threshold to some other one come back with
the band they share, and get a second pass over that band with their shingles, in tiles of so many bytes.

Whoever asks for groups only, and not for numbers of links, is spared what can't change a group: classes that links already
connect are not decided on, neither inside a tile nor in the second pass, which a band enters only if it holds several of
the first pass's groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.shared import dropped, joined, own_columns, stored
from sievemill.llm.stats import keyed
from sievemill.llm.text import FIRST, SECOND, SEPARATOR, Texts, Words, _mix, slices, texts

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 42, 3, 0.5
REGISTERS = BANDS * ROWS
#: Pairs whose estimate is this near the threshold are decided exactly: four standard errors at 0.5.
MARGIN = 0.18
#: Keys of classes to decide are sent to tasks as so many bits at most.
KEY_BITS = 20
#: Classes of one block of a band; bytes of shingles of one block, and rows sent at once, where shingles are compared.
BLOCK, BLOCK_BYTES, ROWS_AT_ONCE = 2048, 8 << 20, 1000
#: Where only groups are asked for: tiles of more rows are taken one by one; pairs decided at once, the most similar first, after which those they
#: connected are left out; pairs near the threshold that wait until a tile's links are known, beyond which they are looked for again.
FEW, AT_ONCE, HELD = 24, 256, 1 << 18
_DROP = np.zeros(256, bool)
_DROP[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def folded(part: Texts) -> Texts:
    """The texts in lower case (ASCII and Latin-1) without ASCII punctuation."""
    buf = _FOLD[part.buf]
    if len(buf) > 1:
        tail = buf[1:]
        tail[(part.buf[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    keep = ~_DROP[buf]
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return Texts(buf[keep], at[part.offs])


def _signatures(h: np.ndarray, of: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash of n texts from distinct shingles h of texts `of` with weights w: 16 bits per register."""
    m = REGISTERS
    total = np.bincount(of, w, minlength=n)
    best = np.full(n * m, np.inf)
    name = np.zeros(n * m, np.uint16)
    limit = np.where(total > 0, m / np.maximum(total, 1e-9) * (np.log(m) + 1), 0)
    golden = np.uint64(0x9E3779B97F4A7C15)

    def draw(x: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = _mix(x + k.astype(np.uint64) * golden)
        wait = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
        return wait, ((_mix(u ^ golden) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)

    k = np.ones(len(h), np.int64)
    wait, register = draw(h, k)
    t = wait / w
    prints = (_mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(48)).astype(np.uint16)
    alive = np.flatnonzero(t <= limit[of])
    while True:
        while len(alive):
            target = of[alive] * m + register[alive]
            better = t[alive] < best[target]
            a, target = alive[better], target[better]
            order = np.argsort(-t[a], kind="stable")  # of equal targets the last, the earliest, stays
            best[target[order]] = t[a][order]
            name[target[order]] = prints[a][order]
            k[alive] += 1
            wait, register[alive] = draw(h[alive], k[alive])
            t[alive] += wait / w[alive]
            alive = alive[t[alive] <= limit[of[alive]]]
        open_ = (total > 0) & np.isinf(best.reshape(n, m)).any(1)
        if not open_.any():
            return name.reshape(n, m)
        limit[open_] *= 1.4
        alive = np.flatnonzero(open_[of] & (t <= limit[of]))


def _whole(words: Words, h: np.ndarray) -> np.ndarray:
    """A hash of all words of each text in order: differences of one rolling sum."""
    up, down = SECOND.words(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return _mix((sums[words.offs[1:]] - sums[words.offs[:-1]]) * down[words.offs[:-1]] + words.counts.astype(np.uint64))


def _shingles(words: Words, h: np.ndarray, whole: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (of those in `only`), the text and the weight of each, by text."""
    counts, of = words.counts, words.text_of
    starts = words.window_starts(SHINGLE)
    s, s_of = FIRST.windows(h, SHINGLE)[starts] if len(starts) else h[:0], of[starts]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    s, s_of = np.concatenate([s, whole[short]]), np.concatenate([s_of, short])
    if only is not None:
        s, s_of = s[only[s_of]], s_of[only[s_of]]
    key = keyed(s, s_of)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, np.diff(key[order]) != 0] if len(order) else np.zeros(0, bool)
    at = order[new]
    w = np.diff(np.r_[np.flatnonzero(new), len(order)]).astype(np.float64)
    by = np.argsort(s_of[at], kind="stable")
    return s[at][by], s_of[at][by], w[by]


def signatures(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each text's words, number of words, and signature."""
    words = folded(part).words(SEPARATOR)
    h = words.hashes()
    whole = _whole(words, h)
    return whole, words.counts, _signatures(*_shingles(words, h, whole), len(part))


def shingle_sets(part: Texts, bits: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Class keys whose low bits are set, each once, and their shingles: sorted hashes, then weights."""
    words = folded(part).words(SEPARATOR)
    h = words.hashes()
    whole = _whole(words, h)
    only = np.zeros(len(part), bool)
    only[np.unique(whole, return_index=True)[1]] = True
    only &= bits[whole & np.uint64(len(bits) - 1)] & (words.counts > 0)
    s, of, w = _shingles(words, h, whole, only)
    order = np.lexsort((s, of))
    s, w = s[order], w[order].astype(np.uint32)
    named = np.flatnonzero(only)
    lo, hi = np.searchsorted(of, named, "left").tolist(), np.searchsorted(of, named, "right").tolist()
    return whole[named].view(np.int64).tolist(), [s[a:b].tobytes() + w[a:b].tobytes() for a, b in zip(lo, hi)]


def _unpacked(shingles: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(shingles) // 12
    return np.frombuffer(shingles, np.uint64, n), np.frombuffer(shingles, np.uint32, n, 8 * n).astype(np.float64)


def similarity(one: bytes, other: bytes) -> float:
    """Probability Jaccard similarity of two sets of weighted shingles."""
    return _similarity(_unpacked(one), _unpacked(other))


def _similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    (g, v), (h, w) = one, other
    if len(g) > len(h):
        g, v, h, w = h, w, g, v
    j = np.minimum(np.searchsorted(h, g), max(len(h) - 1, 0))
    i = np.flatnonzero(h[j] == g) if len(h) else j[:0]
    j = j[i]
    if not len(i):
        return 0.0
    order = np.argsort(v[i] / w[j], kind="stable")
    x, y = v[i][order], w[j][order]
    # of max(x_j / x_i, y_j / y_i) the first is larger from i on in the order of x / y, the second before
    above, below = v.sum() - np.cumsum(x) + x, w.sum() - y.sum() + np.cumsum(y) - y
    return float((1 / (above / x + below / y)).sum())


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b: the smallest node that each is connected to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label != label[label]).any():
        label = label[label]
    return label


def _links(tile: np.ndarray, band: np.ndarray, block: np.ndarray, mixed: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows a < b of one tile that may be similar and share no earlier band, and whether they are beyond doubt. tile: equal for the rows of a tile, which are together."""
    found_a, found_b, found_sure = [], [], []
    n = len(tile)
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]), n]).max() if n else 0
    at, d = np.arange(n), 0
    while d + 1 < size:
        d += 1
        at = at[at + d < n]
        at = at[tile[at] == tile[at + d]]
        if not len(at):
            break
        pairs = at[~mixed[at] | (block[at] != block[at + d])]
        for i in range(0, len(pairs), 4096):
            a = pairs[i : i + 4096]
            same = sig[a] == sig[a + d]
            first = same.reshape(len(a), BANDS, ROWS).all(2).argmax(1)
            agree = same.sum(1)
            hit = (first == band[a]) & (agree >= (threshold - MARGIN) * REGISTERS)
            found_a.append(a[hit])
            found_b.append(a[hit] + d)
            found_sure.append(agree[hit] >= (threshold + MARGIN) * REGISTERS)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b]), np.concatenate([none.astype(bool), *found_sure])


def _tiles(tile: np.ndarray, block: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Rows of tiles that have few, and of each other tile its rows, block by block, and how many are in its first block if two are compared."""
    n = len(tile)
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    size = np.diff(np.r_[first, n])
    many = []
    for lo, m in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
        at = np.arange(lo, lo + m)
        if mixed[lo]:
            at = at[np.argsort(block[at], kind="stable")]
        many.append((at, int((block[at] == block[at[0]]).sum()) if mixed[lo] else 0))
    return np.flatnonzero(np.repeat(size <= FEW, size)), many


def _fans(sig: np.ndarray, cut: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each row of a tile, the first of the later rows it is to be compared with, and in how many registers each of them agrees."""
    across = np.ascontiguousarray(sig.T)
    for p in range(cut or len(sig) - 1):
        q = cut or p + 1
        yield p, q, np.add.reduce((across[:, q:] == sig[p][:, None]).view(np.uint8), 0, np.uint8)


def _near(threshold: float) -> tuple[int, int]:
    """In how many registers pairs agree at least to be near the threshold, and to be above it beyond doubt."""
    return max(0, math.ceil((threshold - MARGIN) * REGISTERS)), math.ceil((threshold + MARGIN) * REGISTERS)


def _hits(q: int, agree: np.ndarray, threshold: float) -> np.ndarray:
    """Rows from q on that are near the threshold to the row that agree was counted for."""
    low, high = _near(threshold)
    return q + np.flatnonzero((agree >= low) & (agree < high))


def _apart(p: int, hit: np.ndarray, sig: np.ndarray, band: int, label: np.ndarray) -> np.ndarray:
    """Of the rows hit those that share no earlier band with row p and have another label."""
    hit = hit[label[hit] != label[p]]
    return hit[(sig[hit] == sig[p]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band] if len(hit) else hit


def _merged(label: np.ndarray, p: int, others: np.ndarray) -> np.ndarray:
    """Labels once those of row p and of the others are the same, the least of them."""
    known = label[others]
    if (known == label[p]).all():
        return label
    to = np.arange(len(label))
    to[known] = to[label[p]] = min(known.min(), label[p])
    return to[label]


def _grouped(tile: np.ndarray, band: np.ndarray, block: np.ndarray, mixed: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row, a row of its tile that stands for those that links beyond doubt connect it to; and whether it is near the threshold to one
    that they don't."""
    few, many = _tiles(tile, block, mixed)
    near = np.zeros(len(tile), bool)
    a, b, sure = _links(tile[few], band[few], block[few], mixed[few], sig[few], threshold)
    a, b = few[a], few[b]
    label = _roots(len(tile), a[sure], b[sure])
    apart = ~sure & (label[a] != label[b])
    near[a[apart]] = near[b[apart]] = True
    for at, cut in many:
        s, own, waiting, held = sig[at], np.arange(len(at)), [], 0
        for p, q, agree in _fans(s, cut):
            own = _merged(own, p, q + np.flatnonzero(agree >= _near(threshold)[1]))
            if not own.any():
                break
            if held <= HELD:
                hit = _hits(q, agree, threshold)
                waiting.append((p, hit[own[hit] != own[p]]))
                held += len(waiting[-1][1])
        label[at] = at[own]
        if own.any():
            for p, hit in waiting if held <= HELD else ((p, _hits(q, agree, threshold)) for p, q, agree in _fans(s, cut)):
                to = _apart(p, hit, s, band[at[0]], own)
                near[at[to]] = True
                near[at[p]] |= len(to) > 0
    return label, near


class _Sets:
    """Sets of weighted shingles of a tile; one is compared with many at once."""

    def __init__(self, packed: list):
        self.sets = [_unpacked(x) for x in packed]
        self.total = np.array([w.sum() for _, w in self.sets])
        self.plain = np.array([(w == 1).all() for _, w in self.sets])
        ends = np.cumsum([len(h) for h, _ in self.sets])[:-1]
        names, at = np.unique(np.concatenate([h for h, _ in self.sets]), return_inverse=True)
        self.at = np.split(at.astype(np.int32), ends)
        self.share = [w / t for (_, w), t in zip(self.sets, self.total)]
        self.one = np.zeros(len(names))

    def alike(self, p: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the others have at least the threshold's similarity to p."""
        rows = others.tolist()
        self.one[self.at[p]] = self.share[p]
        least = np.minimum(self.one[np.concatenate([self.at[r] for r in rows])], np.concatenate([self.share[r] for r in rows]))
        self.one[self.at[p]] = 0
        common = np.add.reduceat(least, np.r_[0, np.cumsum([len(self.at[r]) for r in rows])[:-1]])
        # the similarity lies between common / (2 - common) and common; without weights it is that of plain sets
        out = common / (2 - common) >= threshold + 1e-9
        plain = self.plain[others] & self.plain[p]
        both = np.rint(common * np.maximum(self.total[others], self.total[p]))
        out[plain] = (both / (self.total[others] + self.total[p] - both) >= threshold - 1e-9)[plain]
        for k in np.flatnonzero(~plain & ~out & (common >= threshold - 2e-9)).tolist():
            out[k] = _similarity(self.sets[p], self.sets[rows[k]]) >= threshold - 1e-9
        return out


def _bridges(tile: np.ndarray, band: np.ndarray, block: np.ndarray, mixed: np.ndarray, sig: np.ndarray, shingles: pa.ChunkedArray, group: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Groups of the rows of a tile that are connected by links near the threshold, by their shingles, as links between groups."""
    few, many = _tiles(tile, block, mixed)
    a, b, sure = _links(tile[few], band[few], block[few], mixed[few], sig[few], threshold)
    a, b = few[a[~sure]], few[b[~sure]]
    a, b = a[group[a] != group[b]], b[group[a] != group[b]]
    sets = {r: _unpacked(shingles[r].as_buffer()) for r in np.unique(np.concatenate([a, b])).tolist()}
    alike = np.array([_similarity(sets[x], sets[y]) >= threshold - 1e-9 for x, y in zip(a.tolist(), b.tolist())], bool)
    found = [(group[a[alike]], group[b[alike]])]
    for at, cut in many:
        names, before = np.unique(group[at], return_inverse=True)
        if len(names) == 1:
            continue
        s, own, whole = sig[at], before, _Sets([shingles[r].as_buffer() for r in at.tolist()])
        for p, q, agree in _fans(s, cut):
            to = _apart(p, _hits(q, agree, threshold), s, band[at[0]], own)
            to = to[np.argsort(-agree[to - q].astype(int), kind="stable")]
            while len(to):
                now, to = to[:AT_ONCE], to[AT_ONCE:]
                own = _merged(own, p, now[whole.alike(p, now, threshold)])
                to = to[own[to] != own[p]]
        changed = np.flatnonzero(own != before)
        pairs = np.unique(np.stack([before[changed], own[changed]]), axis=1)
        found.append((names[pairs[0]], names[pairs[1]]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _compare(threshold: float, exact: bool = False, counted: bool = True):
    """Rows (key, root, n) of counted links, and (key, null, null, bucket, band) of classes that are near the threshold to another; if exact,
    only links among those, by their shingles. If not counted, n is 0, links and classes near the threshold are left out where other links
    connect the same classes, and those by shingles are links between groups."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def nearby(key: np.ndarray, bucket: np.ndarray, band: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(near):
                none = pa.nulls(len(near), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key[near]), none, none, pa.array(bucket[near]), pa.array(band[near].astype(np.int32))], LINKS)

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            col = lambda c: table[c].to_numpy()
            key, band, block, bucket = col("key"), col("band").astype(int), col("block"), col("bucket")
            tile = keyed(_mix(bucket.view(np.uint64) + np.uint64(1)), (col("i").astype(np.int64) << 32) + col("j"))
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(key), REGISTERS)
            if not counted:
                if exact:
                    one, other = _bridges(tile, band, block, col("i") != col("j"), sig, table["shingles"], col("group"), threshold)
                else:
                    label, close = _grouped(tile, band, block, col("i") != col("j"), sig, threshold)
                    yield from nearby(key, bucket, band, np.flatnonzero(close))
                    linked = np.flatnonzero(label != np.arange(len(key)))
                    one, other = key[linked], key[label[linked]]
                if len(one):
                    none = pa.nulls(len(one), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other), pa.array(np.zeros(len(one), np.int64)), none, none.cast(pa.int32())], LINKS)
                return
            a, b, sure = _links(tile, band, block, col("i") != col("j"), sig, threshold)
            if exact:
                a, b = a[~sure], b[~sure]
                sets: dict[int, tuple[np.ndarray, np.ndarray]] = {r: _unpacked(table["shingles"][r].as_buffer()) for r in np.unique(np.concatenate([a, b])).tolist()}
                alike = np.array([_similarity(sets[x], sets[y]) >= threshold - 1e-9 for x, y in zip(a.tolist(), b.tolist())], bool)
                a, b = a[alike], b[alike]
            else:
                yield from nearby(key, bucket, band, np.unique(np.concatenate([a[~sure], b[~sure]])))
                a, b = a[sure], b[sure]
            if len(a):
                keys, place = np.unique(key, return_inverse=True)
                count = np.bincount(place[a], minlength=len(keys)) + np.bincount(place[b], minlength=len(keys))
                root = _roots(len(keys), place[a], place[b])
                linked = np.flatnonzero(count)
                none = pa.nulls(len(linked), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys[linked]), pa.array(keys[root[linked]]), pa.array(count[linked].astype(np.int64)), none, none.cast(pa.int32())], LINKS)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            # the last tile may go on in the next batch
            last = [table[c][-1].as_py() for c in ("bucket", "i", "j")]
            same = np.logical_and.reduce([table[c].to_numpy() == v for c, v in zip(("bucket", "i", "j"), last)])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            yield from done(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield from done(rest)

    return rows


LINKS = ["key", "root", "n", "bucket", "band"]


def _compared(members: DataFrame, classes: DataFrame, threshold: float, exact: bool = False, counted: bool = True) -> DataFrame:
    """Links of members (bucket, band, key, blocks): each bucket's classes in `blocks` blocks, compared block by block."""
    members = members.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("bucket", "band", "key", *(["group"] if exact and not counted else []), "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tiles = members.join(classes, "key").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    links = tiles.mapInArrow(_compare(threshold, exact, counted), "key long, root long, n long, bucket long, band int")
    if not exact:
        return stored(links, "counts")
    conf, name = members.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, ROWS_AT_ONCE)
    try:
        return stored(links, "decided")
    finally:
        conf.set(name, before)


def _decided(d: DataFrame, near: DataFrame, classes: DataFrame, threshold: float, group: DataFrame | None = None) -> DataFrame | None:
    """(key, root, n) of links among classes near the threshold (bucket, band, key), by exact similarity; None if there are no such classes. The
    texts, d, are read once more; shingles are shuffled once for each bucket that a class is near another in, and block of it. With the group
    (key, root) of classes that have one: only buckets of several groups, and links between groups."""
    near = stored(near.distinct(), "near")
    if group is not None:
        near = stored(near.join(group, "key", "left").withColumn("group", F.coalesce("root", "key")).drop("root"), "near")
        several = near.groupBy("bucket").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most")
        near = stored(near.join(several.select("bucket"), "bucket", "left_semi"), "near")
    mask = (1 << KEY_BITS) - 1
    low = near.select(F.col("key").bitwiseAND(F.lit(mask)).alias("low")).distinct().toArrow()["low"].to_numpy()
    if not len(low):
        return None
    bits = np.zeros(mask + 1, bool)
    bits[low] = True

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in slices(texts(batch.column("text"))):
                keys, found = shingle_sets(part, bits)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "shingles"])

    named = near.select("key").distinct()
    whole = d.select("text").mapInArrow(sets, "key long, shingles binary").join(named, "key", "left_semi")
    whole = stored(whole.groupBy("key").agg(F.any_value("shingles").alias("shingles")).join(classes, "key"), "shingles")
    weighed = stored(near.join(whole.select("key", F.octet_length("shingles").cast("long").alias("bytes")), "key"), "near")
    per = stored(weighed.groupBy("bucket").agg(F.sum("bytes").alias("total"), F.count(F.lit(1)).alias("size")), "bands")
    members = joined(weighed, per, "bucket", "size", weighed.count()).withColumn("blocks", F.ceil(F.col("total") / BLOCK_BYTES).cast("int"))
    return _compared(members, whole, threshold, exact=True, counted=group is None)


def components(links: DataFrame) -> DataFrame:
    """(key, root): the smallest key that each is connected to; links are (a, b). Keys without links don't occur.

    Alternating large and small stars: links move to ever smaller neighbours until nothing changes."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None

    def nearest(pairs: DataFrame, n: int) -> DataFrame:
        """pairs (a, b) with the smallest b of each a; an a may be in a third of them."""
        return joined(pairs, pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")), "a", "degree", n)

    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if now == state:
            return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())
        state = now
        both = edges.union(edges.select("b", "a"))
        large = nearest(both, 2 * now.n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        large = stored(large, "links")
        small = nearest(large, large.count())
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, edges = edges, stored(small, "links")
        dropped(before)
        dropped(large)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, counted: bool = True) -> DataFrame:
    """Classes of equal texts and groups of similar ones.

    Returns id_col; class_id, the smallest id whose text has the same words (without case and ASCII punctuation);
    n_copies, rows of that class; n_links, other classes that share a band and whose similarity is at least the threshold (exact within MARGIN of it);
    group_id, the smallest id that links connect it to. If not counted there is no n_links, and the work on a group no longer grows with the
    number of its links; groups are the same. A null text counts as empty; texts without words are one class
    without links. A row with a null id belongs to the class of its text but never names it; a class of null ids
    alone has a null class_id, and a group of those a null group_id. Rows that repeat an id are handled one by one. Texts are compared whole, however
    long; a similarity of exactly the threshold is a link. Other columns are ignored, whatever their names. An empty
    table gives an empty one. Ids are integers."""
    d = own_columns(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in slices(texts(batch.column("text"))):
                whole, counts, sig = signatures(part)
                out = [s.tobytes() if c else None for s, c in zip(sig, counts.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.array(whole.view(np.int64)), pa.array(out, pa.binary())], ["id", "key", "sig"])

    signed = stored(d.mapInArrow(sign, "id long, key long, sig binary"), "signatures")
    classes = stored(signed.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.any_value("sig").alias("sig")), "classes")
    bands = classes.where("sig is not null").select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = joined(bands, stored(shared, "bands"), "bucket", "size", BANDS * classes.count()).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    links = _compared(members, classes.select("key", "sig"), threshold, counted=counted)
    near = links.where("n is null").select("bucket", "band", "key")
    links = links.where("n is not null").select("key", "root", "n")
    ends = lambda x: x.select(F.col("key").alias("a"), F.col("root").alias("b"))
    group = None if counted else components(ends(links))
    decided = _decided(d, near, classes.select("key", "sig"), threshold, group)
    if counted:
        links = links if decided is None else links.union(decided.select("key", "root", "n"))
        group = components(ends(links))
    elif decided is not None:
        group = components(ends(group).union(ends(decided)))
    n_links = ["n_links"] if counted else []
    known = classes.drop("sig").join(group, "key", "left")
    if counted:
        known = known.join(links.groupBy("key").agg(F.sum("n").alias("n_links")), "key", "left").fillna(0, "n_links")
    known = stored(known.withColumn("root", F.coalesce("root", "key")), "known")
    least = known.groupBy("root").agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    known = joined(known, least, "root", "group_size", classes.count())
    known = stored(known.select("key", "class_id", "n_copies", *n_links, "group_id"), "known")
    found = joined(signed.select("id", "key"), known, "key", "n_copies", signed.count())
    return found.select(F.col("id").alias(id_col), "class_id", "n_copies", *n_links, "group_id")
