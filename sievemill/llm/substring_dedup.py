"""Passages that repeat across documents, found by anchors at the positions of a difference cover.

Two equal runs of at least `window` words, at whatever places of their documents, share an
anchor: places p = i + s and q = j + s, s < PERIOD, with both p and q modulo PERIOD in COVER.
So only the `window - PERIOD + 1` words at cover places are hashed and compared over the
corpus, and only windows around anchors that two documents share are looked at in full.

Nothing here pairs documents. Each chunk of documents sends its distinct hashes once, a bucket of
hashes answers each chunk that holds a hash others hold too; so a passage in a third of all
documents is one entry per chunk. Documents are shuffled once (the plan reuses the exchange)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.shared import own_columns, pieces, text_bytes
from sievemill.llm.text import FIRST, SECOND, Words, packed, slices, texts, values

PERIOD, COVER = 7, (1, 2, 4)
#: A window's hash of 96 bits and the smallest id that has it.
ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("id", "<i8")])
MESSAGE = "bucket int, chunk int, body binary"


def _period(window: int) -> tuple[int, tuple[int, ...]]:
    return (PERIOD, COVER) if window > PERIOD else (1, (0,))


def _anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors and their hashes."""
    period, cover = _period(window)
    at = words.window_starts(window - period + 1)
    place = at - np.repeat(words.offs[:-1], words.counts)[at]
    at = at[np.isin(place % period, cover)]
    return at, FIRST.windows(hashes, window - period + 1)[at] if len(at) else np.zeros(0, np.uint64)


def _pack(values_: np.ndarray) -> bytes:
    """Entries column by column, ids byte by byte: most bytes of ids are alike, which the shuffle's compression uses."""
    if values_.dtype != ENTRY:
        return values_.tobytes()
    return values_["a"].tobytes() + values_["b"].tobytes() + np.ascontiguousarray(values_["id"]).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(bodies: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries, and how many each body has."""
    raw, offs = packed(bodies, np.uint8)
    if kind != ENTRY:
        return raw.view(kind), np.diff(offs) // 8
    n = np.diff(offs) // 20
    out, to = np.empty(n.sum(), ENTRY), 0
    for o, k in zip(offs[:-1].tolist(), n.tolist()):
        out["a"][to : to + k] = np.frombuffer(raw, "<u8", k, o)
        out["b"][to : to + k] = np.frombuffer(raw, "<u4", k, o + 8 * k)
        out["id"][to : to + k] = np.ascontiguousarray(raw[o + 12 * k : o + 20 * k].reshape(8, k).T).view("<i8").ravel()
        to += k
    return out, n


def _grouped(group: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each group and its packed entries."""
    order = np.argsort(group, kind="stable")
    ids, first = np.unique(group[order], return_index=True)
    body, ends = body[order], np.append(first, len(order))
    return ids, pa.array([_pack(body[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())


def _send(chunk: int, keys: np.ndarray, body: np.ndarray, n: int) -> pa.Table:
    """One row per bucket of keys; a bucket is a range of hashes."""
    ids, bodies = _grouped(((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64), body)
    return pa.table({"bucket": pa.array(ids, pa.int32()), "chunk": pa.array(np.full(len(ids), chunk), pa.int32()), "body": bodies})


def _answer(kind: np.dtype, answer: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    def reply(table: pa.Table) -> pa.Table:
        body, n = _unpack(table["body"], kind)
        body, chunk = answer(body, np.repeat(values(table["chunk"]), n))
        ids, bodies = _grouped(chunk, body)
        return pa.table({"chunk": pa.array(ids, pa.int32()), "body": bodies})

    return reply


def _shared(hashes: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose hash more than one chunk sent."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return h[twice], chunk[order][twice]


def _earlier(entries: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry that another chunk has with a smaller id: that id."""
    order = np.lexsort((entries["id"], entries["b"], entries["a"]))
    e, c = entries[order], chunk[order]
    if not len(e):
        return e, c
    new = np.r_[True, (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])]
    least = e["id"][np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))]
    later = least < e["id"]
    e, c = e[later].copy(), c[later]
    e["id"] = least[later]
    return e, c


def _candidates(table: pa.Table, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a chunk around anchors that it shares with another chunk, or within itself.

    Row of the document, place of its first word, and both hashes of the window."""
    period, _ = _period(window)
    has_id = table["id"].is_valid().to_numpy()
    found = []
    # anchors that two documents of this chunk share
    own, rows = [], []
    for i, _, part in slices(texts(table["text"])):
        words = part.words()
        at, h = _anchors(words, words.hashes(), window)
        row = words.text_of[at] + i
        own.append(h[has_id[row]])
        rows.append(row[has_id[row]])
    h, r = np.concatenate([np.zeros(0, np.uint64), *own]), np.concatenate([np.zeros(0, np.int64), *rows])
    order = np.argsort(h, kind="stable")
    h, r = h[order], r[order]
    same = (h[1:] == h[:-1]) & (r[1:] != r[:-1])
    shared = np.union1d(shared, h[1:][same])
    for i, _, part in slices(texts(table["text"])):
        words = part.words()
        a = words.hashes()
        at, h = _anchors(words, a, window)
        at = at[has_id[words.text_of[at] + i]]
        h = FIRST.windows(a, window - period + 1)[at] if len(at) else h[:0]
        k = np.searchsorted(shared, h)
        at = at[shared[np.minimum(k, len(shared) - 1)] == h] if len(shared) else at[:0]
        near = np.zeros(len(words) + 1, np.int32)
        np.add.at(near, np.maximum(at - period + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        starts = words.window_starts(window)
        starts = starts[np.cumsum(near)[starts] > 0]
        if len(starts):
            row = words.text_of[starts] + i
            b = words.hashes(SECOND)
            found.append((row, starts - words.offs[row - i], FIRST.windows(a, window)[starts], SECOND.windows(b, window)[starts]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _first_ids(entries: np.ndarray) -> np.ndarray:
    """Each window once, with its smallest id, by hash."""
    e = entries[np.lexsort((entries["id"], entries["b"], entries["a"]))]
    if not len(e):
        return e
    return e[np.r_[True, (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])]]


def _entries(table: pa.Table, found: tuple[np.ndarray, ...]) -> np.ndarray:
    row, _, a, b = found
    e = np.empty(len(row), ENTRY)
    e["a"], e["b"] = a, b >> np.uint64(32)
    ids = table["id"].fill_null(0)
    e["id"] = values(ids)[row] if len(row) else 0
    return e


def _lookup(sorted_: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The id that sorted_ has for each window of e; the largest integer where it has none."""
    none = np.full(len(e), np.iinfo(np.int64).max)
    if not len(sorted_):
        return none
    # 64 bits order the entries; the rare equal ones are told apart by the others
    k = np.searchsorted(sorted_["a"], e["a"])
    out, open_ = none, np.ones(len(e), bool)
    while True:
        k2 = np.minimum(k, len(sorted_) - 1)
        open_ &= (k < len(sorted_)) & (sorted_["a"][k2] == e["a"])
        if not open_.any():
            return out
        hit = open_ & (sorted_["b"][k2] == e["b"])
        out[hit] = sorted_["id"][k2][hit]
        open_ &= ~hit
        k = k + 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Remove each word that a window of `window` words covers which a document with a smaller id also has.

    Returns id_col, n_words, n_removed, kept_text (kept words joined by one space). Windows are those of the
    input. A null text counts as empty; an empty one has no words. A row with a null id removes nothing and
    loses nothing. Rows that repeat an id don't affect each other, not even equal ones; ids are integers. Texts are compared whole, however long. Other
    columns are ignored, whatever their names; an empty table gives an empty one.

    Rows without an id and texts too short for a window pass by; all others are spread by id and text."""
    size = text_bytes(docs)
    n_chunks, n_buckets = pieces(size), pieces(size * 0.7)
    d = own_columns(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    alone = F.col("id").isNull() | (F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * window - 1)
    short = d.where(alone)
    d = d.where(~alone).select(F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks)).cast("int").alias("chunk"), "id", "text")

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in slices(texts(batch.column("text"))):
                words = part.words()
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.array(words.counts.astype(np.int64)), pa.array(np.zeros(j - i, np.int64)), words.joined(np.ones(len(words), bool))], ["id", "n_words", "n_removed", "kept_text"])

    def chunk_of(table: pa.Table) -> int:
        return table["chunk"][0].as_py()

    def anchors(table: pa.Table) -> pa.Table:
        t = table.filter(table["id"].is_valid())
        hashes = [np.zeros(0, np.uint64)]
        for _, _, part in slices(texts(t["text"])):
            words = part.words()
            hashes.append(_anchors(words, words.hashes(), window)[1])
        h = np.unique(np.concatenate(hashes))
        return _send(chunk_of(table), h, h, n_buckets)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        e = _first_ids(_entries(left, _candidates(left, np.unique(_unpack(right["body"], np.uint64)[0]), window)))
        return _send(chunk_of(left), e["a"], e, n_buckets)

    def cut(left: pa.Table, shared: np.ndarray, earlier: np.ndarray) -> pa.Table:
        found = _candidates(left, shared, window)
        e = _entries(left, found)
        least = np.minimum(_lookup(_first_ids(e), e), _lookup(_first_ids(earlier), e))
        hit = least < e["id"]
        rows, places = found[0][hit], found[1][hit]
        order = np.argsort(rows, kind="stable")
        rows, places = rows[order], places[order]
        n_words, n_removed, kept = [], [], []
        for i, j, part in slices(texts(left["text"])):
            words = part.words()
            lo, hi = np.searchsorted(rows, (i, j))
            at = words.offs[rows[lo:hi] - i] + places[lo:hi]
            cover = np.zeros(len(words) + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            n_words.append(words.counts)
            n_removed.append(np.diff(sums[words.offs]))
            kept.append(words.joined(~gone))
        return pa.table({"id": left["id"], "n_words": pa.array(np.concatenate(n_words), pa.int64()), "n_removed": pa.array(np.concatenate(n_removed), pa.int64()), "kept_text": pa.chunked_array(kept, pa.string())})

    def cut_both(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right["kind"].to_numpy()
        return cut(left, np.unique(_unpack(right.filter(kind == 0)["body"], np.uint64)[0]), _unpack(right.filter(kind == 1)["body"], ENTRY)[0])

    by_chunk = lambda df: df.groupBy("chunk")
    shared = by_chunk(d).applyInArrow(anchors, MESSAGE).groupBy("bucket").applyInArrow(_answer(np.uint64, _shared), "chunk int, body binary")
    earlier = by_chunk(d).cogroup(by_chunk(shared)).applyInArrow(windows, MESSAGE).groupBy("bucket").applyInArrow(_answer(ENTRY, _earlier), "chunk int, body binary")
    told = shared.withColumn("kind", F.lit(0)).union(earlier.withColumn("kind", F.lit(1)))
    result = "id long, n_words long, n_removed long, kept_text string"
    out = by_chunk(d).cogroup(by_chunk(told)).applyInArrow(cut_both, result).union(short.mapInArrow(unchanged, result))
    return out.withColumnRenamed("id", id_col)
