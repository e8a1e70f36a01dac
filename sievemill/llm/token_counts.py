"""Token counts under a unigram model, with forward scores shared along a trie of pre-tokens.

Every word with the mark of a word's beginning is a pre-token. The distinct new ones of a slice, in order, walk a
trie: the best scores of the prefix that a pre-token shares with its predecessor are kept, only the rest is
scored. Terminal counts are kept by hash, so a word is scored once per worker however often it occurs.

The pieces are those of a public vocabulary; nothing is trained. Its order gives their probabilities by Zipf's law:
a piece of rank r has probability in proportion to 1 / (r + 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievemill.llm.shared import own_columns
from sievemill.llm.text import FIRST, slices, texts

MARK = "▁"
#: What an unknown character scores below the rarest piece; it counts as its bytes.
UNKNOWN = -10.0
#: Hashes with counts that a worker keeps, 16 bytes each; beyond it starts anew.
KEPT = 2_000_000
SLICE = 4 << 20
MOST_PIECES = 1_000_000


def pieces(model_path: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary and their log probabilities; bytes, control and unknown ones aside."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    if n > MOST_PIECES:
        raise ValueError(f"a vocabulary of {n} pieces is too large to send to every task")
    real = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    real.sort(key=lambda i: (-sp.get_score(i), i))
    norm = np.log((1.0 / np.arange(1, len(real) + 1)).sum())
    return {sp.id_to_piece(i): float(-np.log(r + 1) - norm) for r, i in enumerate(real)}


class Counter:
    """Counts of pre-tokens; keeps what it has counted."""

    def __init__(self, vocabulary: dict[str, float]):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        self.unknown = min(vocabulary.values(), default=0.0) + UNKNOWN
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def score(self, words: list[str]) -> list[int]:
        """Tokens of each of some sorted words, by one walk of their trie."""
        get, longest, unknown = self.vocabulary.get, self.longest, self.unknown
        before, out = "", []
        best, count = [0.0], [0]
        for word in words:
            word = MARK + word
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, tokens = -1e300, 0
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None and best[start] + s > top:
                        top, tokens = best[start] + s, count[start] + 1
                if word[end - 1] not in self.vocabulary:
                    s = best[end - 1] + unknown
                    if s > top:
                        top, tokens = s, count[end - 1] + len(word[end - 1].encode())
                best.append(top)
                count.append(tokens)
            out.append(count[-1])
            before = word
        return out

    def of(self, hashes: np.ndarray, word: "callable") -> np.ndarray:
        """Counts of hashed words; word(i) gives the i-th."""
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        counts = np.zeros(len(keys), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            pairs = sorted((word(first[i]), i) for i in new.tolist())
            counts[[i for _, i in pairs]] = self.score([w for w, _ in pairs])
            if len(self.keys) + len(new) > KEPT:
                self.keys, self.counts = self.keys[:0], self.counts[:0]
                at = np.zeros(len(keys), int)
            self.keys, self.counts = np.insert(self.keys, at[new], keys[new]), np.insert(self.counts, at[new], counts[new])
        return counts[back]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text.

    Returns id_col, n_words, n_tokens. A null or empty text has none. Null and repeated ids are counted row by row; other
    columns are ignored, whatever their names; an empty table gives an empty one. Of segmentations with equal scores the one whose last piece is longest counts.
    Texts are read whole, and words of any length are scored whole. Ids may be of any type. The vocabulary's size is checked before it is sent to tasks."""
    vocabulary = pieces(model_path)
    d = own_columns(docs, id_col, text_col).toDF("id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            for i, j, part in slices(texts(batch.column("text")), SLICE):
                words = part.words()
                per_word = counter.of(words.hashes(FIRST), lambda k: part.buf[words.starts[k] : words.ends[k]].tobytes().decode())
                total = np.zeros(len(words) + 1, np.int64)
                np.cumsum(per_word, out=total[1:])
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.array(words.counts.astype(np.int64)), pa.array(np.diff(total[words.offs]))], ["id", "n_words", "n_tokens"])

    return d.mapInArrow(rows, f"id {dict(d.dtypes)['id']}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
