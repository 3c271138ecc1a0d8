"""Token ids of whole texts by a public tokenizer, many texts at once inside a task.

The tokenizer splits at white space and between letters and marks, so the ids of a text
are those of its units one after the other. Each distinct unit goes through the
tokenizers library once for a worker; texts are put together from these ids with numpy.
A text in which a special token is written out goes through the library as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chronofold.llm import words as W

KEPT_UNITS = 4_000_000
"""Distinct units a worker remembers; it starts anew beyond (speed only, never results)."""

SLICE = 4 << 20
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts. Units and their ids are held as sorted hashes over one pool of ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocabulary = self.library.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        ids = [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.pool) + np.cumsum(count) - count
        flat = np.fromiter((i for one in ids for i in one), np.uint32, int(count.sum()))
        at = np.searchsorted(self.keys, keys)
        self.pool = np.concatenate([self.pool, flat])
        self.keys, self.first, self.count = (
            np.insert(old, at, new) for old, new in ((self.keys, keys), (self.first, first), (self.count, count))
        )

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) and the number of ids of each text."""
        hashes, start, end, word = W.word_hashes(buf, offsets, cut_after_letters=True)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.isin(keys, self.keys, assume_unique=True)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > KEPT_UNITS:
                self._forget()  # a text with more units than that is learnt whole and forgotten next
                known[:] = False
            new = where[~known]
            units = [bytes(buf[s:e]).decode() for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            self._learn(keys[~known], units)
        place = np.searchsorted(self.keys, keys)
        first, count = self.first[place][back], self.count[place][back]
        ids = self.pool[W.ragged(first, count)]
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, before[word[1:]] - before[word[:-1]]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_rows(column: pa.Array, path: str, end_id: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, flat ids, offsets of the rows' ids) for runs of rows of a text column.

    Null is an empty text. ``end_id`` follows the ids of every text, also of empty ones.
    """
    coder = encoder(path)
    column = column.cast(pa.large_string()).fill_null("")
    odd = np.zeros(len(column), bool)
    for token in coder.special:
        odd |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
    if odd.any():
        column_here = pc.if_else(pa.array(~odd), column, "")
    else:
        column_here = column
    buf, offsets = W.text_bytes(column_here)
    for lo, hi in W.row_slices(offsets, SLICE):
        part = offsets[lo : hi + 1]
        ids, n = coder.encode(buf[part[0] : part[-1]], part - part[0])
        if odd[lo:hi].any():
            cut = np.split(ids, np.cumsum(n)[:-1])
            for i in np.flatnonzero(odd[lo:hi]):
                cut[i] = coder.whole(column[lo + int(i)].as_py())
            ids, n = np.concatenate(cut), np.array([len(x) for x in cut], np.int64)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
            n = n + 1
        yield lo, ids, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
