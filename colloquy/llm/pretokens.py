"""Token ids of whole columns of texts: each distinct piece of text is encoded once per batch.

A column's bytes are cut where every byte-level pattern of this family ends a match whatever
stands around: before white space after other text, after white space that is no blank, and
before the last sign of a run of white space that other text follows. A blank goes with the
text after it. The pieces are views of the column's own buffer; Arrow finds the distinct ones
and puts the ids together, so no Python object is made per piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from colloquy.llm.words import _SPACE, flat

# White space beyond ASCII as Unicode has it, and all of it as a class of a pattern.
WIDE_WHITE = "\x85\xa0  -     　"
WHITE = rf"\t-\r {WIDE_WHITE}"

KNOWN = 300_000  # pieces kept per task, each of at most LONGEST bytes
LONGEST = 64
KEPT = 4 << 20  # bytes of words and their ids kept per task; beyond that only the words of the last column stay


def spelled(pattern: str) -> str:
    r"""A pattern with \s and \S, alone or in a negated class, spelled out: libraries differ in what they count as white space."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


def cuts(raw: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of a column; rows that `whole` marks are one piece, an empty row has none."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    white = _SPACE[raw]
    first = np.zeros(n + 1, dtype=bool)  # of a row
    first[offsets[:-1]] = True
    first[n] = True
    begins = np.zeros(n, dtype=bool)
    before, here = white[:-1], white[1:]
    begins[1:] = here & ~before  # white space after other text
    begins[1:] |= ~here & before & (raw[:-1] != 0x20)  # text after white space that is no blank
    begins[1:-1] |= before[:-1] & here[:-1] & ~white[2:] & ~first[2:-1]  # the last of a run that text follows
    if whole.any():
        begins[np.repeat(whole, np.diff(offsets))] = False
    begins |= first[:-1]
    return np.flatnonzero(begins)


def together(made: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids of pieces, one after the other, and where each piece's begin and end."""
    return np.frombuffer(b"".join(made), "<u4"), np.cumsum([0, *map(len, made)]) // 4


def listed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids, pa.uint32()))


class ColumnEncoder:
    """Ids of columns. `ids_of(piece)` gives a piece's ids as little-endian 32-bit numbers; a piece is UTF-8.

    `words(pieces)`, if given, does the same for a column of distinct words at once and returns what `together` does: a word has no
    white space but for a blank at its front. Rows with one of the strings `special`, or with white space beyond ASCII, are one piece each.
    """

    def __init__(self, ids_of: Callable[[bytes], bytes], words: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] | None = None, special: Sequence[str] = ()):
        import re

        self.ids_of, self.words = ids_of, words
        self.seen, self.lists = pa.array([], pa.large_binary()), pa.array([], pa.large_list(pa.uint32()))
        self.apart = "|".join([f"[{WIDE_WHITE}]", *map(re.escape, special)])
        self.known: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        out = []
        for piece in pieces:
            ids = self.known.get(piece)
            if ids is None:
                ids = self.ids_of(piece)
                if len(piece) <= LONGEST:
                    if len(self.known) >= KNOWN:
                        self.known.clear()
                    self.known[piece] = ids
            out.append(ids)
        return out

    def _word_lists(self, words: pa.Array) -> pa.Array:
        """A list of ids per word. Words of columns before are looked up, so a column may be small without being encoded word by word again."""
        if self.words is None:
            return listed(*together(self._ids(words.to_pylist())))
        at = pc.index_in(words, value_set=self.seen)
        if at.null_count:
            if self.seen.nbytes + self.lists.nbytes > KEPT:
                met = at.drop_null()
                self.seen, self.lists = self.seen.take(met), self.lists.take(met)
                at = pa.array(np.cumsum(at.is_valid()) - 1, pa.int32(), mask=at.is_null().to_numpy(zero_copy_only=False))
            new = at.is_null().to_numpy(zero_copy_only=False)
            place = np.where(new, len(self.seen) + np.cumsum(new) - 1, at.fill_null(0).to_numpy())
            fresh = words.filter(pa.array(new))
            self.seen, self.lists = pa.concat_arrays([self.seen, fresh]), pa.concat_arrays([self.lists, listed(*self.words(fresh))])
            at = pa.array(place)
        return self.lists.take(at)

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(ids of all rows one after the other, first id of every row and the end)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        raw, offsets = flat(texts)
        whole = pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False)
        start = cuts(raw, offsets, whole)
        bounds = np.append(start, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        first = np.searchsorted(start, offsets)  # piece of every row
        word = np.zeros(len(distinct), dtype=bool)  # a piece ends in white space only if it is nothing else
        word[codes] = ~_SPACE[raw[bounds[1:] - 1]] & ~np.repeat(whole, np.diff(first))
        others = listed(*together(self._ids(distinct.filter(pa.array(~word)).to_pylist())))
        lists = pa.concat_arrays([self._word_lists(distinct.filter(pa.array(word))), others])
        place = np.where(word, np.cumsum(word) - 1, word.sum() + np.cumsum(~word) - 1)
        lists = lists.take(pa.array(place[codes]))
        return lists.values, lists.offsets.to_numpy()[first]
