"""Byte-level BPE by monoid tree reduction, and back.

The encodings of byte strings form a monoid: from those of two neighbours follows the encoding
of both together. A pretoken is cut in halves down to LEAF bytes, which are merged directly;
going up, two neighbours are joined by encoding a window of tokens around the seam anew. The
window grows until the tokens outside it provably stay.

Why they stay: merging always takes the lowest rank, leftmost first, so what happens between two
tokens depends on these two alone. A row of tokens is the encoding of its bytes exactly if every
two neighbours, encoded together, give themselves again: the first merge across a border would
also be the first across it with nothing but these two. Tokens within each half, and within the
window, are neighbours already; only the window's two edges are left to test. A side whose edge
fails gets twice as many tokens, at most the whole half.

Texts are cut into pretokens by the pattern. Where a match ends whatever stands around, halves
of a text are joined as they are; a text that has to be taken whole (`pretokens`) is cut in halves
too, and a window of characters around the seam, which grows to such places on either side, is encoded
anew. Decoding looks up the bytes of each token and concatenates.

Results in special cases: a null or empty text has no tokens; strings that look like special
tokens are ordinary text; rows are encoded one by one, so repeated rows and null doc_ids stay;
an empty table gives an empty result; other columns are kept, and one that has the name of the
made column (`ids`, `decoded`) is replaced. Memory: texts are worked off in slices of SLICE
bytes, one text at least; pieces remembered are bounded in number and length.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from colloquy.llm.pretokens import ColumnEncoder, spelled
from colloquy.llm.ship import ship
from colloquy.llm.words import by_bytes, flat

LEAF = 4  # bytes merged directly
SHORT, MERGED = 24, 150_000  # encodings of so many bytes at most are remembered, and so many of them
BLOCK = 4096  # characters matched at once in a text that is taken whole
SLICE = 4 << 20
NONE = 1 << 40  # the rank of what is no token


class Monoid:
    """Encodings of byte strings, as tuples of tokens (their bytes), under concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.merged: dict[bytes, tuple[bytes, ...]] = {}

    def merge(self, piece: bytes) -> tuple[bytes, ...]:
        """The encoding of a leaf or a window, by the definition; short ones are remembered."""
        found = self.merged.get(piece)
        if found is None:
            found = tuple(self._merge(piece))
            if len(piece) <= SHORT:
                if len(self.merged) >= MERGED:
                    self.merged.clear()
                self.merged[piece] = found
        return found

    def _merge(self, piece: bytes) -> list[bytes]:
        """Lowest rank first, leftmost of equals: what encoding means."""
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while rank and (low := min(rank)) < NONE:
            if len(rank) > 32 and rank.count(low) > 8:
                parts = self._sweep(parts, rank, low)
                rank = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
                continue
            i = rank.index(low)
            parts[i] += parts.pop(i + 1)
            rank.pop(i)
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], NONE)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], NONE)
        return parts

    def _sweep(self, parts: list[bytes], rank: list[int], low: int) -> list[bytes]:
        """Many equal pairs in one pass from left to right, as far as none of a lower rank comes up."""
        get, out, i = self.ranks.get, [], 0
        while i < len(parts):
            if i < len(rank) and rank[i] == low:
                made = parts[i] + parts[i + 1]
                i += 2
                lower = (out and get(out[-1] + made, NONE) < low) or (i < len(parts) and get(made + parts[i], NONE) < low)
                out.append(made)
                if lower:
                    break
            else:
                out.append(parts[i])
                i += 1
        return out + parts[i:]

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens side by side stay as they are."""
        return len(self.merge(a + b)) == 2 and self.merge(a + b)[0] == a

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The encoding of both together, from that of each."""
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            a, b = max(0, len(left) - i), min(len(right), j)
            window = self.merge(b"".join(left[a:] + right[:b]))
            left_stays = a == 0 or self.stable(left[a - 1], window[0])
            right_stays = b == len(right) or self.stable(window[-1], right[b])
            if left_stays and right_stays:
                return left[:a] + window + right[b:]
            i, j = i if left_stays else 2 * i, j if right_stays else 2 * j

    def encode(self, piece: bytes) -> tuple[bytes, ...]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = 1 << (len(piece) - 1).bit_length() - 1  # a power of two: runs of one sign keep their step
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))


class Coder:
    """Ids of texts and texts of ids for one file of ranks."""

    def __init__(self, file: str):
        import regex

        with open(file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.monoid = Monoid(ranks)
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.matches = regex.compile(spelled(public_tokenizers.PATTERN)).finditer
        # A letter or digit before something that is neither its kind: a match ends here whatever stands around.
        self.ends = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})").finditer
        self.columns = ColumnEncoder(self.piece)
        table = sorted(ranks, key=ranks.get)
        if [ranks[token] for token in table] != list(range(len(table))):
            raise ValueError("ranks must be the numbers from 0 without gaps")
        self.table = pa.array(table, pa.large_binary())

    def pretoken(self, piece: bytes) -> bytes:
        """Ids of one match. A match that is a token is that token; it would be so by merging too."""
        whole = self.packed.get(piece)
        return whole if whole is not None else b"".join(map(self.packed.__getitem__, self.monoid.encode(piece)))

    def piece(self, piece: bytes) -> bytes:
        """Ids of a text or a part of one that `pretokens` cut out."""
        letters = piece[1:] if piece[0] == 0x20 else piece
        if letters.isalpha():  # ASCII letters after a blank or none: one match
            return self.pretoken(piece)
        return b"".join(self._halves(piece.decode()))

    def _plain(self, text: str) -> list[bytes]:
        return [self.pretoken(match[0].encode()) for match in self.matches(text)]

    def _halves(self, text: str) -> list[bytes]:
        """Ids per match. Two halves are joined by matching anew what lies between the nearest sure ends on either side of the seam."""
        if len(text) <= BLOCK:
            return self._plain(text)
        half, reach = len(text) // 2, 64
        low = high = None
        while (low is None and reach < 2 * half) or (high is None and reach < 2 * (len(text) - half)):
            if low is None:
                low = max((m.start() for m in self.ends(text, max(0, half - reach), half)), default=None)
            if high is None:
                high = next((m.start() for m in self.ends(text, half, min(len(text), half + reach))), None)
            reach *= 2
        if low is None and high is None:
            return self._plain(text)
        low, high = low or 0, high or len(text)
        return self._halves(text[:low]) + self._halves(text[low:high]) + self._halves(text[high:])

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(ids of all rows one after the other, first id of every row and the end)."""
        return self.columns.encode(texts)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each id; those of neighbours lie side by side in one buffer."""
        return self.table.take(ids)


_CODERS: dict[str, Coder] = {}


def coder(file: str) -> Coder:
    if file not in _CODERS:
        _CODERS[file] = Coder(file)
    return _CODERS[file]


def _joined(values: pa.Buffer | None, ends: np.ndarray) -> pa.Array:
    """Rows of bytes that lie one after the other."""
    made = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), values or pa.py_buffer(b"")])
    return made.cast(pa.binary())


def _with(df: DataFrame, name: str) -> tuple[list[str], T.StructType]:
    """The columns to keep, and the schema with the made one, bytes, after them."""
    kept = [c for c in df.columns if c != name]
    return kept, T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.BinaryType())])


def encode_texts(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """`docs` with `ids`: the tokens of the column `text` as little-endian unsigned 32-bit numbers in a row."""
    kept, schema = _with(docs, "ids")

    def encode(batches):
        table = coder(ranks)
        for batch in batches:
            for part in by_bytes(batch, text, SLICE):
                ids, first = table.encode(part.column(text))
                packed = pa.py_buffer(np.ascontiguousarray(ids.to_numpy(), "<u4"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], _joined(packed, 4 * first)], names=[*kept, "ids"])

    ship(docs.sparkSession)
    return docs.mapInArrow(encode, schema)


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """`encoded` with `decoded`: the bytes that its `ids` stand for; null ids have none."""
    kept, schema = _with(encoded, "decoded")

    def decode(batches):
        table = coder(ranks)
        for batch in batches:
            for part in by_bytes(batch, "ids", SLICE):
                raw, first = flat(part.column("ids"))
                spelt = table.decode(pa.array(np.ascontiguousarray(raw).view("<u4"), pa.uint32()))
                ends = np.frombuffer(spelt.buffers()[1], np.int64)[: len(spelt) + 1] if len(spelt) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], _joined(spelt.buffers()[2], ends[first // 4])], names=[*kept, "decoded"])

    ship(encoded.sparkSession)
    return encoded.mapInArrow(decode, schema)
