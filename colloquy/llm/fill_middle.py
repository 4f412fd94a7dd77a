"""Fill-in-the-middle documents: cut points by descent in a Fenwick tree over text blocks.

A text is `[A-Za-z]+|[^A-Za-z]` units, from left to right. The bytes of a batch of texts lie
one after the other, cut into blocks of BLOCK bytes; a Fenwick tree over the blocks holds how
many units and how many code points begin in each. A cut after u units is found by binary
lifting: from the largest power of two down, a step is taken where the units before it do not
exceed the target, and the block it ends in is searched for the boundary. The code points
before the cut come out of the same descent. No text is split into units.

Which documents are changed, where they are cut, and in which order their parts come follows
from a digest of seed and doc_id, so reruns and other partitions agree.

Results in special cases: null and empty texts, and texts with one of the marks, stay plain,
with null lengths; a null doc_id reads as no digits; copies and repeated rows are worked off one by
one; an empty table gives an empty result. Other columns are kept; one that has the name of an
output is replaced. Memory: slices of SLICE bytes of text, one text at least.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.ship import ship
from colloquy.llm.words import by_bytes, flat

BLOCK = 512  # bytes
SLICE = 4 << 20
SEARCHED = 8192  # boundaries looked for at once within blocks
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Blocks:
    """Units and code points of texts that lie one after the other in `raw`; a text begins a unit at each of `offsets`."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.size, self.count = len(raw), -(-len(raw) // BLOCK)
        points = np.zeros(self.count * BLOCK, dtype=bool)
        points[: self.size] = (raw & 0xC0) != 0x80
        units = points.copy()
        inside = _LETTER[raw]
        inside[1:] &= inside[:-1]  # a letter after a letter
        inside[:1] = False
        inside[offsets[:-1][offsets[:-1] < self.size]] = False
        units[: self.size] &= ~inside
        self.begins = np.stack([units, points]).reshape(2, self.count, BLOCK)
        self.tree = np.zeros((2, self.count + 1), dtype=np.int64)
        self.tree[:, 1:] = self.begins.sum(axis=2)
        step = 1
        while step < self.count:  # each node adds up the nodes below it
            at = np.arange(2 * step, self.count + 1, 2 * step)
            self.tree[:, at] += self.tree[:, at - step]
            step *= 2

    def before(self, place: np.ndarray) -> np.ndarray:
        """(units, points) that begin before each place."""
        block, within = np.divmod(place, BLOCK)
        out = self._within(block, lambda at: np.arange(BLOCK) < within[at, None])
        while block.any():
            out += self.tree[:, block]
            block = block & (block - 1)
        return out

    def find(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the unit begins that so many units stand before, and the code points before it; the end if there is none."""
        block = np.zeros(len(unit), dtype=np.int64)
        done = np.zeros((2, len(unit)), dtype=np.int64)
        step = 1 << self.count.bit_length()
        while step := step >> 1:
            ahead = np.minimum(block + step, self.count)
            go = (block + step <= self.count) & (done[0] + self.tree[0, ahead] <= unit)
            done += np.where(go, self.tree[:, ahead], 0)
            block = np.where(go, ahead, block)
        place = np.full(len(unit), self.size, dtype=np.int64)
        for low in range(0, len(unit), SEARCHED):
            at = low + np.flatnonzero(block[low : low + SEARCHED] < self.count)
            begun = np.cumsum(self.begins[0, block[at]], axis=1)
            place[at] = block[at] * BLOCK + np.argmax(begun > (unit - done[0])[at, None], axis=1)
        within = place - block * BLOCK
        return place, done[1] + self._within(block, lambda at: np.arange(BLOCK) < within[at, None])[1]

    def _within(self, block: np.ndarray, wanted) -> np.ndarray:
        out = np.zeros((2, len(block)), dtype=np.int64)
        for low in range(0, len(block), SEARCHED):
            at = low + np.flatnonzero(block[low : low + SEARCHED] < self.count)
            out[:, at] = (self.begins[:, block[at]] & wanted(at)).sum(axis=2)
        return out


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers per id: the head of the SHA-256 of `seed:id`."""
    digest = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest() for i in ids)
    return np.frombuffer(b"".join(digest), ">u4").reshape(-1, 8)[:, :4].astype(np.int64)


def fill_in_middle(
    docs: DataFrame, seed: int = 1, changed: int = 90, suffix_first: int = 20, marks: tuple[str, str, str] = MARKS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`docs` with `n` (units), `form` (plain, psm, spm), `prefix_chars`, `middle_chars`, and `output`, the text to train on.

    `changed` percent of the documents are cut; of these, `suffix_first` percent have the suffix before the prefix.
    """
    made = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    kept = [c for c in docs.columns if c not in made.names]
    schema = T.StructType([*[docs.schema[c] for c in kept], *made.fields])
    before_prefix, before_suffix, before_middle = (m.encode() for m in marks)

    def cut(batches):
        for batch in batches:
            for part in by_bytes(batch, text, SLICE):
                made = transform(part)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made.values()], names=[*kept, *made])

    def transform(part: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = part.column(text).cast(pa.large_string()).fill_null("")
        raw, offsets = flat(texts)
        blocks = Blocks(raw, offsets)
        first_unit, first_point = blocks.before(offsets)
        n = np.diff(first_unit)
        h = draws(part.column(key).to_pylist(), seed)
        ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
        place, points = np.zeros_like(ends), np.zeros_like(ends)
        for k in range(2):
            inside = ends[:, k] < n  # else the cut is the text's end
            found = blocks.find((first_unit[:-1] + ends[:, k])[inside])
            place[:, k], points[:, k] = offsets[1:], first_point[1:]
            place[inside, k], points[inside, k] = found
        plain = (n == 0) | (h[:, 2] % 100 >= changed)
        for mark in marks:
            plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        form = np.where(plain, "plain", np.where(h[:, 3] % 100 < suffix_first, "spm", "psm"))
        data, outputs = raw.tobytes(), []
        for kind, start, (a, b), end in zip(form.tolist(), offsets[:-1].tolist(), place.tolist(), offsets[1:].tolist(), strict=True):
            if kind == "psm":
                outputs.append(b"".join((before_prefix, data[start:a], before_suffix, data[b:end], before_middle, data[a:b])))
            elif kind == "spm":
                outputs.append(b"".join((before_suffix, data[b:end], before_prefix, data[start:a], before_middle, data[a:b])))
            else:
                outputs.append(data[start:end])
        return {
            "n": pa.array(n),
            "form": pa.array(form.tolist(), pa.string()),
            "prefix_chars": pa.array(points[:, 0] - first_point[:-1], mask=plain),
            "middle_chars": pa.array(points[:, 1] - points[:, 0], mask=plain),
            "output": pa.array(outputs, pa.binary()).cast(pa.string()),
        }

    ship(docs.sparkSession)
    return docs.mapInArrow(cut, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again. No cut text has a mark of its own, and none can arise where a part meets a mark."""
    part = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    psm = F.concat(part[1], part[3], part[2])  # prefix, middle, suffix
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
