"""Best-fit packing by patterns of lengths, fitted with non-negative least squares.

Documents become token pieces of at most `room` tokens. Only a histogram of the piece
lengths (at most `room` numbers) reaches the driver. There, patterns of one to three
lengths that fill a sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded, and what is left over is packed best fit, longest
first, on counts of lengths and of gaps. Every pattern with its repeats is a range of
sequences, so a piece finds its sequence and offset by its number among the pieces of its
length: no piece meets another in a task.

Results in special cases: a null or empty text is a document of the end token alone; rows
are packed one by one, so repeated rows and null doc_ids stay; an empty table gives an
empty result; other columns are passed over. Pieces are numbered once, in a table in the
shared folder, so a task run again finds the same numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.pretokens import ColumnEncoder
from colloquy.llm.ship import ship
from colloquy.llm.words import by_bytes
from colloquy.session import BROADCAST_BYTES, BROADCAST_ROWS, materialise, measure

TOGETHER = 100  # words handed to the library as one text
SLICE = 2 << 20  # bytes of text encoded at once


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, pretoken by pretoken, from a `tokenizers` file."""

    def __init__(self, file: str):
        import json
        import os
        import re

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        cut = json.loads(tokenizer.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if cut["normalizer"] or (cut["pre_tokenizer"] or {}) | byte_level != cut["pre_tokenizer"] or cut["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE files that leave the text as it is are read")
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given the task one core
        tokenizer.encode_special_tokens = True  # special strings are cut out here, for speed
        self.batch = tokenizer.encode_batch_fast
        self.line_end = np.frombuffer(self._plain("\n"), "<u4")
        self.columns = ColumnEncoder(lambda piece: self.encode(piece.decode()), self.words if len(self.line_end) == 1 else None, list(self.special))

    def _plain(self, text: str) -> bytes:
        return np.array(self.batch([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and where each word's begin and end. They are put into lines, TOGETHER at a time: a line end between two words touches neither."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        bounds = pa.array([*range(0, len(words), TOGETHER), len(words)], pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(bounds, words.cast(pa.binary())), b"\n").cast(pa.string()).to_pylist()
        made = [part for x in self.batch(lines, add_special_tokens=False) for part in (np.array(x.ids, "<u4"), self.line_end)]
        ids = np.concatenate(made)
        ends = np.flatnonzero(ids == self.line_end[0])
        return np.delete(ids, ends), np.append(0, ends - np.arange(len(ends)))

    def encode(self, text: str) -> bytes:
        if self.cut and any(s in text for s in self.special):
            return b"".join(self.special[x] if i % 2 else self._plain(x) for i, x in enumerate(self.cut(text)))
        return self._plain(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def pieces(docs: DataFrame, tokenizer: str, room: int, end: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its number `_n` among those of its length in task `_task`."""

    def cut(batches):
        from pyspark import TaskContext

        columns, task = encoder(tokenizer).columns, TaskContext.get().partitionId()
        seen = np.zeros(room + 1, dtype=np.int64)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                ids, first = columns.encode(part.column(1))
                yield made(part.column(0), np.insert(ids.to_numpy(), first[1:], end).astype("<u4"), np.diff(first) + 1, seen, task)

    def made(docs, ids, sizes, seen, task):
        """Pieces of rows whose ids lie one after the other; `seen` counts the task's pieces by length."""
        parts = (sizes - 1) // room + 1
        owner = np.repeat(np.arange(len(sizes)), parts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        head = ((sizes - 1) % room + 1)[owner]  # the first piece takes what is left over
        start = np.where(k > 0, head + (k - 1) * room, 0)
        length = np.where(k > 0, room, head)
        ends = np.cumsum(length)
        view = memoryview(ids).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        number = np.empty(len(length), dtype=np.int64)
        number[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
        seen += np.bincount(length, minlength=room + 1)
        columns = [
            docs.take(pa.array(owner)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
            pa.array(number), pa.array(np.full(len(k), task, np.int64)),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "_n", "_task"]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _n long, _task long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema + (", ids array<long>" if keep_ids else ""))


def patterns_of(lengths: np.ndarray, room: int, waste: int) -> np.ndarray:
    """All patterns of up to three of the lengths that fill room - waste to room; zeros stand for no piece."""
    have = np.zeros(room + 1, dtype=bool)
    have[lengths] = True
    found = []
    for total in range(room - waste, room + 1):
        a = np.arange(1, room + 1)
        a = a[have[a]]
        if have[total] if total else False:
            found.append(np.array([[total, 0, 0]]))
        b = total - a
        ok = (b >= 1) & (b <= a)
        ok[ok] = have[b[ok]]
        found.append(np.stack([a[ok], b[ok], np.zeros(ok.sum(), np.int64)], 1))
        x, y = np.meshgrid(a, a, indexing="ij")
        z = total - x - y
        ok = (x >= y) & (y >= z) & (z >= 1)
        ok[ok] = have[z[ok]]
        found.append(np.stack([x[ok], y[ok], z[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' use of lengths next to the histogram: accelerated projected gradient."""
    room = len(histogram) - 1
    weight = np.zeros(room + 1)
    weight[1:] = np.arange(1, room + 1) / room  # a long piece left over costs more than a short one

    def use(x):
        out = np.zeros(room + 1)
        for k in range(patterns.shape[1]):
            out += np.bincount(patterns[:, k], weights=x, minlength=room + 1)
        out[0] = 0
        return out

    def back(r):
        r = r * weight
        return sum(r[patterns[:, k]] for k in range(patterns.shape[1]))

    goal, probe = weight * histogram, np.ones(len(patterns))
    for _ in range(20):  # largest curvature, by power iteration
        probe = back(weight * use(probe))
        top = np.linalg.norm(probe)
        probe = probe / top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y - back(weight * use(y) - goal) / (1.02 * top))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


def plan(histogram: np.ndarray, room: int, waste: int = 2) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a sequence, number of such sequences); together they hold the histogram exactly.

    Time and memory depend on `room` alone, not on the number of pieces.
    """
    left = histogram.astype(np.int64).copy()
    plans: list[tuple[dict[int, int], int]] = []
    patterns = patterns_of(np.flatnonzero(left), room, waste)
    if len(patterns):
        x = fit(patterns, left.astype(float))
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 0.5:
                break
            sizes, times = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
            repeats = int(min(np.rint(x[p]), *(left[sizes] // times)))
            if repeats > 0:
                left[sizes] -= repeats * times
                plans.append(({int(s): int(m) for s, m in zip(sizes, times, strict=True)}, repeats))
    return plans + residual(left, room)


def residual(left: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on counts: equal sequences are one entry with a number of repeats."""
    open_at: dict[int, list[list]] = {}  # gap -> [[pattern, repeats], ...]
    for length in range(room, 0, -1):
        todo = int(left[length])
        gap = length
        while todo and gap < room:
            if not open_at.get(gap):
                gap += 1
                continue
            pattern, repeats = open_at[gap].pop()
            fits = gap // length
            if todo >= fits * repeats:
                take, each = repeats, fits
            elif todo >= fits:
                take, each = todo // fits, fits
            else:
                take, each = 1, todo
            if repeats > take:
                open_at[gap].append([dict(pattern), repeats - take])
            open_at.setdefault(gap - each * length, []).append([{**pattern, length: pattern.get(length, 0) + each}, take])
            todo -= take * each
        if todo:
            fits = room // length
            full, rest = divmod(todo, fits)
            if full:
                open_at.setdefault(room - fits * length, []).append([{length: fits}, full])
            if rest:
                open_at.setdefault(room - rest * length, []).append([{length: rest}, 1])
    return [(pattern, repeats) for entries in open_at.values() for pattern, repeats in entries]


def slots(plans: list[tuple[dict[int, int], int]]) -> dict[int, list[np.ndarray]]:
    """Per length: up to which number each pattern takes its pieces, pieces per sequence, first sequence, offset."""
    made: dict[int, list[list[int]]] = {}
    sequence = 0
    for pattern, repeats in plans:
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            rows = made.setdefault(length, [])
            first = rows[-1][0] if rows else 0
            rows.append([first + each * repeats, first, each, sequence, offset])
            offset += each * length
        sequence += repeats
    return {length: list(np.array(rows, np.int64).T) for length, rows in made.items()}


def pack(cut: DataFrame, room: int) -> DataFrame:
    """Adds sequence_id and offset to pieces as `pieces` makes them."""
    cut = materialise(cut, "pieces")
    sizes = cut.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialise(sizes.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))), "piece-counts")
    histogram = np.zeros(room + 1, dtype=np.int64)
    for row in sizes.groupBy("length").agg(F.sum("_count").alias("n")).collect():  # at most `room` rows
        histogram[row["length"]] = row["n"]
    places = slots(plan(histogram, room))
    names = [c for c in cut.columns if c not in ("_n", "_task")]

    def placed(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length = table["length"].to_numpy()
            number = table["_n"].to_numpy() + table["_before"].to_numpy()
            sequence, offset = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(group):
                    continue
                size = int(length[group[0]])
                upto, first, each, base, at = places[size]
                n = number[group]
                k = np.searchsorted(upto, n, side="right")
                in_pattern = n - first[k]
                sequence[group] = base[k] + in_pattern // each[k]
                offset[group] = at[k] + in_pattern % each[k] * size
            out = table.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from out.to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    sizes = sizes.select("_task", "length", "_before")
    sizes = F.broadcast(sizes) if measure(sizes).within(BROADCAST_ROWS, BROADCAST_BYTES) else sizes.hint("shuffle_merge")
    joined = cut.join(sizes, ["_task", "length"]).select(*names, "_n", "_before")
    return joined.mapInArrow(placed, f"{kinds}, sequence_id long, offset long")
