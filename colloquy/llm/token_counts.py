"""Token counts by byte-pair merging, without making any identifier.

A text is cut where no piece of the vocabulary can lie across the cut, so each part
merges on its own. In a part the adjacent pair of lowest rank is taken from a heap, again
and again; symbols stand in a linked list. The count is initial symbols minus merges; a
lone character outside the vocabulary counts as its UTF-8 bytes.

Results in special cases: a null or empty text has 0 tokens; strings that look like
special tokens are ordinary text; every row is counted on its own, so repeated rows and
null doc_ids stay; other columns are passed over. Memory per task: one Arrow batch and a
table of at most `CACHE` counted parts. No shuffle.
"""

from __future__ import annotations

import heapq
import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.ship import ship

CACHE = 600_000  # counted parts kept per task, each of at most LONGEST characters
LONGEST = 48
SPACE = "▁"


class Merger:
    """Ranks of a sentencepiece BPE vocabulary, and the count of tokens of a text."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(model, "rb") as file:
            spec.ParseFromString(file.read())
        plain = {1, 4, 5}  # normal, user defined, unused: what merging may build
        self.rank = {p.piece: -p.score for p in spec.pieces if p.type in plain}
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only vocabularies that leave the text as it is are counted")
        if any(p.type == 4 for p in spec.pieces):
            raise ValueError("vocabularies with user-defined pieces are not counted")
        self.prefix = SPACE if spec.normalizer_spec.add_dummy_prefix else ""
        self.fallback = spec.trainer_spec.byte_fallback
        joined = [p for p in self.rank if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in joined):
            raise ValueError("a piece holds a space after another character: texts cannot be cut at spaces")
        # A character of no longer piece stands alone, a space starts a part, and where no
        # piece has a letter beside another character, the two lie in different parts.
        inner = {c for p in joined for c in p} - {SPACE}
        apart = all(a.isalpha() == b.isalpha() for p in joined for a, b in pairwise(p.lstrip(SPACE)))
        groups = [{c for c in inner if c.isalpha()}, {c for c in inner if not c.isalpha()}] if apart else [inner]
        runs = [f"{SPACE}*[{re.escape(''.join(sorted(g)))}]+" for g in groups if g]
        self.parts = re.compile("|".join([*runs, f"{SPACE}+", f"[^{SPACE}]"])).findall
        self.known: dict[str, int] = Known(self)

    def merged(self, part: str) -> int:
        """Tokens of one part."""
        rank, symbols = self.rank, list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] + symbols[i])) is not None:
                heapq.heappush(heap, (r, h, len(symbols[h]) + size))
        unknown = sum(len(s.encode()) - 1 for s in symbols if len(s) == 1 and s not in rank) if self.fallback else 0
        return n - merges + unknown

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.known.__getitem__, self.parts(self.prefix + text.replace(" ", SPACE))))


class Known(dict):
    """Counts of parts, made on demand and bounded in number and length."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, part: str) -> int:
        n = self.merger.merged(part)
        if len(part) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[part] = n
        return n


_MERGERS: dict[str, Merger] = {}


def merger(model: str) -> Merger:
    """The vocabulary at this path, read once per worker."""
    if model not in _MERGERS:
        _MERGERS[model] = Merger(model)
    return _MERGERS[model]


def count_tokens(docs: DataFrame, model: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row."""

    def counted(batches):
        count = merger(model).count
        for batch in batches:
            texts = batch.column(1)
            sizes = [count(x.as_py() or "") for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64())], names=[key, "n_bytes", "n_tokens"]
            )

    ship(docs.sparkSession)
    slim = docs.select(
        F.col(f"`{key}`").alias(key),
        F.col(f"`{text}`").alias("_text"),
        F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = docs.schema[key].dataType.simpleString()
    out = slim.mapInArrow(counted, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
