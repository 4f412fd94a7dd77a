"""Near-duplicate documents: bottom-k sketches, inverted lists, estimates, exact Jaccard.

1. Every text becomes its set of hashed shingles; the k least hashes are its sketch. Texts
   with equal sets are one class, so exact copies are one row from here on.
2. Inverted lists over retained values. A class needs to be in the lists of its rarest values
   only: two sets at the threshold share `least` of their k values at least (but for a chance
   below 1e-7), so they meet in the first k - least + 1 of any common order. The order is by
   frequency, which keeps passages that many documents share out of the lists.
3. In every list the most central class is compared with all others: the sketch of the union
   estimates the Jaccard index, and full sets decide. This joins groups of copies without
   forming their pairs.
4. Lists whose classes are not joined yet are worked off in blocks of bounded size, inside the
   task: members of different components, in the list of their first common value only, are
   estimated; of those that pass, full sets are sent to the list and decide there. Rows that
   leave a task are members or links that join components, never the pairs of a group.
5. Connected components of all links.

Results in special cases: null or empty texts, and texts without words, have no shingles and
are linked with nothing; a text with fewer words than a shingle is one shingle. A null doc_id
is not counted as the smallest; a component of null doc_ids alone has a null component_id.
Repeated rows are rows of one component. An empty table gives an empty result. Other columns
are passed over.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.components import components
from colloquy.llm.ship import ship
from colloquy.llm.words import Words, by_bytes, mix, shingles
from colloquy.session import materialise, measure

BLOCK = 1024  # members of a list that meet in one task
SHINGLES = 4_000_000  # shingles of one block of a list, about: 32 MB
SENT_ROWS, SENT_BYTES = 2_000_000, 64 << 20  # wanted classes are broadcast below both, else joined by shuffle
_A, _B = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


def shared_at_least(k: int, threshold: float) -> int:
    """Values of k that sketches at the threshold share, six and a half standard deviations below the mean."""
    return max(1, math.floor(k * threshold - 6.5 * math.sqrt(k * threshold * (1 - threshold))))


def _sets(batch: pa.RecordBatch, width: int):
    """The sorted distinct shingles of every row of a batch."""
    words = Words(batch.column("text"))
    runs, first = shingles(words.keys(), words.first, width)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(runs[a:b])


def _digest(values: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(values ^ _A).sum(dtype=np.uint64).view(np.int64)), int(mix(values + _B).sum(dtype=np.uint64).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.uint64).view(np.int64)))


def sketches(docs: DataFrame, k: int, width: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), sketch (its k least values)."""

    def made(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                n, d1, d2, least = [], [], [], []
                for values in _sets(batch, width):
                    a, b = _digest(values)
                    n.append(len(values))
                    d1.append(a)
                    d2.append(b)
                    least.append(values[:k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(least)],
                    names=["doc_id", "n_shingles", "d1", "d2", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, n_shingles long, d1 long, d2 long, sketch array<long>")


def _ranked(classes: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """cid, n, ordered (sketch, rarest first), p (how many of them need a list), central."""
    values = classes.select("cid", "n", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    joined = values.join(common, "v")
    size = F.least(F.col("n"), F.lit(k))
    # Up to this size, partners are whole sets in their sketches too, and the threshold holds as it is.
    small = math.floor(k * percent / 100)
    prefix = F.when(F.col("n") <= small, F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).otherwise(size - least + 1)
    known = joined.groupBy("cid").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "v"))).alias("_c"), F.sum("f").alias("central")
    )
    # Values of a single class come first in the order and have no list.
    keep = F.greatest(F.lit(0), prefix - (size - F.size("_c"))).cast("int")
    known = known.withColumn("p", keep).where("p > 0")
    return known.select("cid", "n", "central", F.slice(F.transform("_c", lambda c: c["v"]), 1, F.col("p")).alias("listed"))


def _wanted_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, values): the full set of every wanted class (cid, d1, d2), made from the texts again."""

    def made(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                rows = [v for v in _sets(batch, width) if len(v)]
                digests = [_digest(v) for v in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in digests], pa.int64()), pa.array([b for _, b in digests], pa.int64()), _lists(rows)],
                    names=["d1", "d2", "values"],
                )

    sets = docs.select("text").mapInArrow(made, "d1 long, d2 long, values array<long>")
    if measure(wanted).within(SENT_ROWS, SENT_BYTES):
        wanted = F.broadcast(wanted)
    return sets.join(wanted, ["d1", "d2"]).groupBy("cid").agg(F.first("values").alias("values"))


def _estimated(k: int, least: int):
    """Keeps pairs whose union's sketch has `least` values of both, or, if the union is smaller than k, enough of them."""

    def kept(batches):
        for batch in batches:
            sa, sb = (batch.column(c) for c in ("sa", "sb"))
            a_at, a_values = sa.offsets.to_numpy(), sa.values.to_numpy().view(np.uint64)
            b_at, b_values = sb.offsets.to_numpy(), sb.values.to_numpy().view(np.uint64)
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = a_values[a_at[i] : a_at[i + 1]], b_values[b_at[i] : b_at[i + 1]]
                good[i] = _passes(a, b, k, least)
            chosen = batch.filter(pa.array(good))
            yield chosen.select(["a", "b"])

    return kept


def _passes(a: np.ndarray, b: np.ndarray, k: int, least: int) -> bool:
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:][both[1:] == both[:-1]]
    union = len(both) - len(twice)
    if union > k:
        # The k least of the union are complete in both sketches.
        distinct = both[np.concatenate([[True], both[1:] != both[:-1]])]
        return np.searchsorted(twice, distinct[k - 1], side="right") >= least
    return len(twice) * k >= least * union


def _decided(percent: int):
    def kept(batches):
        for batch in batches:
            va, vb = batch.column("va"), batch.column("vb")
            a_at, a_values = va.offsets.to_numpy(), va.values.to_numpy()
            b_at, b_values = vb.offsets.to_numpy(), vb.values.to_numpy()
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = a_values[a_at[i] : a_at[i + 1]], b_values[b_at[i] : b_at[i + 1]]
                joined = np.sort(np.concatenate([a, b]))
                both = int((joined[1:] == joined[:-1]).sum())
                good[i] = 100 * both >= percent * (len(joined) - both)
            yield batch.filter(pa.array(good)).select(["a", "b"])

    return kept


def _blocks(entries: DataFrame) -> DataFrame:
    """Members of a list dealt to pairs of blocks (i <= j): as many blocks as BLOCK members, or SHINGLES of their shingles, call for."""
    sums = entries.groupBy("v").agg(F.count(F.lit(1)).alias("_l"), F.sum("n").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_l") / BLOCK), F.least("_l", F.ceil(F.col("_s") / SHINGLES))).cast("int")
    joined = entries.join(sums.select("v", blocks.alias("_nb")), "v")
    own = F.pmod(F.xxhash64("cid"), F.col("_nb")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_nb") - 1),
        lambda o: F.struct(F.least(F.col("_own"), o).alias("i"), F.greatest(F.col("_own"), o).alias("j")),
    )
    dealt = joined.withColumn("_own", own).withColumn("_p", F.explode(pairs))
    return dealt.select(*entries.columns, F.col("_own").alias("own"), F.col("_p.i").alias("i"), F.col("_p.j").alias("j"))


def _spread(still: DataFrame, sketch: DataFrame, listed: DataFrame) -> DataFrame:
    """Members with their sketches, each pair of blocks where its own hash says: by the list alone, all of a hot list would be one task."""
    return _blocks(still).join(sketch, "cid").join(listed, "cid").repartition("v", "i", "j")


def _slices(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column of lists of numbers, as views."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    at, values = whole.offsets.to_numpy(), whole.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _members(k: int, least: int, percent: int):
    """In one pair of blocks of a list: the members that have a partner in another component whose estimate passes."""

    def found(key, table):
        v, i, j = (x.as_py() for x in key)
        cid, comp, n, own = (table[c].to_numpy() for c in ("cid", "comp", "n", "own"))
        whole, listed = _slices(table["sketch"]), _slices(table["listed"])
        values, at = _dense(whole)
        owner = np.repeat(np.arange(len(whole)), np.diff(at))
        lv, lat = _dense_in(listed, values)
        flat = values.ids
        width = max((len(x) for x in listed), default=0)
        grid = np.full((len(whole), width), -1)
        for r in range(len(whole)):
            grid[r, : lat[r + 1] - lat[r]] = lv[lat[r] : lat[r + 1]]
        this = int(np.searchsorted(values.distinct, v))
        mark = np.zeros(len(values.distinct) + 1, dtype=bool)  # the last stands for no value
        hit = np.zeros(len(whole), dtype=bool)
        for r in range(len(whole)):
            later = (comp != comp[r]) & (cid > cid[r]) if i == j else (comp != comp[r]) & (own != own[r]) & (own == j)
            if i != j and own[r] != i:
                continue
            later &= (100 * n >= percent * n[r]) & (100 * n[r] >= percent * n)
            if not later.any():
                continue
            mark[flat[at[r] : at[r + 1]]] = True
            shared = np.bincount(owner[mark[flat]], minlength=len(whole))
            mark[:] = False
            need = np.minimum(least, np.ceil(percent / 100 * np.minimum(n, n[r])))
            later &= shared >= need
            if not later.any():
                continue
            mark[grid[r][grid[r] >= 0]] = True
            some = np.flatnonzero(later)
            common = mark[grid[some]] & (grid[some] >= 0)
            mark[:] = False
            firsts = grid[some, common.argmax(1)]
            for s in some[common.any(1) & (firsts == this)]:
                if _passes(whole[r].view(np.uint64), whole[s].view(np.uint64), k, least):
                    hit[r] = hit[s] = True
        keep = np.flatnonzero(hit)
        return pa.table({
            "v": np.full(len(keep), v, np.int64), "i": np.full(len(keep), i, np.int32), "j": np.full(len(keep), j, np.int32),
            "cid": cid[keep], "comp": comp[keep], "own": own[keep].astype(np.int32),
        })

    return found


class _Values:
    def __init__(self, flat: np.ndarray):
        self.distinct, ids = np.unique(flat, return_inverse=True)
        self.ids = ids.astype(np.int64)


def _dense(rows: list[np.ndarray]):
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return _Values(np.concatenate(rows) if rows else np.empty(0, np.int64)), at


def _dense_in(rows: list[np.ndarray], values: _Values):
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return np.searchsorted(values.distinct, flat), at


def _joined(percent: int):
    """In one pair of blocks: exact links between components, no more than join them."""

    def linked(key, table):
        _, i, j = (x.as_py() for x in key)
        cid, comp, own = (table[c].to_numpy() for c in ("cid", "comp", "own"))
        rows = _slices(table["values"])
        values, at = _dense(rows)
        owner, size = np.repeat(np.arange(len(rows)), np.diff(at)), np.diff(at)
        _, root = np.unique(comp, return_inverse=True)  # components of the list, merged as links are found
        mark = np.zeros(len(values.distinct), dtype=bool)
        a, b = [], []
        for r in range(len(rows)):
            if i != j and own[r] != i:
                continue
            other = np.flatnonzero((root != root[r]) & ((cid > cid[r]) if i == j else (own == j)))
            if not len(other):
                continue
            mark[values.ids[at[r] : at[r + 1]]] = True
            both = np.bincount(owner[mark[values.ids]], minlength=len(rows))[other]
            mark[:] = False
            for s in other[100 * both >= percent * (size[r] + size[other] - both)]:
                if root[s] != root[r]:
                    root[root == root[s]] = root[r]
                    a.append(cid[r])
                    b.append(cid[s])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return linked


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 64, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents are linked where 100 * intersection >= percent * union.

    `docs` has doc_id and text.
    """
    spark = docs.sparkSession
    ship(spark)
    least = shared_at_least(k, percent / 100)
    made = materialise(sketches(docs, k, width), "sketches")
    grouped = made.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")  # numbered once, in a table
    ranked = materialise(_ranked(classes, k, least, percent), "ranked")

    # The centre of every list against its members.
    entries = ranked.select("cid", "n", "central", F.explode("listed").alias("v"))
    centres = entries.groupBy("v").agg(
        F.max(F.struct("central", (-F.col("cid")).alias("c"), F.col("n"))).alias("_t"), F.count(F.lit(1)).alias("_l")
    ).where("_l > 1").select("v", (-F.col("_t.c")).alias("a"), F.col("_t.n").alias("na"))
    sized = (100 * F.col("n") >= percent * F.col("na")) & (100 * F.col("na") >= percent * F.col("n"))
    pairs = entries.join(centres, "v").where((F.col("cid") != F.col("a")) & sized).select("a", F.col("cid").alias("b")).distinct()
    sketch = classes.select("cid", "sketch")
    with_a = pairs.join(sketch.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), "a")
    with_both = with_a.join(sketch.select(F.col("cid").alias("b"), F.col("sketch").alias("sb")), "b")
    likely = materialise(with_both.mapInArrow(_estimated(k, least), "a long, b long"), "likely")
    ids = classes.select("cid", "d1", "d2")
    stars = materialise(_verified(docs, likely, ids, width, percent), "stars")

    # Lists that still have several components.
    known = materialise(components(stars, rounds=2), "first-components").select(F.col("u").alias("cid"), "root")
    placed = entries.select("cid", "n", "v").join(known, "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")
    placed = materialise(placed, "entries")
    several = placed.groupBy("v").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b").select("v")
    still = placed.join(several, "v", "left_semi")
    full = _spread(still, sketch, ranked.select("cid", "listed"))
    members = "v long, i int, j int, cid long, comp long, own int"
    met = full.groupBy("v", "i", "j").applyInArrow(_members(k, least, percent), members)
    met = materialise(met, "members")
    sets = _wanted_sets(docs, materialise(met.select("cid").distinct().join(ids, "cid"), "wanted"), width)
    rest = met.join(sets, "cid").groupBy("v", "i", "j").applyInArrow(_joined(percent), "a long, b long")
    links = stars.unionAll(materialise(rest, "links"))

    # The smallest doc_id of every component, brought back to all rows by the set's digest.
    root = components(links).select(F.col("u").alias("cid"), "root")
    rooted = classes.select("cid", "d1", "d2", "first_id").join(root, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = materialise(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    owned = rooted.join(smallest, "root").select("d1", "d2", "component_id")
    none = F.col("n_shingles") == 0
    keyed = made.select("doc_id", "n_shingles", "d1", "d2").join(owned, ["d1", "d2"], "left")
    out = keyed.withColumn("component_id", F.when(none, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), none).alias("kept"))


def _verified(docs: DataFrame, pairs: DataFrame, ids: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are at the threshold."""
    either = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = materialise(_wanted_sets(docs, materialise(either.join(ids, "cid"), "wanted"), width), "sets")
    with_b = pairs.join(sets.select(F.col("cid").alias("b"), F.col("values").alias("vb")), "b")
    with_both = with_b.join(sets.select(F.col("cid").alias("a"), F.col("values").alias("va")), "a")
    return with_both.select("a", "b", "va", "vb").mapInArrow(_decided(percent), "a long, b long")
