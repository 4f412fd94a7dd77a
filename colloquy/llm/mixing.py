"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Targets: the sources share `share` times all sizes by weight; a target stops at `cap` times
its source's size, and the excess is shared again by weight until none is above.

Copies: a document is wanted m = min(cap, level * liking) times, with one level per source
such that the wanted sizes add up to the target; `liking` depends on the document's size
class. It gets floor(m) certain copies. The rest is one copy with inclusion probability
p = m - floor(m): with u uniform from the document's hash, documents are ranked by
(u / (1 - u)) / (p / (1 - p)), and the first are taken until their sizes reach what the
certain copies leave of the target. The document at the edge is taken if that comes nearer.

Ranks of a source are never sorted in one task: documents fall into `BINS` bins by rank value,
sizes are added up per (source, bin), and only the bin with the edge is cut again, into
`BINS` finer ones, before its rows are ordered.

Results in special cases: a null text has size 0; a null source is a source of its own, last in
order; documents of size 0 take nothing and their source, if all are such, has target 0.
Repeated rows (equal doc_id and text) have equal ranks; at the edge as many of them are taken as
come nearest to the target, and only then are they numbered. An empty table gives an empty result. Other columns are kept, but columns named as the
results are replaced. Reruns agree, since u depends on doc_id, text and seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import BROADCAST_BYTES, BROADCAST_ROWS, materialise, measure

BINS = 1024
#: How much a document is liked, by the number of its words: (at least, liking).
LIKING = ((0, 0.8), (32, 1.0), (4096, 0.9))
WORD = r"[^\x20\x09-\x0D]+"
_TINY = 1e-12


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds size: the number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long"))


def _filled(total: Column, weight: Column, limit: Column, part: list[str]) -> Column:
    """Shares of `total` by weight, none above its limit: rows in order of limit / weight fill up first."""
    ratio = F.try_divide(limit.cast("double"), weight)
    order = Window.partitionBy(*part).orderBy(ratio, "_tie")
    spent = F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    waiting = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.try_divide(total - spent, waiting)
    # Rows below the level are full; the first that is not fixes the level for all after it.
    first = F.struct(ratio.alias("ratio"), F.col("_tie"), level.alias("level"))
    open_level = F.min(F.when(ratio > level, first)).over(Window.partitionBy(*part))["level"]
    return F.least(limit.cast("double"), F.coalesce(open_level * weight, limit.cast("double")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if measure(df).within(BROADCAST_ROWS, BROADCAST_BYTES) else df


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """source, source_size, target of every source. One row per source is all that is ordered here."""
    sources = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("long").alias("t")).first()["t"]
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("double")
    rows = sources.withColumn("_tie", place).withColumn("_w", weight).withColumn("_one", F.lit(0))
    goal = _filled(F.lit(total) * F.lit(share), F.col("_w"), F.col("source_size") * cap, ["_one"])
    return materialise(rows.withColumn("target", goal).select("source", "source_size", "target"), "targets")


def _join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Joins on keys that may be null; `right` is a table of sources, bins or levels and is broadcast if it measures small."""
    other = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)]
    return left.join(_small(other), same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def _edges(binned: DataFrame, keys: list[str], bin_: str, rest: str) -> DataFrame:
    """Per key: the bin in which the running size passes what is to be taken, and the size of the bins before it."""
    sums = binned.groupBy(*keys, bin_).agg(F.sum("size").alias("_s"), F.first(rest).alias("_rest"))
    order = Window.partitionBy(*keys).orderBy(bin_)
    run = sums.withColumn("_upto", F.sum("_s").over(order)).where(F.col("_upto") > F.col("_rest"))
    best = run.groupBy(*keys).agg(F.min(F.struct(bin_, (F.col("_upto") - F.col("_s")).alias("_before"))).alias("_e"))
    return materialise(best.select(*keys, F.col(f"_e.{bin_}").alias("_edge"), F.col("_e._before").alias("_before")), "edges")


def _counted(tied: DataFrame) -> DataFrame:
    """Equal rows with `_number`, from 1 on within their source: numbered in their task once they are in a table, then by the tasks before."""
    tied = materialise(tied.withColumn("_m", F.monotonically_increasing_id()), "tied").withColumn("_task", F.shiftright("_m", 33))
    before = Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tied.groupBy("source", "_task").agg(F.count(F.lit(1)).alias("_n"))
    tasks = materialise(tasks.select("source", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "tied-tasks")
    own = F.row_number().over(Window.partitionBy("source", "_task").orderBy("_m"))
    return _join(tied, tasks, "source", "_task").withColumn("_number", (own + F.col("_before")).cast("int")).drop("_m", "_task", "_before")


def mix(
    docs: DataFrame, weights: tuple[int, ...], share: float = 1.5, cap: int = 2, seed: str = "mix", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Adds size, source_size, target and copies to every document; `docs` has `key`, `text` and source."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    # The table's own columns get numbers meanwhile, so that none clashes with what is added.
    carried = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(own)]
    docs = docs.select(*carried, F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), "source")
    uniform = F.md5(F.concat_ws("\x1f", F.lit(seed), F.col("_key").cast("string"), F.md5(F.coalesce("_text", F.lit("")))))
    u = (F.conv(F.substring(uniform, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    liking = F.lit(LIKING[0][1])
    for least, value in LIKING[1:]:
        liking = F.when(F.col("size") >= least, F.lit(value)).otherwise(liking)
    # The narrow table of sizes is written once; texts are not moved for the decisions.
    rows = materialise(
        sized(docs, "_text").select("source", "size", u.alias("_u"), liking.alias("_like")), "sizes"
    )
    goals = targets(rows, weights, share, cap)
    levels = rows.groupBy("source", "_like").agg(F.sum("size").alias("_size"))
    levels = _join(levels, goals, "source").withColumn("_tie", F.col("_like"))
    wanted = _filled(F.col("target"), F.col("_like") * F.col("_size"), F.col("_size") * cap, ["source"])
    copies = F.when(F.col("_size") > 0, wanted / F.col("_size")).otherwise(F.lit(0.0))
    levels = levels.withColumn("_m", F.least(F.lit(float(cap)), copies))
    levels = levels.withColumn("_sure", F.floor(F.col("_m") + _TINY)).withColumn("_p", F.greatest(F.lit(0.0), F.col("_m") - F.col("_sure")))
    levels = materialise(levels, "levels")
    left = levels.groupBy("source").agg((F.first("target") - F.sum(F.col("_sure") * F.col("_size"))).alias("_rest"))
    plan = _join(levels.select("source", "_like", "source_size", "target", "_sure", "_p"), materialise(left, "left"), "source")
    plan = materialise(plan, "mix-plan")

    def ranked(df: DataFrame) -> DataFrame:
        odds = F.try_divide(F.col("_u") / (1 - F.col("_u")), F.try_divide(F.col("_p"), 1 - F.col("_p")))
        rank = F.when((F.col("_p") > _TINY) & (F.col("size") > 0), odds)
        spot = F.col("_q") / (1 + F.col("_q")) * BINS
        binned = _join(df, plan, "source", "_like").withColumn("_q", rank)
        return binned.withColumn("_bin", F.floor(spot)).withColumn("_fine", F.floor((spot - F.floor(spot)) * BINS))

    drawn = ranked(rows).where("_q IS NOT NULL")
    edge = _edges(drawn, ["source"], "_bin", "_rest").withColumnRenamed("_edge", "_b1").withColumnRenamed("_before", "_s1")
    inside = _join(drawn, edge, "source").where("_bin = _b1").withColumn("_rest", F.col("_rest") - F.col("_s1"))
    fine = _edges(inside, ["source"], "_fine", "_rest").withColumnRenamed("_edge", "_b2").withColumnRenamed("_before", "_s2")
    last = _join(inside, fine, "source").where("_fine = _b2").withColumn("_rest", F.col("_rest") - F.col("_s2"))
    # Rows of one fine bin, equal ones put together, in order: all before the edge, and of those at the edge as many as come nearest.
    alike = last.groupBy("source", "_q", "size", "_u").agg(F.count(F.lit(1)).alias("_c"), F.first("_rest").alias("_rest"))
    order = Window.partitionBy("source").orderBy("_q", "size", "_u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.sum(F.col("size") * F.col("_c")).over(order) - F.col("size") * F.col("_c")
    nearest = F.floor((F.col("_rest") - begin) / F.col("size") + 0.5)
    taken = alike.withColumn("_k", F.least(F.col("_c"), nearest)).where("_k > 0")
    edges = taken.groupBy("source").agg(F.max(F.struct("_q", "size", "_u", "_k", "_c")).alias("_e"))
    fields = {"_q": "_lq", "size": "_lsize", "_u": "_lu", "_k": "_lk", "_c": "_lc"}
    edges = edges.select("source", *[F.col(f"_e.{c}").alias(name) for c, name in fields.items()])
    cut = _join(_join(edge, fine, "source"), materialise(edges, "last"), "source")
    cut = materialise(cut, "cuts")
    chosen = _join(ranked(sized(docs, "_text").withColumn("_u", u).withColumn("_like", liking)), cut, "source")
    here, last_taken = F.struct("_q", "size", "_u"), F.struct("_lq", "_lsize", "_lu")
    parted = F.coalesce(F.col("_lq").isNotNull() & (here == last_taken) & (F.col("_lk") < F.col("_lc")), F.lit(False))
    if cut.where("_lk < _lc").isEmpty():
        chosen = chosen.withColumn("_number", F.lit(0))
    else:
        chosen = chosen.where(~parted).withColumn("_number", F.lit(0)).unionByName(_counted(chosen.where(parted)))
    extra = (
        F.when(F.col("_q").isNull(), False)
        .when(F.col("_b1").isNull(), F.col("_rest") > 0)
        .when(F.col("_bin") != F.col("_b1"), F.col("_bin") < F.col("_b1"))
        .when(F.col("_b2").isNull(), True)
        .when(F.col("_fine") != F.col("_b2"), F.col("_fine") < F.col("_b2"))
        .when(parted, F.col("_number") <= F.col("_lk"))
        .otherwise(F.col("_lq").isNotNull() & (here <= last_taken))
    )
    count = F.col("_sure") + F.coalesce(extra, F.lit(False)).cast("long")
    return chosen.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(own)], "size", "source_size", "target", count.cast("long").alias("copies"))
