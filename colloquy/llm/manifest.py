"""A Merkle manifest of a dataset, with an inclusion proof per row.

Slot pivot: nodes that stand side by side, `fanout` at a time, are spread by conditional
aggregates into the columns _h0, _h1, ... of their parent's row. The columns put together, hashed, are
the parent; the columns but for one's own slot are the siblings, so a level of all proofs comes
out of the same row. Trees grow per group, and a tree over the groups' roots has the dataset's root.

Positions come from one range-partitioned sort: rows are numbered in their task when the sorted table
is written, and the counts of the tasks before are added. A level is a grouping by (group, position
div fanout) that is already summed up in the tasks of the level below, and is written as a table; a hot
group is as many rows as any. Going down, a level of proofs is the join of a parent's proof with the
parent's row. Proofs of rows are made last and are never shuffled; those of the level above are.

Results in special cases: rows without an order key come first in their group, equal ones are
ordered by their leaf, and equal rows take one place each; a null group is a group, the first. A group
of one row has its leaf as subroot and a proof from the levels above alone. An empty table gives an
empty result. Other columns are carried along and cannot clash; one that has the name of an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.joins import join_small
from colloquy.session import materialise

_PROOF = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """A value so that no two rows of fields read alike: its byte count and itself, or - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The digest of a row: lowercase hex SHA-256."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings from the leaf's level up, left to right."""
    return F.sha2(F.aggregate(proof, F.lit(""), lambda acc, s: F.concat(acc, s["l"], s["r"])), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` as a written table with `name`, the place of each in `order` from 0 on."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered")
    task = F.shiftright("_m", 33)
    counts = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_task", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))  # a row per task
    at = (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).alias(name)
    return placed.join(F.broadcast(before), task == F.col("_task")).select(*rows.columns, at)


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """Rows of parents: `_h0`.. and `_row0`.. hold the children by slot. Groups that are down to one node have none."""
    slot = F.pmod("_pos", F.lit(fanout))
    columns = [c for c in ("_h", "_row") if c in nodes.columns]
    spread = [F.first(F.when(slot == i, F.col(c)), ignorenulls=True).alias(f"{c}{i}") for i in range(fanout) for c in columns]
    return nodes.where("_n > 1").groupBy("_g", F.floor(F.col("_pos") / fanout).alias("_p"), "_n").agg(*spread)


def _up(parents: DataFrame, fanout: int) -> DataFrame:
    whole = F.concat(*[F.coalesce(f"_h{i}", F.lit("")) for i in range(fanout)])
    return parents.select("_g", F.col("_p").alias("_pos"), F.ceil(F.col("_n") / fanout).alias("_n"), F.sha2(whole, 256).alias("_h"))


def _grow(nodes: DataFrame, most: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of parents as written tables, and the last node of each group with the level it stands on."""
    levels, last = [], nodes.where("_n = 1").select("_g", "_h", F.lit(0).alias("_level"))
    while most > 1:
        levels.append(materialise(_parents(nodes, fanout), "merkle"))
        nodes, most = _up(levels[-1], fanout), -(-most // fanout)
        last = last.unionByName(nodes.where("_n = 1").select("_g", "_h", F.lit(len(levels)).alias("_level")))
    return levels, materialise(last, "merkle-last")


def _down(parents: DataFrame, proofs: DataFrame, fanout: int) -> DataFrame:
    """Proofs of the children from those of the parents."""
    slots = [f"_h{i}" for i in range(fanout)]
    rows = any(c.startswith("_row") for c in parents.columns)

    def child(i: int) -> Column:
        beside = lambda names: F.concat(F.lit(""), *[F.coalesce(c, F.lit("")) for c in names])
        step = F.struct(beside(slots[:i]).alias("l"), beside(slots[i + 1 :]).alias("r"))
        made = [(F.col("_p") * fanout + i).alias("_pos"), F.col(f"_h{i}").alias("_h"), F.concat(F.array(step), "_proof").alias("_proof")]
        return F.struct(*made, *([F.col(f"_row{i}").alias("_row")] if rows else []))

    children = F.filter(F.array(*[child(i) for i in range(fanout)]), lambda c: c["_h"].isNotNull())
    above = proofs.select("_g", F.col("_pos").alias("_p"), "_proof", "_subroot")
    made = parents.join(above, ["_g", "_p"]).select("_g", "_subroot", F.explode(children).alias("_c"))
    return made.select("_g", "_subroot", "_c._pos", "_c._proof", *(["_c._row"] if rows else []))


def manifest(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", fanout: int = 3) -> DataFrame:
    """`leaves` with `subroot`, `root` and `proof`: per level the siblings left and right of one's own slot.

    A row's digest is in the column `leaf`; rows are ordered by `order` within `group`, groups by their bytes.
    """
    spark = leaves.sparkSession
    made = ("subroot", "root", "proof")
    kept = [c for c in leaves.columns if c not in made]
    rows = leaves.select(
        F.col(f"`{group}`").alias("_group"), F.col(f"`{order}`").alias("_order"), F.col(f"`{leaf}`").alias("_h"),
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.monotonically_increasing_id().alias("_own"),
    )
    rows = _numbered(rows, ["_group", "_order", "_h", "_own"], "_at")
    groups = rows.groupBy("_group").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = materialise(_numbered(groups, ["_group"], "_g"), "merkle-groups")
    total = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("_n").alias("most")).first()
    if not total["groups"]:
        return leaves.select(*kept, F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(_PROOF).alias("proof")).limit(0)

    told = F.coalesce(F.concat(F.lit(":"), F.col("_group")), F.lit("-")).alias("_key")  # a null group is one too
    numbers = groups.select(told, "_g", "_first", "_n")
    nodes = join_small(rows.select(told, "_at", "_h", "_row"), numbers, ["_key"], spread_by=["_at"])
    nodes = nodes.select("_g", (F.col("_at") - F.col("_first")).alias("_pos"), "_n", "_h", "_row")
    levels, last = _grow(nodes, total["most"], fanout)

    upper, top = _grow(last.select(F.lit(0).alias("_g"), F.col("_g").alias("_pos"), F.lit(total["groups"]).alias("_n"), "_h"), total["groups"], fanout)
    root = top.first()["_h"]
    proofs = spark.createDataFrame([(0, 0, [], "")], f"_g int, _pos long, _proof {_PROOF}, _subroot string")
    for parents in reversed(upper):
        proofs = _down(parents, proofs, fanout)
    entry = last.join(proofs.select(F.col("_pos").alias("_g"), "_proof"), "_g")
    entry = materialise(entry.select("_g", F.lit(0).cast("long").alias("_pos"), "_proof", F.col("_h").alias("_subroot"), "_level"), "merkle-entry")

    at_level = lambda k: entry.where(F.col("_level") == k).drop("_level")
    proofs = at_level(len(levels))
    for k in range(len(levels) - 1, 0, -1):
        proofs = _down(levels[k], proofs, fanout).unionByName(at_level(k))
    alone = nodes.where("_n = 1").select("_g", "_row").join(at_level(0).drop("_pos"), "_g").select("_row", "_subroot", "_proof")
    whole = _down(levels[0], proofs, fanout).select("_row", "_subroot", "_proof").unionByName(alone) if levels else alone
    return whole.select("_row.*", F.col("_subroot").alias("subroot"), F.lit(root).alias("root"), F.col("_proof").alias("proof"))
