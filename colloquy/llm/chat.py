"""Chat formatting in budgeted windows, in DataFrame functions alone.

A turn is written as  <s>[INST] role [/INST] text</s>  with the control strings inside role
and text broken by a backslash, which is undone when read. Turns have prefix sums of their
tokens; a window takes whole turns that the sums put together, after the conversation's
system turn and as many turns of limited history as fit. History and system turns stand in
several windows but are targets of the loss in none but their first.

Sums are taken in two steps: blocks of turns are added up first, so a conversation of any
length is spread over many tasks; windows are put together by (conversation, window), which
holds at most `budget` tokens and one turn.

How windows are cut: new turns of a window fill at most half of what system turn and history
leave of the budget, by their ends' prefix sums, plus a turn that crosses the half; a turn
longer than that half has a window of its own, without history, and may exceed the budget,
since turns are not cut.

Results in special cases: a null text is empty; a null role is written as the empty role; rows of a
conversation are ordered by turn, equal turns by role and text, null turns first; rows with a null
conversation form one conversation. Repeated rows are turns each. Only a conversation's first turn
can be its system turn; others of that role are ordinary. An empty table gives no windows.
Other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import materialise

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
#: Control strings, broken after their first sign.
_CONTROL = r"([<\[])(/?(?:s>|INST\]))"
_BROKEN = r"([<\[])\\(/?(?:s>|INST\]))"
_TURN = r"(?s)<s>\[INST\] (.*?) \[/INST\] (.*?)</s>"
BLOCK = 256  # turns whose tokens are added up in one step


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _BROKEN, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def _turns(rows: DataFrame, budget_unit: Column | None) -> DataFrame:
    """Rows with their written form, tokens and a place in the conversation (`_block`, `_in`)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    written = F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))
    base = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    base = base.withColumn("_form", written)
    tokens = budget_unit if budget_unit is not None else F.ceil(F.octet_length("_form") / F.lit(4)).cast("long")
    return base.withColumn("_tokens", tokens).withColumn("_block", F.floor(F.col("turn") / BLOCK))


def _running(turns: DataFrame) -> DataFrame:
    """Adds `_n` (number in the conversation, from 0), `_start` (tokens before it), `_first` (is it the first)."""
    inner = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    within = turns.withColumn("_k", F.row_number().over(inner) - 1).withColumn(
        "_a", F.coalesce(F.sum("_tokens").over(before), F.lit(0))
    )
    blocks = turns.groupBy("conv_id", "_block").agg(F.sum("_tokens").alias("_t"), F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("_block").alias("_b"),
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_block").eqNullSafe(F.col("_b"))
    return within.join(blocks, same).select(
        "conv_id", "turn", "role", "text", "_form", "_tokens",
        (F.col("_k") + F.col("_c0")).alias("_n"), (F.col("_a") + F.col("_t0")).alias("_start"),
    )


def windows(rows: DataFrame, budget: int, history: int, tokens: Column | None = None) -> DataFrame:
    """conv_id, window, formatted, n_new, loss: one row per window.

    `loss` holds (start, length) in characters of `formatted` for each target, the text of a new assistant turn.
    `history` is the most tokens of turns repeated from before the window.
    """
    turns = materialise(_running(_turns(rows, tokens)), "turns")
    system = turns.where((F.col("_n") == 0) & (F.col("role") == "system")).select(
        F.col("conv_id").alias("_sconv"), F.col("_form").alias("_sform"), F.col("_tokens").alias("_stokens")
    )
    joined = turns.join(system, F.col("conv_id").eqNullSafe(F.col("_sconv")), "left").drop("_sconv")
    room = F.greatest(F.lit(2), F.lit(budget) - F.coalesce("_stokens", F.lit(0)) - history)
    half = (room / 2).cast("long")
    body = joined.withColumn("_half", half).withColumn("_long", F.col("_tokens") > F.col("_half"))
    # A window is named by its first possible place: the slice its turns end in, or the long turn itself.
    # Turns on the two sides of a long turn must not share a window, and a slice holds a long turn's end
    # only if the turns after it in that slice come with its number.
    slice_ = F.floor((F.col("_start") + F.col("_tokens") - 1) / F.col("_half"))
    ordered = Window.partitionBy("conv_id", "_slice").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    cut = body.withColumn("_slice", slice_).withColumn("_longs", F.sum(F.col("_long").cast("int")).over(ordered))
    cut = cut.withColumn("_side", 2 * F.col("_longs") - F.col("_long").cast("int"))
    key = ["conv_id", "_slice", "_side"]
    spans = cut.groupBy(*key).agg(
        F.min("_n").alias("_from"), F.min("_start").alias("_begin"), F.first("_sform").alias("_sform"),
        F.first("_half").alias("_h"), F.max("_long").alias("_alone"),
        F.sort_array(F.collect_list(F.struct("_n", "role", "_form", "text"))).alias("_new"),
    )
    # History: a turn that begins at most `history` tokens before a window's beginning. Both are put into
    # bins of that width, so a turn meets the windows of its own bin and the next.
    width = max(history, 1)
    places = spans.where(~F.col("_alone")).select(
        *[F.col(c).alias(f"_w{c}") for c in key], "_begin", "_from", F.floor(F.col("_begin") / width).alias("_bin")
    )
    bins = F.explode(F.array(F.floor(F.col("_start") / width), F.floor(F.col("_start") / width) + 1))
    past = cut.select(F.col("conv_id").alias("_p"), F.col("_n").alias("_pn"), F.col("_start").alias("_ps"), "_sform", "_form", bins.alias("_pbin"))
    near = (
        F.col("_p").eqNullSafe(F.col("_wconv_id")) & (F.col("_pbin") == F.col("_bin"))
        & (F.col("_pn") < F.col("_from")) & (F.col("_begin") - F.col("_ps") <= history)
        & ~((F.col("_pn") == 0) & F.col("_sform").isNotNull())
    )
    told = places.join(past, near).groupBy(*[f"_w{c}" for c in key]).agg(
        F.sort_array(F.collect_list(F.struct("_pn", "_form"))).alias("_told")
    )
    match = [spans[c].eqNullSafe(told[f"_w{c}"]) for c in key]
    whole = spans.join(told, match, "left").select(
        "conv_id", F.col("_from").alias("window"), "_new",
        F.concat(
            F.when(F.col("_from") > 0, F.coalesce("_sform", F.lit(""))).otherwise(""),
            F.array_join(F.transform(F.coalesce(F.col("_told"), F.array().cast("array<struct<_pn:bigint,_form:string>>")), lambda t: t["_form"]), ""),
        ).alias("_before"),
    )

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["_form"])
        size = F.length(escape(turn["text"]))
        target = F.struct((begin - F.length(F.lit(CLOSE)) - size).alias("start"), size.alias("length"))
        more = F.when(turn["role"] == "assistant", F.array(target)).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct(begin.alias("at"), F.concat(state["loss"], more).alias("loss"))

    start = F.struct(F.length("_before").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    return whole.select(
        "conv_id", "window",
        F.concat("_before", F.array_join(F.transform("_new", lambda t: t["_form"]), "")).alias("formatted"),
        F.size("_new").alias("n_new"),
        F.aggregate("_new", start, add, lambda state: state["loss"]).alias("loss"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text) and targets (text under the mask), parsed from `formatted` and `loss` alone.

    A window's last n_new turns are its own; those before them are repeats.
    """
    roles = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(2))
    turns = F.arrays_zip(F.transform(roles, unescape).alias("role"), F.transform(texts, unescape).alias("text"))
    targets = F.transform("loss", lambda t: unescape(F.substring(F.col("formatted"), t["start"] + 1, t["length"])))
    return made.select("conv_id", "window", F.length("formatted").alias("chars"), F.slice(turns, -F.col("n_new"), F.col("n_new")).alias("turns"), targets.alias("targets"))
