"""What surrounds a hit: details of its meeting, its neighbours, and the text to hand on."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import TOKEN
from colloquy.operators.joins import join_small
from colloquy.schemas import CHUNK_KEY, UTTERANCE_KEY
from colloquy.session import materialise

# Rows of one meeting that a single task may sort; longer meetings are cut into spans.
SPAN = 100_000


def meeting_details(utterances: DataFrame, speaker: str = "user") -> DataFrame:
    """Per meeting: turns, speakers, words, characters, first and last turn, and one speaker's share of the talk.

    All parts are summed up before the shuffle, so a long meeting is a few rows per task.
    """
    n_words = F.regexp_count("text", F.lit(TOKEN))
    n_chars = F.char_length("text")
    of_speaker = F.sum(F.when(F.col("role") == speaker, n_chars).otherwise(0))
    return (
        utterances.groupBy("conv_id", "role")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(n_words).alias("w"),
            F.sum(n_chars).alias("c"),
            of_speaker.alias("s"),
            F.min("turn").alias("lo"),
            F.max("turn").alias("hi"),
        )
        .groupBy("conv_id")
        .agg(
            F.sum("n").alias("n_turns"),
            F.count("role").alias("n_speakers"),
            F.coalesce(F.sum("w"), F.lit(0)).alias("n_words"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("n_chars"),
            F.min("lo").alias("first_turn"),
            F.max("hi").alias("last_turn"),
            F.round(F.sum("s") / F.nullif(F.sum("c"), F.lit(0)), 6).alias("speaker_share"),
        )
    )


def places(utterances: DataFrame, block: int = SPAN) -> DataFrame:
    """Add `place`: 0, 1, 2, ... along each meeting by turn, role and text, whatever numbers the turns have. A written table.

    Rows are dealt by ranges of (conv_id, turn, role, start of the text) into blocks of about `block` rows, counted per
    meeting and block, and numbered within these; a prefix sum of the counts says where a block of a meeting begins. Only
    meetings that lie in several blocks have one, so the table of those sums has at most two rows a block and is broadcast.
    """
    spark = utterances.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-utterances.count() // block))
    dealt = utterances.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64))
    dealt = materialise(dealt.withColumn("_block", F.spark_partition_id()), "blocks")
    sizes = materialise(dealt.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_size")), "block-sizes")
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_in"), F.sum("_size").over(before).alias("_start"))
    start = F.broadcast(start.filter("_start > 0"))
    within = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")
    numbered = dealt.withColumn("_at", F.row_number().over(within) - 1)
    joined = numbered.join(start, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_in")), "left")
    place = (F.coalesce("_start", F.lit(0)) + F.col("_at")).cast("long")
    return materialise(joined.select(*utterances.columns, place.alias("place")), "places")


def neighbours(utterances: DataFrame, r: int = 1, span: int = SPAN) -> DataFrame:
    """Each utterance with up to `r` before it and `r` after it, as arrays in turn order.

    (conv_id, turn) must be unique, as `current` makes it; rows without a turn come
    first, by role and text, and rows without a meeting form one meeting. While no meeting has more
    than `span` utterances, one window per meeting does. Otherwise meetings are cut
    into spans of `span` places (see `places`), and the spans exchange their first and
    last `r` utterances, so that turns may be numbered by milliseconds or be missing.
    """
    said = F.struct("turn", "role", "text")
    if _longest(utterances) <= span:
        order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
        return utterances.select(
            "conv_id",
            "turn",
            "role",
            "text",
            F.collect_list(said).over(order.rowsBetween(-r, -1)).alias("before"),
            F.collect_list(said).over(order.rowsBetween(1, r)).alias("after"),
        )

    group = Window.partitionBy("conv_id", "_span")
    order = group.orderBy("turn", "role", "text")
    rows = places(utterances).withColumn("_span", F.floor(F.col("place") / F.lit(span)).cast("long")).select(
        "conv_id",
        "_span",
        "turn",
        "role",
        "text",
        F.collect_list(said).over(order.rowsBetween(-r, -1)).alias("_before"),
        F.collect_list(said).over(order.rowsBetween(1, r)).alias("_after"),
        F.row_number().over(order).alias("_n"),
        F.count(F.lit(1)).over(group).alias("_of"),
    )
    # At most r rows from either end of each span.
    ends = (
        rows.filter((F.col("_n") <= r) | (F.col("_n") > F.col("_of") - r))
        .groupBy("conv_id", "_span")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_n") <= r, said))).alias("_head"),
            F.sort_array(F.collect_list(F.when(F.col("_n") > F.col("_of") - r, said))).alias("_tail"),
        )
    )
    along = Window.partitionBy("conv_id").orderBy("_span")
    outside = ends.select(
        "conv_id",
        "_span",
        F.flatten(F.collect_list("_tail").over(along.rowsBetween(-r, -1))).alias("_earlier"),
        F.flatten(F.collect_list("_head").over(along.rowsBetween(1, r))).alias("_later"),
    )
    # Rows without a meeting have a place too: the join must find NULL equal to NULL.
    outside = outside.withColumnsRenamed({"conv_id": "_conv", "_span": "_place"})
    joined = rows.join(outside, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_span").eqNullSafe(F.col("_place")))
    earlier = F.concat("_earlier", "_before")
    start = F.greatest(F.size(earlier) - r + 1, F.lit(1))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.slice(earlier, start, F.lit(r)).alias("before"),
        F.slice(F.concat("_after", "_later"), F.lit(1), F.lit(r)).alias("after"),
    )


def _longest(utterances: DataFrame) -> int:
    return utterances.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0


def around_hits(hits: DataFrame, utterances: DataFrame, r: int = 1, span: int = SPAN) -> DataFrame:
    """Hits with the utterances around them; only the meetings that were hit are looked at.

    Where one of these has more than `span` utterances no meeting is sorted: a hit asks for the places up to `r` before
    and after its own, and finds them by an equi-join. `hits` are read more than once: pass a written table.
    """
    met = hits.select("conv_id").distinct()
    rows = join_small(utterances, met, ["conv_id"], spread_by=["turn"], how="left_semi").select("conv_id", "turn", "role", "text")
    if _longest(rows) <= span:
        return join_small(neighbours(rows, r, span), hits, ["conv_id", "turn"], spread_by=["turn"])
    numbered = places(rows)
    own = hits.select("conv_id", "turn").distinct()
    centres = materialise(join_small(numbered, own, ["conv_id", "turn"], spread_by=["turn"]), "centres")
    asked = centres.select("conv_id", F.col("place").alias("_centre"), F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("_d"))
    asked = asked.filter("_d <> 0").withColumn("place", F.col("_centre") + F.col("_d"))
    found = join_small(numbered, asked, ["conv_id", "place"], spread_by=["turn"])
    near = found.groupBy("conv_id", F.col("_centre").alias("place")).agg(
        F.sort_array(F.collect_list(F.struct("_d", F.struct("turn", "role", "text").alias("said")))).alias("_near")  # at most 2 r
    )
    near = materialise(near, "near")
    side = lambda keep: F.transform(F.filter(F.coalesce("_near", F.array()), keep), lambda x: x["said"])
    both = join_small(centres, near, ["conv_id", "place"], spread_by=["turn"], how="left")
    both = both.select("conv_id", "turn", "role", "text", side(lambda x: x["_d"] < 0).alias("before"), side(lambda x: x["_d"] > 0).alias("after"))
    return join_small(both, hits, ["conv_id", "turn"], spread_by=["turn"])


def spoken(role: Column, text: Column) -> Column:
    """One line of a transcript; without a role it is the text alone."""
    return F.concat_ws(": ", role, F.coalesce(text, F.lit("")))


def assemble_context(hits: DataFrame, units: DataFrame, max_chars: int, key=CHUNK_KEY) -> DataFrame:
    """Per request the text of its best hits, in rank order, one "speaker: text" line each.

    Hits are taken while they and the line ends between them fit into `max_chars`.
    The first is always taken, cut to the budget if it is longer. There are at
    most k hits per request, so a group stays as small as the search made it.
    `hits` are read more than once: pass a written table, not a search.
    """
    places = hits.select("req_id", "rank", *key)
    lines = join_small(units.select(*key, "role", "text"), places, list(key), spread_by=list(key))
    lines = lines.select("req_id", "rank", spoken(F.col("role"), F.col("text")).alias("line"))
    return _within(lines, max_chars)


def _within(lines: DataFrame, max_chars: int) -> DataFrame:
    """Per request the lines (req_id, rank, line) that fit, in rank order, as one text."""
    so_far = Window.partitionBy("req_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.char_length("line")).over(so_far) + F.count(F.lit(1)).over(so_far) - 1
    return (
        lines.withColumn("_used", used)
        .filter((F.col("_used") <= max_chars) | (F.col("rank") == 1))
        .withColumn("line", F.substring("line", 1, max_chars))
        .groupBy("req_id")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"),
            F.count(F.lit(1)).alias("n_hits"),
        )
    )


def merge_hits(hits: DataFrame, width: int, overlap: int) -> DataFrame:
    """Hits whose chunks overlap or touch, as one span each: req_id, conv_id, turn, words lo to hi (hi excluded), rank, n_chunks.

    Chunks are windows of `width` words that overlap by `overlap`, as `chunk` cuts them. A span starts where a chunk begins
    behind the end of the one before it (gaps and islands), and has the best rank of its chunks. A request has at most k
    hits, which bounds a group. A repeated hit counts once.
    """
    best = hits.groupBy("req_id", *CHUNK_KEY).agg(F.min("rank").alias("rank"))
    along = Window.partitionBy("req_id", *UTTERANCE_KEY).orderBy("chunk")
    lo = (F.col("chunk") * (width - overlap)).cast("long")
    fresh = F.when(lo > F.lag(lo + width).over(along), 1).otherwise(0)
    marked = best.withColumns({"_lo": lo, "_fresh": fresh}).withColumn("_island", F.sum("_fresh").over(along))
    return (
        marked.groupBy("req_id", *UTTERANCE_KEY, "_island")
        .agg(F.min("_lo").alias("lo"), (F.max("_lo") + width).alias("hi"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_chunks"))
        .drop("_island")
    )


def merged_context(hits: DataFrame, utterances: DataFrame, max_chars: int, width: int = 40, overlap: int = 10) -> DataFrame:
    """`assemble_context` over merged hits: no word of an utterance is handed on twice to a request.

    Spans are ranked by their best chunk and cut from the utterances, which must be those the chunks were cut from.
    """
    spans = materialise(merge_hits(hits, width, overlap), "spans")
    said = join_small(utterances.select(*UTTERANCE_KEY, "role", "text"), spans, list(UTTERANCE_KEY), spread_by=["text"])
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    text = F.array_join(F.slice(tokens, (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
    return _within(said.select("req_id", "rank", spoken(F.col("role"), text).alias("line")), max_chars)
