"""Details, neighbours and contexts, with answers written in advance."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import context

SAID = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def said(spark):
    # One long meeting with gaps in its turns, some short ones.
    rows = [(1, t, "user", f"long {t}") for t in range(0, 400) if t % 7 and not 100 <= t < 160]
    rows += [(c, t, "assistant", f"short {c} {t}") for c in (2, 3, 4) for t in range(c)]
    return spark.createDataFrame(rows, SAID).repartition(5)


def plain(rows, r):
    out, meetings = {}, {}
    for row in rows:
        meetings.setdefault(row["conv_id"], []).append(row["turn"])
    for conv, turns in meetings.items():
        turns.sort()
        for i, t in enumerate(turns):
            out[conv, t] = (turns[max(0, i - r) : i], turns[i + 1 : i + 1 + r])
    return out


@pytest.mark.parametrize("span", [100_000, 50, 10, 3, 1])
@pytest.mark.parametrize("r", [1, 3])
def test_neighbours_for_any_span(said, span, r):
    rows = context.neighbours(said, r, span).collect()
    got = {(x["conv_id"], x["turn"]): ([u["turn"] for u in x["before"]], [u["turn"] for u in x["after"]]) for x in rows}
    assert got == plain(said.collect(), r)
    assert len(rows) == said.count()


def test_details(spark):
    rows = [(1, 0, "user", "abcd ef"), (1, 2, "assistant", "abc"), (1, 3, "user", None), (2, 0, None, "x y z")]
    got = {r["conv_id"]: r.asDict() for r in context.meeting_details(spark.createDataFrame(rows, SAID)).collect()}
    assert got[1] == {"conv_id": 1, "n_turns": 3, "n_speakers": 2, "n_words": 3, "n_chars": 10, "first_turn": 0, "last_turn": 3, "speaker_share": 0.7}
    assert (got[2]["n_speakers"], got[2]["n_words"], got[2]["speaker_share"]) == (0, 3, 0.0)


def test_details_of_a_meeting_without_text(spark):
    row = context.meeting_details(spark.createDataFrame([(1, 0, "user", None)], SAID)).first()
    assert (row["n_turns"], row["n_chars"], row["speaker_share"]) == (1, 0, None)


def test_context_keeps_what_fits_and_always_the_first(spark):
    units = spark.createDataFrame(
        [(1, 0, 0, "user", "aaaa"), (1, 1, 0, "bot", "bb"), (1, 2, 0, "user", "c" * 50)], "conv_id long, turn long, chunk int, role string, text string"
    )
    hits = spark.createDataFrame(
        [(1, 1, 0, 0, 1), (1, 1, 1, 0, 2), (1, 1, 2, 0, 3), (2, 1, 2, 0, 1), (2, 1, 1, 0, 2)], "req_id long, conv_id long, turn long, chunk int, rank int"
    )
    got = {r["req_id"]: (r["context"], r["n_hits"]) for r in context.assemble_context(hits, units, 18).collect()}
    assert got == {1: ("user: aaaa\nbot: bb", 2), 2: ("user: cccccccccccc", 1)}
    tight = {r["req_id"]: r["context"] for r in context.assemble_context(hits, units, 17).collect()}
    assert tight[1] == "user: aaaa"


def test_surroundings_of_hits(spark, said):
    hits = spark.createDataFrame([(7, 3, 1), (8, 3, 1), (7, 1, 163)], "req_id long, conv_id long, turn long")
    got = {(r["req_id"], r["conv_id"]): ([u["turn"] for u in r["before"]], [u["turn"] for u in r["after"]]) for r in context.around_hits(hits, said).collect()}
    assert got == {(7, 3): ([0], [2]), (8, 3): ([0], [2]), (7, 1): ([162], [164])}


def test_line_without_a_speaker(spark):
    assert spark.range(1).select(context.spoken(F.lit(None).cast("string"), F.lit("x"))).first()[0] == "x"


@pytest.mark.parametrize("span", [1, 2, 5, 100])
def test_rows_without_turn_or_meeting_keep_their_place_in_every_span(spark, span):
    rows = [(1, t, "user", f"t{t}") for t in range(9)] + [(1, None, "user", "n1"), (1, None, "user", "n2"), (None, 3, "user", "m"), (None, None, "user", "o")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(repr, context.neighbours(said, r=2, span=span).collect()))
    assert got == sorted(map(repr, context.neighbours(said, r=2, span=1000).collect())) and len(got) == 13


def test_places_count_along_meetings_whatever_the_turns(spark):
    rows = [(1, 1_760_000_000_000 + 997 * i, "user", f"at {i}") for i in range(500)] + [(2, None, r, "x") for r in ("a", "b")] + [(None, 5, "u", "y")]
    got = context.places(spark.createDataFrame(rows, SAID).repartition(5), block=40).collect()
    by_meeting = {}
    for row in sorted(got, key=lambda r: r["place"]):
        by_meeting.setdefault(row["conv_id"], []).append((row["place"], row["text"], row["role"]))
    assert by_meeting[1] == [(i, f"at {i}", "user") for i in range(500)]
    assert by_meeting[2] == [(0, "x", "a"), (1, "x", "b")] and by_meeting[None] == [(0, "y", "u")]


def test_hits_find_their_neighbours_by_place(spark, said):
    hits = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (1, 1, 398), (1, 2, 0), (1, 3, 1), (1, 9, 9)], "req_id long, conv_id long, turn long")
    key = lambda r: (r["req_id"], r["conv_id"], r["turn"], r["role"], r["text"], str(r["before"]), str(r["after"]))
    want = sorted(map(key, context.around_hits(hits, said, r=2).collect()))
    got = sorted(map(key, context.around_hits(hits, said, r=2, span=10).collect()))
    assert got == want and len(want) == 5


def test_a_long_meeting_with_turns_in_milliseconds_is_not_sorted_whole(spark):
    rows = spark.range(1_000_000).selectExpr("1L AS conv_id", "1760000000000 + id * 1009 AS turn", "'user' AS role", "concat('at ', id) AS text")
    hits = spark.createDataFrame([(1, 1, 1760000000000 + i * 1009) for i in (0, 499_999, 999_999)], "req_id long, conv_id long, turn long")
    near = context.around_hits(hits, rows, r=1)
    got = sorted((r["turn"], [u["text"] for u in r["before"]], [u["text"] for u in r["after"]]) for r in near.collect())
    assert [g[1:] for g in got] == [([], ["at 1"]), (["at 499998"], ["at 500000"]), (["at 999998"], [])]
    assert "Window" not in near._jdf.queryExecution().executedPlan().toString()


def test_overlapping_hits_become_one_span(spark):
    utterances = spark.createDataFrame([(1, 0, "user", " ".join(f"w{i}" for i in range(200))), (1, 1, None, "b c")], SAID)
    key = "req_id long, conv_id long, turn long, chunk int, rank int"
    hits = spark.createDataFrame([(1, 1, 0, 1, 3), (1, 1, 0, 0, 2), (1, 1, 1, 0, 1), (1, 1, 0, 4, 4), (1, 1, 0, 4, 4), (2, 1, 0, 2, 1)], key)
    spans = {(r["req_id"], r["turn"], r["lo"], r["hi"], r["rank"], r["n_chunks"]) for r in context.merge_hits(hits, 40, 10).collect()}
    assert spans == {(1, 0, 0, 70, 2, 2), (1, 0, 120, 160, 4, 1), (1, 1, 0, 40, 1, 1), (2, 0, 60, 100, 1, 1)}
    got = {r["req_id"]: r["context"] for r in context.merged_context(hits, utterances, 10_000).collect()}
    said = lambda lo, hi: "user: " + " ".join(f"w{i}" for i in range(lo, hi))
    assert got == {1: "\n".join(["b c", said(0, 70), said(120, 160)]), 2: said(60, 100)}
