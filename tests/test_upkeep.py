"""One stream from landing to store, and compaction of its log."""

import re

import pytest
from test_sources import land, turn

from colloquy.operators import encode
from colloquy.operators.prepare import chunk, current
from colloquy.sources.compacted import compact, current_rows, read_batched_log
from colloquy.sources.transcripts import quarantine
from colloquy.sources.vector_store import read_vectors
from colloquy.streaming import upkeep

DIM, BUCKETS = 16, 4


def hashed(units):
    return encode.hash_vectors(units, DIM)


class Folder:
    """A landing folder with its log, stream and store."""

    def __init__(self, spark, base):
        self.spark, self.landed, self.base = spark, base / "landed", base
        self.log, self.checkpoint, self.store, self.compacted = (str(base / n) for n in ("log", "offsets", "store", "compacted"))
        self.landed.mkdir(parents=True)

    def run(self, encoder=hashed, compacted=False):
        upkeep.stream_to_store(
            self.spark, str(self.landed), self.log, self.checkpoint, encoder, self.store, DIM, BUCKETS, self.compacted if compacted else None
        )

    def logged(self):
        return sorted(((r["conv_id"], r["turn"], r["text"]) for r in read_batched_log(self.spark, self.log).collect()), key=repr)

    def stored(self):
        rows = read_vectors(self.spark, self.store, f"hash-md5-{DIM}").collect()
        return sorted((r["conv_id"], r["turn"], tuple(r["vec"])) for r in rows)

    def built_anew(self):
        good, _ = quarantine(read_batched_log(self.spark, self.log))
        return sorted((r["conv_id"], r["turn"], tuple(r["vec"])) for r in hashed(chunk(current(good))).collect())


@pytest.fixture
def folder(spark, tmp_path):
    made = Folder(spark, tmp_path)
    land(made.landed, "a.json", [turn(c, t, f"words {c} of {t}") for c in range(12) for t in range(3)] + ["broken"])
    return made


def test_corrections_withdrawals_and_repeats(folder):
    folder.run()
    assert folder.stored() == folder.built_anew() and len(folder.stored()) == 36
    land(folder.landed, "b.json", [turn(3, 0, "corrected"), turn(40, 0, "new"), *[turn(c, t, "") for c in (5, 6) for t in range(3)]])
    folder.run()
    assert folder.stored() == folder.built_anew() and len(folder.stored()) == 31
    before = folder.logged(), folder.stored()
    folder.run()  # nothing has landed
    assert (folder.logged(), folder.stored()) == before


def test_a_bucket_that_loses_all_text_is_emptied(folder):
    folder.run()
    land(folder.landed, "b.json", [turn(c, t, None) for c in range(12) for t in range(3)])
    folder.run()
    assert folder.stored() == []


def test_failure_between_log_and_store(spark, folder):
    folder.run()
    land(folder.landed, "b.json", [turn(3, 0, "corrected"), turn(41, 0, "new")])

    def fails(units):
        raise RuntimeError("lost on the way to the store")

    with pytest.raises(Exception, match="lost on the way"):
        folder.run(fails)
    logged = folder.logged()
    assert (41, 0, "new") in logged and not any(r[0] == 41 for r in folder.stored())
    land(folder.landed, "c.json", [turn(42, 0, "later")])
    folder.run()
    assert folder.logged() == sorted([*logged, (42, 0, "later")], key=repr)
    assert folder.stored() == folder.built_anew() and {41, 42} <= {r[0] for r in folder.stored()}


def test_failure_after_the_store_is_not_stored_twice(spark, folder):
    """The mark is lost after the store was written: the batch is done again, with the same result."""
    folder.run()
    before = folder.logged(), folder.stored()
    path, number = folder.log, upkeep.marks(spark, folder.log)
    ((stream, batch),) = number.items()
    mark = spark.createDataFrame([(stream, batch - 1)], upkeep.MARKS)
    mark.write.mode("overwrite").parquet(upkeep._marks_path(path))
    commit = folder.base / "offsets" / "commits" / str(batch)
    commit.unlink()
    commit.with_name(f".{batch}.crc").unlink(missing_ok=True)
    folder.run()
    assert (folder.logged(), folder.stored()) == before
    assert upkeep.marks(spark, path) == number


def test_another_checkpoint_does_not_overwrite_the_log(spark, folder):
    folder.run()
    logged = folder.logged()
    folder.checkpoint = str(folder.base / "other-offsets")
    folder.run()
    assert len(folder.logged()) == 2 * len(logged)
    assert folder.stored() == folder.built_anew() and len(upkeep.marks(spark, folder.log)) == 2


def state(df):
    return sorted((r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in df.collect())


def test_compacted_view_before_between_and_after(spark, folder):
    def same():
        want = state(current(quarantine(read_batched_log(spark, folder.log))[0]))
        assert state(current_rows(spark, folder.log, folder.compacted)) == want
        return want

    def take_in():
        return compact(spark, folder.log, folder.compacted, upkeep.marks(spark, folder.log))

    folder.run(compacted=True)
    same()
    assert take_in() == [0, 1, 2, 3] and take_in() == []
    same()
    land(folder.landed, "b.json", [turn(3, 0, "corrected"), turn(5, 1, "")])
    land(folder.landed, "0-late.json", [turn(3, 1, "an old export that lands late"), turn(77, 0, "new")], mtime=1_000)
    folder.run(compacted=True)
    want = same()
    assert (5, 1, "user", "") in want and (3, 1, "user", "words 3 of 1") in want and (77, 0, "user", "new") in want
    rewritten = take_in()
    assert 0 < len(rewritten) <= 3
    assert same() == want
    land(folder.landed, "c.json", [turn(5, 1, "an older text of what was withdrawn")], mtime=2_000)
    folder.run(compacted=True)
    assert (5, 1, "user", "") in same()
    assert folder.stored() == folder.built_anew()


def test_a_compaction_that_died_is_run_again(spark, folder, monkeypatch):
    folder.run()
    compact(spark, folder.log, folder.compacted, upkeep.marks(spark, folder.log))
    land(folder.landed, "b.json", [turn(3, 0, "corrected")])
    folder.run()
    want = state(current_rows(spark, folder.log, folder.compacted))
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died before publishing")))
    with pytest.raises(RuntimeError, match="died"):
        compact(spark, folder.log, folder.compacted, upkeep.marks(spark, folder.log))
    monkeypatch.setattr(type(spark), "createDataFrame", create)
    assert state(current_rows(spark, folder.log, folder.compacted)) == want
    assert len(compact(spark, folder.log, folder.compacted, upkeep.marks(spark, folder.log))) == 1
    assert state(current_rows(spark, folder.log, folder.compacted)) == want


def test_a_view_reads_the_tail_of_the_log_only(spark, folder):
    folder.run()
    compact(spark, folder.log, folder.compacted, upkeep.marks(spark, folder.log))
    plan = current_rows(spark, folder.log, folder.compacted)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*stream#\d+[^\]]*batch#\d+L? (<=|>) ", plan)
    assert re.search(r"PartitionFilters: \[[^\]]*version#\d+L? = ", plan)
