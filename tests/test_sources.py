"""Reading, quarantine, ingest, versions, and the vector store, on small hand-made input."""

import json
import os
import re
from datetime import datetime
import time
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.operators import encode, prepare
from colloquy.plans.store import build_store, refresh_store
from colloquy.schemas import CORRUPT
from colloquy.session import shared_dir
from colloquy.sources.transcripts import parse_lines, quarantine, quarantine_counts, read_log, read_transcripts
from colloquy.sources.vector_store import bucket_of, read_vectors, store_vectors
from colloquy.streaming.ingest import ingest_stream


def land(folder: Path, name: str, lines: list, mtime: int | None = None) -> None:
    """Write under another name, then rename: a stream must not see half a file."""
    folder.mkdir(parents=True, exist_ok=True)
    text = "\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines) + "\n"
    hidden = folder / f".{name}.part"
    hidden.write_text(text)
    if mtime:
        os.utime(hidden, (mtime, mtime))
    hidden.rename(folder / name)


def turn(conv, n, text, role="user"):
    return {"conv_id": conv, "turn": n, "role": role, "text": text}


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "landed"
    land(
        folder,
        "a.json",
        [turn(1, 0, "one"), '{"conv_id": 1, "turn": 1, "text": "bro', "not json", {"turn": 4, "role": "user", "text": "no key"}, turn(1, 2, None)],
    )
    return folder


def test_json_is_read_into_the_log_schema(spark, landed):
    log = read_transcripts(spark, str(landed), "json")
    assert log.columns == ["conv_id", "turn", "role", "text", CORRUPT, "source_file", "file_mtime"]
    assert all(row["source_file"].endswith("a.json") and row["file_mtime"] for row in log.collect())


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="format"):
        read_transcripts(spark, "/nowhere", "csv")


def test_quarantine_splits_and_counts_the_stored_log(spark, landed, tmp_path):
    ingest_stream(spark, str(landed), str(tmp_path / "log"), str(tmp_path / "offsets"))
    log = read_log(spark, str(tmp_path / "log"))
    good, bad = quarantine(log)
    assert sorted((r["conv_id"], r["turn"], r["text"]) for r in good.select("conv_id", "turn", "text").collect()) == [(1, 0, "one"), (1, 2, None)]
    assert bad.count() == 3
    assert quarantine_counts(log).first().asDict() == {"n_records": 5, "n_good": 2, "n_corrupt": 2, "n_keyless": 1, "n_no_text": 1}
    assert prepare.chunk(good).count() == 1


def test_parsed_lines_equal_the_json_reader(spark, landed):
    columns = ["conv_id", "turn", "role", "text", CORRUPT]
    lines = spark.read.text(str(landed))
    read = read_transcripts(spark, str(landed), "json")
    assert sorted(map(repr, parse_lines(lines).select(columns).collect())) == sorted(map(repr, read.select(columns).collect()))


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    source, log, offsets = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "offsets")
    land(source, "a.json", [turn(c, t, f"text {c} {t}") for c in range(5) for t in range(4)])
    ingest_stream(spark, str(source), log, offsets)
    land(source, "b.json", [turn(9, t, f"late {t}") for t in range(3)])
    ingest_stream(spark, str(source), log, offsets, max_files_per_trigger=1)
    ingest_stream(spark, str(source), log, offsets)
    streamed = read_log(spark, log).select("conv_id", "turn", "role", "text")
    batch = read_transcripts(spark, str(source), "json").select("conv_id", "turn", "role", "text")
    assert streamed.count() == 23
    assert streamed.exceptAll(batch).count() == batch.exceptAll(streamed).count() == 0


def test_a_file_of_any_age_arrives(spark, tmp_path):
    folder, log, offsets = tmp_path / "landed", str(tmp_path / "log"), str(tmp_path / "offsets")
    land(folder, "a.json", [turn(1, 0, "now")])
    ingest_stream(spark, str(folder), log, offsets, buckets=4)
    land(folder, "b.json", [turn(2, 0, "as new as the first")])
    land(folder, "c.json", [turn(3, 0, "unpacked with the oldest time there is")], mtime=1)
    ingest_stream(spark, str(folder), log, offsets, buckets=4)
    ingest_stream(spark, str(folder), log, offsets, buckets=4)
    assert sorted(r["conv_id"] for r in read_log(spark, log).collect()) == [1, 2, 3]


def test_large_exports_are_written_by_several_tasks_and_small_ones_make_few_files(spark, tmp_path):
    folder = tmp_path / "landed"
    for name in ("a", "b", "c"):
        land(folder, f"{name}.json", [turn(1, n, f"{name} {n}") for n in range(300)])
    few, many = (str(tmp_path / name) for name in ("few", "many"))
    ingest_stream(spark, str(folder), few, f"{few}-offsets", buckets=4)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1k")
    try:
        ingest_stream(spark, str(folder), many, f"{many}-offsets", buckets=4)
    finally:
        spark.conf.set(size, before)
    files = lambda path: len(list(Path(path).rglob("part-*.parquet")))
    assert files(few) == 1 < files(many)
    assert read_log(spark, many).count() == read_log(spark, few).count() == 900
    small = str(tmp_path / "batches")
    ingest_stream(spark, str(folder), small, f"{small}-offsets", buckets=4, max_bytes_per_trigger=10_000)
    assert files(small) > 1 and read_log(spark, small).count() == 900


def test_parquet_exports_stream_too(spark, tmp_path):
    exports = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").repartition(3).write.parquet(exports)
    ingest_stream(spark, exports, str(tmp_path / "log"), str(tmp_path / "offsets"), format="parquet", buckets=4)
    columns = ["conv_id", "turn", "role", "text"]
    streamed = read_log(spark, str(tmp_path / "log")).select(columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, spark.read.parquet(exports).select(columns).collect()))


def test_parquet_has_no_corrupt_records_but_may_lack_keys(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (None, 1, "user", "b"), (1, None, "user", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "p"))
    for origin in (True, False):
        read = read_transcripts(spark, str(tmp_path / "p"), origin=origin)
        good, bad = quarantine(read)
        assert [r["text"] for r in good.collect()] == ["a"] and bad.count() == 2
        assert quarantine_counts(read).first().asDict() == {"n_records": 3, "n_good": 1, "n_corrupt": 0, "n_keyless": 2, "n_no_text": 0}


def test_corrected_turn_replaces_the_old_one(spark, tmp_path):
    source = tmp_path / "in"
    land(source, "b.json", [turn(1, 0, "old"), turn(1, 1, "kept")], mtime=1_700_000_000)
    land(source, "a.json", [turn(1, 0, "new")], mtime=1_700_000_100)
    land(source, "c.json", [turn(1, 1, "same time, later name")], mtime=1_700_000_000)
    rows = prepare.current(read_transcripts(spark, str(source), "json")).collect()
    assert {(r["turn"], r["text"]) for r in rows} == {(0, "new"), (1, "same time, later name")}


def vectors(spark, rows):
    schema = "conv_id long, turn long, chunk int, role string, vec array<float>, encoder string, dim int, norm double"
    return spark.createDataFrame([(c, 0, 0, "user", v, "toy", 2, 1.0) for c, v in rows], schema)


def test_only_the_rewritten_bucket_changes(spark, tmp_path):
    path = str(tmp_path / "store")
    store_vectors(vectors(spark, [(c, [float(c), 1.0]) for c in range(20)]), path, 2, buckets=4)
    touched = spark.range(1).select(bucket_of(F.lit(3).cast("long"), 4)).first()[0]
    same = [r["id"] for r in spark.range(20).filter(bucket_of(F.col("id"), 4) == touched).collect()]
    files = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    store_vectors(vectors(spark, [(c, [-1.0, -1.0]) for c in same]), path, 2, buckets=4)
    after = {r["conv_id"]: r["vec"] for r in read_vectors(spark, path, "toy", buckets=4).collect()}
    assert after == {c: [-1.0, -1.0] if c in same else [float(c), 1.0] for c in range(20)}
    kept = {p for p in files if f"bucket={touched}" not in str(p)}
    assert kept and all(p.stat().st_mtime_ns == files[p] for p in kept)


def test_named_meetings_prune_the_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    store_vectors(vectors(spark, [(c, [float(c), 1.0]) for c in range(20)]), path, 2, buckets=4)
    found = read_vectors(spark, path, "toy", conv_ids=[3, 7], buckets=4)
    assert sorted(r["conv_id"] for r in found.collect()) == [3, 7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=|INSET)", plan)
    assert len(found.inputFiles()) >= 1
    assert read_vectors(spark, path, "other").count() == 0


@pytest.mark.parametrize("vec", [[1.0], [1.0, 2.0, 3.0], None, [1.0, None]])
def test_unsound_vector_fails_the_write(spark, tmp_path, vec):
    path = str(tmp_path / "store")
    with pytest.raises(PySparkException, match="vector of length 2 expected"):
        store_vectors(vectors(spark, [(1, [1.0, 2.0]), (2, vec)]), path, 2)
    assert not list(Path(path).rglob("*.parquet"))


def test_refresh_rebuilds_changed_buckets_whole(spark, tmp_path):
    source, log, offsets, path = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "offsets"), str(tmp_path / "store")
    encoder = lambda units: encode.hash_vectors(units, 16)
    land(source, "a.json", [turn(c, t, f"alpha{c} beta{t} gamma") for c in range(30) for t in range(2)], mtime=1_700_000_000)
    ingest_stream(spark, str(source), log, offsets, buckets=8)
    build_store(read_log(spark, log), encoder, path, 16, buckets=8)
    land(source, "b.json", [turn(5, 1, "delta epsilon")], mtime=1_700_000_100)
    ingest_stream(spark, str(source), log, offsets, buckets=8)
    changed = refresh_store(spark, log, encoder, path, 16, buckets=8)
    assert len(changed) == 1
    now = prepare.current(read_transcripts(spark, str(source), "json"))
    expected = encoder(prepare.chunk(now)).select("conv_id", "turn", "chunk", "vec")
    stored = read_vectors(spark, path, "hash-md5-16").select("conv_id", "turn", "chunk", "vec")
    assert stored.count() == 60
    assert stored.exceptAll(expected).count() == 0


@pytest.mark.parametrize("text", ["", None])
def test_withdrawn_text_leaves_the_store(spark, tmp_path, text):
    source, log, offsets, path = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "offsets"), str(tmp_path / "store")
    encoder = lambda units: encode.hash_vectors(units, 16)
    land(source, "a.json", [turn(c, 0, f"word{c}") for c in range(4)], mtime=1_700_000_000)
    ingest_stream(spark, str(source), log, offsets, buckets=64)
    build_store(read_log(spark, log), encoder, path, 16, buckets=64)
    land(source, "b.json", [turn(2, 0, text)], mtime=1_700_000_100)
    ingest_stream(spark, str(source), log, offsets, buckets=64)
    assert len(refresh_store(spark, log, encoder, path, 16, buckets=64)) == 1
    assert sorted(r["conv_id"] for r in read_vectors(spark, path, "hash-md5-16").collect()) == [0, 1, 3]


@pytest.mark.parametrize("mtime", [1_700_000_000, 1_600_000_000])
def test_files_with_equal_or_older_times_are_stored_too(spark, tmp_path, mtime):
    source, log, offsets, path = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "offsets"), str(tmp_path / "store")
    encoder = lambda units: encode.hash_vectors(units, 16)
    land(source, "a.json", [turn(1, 0, "one")], mtime=1_700_000_000)
    ingest_stream(spark, str(source), log, offsets, buckets=8)
    build_store(read_log(spark, log), encoder, path, 16, buckets=8)
    land(source, "b.json", [turn(2, 0, "two")], mtime=mtime)
    ingest_stream(spark, str(source), log, offsets, buckets=8)
    assert refresh_store(spark, log, encoder, path, 16, buckets=8)
    assert sorted(r["conv_id"] for r in read_vectors(spark, path, "hash-md5-16").collect()) == [1, 2]
    assert refresh_store(spark, log, encoder, path, 16, buckets=8) == []


def test_thousands_of_meetings_are_read_by_name(spark, tmp_path):
    path = str(tmp_path / "store")
    store_vectors(vectors(spark, [(c, [float(c), 1.0]) for c in range(20)]), path, 2, buckets=4)
    began = time.monotonic()
    assert read_vectors(spark, path, "toy", conv_ids=range(10, 5010), buckets=4).count() == 10
    assert time.monotonic() - began < 20


def test_versions_that_tie_in_one_file_do_not_depend_on_order(spark):
    rows = [(1, 0, "user", t, "f", 5) for t in ("a", "c", "b")]
    schema = "conv_id long, turn long, role string, text string, source_file string, file_mtime long"
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        assert [r["text"] for r in prepare.current(spark.createDataFrame(order, schema)).collect()] == ["c"]


def test_small_exports_do_not_become_small_files(spark, tmp_path):
    source, log = tmp_path / "in", tmp_path / "log"
    for e in range(24):
        land(source, f"{e}.json", [turn(c, e, "text") for c in range(22)], mtime=1_700_000_000 + e)
    ingest_stream(spark, str(source), str(log), str(tmp_path / "offsets"), buckets=16)
    assert read_log(spark, str(log)).count() == 24 * 22
    assert len(list(log.rglob("*.parquet"))) <= 16


def test_shared_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir())


def test_shared_dir_must_be_set_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
