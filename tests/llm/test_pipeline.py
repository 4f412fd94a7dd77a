"""The pipeline stage by stage against plain Python, and as a whole."""

import collections
import hashlib
import random

import pytest
from conftest import low, words

import corpus_pipeline as pipeline
from colloquy.session import materialise, scratch_path


@pytest.fixture(scope="module")
def sf_dir(spark, odd):
    rng = random.Random(9)
    rows, labels, kind = [], [], {}
    for i in range(900):
        text = [f"{rng.choice('bcdfglmn')}{rng.choice('aeiou')}word{rng.randint(0, 300)}" for _ in range(rng.randint(20, 80))]
        what = "toxic" if i % 9 == 0 else "poor" if i % 9 == 1 else "copy" if i % 9 == 4 else "clean"
        if what == "toxic":
            text[3:3] = ["horrible", "bastards"]
            text.append("bastards")
        if what == "poor":
            text = [w + "###" for w in text]
        if what == "copy":
            text = f"{previous} and".split()  # the clean text before it, one word longer
        previous = " ".join(text)
        rows.append((10_000 - i, previous, ["en", "de"][i % 2], f"s{i % 4}", len(previous), 0.5, "x", 1))
        labels.append((10_000 - i, int(what != "poor"), int(what == "toxic")))
        kind[10_000 - i] = what
    folder = scratch_path(spark, "pipeline-input")
    odd.unionByName(spark.createDataFrame(rows, odd.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, kind


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_every_stage_does_its_work_and_no_more(spark, sf_dir):
    folder, kind = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, counted(docs)
    functions = dict(pipeline.STAGES)
    assert list(functions) == ["toxicity", "quality", "near_copies", "mixing", "packing"]

    def step(name):
        nonlocal docs, before
        made = materialise(functions[name](spark, docs, folder), name)
        assert made.columns == columns or name == "packing"
        after = counted(made)
        lost, docs, before = before - after, made, after
        return lost

    lost = step("toxicity")
    assert {r[0] for r in lost} == {d for d, k in kind.items() if k == "toxic"}
    lost = step("quality")
    assert {r[0] for r in lost if r[0] in kind} == {d for d, k in kind.items() if k == "poor"}
    kept_before = dict(before)
    lost = step("near_copies")
    sets = {}
    for row in kept_before:
        w = words(low(row[1]))
        sets[row] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for row in before:
        assert before[row] == 1 and not any(alike(row, other) for other in before if other != row)
    for row in lost:
        assert row in before or any(alike(row, other) for other in kept_before if other != row and (other[0] or 0) <= (row[0] or 10**9))
    sizes = {row: len(words(row[1])) for row in before}
    step("mixing")
    taken = collections.Counter()
    for row, copies in before.items():
        assert row in sizes and copies <= 2
        taken[row[3]] += copies * sizes[row]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
    documents = sum(before.values())
    packed = functions["packing"](spark, docs, folder).collect()
    assert sum(r["piece"] == 0 for r in packed) == documents
    used = collections.Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) <= 1.05 * sum(used.values()) / 1024 + 1


def test_near_copies_of_one_id_and_of_none_are_one(spark, odd):
    text = [f"word{i}" for i in range(80)]
    near = lambda end: " ".join([*text, end])
    ids = [(5, "a"), (5, "b"), (None, "c"), (None, "a"), (9, "d")]
    other = [" ".join(f"{w}{i}" for i in range(50)) for w in ("x", "y")]
    texts = [(d, near(e)) for d, e in ids] + [(None, other[0]), (None, other[0] + " z"), (3, other[1]), (3, other[1]), (3, ""), (3, ""), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", None, 0.1, "x", 1) for d, t in texts], odd.schema).repartition(4)
    kept = pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    rows = sorted(((r["doc_id"] or -1, r["text"]) for r in kept.collect()), key=str)
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    five = min(near("a"), near("b"), key=digest)
    without = min(other[0], other[0] + " z", key=digest)
    assert rows == sorted([(5, five), (-1, without), (3, other[1]), (3, ""), (4, "")], key=str)


def test_run_equals_its_stages_and_passes_empty_tables(spark, sf_dir):
    folder, _ = sf_dir
    whole = pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(whole.columns) and whole.count() > 0
    empty = scratch_path(spark, "pipeline-empty")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert pipeline.run(spark, empty).count() == 0
    assert pipeline.ORACLE_SQL is None
