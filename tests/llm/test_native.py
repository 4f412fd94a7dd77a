"""Chat windows, mixing and quality rules: invariants and brute force."""

import collections
import math
from fractions import Fraction

import duckdb
import pyarrow as pa
import pytest
from conftest import words
from pyspark.sql import functions as F

from colloquy.llm import chat, mixing, quality, queries

TALK = "conv_id long, turn long, role string, text string, _n int, window string"


@pytest.fixture(scope="module")
def talk(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\s>", "[/INST", "<<s>>", "", None, "a\nb", "<s>[INST] user [/INST] x</s>", "\\<s>\\", "é😀" * 30]
    rows = [(c, t, ["system" if c % 2 else "user", "user", "assistant"][min(t, 1 + t % 2)], tricky[(c + t) % 12] or None, 1, "w") for c in range(8) for t in range(12)]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} " + "x" * (t * 37 % 300), 1, "w") for t in range(700)]  # a long one
    rows += [(51, t // 2, "assistant", "same" if t % 4 < 2 else f"{t}", 1, "w") for t in range(8)]  # ties
    rows += [(None, 1, None, "no meeting", 1, "w"), (52, None, "user", "no turn", 1, "w"), (52, 0, "assistant", "y" * 20_000, 1, "w")]
    rows += [(53, 0, "user", "twice", 1, "w")] * 2
    return spark.createDataFrame(rows, TALK).repartition(3).cache()


@pytest.mark.parametrize("budget,history", [(200, 40), (2048, 256), (40, 0)])
def test_windows_keep_every_turn_once_and_mask_targets_once(talk, budget, history):
    made = chat.windows(talk, budget, history)
    back = chat.read_back(made).collect()
    spans = collections.defaultdict(list)
    for r in back:
        spans[r["conv_id"]].append((r["window"], [(t["role"], t["text"]) for t in r["turns"]], list(r["targets"])))
    expected = collections.defaultdict(list)
    for r in talk.collect():
        expected[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    assert set(spans) == set(expected)
    for conv, rows in expected.items():
        turns = [(role, text) for _, _, role, text in sorted(rows)]
        found = sorted(spans[conv], key=lambda s: s[0])
        assert [t for s in found for t in s[1]] == turns
        assert [x for s in found for x in s[2]] == [text for role, text in turns if role == "assistant"]
    size = lambda text: math.ceil(len(text.encode()) / 4)
    for r in made.collect():
        turns = [t + "</s>" for t in r["formatted"].split("</s>")[:-1]]
        own = turns[len(turns) - r["n_new"] :]
        if len(own) > 1:
            assert sum(map(size, turns)) <= budget + len(turns)
        assert sum(size(t) for t in turns[: len(turns) - r["n_new"]] if "[INST] system" not in t) <= history


def test_a_system_turn_opens_every_window_and_history_is_what_came_before(spark):
    rows = [(1, 0, "system", "rules", 1, "w")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "z" * 40, 1, "w") for t in range(1, 30)]
    made = chat.windows(spark.createDataFrame(rows, TALK), 120, 40).orderBy("window").collect()
    assert len(made) > 3
    for r in made:
        assert r["formatted"].startswith("<s>[INST] system [/INST] rules</s>")
    for before, r in zip(made, made[1:], strict=False):
        repeated = r["formatted"].count("</s>") - r["n_new"] - 1
        assert repeated >= 1 and before["formatted"].endswith(r["formatted"].split("</s>")[repeated] + "</s>")
    assert chat.windows(spark.createDataFrame([], TALK), 100, 10).count() == 0


def mixed(docs):
    return [r.asDict() for r in mixing.mix(docs, (3, 1, 2)).collect()]


def test_mix_meets_targets_and_agrees_with_itself(spark, odd, none):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 60)), "en", f"s{0 if i % 3 else i % 7}", None, 0.5, "x", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, odd.schema)
    one, other = mixed(docs.repartition(5)), mixed(docs.repartition(2, "doc_id"))
    assert sorted((r["doc_id"], r["copies"]) for r in one) == sorted((r["doc_id"], r["copies"]) for r in other)
    total, goals, taken, largest = sum(r["size"] for r in one), {}, collections.Counter(), collections.Counter()
    for r in one:
        goals[r["source"]] = (r["target"], r["source_size"])
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2 and r["size"] == len(words(r["text"])) and r["_rest"] == 1 and r["n_words"] == "x"
    assert sum(t for t, _ in goals.values()) == pytest.approx(1.5 * total)
    for source, (target, size) in goals.items():
        assert target <= 2 * size + 1e-9 and abs(taken[source] - target) <= largest[source]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(goals))}
    level = {t / weights[s] for s, (t, size) in goals.items() if t < 2 * size - 1e-6}
    assert max(level) - min(level) < 1e-6 * max(level)
    assert all(2 * size <= max(level) * weights[s] + 1e-6 for s, (t, size) in goals.items() if t >= 2 * size - 1e-6)
    assert len(mixed(odd)) == odd.count() and mixed(none) == []


def plain_features(text):
    found, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = collections.defaultdict(list)
    for i in range(len(found) - 4):
        windows[tuple(found[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return (
        len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        len(found) < 10 or 100 * len(covered) > 20 * len(found),
    )


def test_features_are_the_plain_counts(spark, odd, none):
    rng = __import__("random").Random(5)
    more = [" ".join(rng.choice("ab c# |d e!\nf G".split(" ")) for _ in range(n)) for n in (4, 5, 6, 9, 30, 60, 200, 400)]
    more += ["p q r s t " * 3, "p q r s t u p q r s t", "a a a a a a", "x\nx\n \nx "]
    rows = [(900 + i, t, "en", "s", None, None, None, None) for i, t in enumerate(more)]
    docs = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in quality.features(docs).collect():
        assert tuple(r[n] for n in names) == plain_features(r["text"]), (r["text"] or "")[:80]
        assert r["_rest"] in (7, None)
    assert quality.features(none).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (0, 1, 7, 60, 200, 5000) for k in (0, 1, 2, 5, 30, 180) if k <= n]
    rate = 0.05
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), rate).alias("p"))
    p = Fraction(rate)
    for r in got.collect():
        exact = float(sum(math.comb(r["n"], j) * p**j * (1 - p) ** (r["n"] - j) for j in range(r["k"] + 1)))
        assert r["p"] == pytest.approx(exact, rel=1e-9) or (r["k"] >= r["n"] * rate and r["p"] == 1.0)


def test_cutoffs_limit_false_rejection_and_need_evidence(spark, none):
    rows, labels = [], []
    for i in range(1500):
        stratum, good = (None if i % 3 == 0 else "a" if i % 3 == 1 else f"few{i % 2}" if i < 60 else "a"), i % 5 > 0
        rows.append((i, stratum, False, 0.1 + (i % 90) / 100 if good else 3.0))
        labels.append((i, int(good)))
    labels += [(None, 1), (5_000_000, 0), (7, None), (8, 1), (8, 1)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, badness double")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r["stratum"]: r for r in quality.learn(scored, table, "lang", 0.05, 0.05).collect()}
    assert set(found) == {None, "a"}  # the small strata have too few documents for any promise
    for r in found.values():
        assert r["n_rejected"] == 0 and r["cutoff"] < 3.0 and r["bound"] <= 0.05 / len(quality.GRID)
    kept = quality.judge(scored, quality.learn(scored, table, "lang", 0.05, 0.05), "lang")
    verdict = {r["doc_id"]: r["kept"] for r in kept.collect()}
    assert all(verdict[i] == (b < 3.0 or str(s).startswith("few")) for i, s, _, b in rows)
    empty = quality.learn(scored, table.limit(0), "lang", 0.05, 0.05)
    assert empty.count() == 0 and quality.judge(scored, empty, "lang").where("kept").count() == 1500
    blank = quality.features(none)
    assert quality.judge(blank, quality.learn(blank, table, "lang", 0.05, 0.05), "lang").count() == 0


@pytest.mark.parametrize("copies", [1, 200, 3000])
def test_repeated_rows_meet_the_target_as_in_sql(spark, copies):
    same, n = " ".join(f"w{i}" for i in range(100)), 20
    rows = [(7, same, "hot")] * copies + [(100 + i, f"other {i} " + "x " * (7 * i), "hot") for i in range(n)] + [(7, same, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = [(r["doc_id"], r["source"], r["size"], r["target"], r["copies"] * r["size"]) for r in mixing.mix(docs, (3, 1, 2)).collect()]
    taken = {s: (sum(g[4] for g in got if g[1] == s), next(g[3] for g in got if g[1] == s)) for s in ("hot", None)}
    assert all(abs(t - goal) <= 160 for t, goal in taken.values()), taken
    connection = duckdb.connect()
    connection.register("documents", pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows, strict=True)), strict=True))))
    found = connection.execute(queries._MIX).fetchall()
    assert sorted((str(g[0]), g[2], round(g[3], 6), g[4]) for g in got) == sorted((str(f[0]), f[1], round(f[3], 6), f[4]) for f in found)
