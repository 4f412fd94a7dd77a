"""What runs inside tasks must reach workers that do not have the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from colloquy.operators import dense, encode, sparse
from colloquy.plans import queries
from colloquy.session import Size, get_spark

spark = get_spark("workers", "local[2]", spark__sql__shuffle__partitions="2")
spark.sparkContext.setLogLevel("ERROR")
said = spark.createDataFrame([(1, 0, 0, "user", "a b c"), (2, 0, 0, "user", "c d")], "conv_id long, turn long, chunk int, role string, text string")
asked = spark.createDataFrame([(1, "c d"), (2, "a")], "req_id long, text string")
vectors, wanted, stats = encode.hash_vectors(said, 16), encode.hash_vectors(asked, 16), encode.corpus_stats(said)
none = Size(0, 0)
for hits in (
    dense.semantic_search(wanted, vectors, 1),
    dense.semantic_search(wanted, vectors, 1, matrix=none),
    dense.lsh_search(wanted, vectors, 1, 16, bits=1),
    dense.lsh_search(wanted, vectors, 1, 16, bits=1, matrix=none),
    sparse.bm25_search(asked, said, 1, stats),
    sparse.bm25_search(asked, said, 1, stats, words=none),
    sparse.term_search(encode.tfidf_requests(asked, stats), encode.tfidf_rows(said, stats), 1),
):
    assert {{r["req_id"]: r["conv_id"] for r in hits.collect()}} == {{1: 2, 2: 1}}
assert encode.encode(said, queries.letter_model("abcd"), 4, "letters").count() == 2
print("fine")
"""


def test_tasks_do_not_import_the_package(tmp_path):
    repo = str(Path(__file__).parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "fine" in done.stdout, done.stderr[-3000:]
