"""A model that is loaded once per worker, not once per task."""

from pyspark.sql import functions as F

from colloquy.operators.encode import encode


def loader(folder):
    def load():
        import os
        import uuid

        import numpy as np

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: np.array([[len(text), 1] for text in texts], dtype=np.float32)

    return load


def test_loads_are_workers_and_not_tasks(spark, tmp_path):
    units = spark.range(400).repartition(40).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("abc").alias("text"))
    for name, model_id in (("each", None), ("one", "lengths-1")):
        folder = tmp_path / name
        folder.mkdir()
        made = encode(units, loader(str(folder)), 2, "lengths", model_id=model_id)
        assert [tuple(r["vec"]) for r in made.select("vec").distinct().collect()] == [(3.0, 1.0)]
        again = encode(units, loader(str(folder)), 2, "lengths", model_id=model_id)
        assert again.select(F.sum(F.get("vec", 0))).first()[0] == 1200
        loads = [file.name.split("-")[0] for file in folder.iterdir()]
        if model_id:
            assert len(loads) == len(set(loads)) <= 16  # 80 tasks
        else:
            assert len(loads) == 80
