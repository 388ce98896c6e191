import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from afterbell.operators import quantiles


@pytest.mark.parametrize("accuracy,room", [(quantiles.ACCURACY, quantiles.ROOM), (50, 0.06)])
def test_quantiles_are_exact_in_small_and_large_groups(spark, monkeypatch, accuracy, room):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "ROOM", room)
    r = random.Random(1)
    rows = [("one", 3.0), ("two", 1.0), ("two", 4.0), ("empty", None), (None, 2.0), (None, 9.0), (None, None)]
    rows += [("ties", float(r.randrange(4))) for _ in range(999)] + [("many", r.gauss(0, 5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        stats = df.groupBy("g").agg(F.count("v").alias("n"), quantiles.value_range("v", q).alias("_r"))
        out = {x.g: x.q for x in quantiles.with_quantile(stats, df, "v", ["g"], q, "q", "n", "_r").collect()}
        for g in {x for x, _ in rows}:
            values = [v for x, v in rows if x == g and v is not None]
            assert out[g] == (pytest.approx(np.quantile(values, q)) if values else None)
