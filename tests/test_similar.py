import numpy as np
from pyspark.sql import functions as F

from graywether.operators import kernels, probes, similar


def test_most_similar_equals_brute_force_in_few_rows(spark, monkeypatch):
    """Ties go to the first id, a row's own id is left out, no row of Spark is made for a pair."""
    monkeypatch.setattr(similar, "SMALL", 8)
    monkeypatch.setattr(similar, "STRIP", 5)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (70, 4)).astype(float)
    x[:30] = x[0]  # copies
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(900, 0, None), (None, 0, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {}
    for r in probes.neighbours(df, 5).collect():
        got.setdefault(r.case_id, []).append((r["rank"], r.row_id, r.label))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm == 0, 1, norm)
    cos = np.round(u @ u.T, 6)
    for i in range(len(x)):
        want = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-cos[i, j], j))[:5]
        assert sorted(got[i]) == [(n + 1, j, j % 3) for n, j in enumerate(want)]
    unit = df.select(F.lit(0).alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("u"))
    assert similar.most_similar(unit, unit, 1).count() <= 70 * 9  # a row a tile, not 70 a row


def test_blocks_of_a_label_grow_slower_than_its_rows(spark):
    """64 rows a block sent 938 blocks of a label of 60,000 rows to 938 others."""
    sizes = spark.createDataFrame([(60,), (700,), (5000,), (60000,)], "n long")
    assert [r.b for r in sizes.select(kernels.block_count(F.col("n"), 64).alias("b")).collect()] == [1, 11, 16, 30]
