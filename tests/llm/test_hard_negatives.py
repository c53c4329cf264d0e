"""Hard negatives against all scores."""

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.llm.hard_negatives import hard_negatives, mined

SF = "/root/testdata/sf0.001"


def expected(rows, is_anchor):
    """(anchor, positive, rank, negative, scores) by scanning; rows: (id, label, list of whole numbers)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (anchor, label, q) in enumerate(rows):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = sorted(((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), last(i), i, lab) for m, (i, lab, v) in enumerate(rows) if m != n and len(v) == len(q)), key=lambda t: t[:2])
        for ps, _, positive, _ in [t for t in scored if t[3] == label][:5]:
            fit = [t for t in scored if t[3] != label and -30 * ps <= -100 * t[0] <= -90 * ps][:10]
            out += [(anchor, positive, k + 1, t[2], -ps, -t[0]) for k, t in enumerate(fit)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize(("pivots", "tile"), [(None, None), (6, 20), (3, 7)])
def test_made_up_vectors(spark, pivots, tile):
    rng = np.random.default_rng(4)
    centres = rng.integers(-40, 40, (6, 5))
    rows = [(int(k), int(rng.integers(0, 4)), [float(x) for x in centres[k % 6] + rng.integers(-9, 10, 5)]) for k in range(400)]
    rows += [(k, k % 2, [3.0, 4.0]) for k in range(400, 440)] + [(k, 1, [float(k)]) for k in range(440, 460)]  # ties, other lengths
    rows += [(500, None, [1.0] * 5), (501, 1, None), (502, 1, [1.0, None, 2.0, 3.0, 4.0]), (503, 1, [float("nan")] * 5), (504, 1, [float("inf")] * 5), (None, 2, [30.0] * 5), (505, 1, []), (510, 2, [])]
    rows += [rows[0], rows[10], (10, 3, [9.0] * 5), (520, 0, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>").selectExpr("*", "1 as uid", "2 as cell", "3 as pivot", "'x' as low")
    got = hard_negatives(df, F.col("id") % 10 == 0, pivots=pivots, tile=tile)
    assert found(got) == expected(rows, lambda i: i % 10 == 0)
    assert hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_one_vector_may_be_a_third_of_all(spark):
    rng = np.random.default_rng(9)
    rows = [(k, k % 3, [5.0, 5.0, 1.0] if k % 3 == 0 else [float(x) for x in rng.integers(-9, 10, 3)]) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    assert found(hard_negatives(df, F.col("id") % 25 == 0, pivots=4, tile=25)) == expected(rows, lambda i: i % 25 == 0)


def test_very_large_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(k, k % 2, [float(x) * 2.0**23 for x in rng.integers(0, 90, 3)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    assert found(hard_negatives(df, F.col("id") % 10 == 0)) == expected(rows, lambda i: i % 10 == 0)
    assert mined(spark.createDataFrame([(0, [1e300, -1e308], 1), (1, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")).count() == 0


def test_table(spark):
    table = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall() if hasattr(duckdb.sql("select 1"), "fetchall") else []
    rows = [(i, None if lab is None else (lab + 1) % 10 if i % 7 == 0 else lab, None if v is None else [None if x is None else math.floor(256 * x) for x in v]) for i, v, lab in table]
    got = found(mined(spark.read.parquet(f"{SF}/embeddings.parquet")))
    assert got == expected(rows, lambda i: i % 100 == 0) and len({g[0] for g in got}) == 5
    ranks = defaultdict(list)
    for g in got:
        ranks[g[:2]].append(g[2])
    assert all(sorted(r) == list(range(1, len(r) + 1)) for r in ranks.values())
