"""The minimum covariance determinant against all subsets, and groups with much junk."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampfield.llm import quality as Q

LEAST = np.diag([v * v for v in Q.FEATURES.values()])


def determinants(rows, size, factor):
    """The determinant of every subset of so many rows."""
    for chosen in itertools.combinations(range(len(rows)), size):
        x = rows[list(chosen)]
        yield np.linalg.det(np.cov(x.T, bias=True) * factor + LEAST), set(chosen)


def table(spark, groups):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, rows in groups.items() for r in rows], "key string, f array<double>")


def sample(rng, good, bad, shift):
    return np.concatenate([rng.normal(size=(good, 5)), rng.normal(size=(bad, 5)) * 0.3 + shift])


def test_no_subset_has_a_smaller_determinant(spark):
    rng = np.random.default_rng(3)
    groups = {f"g{k}": sample(rng, 9, bad, shift) for k, (bad, shift) in enumerate([(0, 0), (3, 9), (4, -12), (5, 40), (2, 100)])}
    share = 0.6
    rows = table(spark, groups).groupBy("key", "f").agg(F.count("*").alias("n"))
    got = {r["key"]: r for r in Q.smallest_determinants(rows, share, 30).collect()}
    factor, best = Q.consistency(share, 5), 0
    for k, x in groups.items():
        size = int(np.ceil(share * len(x)))
        least, chosen = min(determinants(x, size, factor), key=lambda d: d[0])
        assert got[k]["converged"]
        # classes of distances may add a row at the border, never an outlier
        d = np.einsum("ij,jk,ik->i", x - got[k]["centre"], np.array(got[k]["inverse"]).reshape(5, 5), x - got[k]["centre"])
        assert max(np.argsort(d)[:size]) < 9 or len(x) == 9
        assert got[k]["det"] <= least * 3
        best += got[k]["det"] <= least * (1 + 1e-6)
    assert best >= 3


@pytest.mark.parametrize("copies", [1, 40])
def test_determinant_and_inverse_are_those_of_the_matrix(spark, copies):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 5)), copies, axis=0)
    rows = table(spark, {"a": x}).groupBy("key", "f").agg(F.count("*").alias("n"))
    assert rows.count() == 30
    r = Q._estimate(rows, 1.5, "key").first()
    want = np.cov(x.T, bias=True) * 1.5 + LEAST
    assert r["det"] == pytest.approx(np.linalg.det(want), rel=1e-6)
    assert np.allclose(np.array(r["inverse"]).reshape(5, 5), np.linalg.inv(want), atol=1e-4)
    assert np.allclose(r["centre"], x.mean(axis=0), atol=1e-8)


def texts(rng, n):
    words = ["river", "stone", "and", "the", "walking", "under", "a", "quiet", "morning", "light", "of", "mountains", "we", "remember"]
    return [" ".join(rng.choices(words, k=rng.randint(40, 120))) + "." for _ in range(n)]


@pytest.mark.parametrize("junk", [300])
def test_junk_that_fills_much_of_a_group_goes(spark, junk):
    rng = random.Random(5)
    rows = [(k, t, "en", "a") for k, t in enumerate(texts(rng, 400))]
    rows += [(1000 + k, " ".join("<%s>" % "#$%&"[rng.randint(0, 3)] * rng.randint(3, 5) + str(rng.randint(0, 9999)) for _ in range(rng.randint(15, 30))), "en", "a") for k in range(junk)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["id"]: r for r in Q.quality(df).collect()}
    assert len(got) == 400 + junk and all(r["converged"] for r in got.values())
    assert sum(got[k]["kept"] for k in range(1000, 1000 + junk)) == 0
    assert sum(got[k]["kept"] for k in range(400)) >= 396


def test_null_groups_clashing_names_and_small_tables(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, t, None if k % 2 else "en", None if k % 3 else "s") for k, t in enumerate(texts(rng, 60))] + [(None, None, None, None), (7, "", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns(
        {n: F.lit(1) for n in ("key", "f", "n", "b", "centre", "id", "start", "distance", "k1")}
    )
    plain = sorted(Q.quality(df, least=5).collect(), key=repr)
    assert len(plain) == 62 and sum(r["base_failed"] for r in plain) == 2
    # the same by salted keys
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    assert sorted(Q.quality(df, least=5).collect(), key=repr) == plain
    assert Q.quality(df.limit(0)).collect() == []
    assert Q.quality(df.filter("doc_id = 7 and text = ''")).first()["kept"] is False
    short = Q.quality(df, least=5, steps=1).filter("not base_failed")
    assert short.filter(~F.col("converged")).count() > 0
