import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.llm import vectors


def brute(rows, least=0.98):
    good = {i: (label, np.array(e, float)) for i, label, e in rows if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    n, comp = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    for a in sorted(good):
        for b in sorted(good):
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if c == high else c for k, c in comp.items()}
    return {i: (n[i], comp[i], comp[i] == i) for i, *_ in rows}


def corpus():
    rng, rows = np.random.default_rng(2), []
    for label in (0, 1):
        for _ in range(8):
            centre = rng.standard_normal(16)
            for k in range(6):
                v = centre + rng.standard_normal(16) * (0.02 if k < 4 else 0.3)
                rows += [(label, v.tolist())] * (3 if k == 1 else 1)
    rows += [(0, [0.0] * 16), (0, None), (0, []), (None, [1.0] * 16), (1, [float("nan")] * 16), (1, [None] + [1.0] * 15), (1, [float("inf")] * 16), (0, [1.0, 1.0]), (0, [2.0, 2.0]), (0, [1.0] * 16), (0, [1e30] * 16)]
    return [(i, label, e and [None if x is None else float(np.float32(x)) for x in e]) for i, (label, e) in enumerate(rows, 5)]


@pytest.mark.parametrize("block", [1024, 2])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumns({"rep": F.lit(1), "names": F.lit("x"), "many": F.lit(2)}).repartition(3)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    want = brute(rows)
    assert set(found) == set(want)
    assert all(found[k][0] <= want[k][0] for k in want)  # nothing below the threshold
    assert sum(n for n, *_ in found.values()) >= 0.97 * sum(n for n, *_ in want.values())
    assert all(found[k] == (0, k, True) for k, label, e in rows if want[k][0] == 0)
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_plan_keeps_its_promise():
    for rows in (10, 10**4, 10**8):
        hashes, tables = vectors.plan(rows, 0.98)
        near, far = vectors.same_step(0.2), vectors.same_step(math.sqrt(2))
        assert (1 - near**hashes) ** tables <= vectors.MISSED and rows * tables * far**hashes <= vectors.CHANCE


def test_names_do_not_depend_on_the_batch():
    x = np.random.default_rng(1).standard_normal((500, 33)).astype(np.float32).astype(np.float64)
    whole = vectors.buckets(x, 19, 30)
    assert all((vectors.buckets(x[k : k + 1], 19, 30) == whole[k]).all() for k in range(0, 500, 7))
    assert (vectors.buckets(np.asfortranarray(x[::-1]), 19, 30)[::-1] == whole).all()


@pytest.mark.parametrize("kind", ["string", "double", "date", "array<int>"])
def test_labels_of_any_type(spark, kind):
    literal = {"string": "concat('l', label)", "double": "label + 0.5", "date": "date_add(date'2020-01-01', label)", "array<int>": "array(label)"}[kind]
    rows = [(i, i % 2, [1.0, 0.0, i / 1000]) for i in range(8)] + [(8, None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("label", F.expr(literal))
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert found == {**{i: (3, i % 2) for i in range(8)}, 8: (0, 8)}


def test_recall_in_a_larger_label(spark):
    """Pairs right at the threshold and far ones: at least 0.99 of all links, and of components."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1200, 32))
    near = base + rng.standard_normal(base.shape) * 0.19  # a cosine of about 0.98
    x = np.concatenate([base, near]).astype(np.float32)
    unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = np.triu(unit @ unit.T >= 0.98, 1).sum()
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, label int, embedding array<float>")
    found = sum(r["n_links"] for r in vectors.near_duplicates(df).select("n_links").collect()) / 2
    assert want > 300 and 0.99 * want <= found <= want
