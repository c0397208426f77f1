import itertools
import math
import re

import numpy as np
from pyspark.sql import functions as F

from keyfold.llm import toxicity


def test_held_out_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("toxic", "score", "predicted").collect()
    pos, neg = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    wins = sum(sum((p["score"] > n["score"]) + 0.5 * (p["score"] == n["score"]) for n in neg) for p in pos)
    assert wins / (len(pos) * len(neg)) > 0.95
    assert sum(r["predicted"] for r in pos) / len(pos) > 0.8 and sum(r["predicted"] for r in neg) / len(neg) < 0.03


def test_pairs_of_terms(spark):
    """Only both words together are toxic: no additive weight tells that."""
    rows, n = [], 0
    for a, b, y in (("insult", "group", 1), ("insult", "", 0), ("", "group", 0), ("", "", 0)) * 150:
        rows.append((n, f"{a} {b} filler{n % 7} other{n % 5}", y))
        n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.fit(df, df, use=F.lit(True))
    odd = spark.createDataFrame([(1, "insult group"), (2, "insult"), (3, "group"), (4, ""), (5, None), (6, "GROUP, insult! " * 9000), (6, "group")], "doc_id bigint, text string").withColumn("terms", F.lit("clash"))
    found = toxicity.score(odd, machine).collect()
    assert len(found) == 7 and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["score"] for r in found if r["doc_id"] != 6}
    assert by[1] > 0.8 and max(by[2], by[3], by[4]) < 0.3 and by[4] == by[5]
    assert max(r["score"] for r in found if r["doc_id"] == 6) > 0.8
    assert toxicity.score(odd.where("false"), machine).count() == 0


def logistic(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_against_the_sum_over_pairs(spark):
    """The score is the logistic function of bias, weights and all pairs of factors, term by term."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["kind", "words", "insulting", "groups", "other", "é", "x1"], 6)) for _ in range(40)] + ["", None, "!?", "kind kind KIND"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    held = {r["doc_id"]: r["terms"] for r in toxicity.term_sets(df).collect()}
    every = sorted({t for h in held.values() for t in h})[:-2]  # two terms have no weights
    place = np.full(1 << toxicity.BITS, -1, np.int64)
    place[every] = np.arange(len(every))
    machine = toxicity.Machine(place, -0.7, rng.standard_normal(len(every)), rng.standard_normal((len(every), 4)))
    for r in toxicity.score(df, machine).collect():
        at = [place[t] for t in held[r["doc_id"]] if place[t] >= 0]
        z = machine.bias + sum(machine.weights[i] for i in at) + sum(machine.factors[i] @ machine.factors[j] for i, j in itertools.combinations(at, 2))
        assert abs(r["score"] - logistic(z)) < 1e-9
    words = {w for t in texts if t for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())}
    assert len({t for h in held.values() for t in h}) == len(words) + sum(len(w.encode()) > n for w in words for n in toxicity.HEADS)


def test_pairs_of_words_that_tell_nothing_singly(spark):
    """Toxic where both or neither of two words stand: each word alone is as frequent in either class."""
    rng, rows = np.random.default_rng(8), []
    for n in range(2400):
        a, b = n % 2, n // 2 % 2
        rows.append((n, " ".join(["alpha"] * a + ["omega"] * b + [f"w{rng.integers(40)}" for _ in range(8)]), int(a == b)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.fit(df, df, use=F.col("doc_id") < 2000)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(df.where("doc_id >= 2000"), machine).collect()}
    right = sum((found[n] > 0.5) == bool(y) for n, _, y in rows[2000:])
    assert right / 400 > 0.95
    # a group's name that is as frequent in clean texts, toxic only beside an insult that is mostly harmless
    rows = [(n, " ".join(["insult"] * (n % 2) + ["group"] * (n // 2 % 2) + [f"w{rng.integers(40)}" for _ in range(8)]), int(n % 4 == 3 or n % 4 == 0 and n % 3 == 0)) for n in range(2400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.fit(df, df, use=F.col("doc_id") < 2000)
    odd = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(1, "insult group"), (2, "insult"), (3, "group")], "doc_id bigint, text string"), machine).collect()}
    assert odd[1] > 0.8 and max(odd[2], odd[3]) < 0.2


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, "a", None)], "doc_id bigint, text string, toxic int")
    assert toxicity.score(df, toxicity.fit(df, df.where("false"))).first()["score"] < 0.01
    assert toxicity.score(df, toxicity.fit(df, df, use=F.lit(True))).first()["score"] > 0.99
