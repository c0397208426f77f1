"""The pipeline: each stage on its own input against what the stage should do."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from keyfold.llm import bpe
from keyfold.llm.common import save

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_001, None, None, "s", 0), (10_002, "", "en", "s", 0), (10_003, "12 34", "en", "s", 5), (10_004, " ".join(f"solo{i}" for i in range(80)), "en", "s", 1), (10_005, " ".join(f"solo{i}" for i in range(79)), None, None, None)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    out = [("start", docs)]
    for name, stage in p.STAGES:
        docs = save(stage(spark, docs, SF))
        out.append((name, docs))
    return out


def test_schemas(stages):
    for (_, before), (name, after) in zip(stages[:-2], stages[1:-1]):
        assert after.columns == stages[0][1].columns, name
        assert after.join(before, "doc_id", "left_anti").count() == 0


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_language_keeps_texts_with_letters(stages):
    text = dict(stages[0][1].select("doc_id", "text").collect())
    assert ids(stages[1][1]) == {i for i, t in text.items() if t and re.search(r"[^\W\d_]", t)}


def test_lines_drop_only_emptied_texts(stages):
    before, after = (dict(d.select("doc_id", "text").collect()) for d in (stages[1][1], stages[2][1]))
    assert all(set(after[i].split("\n")) <= set(before[i].split("\n")) for i in after)
    seen = [line for t in after.values() for line in t.split("\n")]
    for i in set(before) - set(after):
        assert all(line in seen for line in before[i].split("\n"))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_one_of_each_near_group_stays(stages):
    docs = dict(stages[2][1].select("doc_id", "text").collect())
    sets, comp = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    order = sorted(docs)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    assert ids(stages[3][1]) == {i for i, c in comp.items() if i == c}


def test_contaminated_texts_go(stages, spark):
    from tests.llm.test_decontaminate import brute

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute([tuple(r) for r in stages[3][1].select("doc_id", "text").collect()], items)
    assert ids(stages[4][1]) == {i for i, (*_, bad) in found.items() if not bad}


def test_encoded(stages):
    last = stages[4][1].select("doc_id", F.sha2("text", 256).alias("digest"))
    rows = stages[5][1].join(last, "doc_id").collect()
    assert len(rows) == stages[4][1].count() and all(r["decoded_sha256"] == r["digest"] for r in rows)
    assert bpe.vocabulary(bpe.default_path()).size == 50257


def test_run(spark):
    assert p.run(spark, SF).count() > 100
