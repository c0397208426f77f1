import re

import pytest
from pyspark.sql import functions as F

from keyfold.llm import decontaminate as d


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = split(text)
        if item is not None:
            windows += [(item, w[k : k + min(13, len(w))]) for k in range(max(1, len(w) - 12))] if w else []
    out = {}
    for doc, text in docs:
        w, hit, held = split(text), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    held.add(str(item))
        out[doc] = (len(w), len(hit), sorted(held), bool(hit) and 20 * len(hit) >= len(w))
    return out


W = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
ITEMS = [(1, W(0, 30)), (2, "one two three"), (10, "One, TWO!"), (3, W(20, 40)), (4, ""), (5, None), (None, W(0, 30)), (6, "lone"), (7, "é É"), (8, W(0, 30))]
DOCS = [
    (1, f"x {W(0, 13)} y"), (2, W(0, 12)), (3, f"{W(5, 25)} z {W(20, 33)}"), (4, "ONE two; three one two"), (5, ""), (6, None), (7, "lone " + "x " * 30), (8, "é é É"), (9, W(0, 30) + " q" * 1000), (10, f"{W(0, 14)}-{W(0, 14)}"),
    (11, W(0, 13).replace(" ", "_")), (12, "clean text only"), (13, "two three"),
]


@pytest.mark.parametrize("block", [200_000, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK", block)
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumns({"items": F.lit("clash"), "n_hit": F.lit(1)}).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in d.decontaminate(docs, items).collect()}
    assert found == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert d.decontaminate(docs.where("false"), items).count() == 0
    assert {r["n_hit"] for r in d.decontaminate(docs, items.where("false")).collect()} == {0}


@pytest.mark.parametrize("block", [200_000, 8])
def test_repeated_and_null_ids(spark, monkeypatch, block):
    """Every row gives a row with the hits of its own text, also with several blocks of the benchmark."""
    monkeypatch.setattr(d, "BLOCK", block)
    rows = [*DOCS, *DOCS[:4], DOCS[0], *((None, t) for _, t in DOCS), (None, None), (2, W(0, 13)), (12, "one two three"), (12, None), (12, "")]
    found = d.decontaminate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect()
    want = [(i, *brute([(i, t)], ITEMS)[i]) for i, t in rows]
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found))) == sorted(map(str, want))


@pytest.mark.parametrize("words", [0, 1, 12, 13, 20, 21, 100])
def test_pieces_hold_each_window_once(monkeypatch, words):
    monkeypatch.setattr(d, "BLOCK", 8)
    text = ". ".join(f"wé{i}" for i in range(words)) + " " * 20
    held = [split(p) for p in d.pieces(text)]
    windows = [w[k : k + 13] for w in held for k in range(max(1, len(w) - 12))]
    whole = split(text)
    assert windows == ([whole[k : k + 13] for k in range(max(1, words - 12))] if words else [])
    assert all(len(w) <= 8 + 12 for w in held)
