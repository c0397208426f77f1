import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keyfold.llm import language


def test_held_out_accuracy(spark):
    found = language.query(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score").collect()
    assert len(rows) > 250 and sum(r["ok"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \n"), (4, "a"), (5, "die und der ist " * 40000), (6, "中文字"), (7, "dup text"), (7, "dup text"), (None, "les des une")], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    found = language.predict(odd, model).collect()
    assert len(found) == 9
    by = {r["doc_id"]: r for r in found}
    assert [by[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and [by[k]["score"] for k in (1, 2, 3)] == [0.0] * 3
    assert by[5]["lang_pred"] == "de" and by[4]["lang_pred"] in ("de", "en", "es", "fr") and by[6]["lang_pred"] != "und"
    assert language.predict(odd.where("false"), model).count() == 0
    nothing = language.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language.predict(odd.where("doc_id > 3"), one).collect()} == {"en"}


def test_text_alone_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": -F.col("doc_id")})
    a = [(r["lang_pred"], r["score"]) for r in language.predict(docs, model).orderBy("doc_id").collect()]
    b = [(r["lang_pred"], r["score"]) for r in language.predict(other, model).orderBy(F.desc("doc_id")).collect()]
    assert a == b


def grams(text):
    """Relative frequencies of the hashed 1- to 4-grams, gram by gram; letters in lower case, anything else one blank."""
    plain = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    plain = " " + " ".join(plain.split(" ")) if not plain.startswith(" ") else plain
    squeezed = [c for k, c in enumerate(plain) if c != " " or k == 0 or plain[k - 1] != " "]
    bins = Counter()
    for end, n in itertools.product(range(len(squeezed)), range(1, language.ORDERS + 1)):
        if end + 1 >= n:
            value = 0
            for k in range(n):  # backwards from the last letter
                value = (value * 0x100000001B3 + ord(squeezed[end - k]) + k + 1) % 2**64
            bins[value * 0x9E3779B97F4A7C15 % 2**64 >> 64 - language.BITS] += 1
    return {b: n / bins.total() for b, n in bins.items()}


def brute(text, model):
    """Family by the greatest margin, then votes of the pairs inside it, ties by the sum of margins."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    freq = grams(text)
    margin = [float(b) + sum(x * float(model.weights[k, j]) for k, x in freq.items()) for j, b in enumerate(model.bias)]
    sure = lambda m: 1 / (1 + math.exp(-3 * m))
    fam = max(range(len(model.families)), key=lambda k: margin[k])
    held, votes = model.languages[model.families[fam]], {}
    for lang in held:
        own = [margin[len(model.families) + j] * (1 if lang == a else -1) for j, (a, b) in enumerate(model.pairs) if lang in (a, b)]
        votes[lang] = (sum(m > 0 for m in own) + 1e-3 * math.tanh(sum(own)), min(own, default=9.0))
    best = max(held, key=lambda k: votes[k][0])
    return best, (sure(margin[fam]) if len(model.families) > 1 else 1.0) * sure(votes[best][1])


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    assert len(model.families) == 2 and len(model.pairs) == 2
    rows = [tuple(r) for r in docs.where("length(text) < 3000").select("doc_id", "text").limit(60).collect()]
    rows += [(90_000 + k, t) for k, t in enumerate([None, "", "12 %", " a", "a", "  Él  42 Ñandú!", "Straße\tÜBER", "x" * 5000, "中文 字", "é" * 3 + "--" + "É"])]
    found = language.predict(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), model).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        lang, score = brute(text[r["doc_id"]], model)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, (r, lang, score)
    assert np.isfinite(model.weights).all()
