import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from keyfold.llm import common, jaccard


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs.items()}
    comp = {i: i for i in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((comp[a], comp[b]))
            comp = {k: low if c == high else c for k, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in docs}


def corpus(seed=4):
    """Edited copies at all similarities, chains, a passage that many share, copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    bases = [[word() for _ in range(n)] for n in (40, 90, 150)]
    passage = " ".join(word() for _ in range(30))
    texts = []
    for base in bases:
        for k in range(14):
            edit = list(base)
            for _ in range(k % 7):
                edit[rng.randrange(len(edit))] = word()
            texts += [" ".join(edit)] * (3 if k == 2 else 1)
    chain = list(bases[2])
    for k in range(12):
        chain[k * 11] = word()
        texts.append(" ".join(chain))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(30)]
    texts += [" ".join(base[:20]).upper() for base in bases] + ["a b c d", "a b c d e", "A  b\tc d", "a", "a", "", "  ", None, "x y", "X y", "é ö", "É ö"]
    return dict(enumerate(texts, 10))


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1024), (5, 80, 1024), (3, 90, 4), (5, 80, 3)])
def test_against_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumns({"n": F.lit(1), "rep": F.lit("x"), "component_id": F.lit("y")}).repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, n, percent).collect()}
    want = brute(docs, n, percent)
    assert found == want
    assert len(set(c for _, c in want.values())) < len(docs) - 10


def test_nothing_to_link(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, None), (None, "a b c d")], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.join(df).collect()), key=str) == sorted([(1, 2, 1), (2, 0, 2), (None, 2, None)], key=str)
    assert jaccard.join(df.where("false")).count() == 0


@pytest.mark.parametrize(("n", "percent", "words"), [(3, 90, 11), (5, 80, 8)])
def test_one_word_more_at_the_boundary(spark, n, percent, words):
    """9 shingles in 10 at 90 percent, 4 in 5 at 80: the smaller set may lack none."""
    docs = {}
    for k in range(4):
        text = " ".join(f"w{k}x{i}" for i in range(words))
        docs |= {10 * k + 1: text, 10 * k + 2: f"{text} behind", 10 * k + 3: f"front {text}", 10 * k + 4: text[:-1] + "other"}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, n, percent).collect()}
    assert found == brute(docs, n, percent)
    assert [found[k][1] for k in (1, 2, 3, 4)] == [1, 1, 1, 4]


def test_every_row_twice(spark):
    """Repeated rows count once, and the texts of one doc_id are different sets."""
    part = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    docs = {}
    for k in range(4):  # three in four words in common: a Jaccard of 0.6
        docs |= {10 * k + 1: part(f"s{k}_", 90) + part(f"a{k}_", 30), 10 * k + 2: part(f"s{k}_", 90) + part(f"b{k}_", 30)}
    docs = {i: " ".join(w) for i, w in docs.items()} | {50: " ".join(part("t", 60)), 51: " ".join(part("t", 61))}
    rows = 2 * [*docs.items(), (31, " ".join(part("t", 62))), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.join(df, 5, 80).collect())
    want = {i: (n, c) for i, (n, c) in brute(docs, 5, 80).items()} | {50: (56, 31), 51: (57, 31)}
    assert {c for i, (_, c) in want.items() if i < 50} == {i for i in docs if i < 50}
    assert found == sorted(2 * [*((str(i), n, c) for i, (n, c) in want.items()), ("31", 58, 31), ("None", 1, None)])


def halves(count=60, words=120):
    """Half of every text is common to all, so that none has a partner but the last two of them, which are near copies."""
    part = lambda tag: [f"{tag}{i}" for i in range(words)]
    docs = {k: " ".join(part("s") + part(f"o{k}_")) for k in range(count)}
    return docs | {count: docs[count - 1] + " behind"}


@pytest.mark.parametrize("percent", [90, 80])
def test_few_whole_sets_are_counted(spark, monkeypatch, percent):
    """Of documents that share a passage only, no whole set is shuffled for its counts."""
    docs, moved, shared = halves(), [], jaccard.shared

    def counted(rows, tokens):
        moved.append(rows.select(F.coalesce(F.sum(F.size(tokens)), F.lit(0))).first()[0])
        return shared(rows, tokens)

    monkeypatch.setattr(jaccard, "shared", counted)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, 3, percent).collect()}
    want = brute(docs, 3, percent)
    assert found == want and want[60][1] == 59
    assert sum(moved) < sum(n for n, _ in want.values())


@pytest.mark.parametrize(("most", "n", "percent"), [(20, 3, 90), (20, 5, 80), (3, 3, 90)])
def test_ids_beyond_one_broadcast(spark, monkeypatch, most, n, percent):
    """Parts of ids that are broadcast in turn, and (3) more of them than are allowed."""
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    docs = corpus()
    df = spark.createDataFrame(2 * list(docs.items()), "doc_id bigint, text string").repartition(3)
    seen, parts = [], jaccard.parts
    monkeypatch.setattr(jaccard, "parts", lambda *a: seen.append(parts(*a)) or seen[-1])
    found = [(r["doc_id"], (r["n_shingles"], r["component_id"])) for r in jaccard.join(df, n, percent).collect()]
    assert dict(found) == brute(docs, n, percent) and len(found) == 2 * len(docs)
    assert len(seen[0]) == 1 if most == 3 else len(seen[0]) > 1
