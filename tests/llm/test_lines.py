import itertools
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from keyfold.llm import lines


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


MASK = 2**64 - 1


def mixed(x, salt):
    """The 64-bit finaliser, in whole numbers."""
    x = (x + salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def brute(docs):
    """The rules of the docstring, document by document, on texts instead of hashes: (text, lines removed) by doc_id."""
    held = {i: t.split("\n") for i, t in docs if t}
    once, pairs = Counter(), Counter()
    for x in held.values():
        once.update(x)
        pairs.update(itertools.pairwise(x))
    count = lambda x: len(x.split())
    pieces = []  # (what must be equal, doc_id, start, stop)
    for i, x in held.items():
        hashes = [xxhash.xxh3_64_intdigest(line.encode()) for line in x]
        starts = {0}
        for k in range(1, len(x)):
            apart = lambda j: not pairs[x[j - 1], x[j]] == once[x[j]] == once[x[j - 1]]  # noqa: B023, E731
            rolling = hashes[k - 1]
            if k > 1 and not apart(k - 1):
                rolling = (rolling * 0x9E3779B97F4A7C15 + hashes[k - 2]) & MASK
            if apart(k) or mixed(rolling, 9) % lines.MEAN == 0:
                starts.add(k)
        for k, line in enumerate(x):
            if once[line] > 1 and count(line) >= lines.OWN_WORDS:
                starts |= {k, k + 1}
        cuts = sorted(k for k in starts if k < len(x)) + [len(x)]
        cuts = [k for a, b in itertools.pairwise(cuts) for k in range(a, b, lines.MOST)] + [len(x)]
        for a, b in itertools.pairwise(cuts):
            if once[x[a]] < 2:
                continue
            body, size = x[a:b], sum(map(count, x[a:b]))
            if size >= (lines.MIN_WORDS if b - a > 1 else lines.LONE_WORDS):
                pieces.append((("alone", tuple(body)), i, a, b))
                continue
            low, high = a, b  # the run
            while low and pairs[x[low - 1], x[low]] > 1:
                low -= 1
            while high < len(x) and pairs[x[high - 1], x[high]] > 1:
                high += 1
            words = lambda p, q: sum(count(line) if once[line] > 1 else 0 for line in x[p:q])  # noqa: B023, E731
            if words(low, high) < lines.RUN_WORDS:
                continue
            front = next((p for p in range(a - 1, low - 1, -1) if words(p, b) >= lines.MIN_WORDS), None)
            back = next((q for q in range(b + 1, high + 1) if words(a, q) >= lines.MIN_WORDS), None)
            if front is not None:
                pieces.append((("front", tuple(x[front:a]), tuple(body)), i, a, b))
            if back is not None:
                pieces.append((("back", tuple(x[b:back]), tuple(body)), i, a, b))
    first = {}
    for same, i, a, b in pieces:
        first[same] = min(first.get(same, (i, a)), (i, a))
    gone = {i: set() for i, _ in docs}
    for same, i, a, b in pieces:
        if (i, a) != first[same]:
            gone[i] |= set(range(a, b))
    return {i: ("\n".join(y for k, y in enumerate(held[i]) if k not in gone[i]) if t else t, len(gone[i])) for i, t in docs}


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"start": F.lit("clash"), "known": F.lit(1), "chunk": F.lit(2), "body": F.lit(3), "ranges": F.lit(4), "n_removed": F.lit("old")})
    return {r["doc_id"]: r for r in lines.dedup_lines(df.repartition(3)).collect()}


def test_passages_go_and_the_first_stays(spark):
    passage = "\n".join(words(15, f"p{k}_") for k in range(5))
    long_line = words(60, "long")
    docs = [(k, f"{words(9, f'a{k}_')}\n{passage}\n{words(9, f'b{k}_')}") for k in range(6)]
    docs += [(10, f"own start\nx\n{long_line}"), (11, f"{long_line}\nown end"), (12, "short\nline"), (13, "short\nline"), (14, ""), (15, None), (16, passage), (17, words(80, "clean"))]
    found = run(spark, docs)
    assert len(found) == len(docs)
    before = dict(docs)
    assert found[0]["text"] == before[0] and found[0]["n_removed"] == 0
    for k in range(1, 6):
        assert found[k]["text"] == f"{words(9, f'a{k}_')}\n{words(9, f'b{k}_')}" and found[k]["n_removed"] == 5
    assert found[10]["text"] == before[10] and found[11]["text"] == "own end"
    for k in (12, 13, 14, 15, 17):
        assert found[k]["text"] == before[k] and found[k]["n_removed"] == 0
    assert (found[15]["n_lines"], found[14]["n_lines"], found[16]["text"], found[16]["n_removed"]) == (0, 1, "", 5)


def test_repeats_inside_one_text_and_of_whole_texts(spark):
    passage = words(50, "q")
    found = run(spark, [(1, f"{passage}\n{words(30, 'm')}\n{passage}"), (2, words(70, "copy")), (3, words(70, "copy"))])
    assert found[1]["text"] == f"{passage}\n{words(30, 'm')}"
    assert (found[2]["text"], found[3]["text"]) == (words(70, "copy"), "")
    same = spark.createDataFrame([(1, passage), (1, passage), (2, f"{passage}\nx"), (2, f"{passage}\nx"), (2, "other"), (None, passage)], "doc_id bigint, text string")
    found = sorted((str(r["doc_id"]), r["text"]) for r in lines.dedup_lines(same).collect())
    assert found == sorted([("1", passage), ("1", passage), ("2", "x"), ("2", "x"), ("2", "other"), ("None", passage)])


def test_only_repetitions_are_removed(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = run(spark, docs)
    held, kept = Counter(), Counter()
    for i, t in docs:
        held.update((t or "").split("\n"))
        kept.update((found[i]["text"] or "").split("\n") if found[i]["text"] or not t else [])
    assert all(kept[x] >= 1 for x in held)  # every line still stands somewhere
    assert all(kept[x] == 1 for x in held if len(x.split()) >= lines.OWN_WORDS)
    assert run(spark, []) == {}


def test_passages_beside_lines_that_are_repeated_too(spark):
    """A hot line, a blank one or another passage beside a passage moves none of its edges."""
    docs = [(k, f"Les.\n{words(9, f'h{k}_')}\n\n{words(9, f'i{k}_')}") for k in range(8)]
    sizes = ((2, 10, 33, 9), (20, 20, 15), (5, 45), (12, 12, 12, 12, 12))
    for k in range(24):
        body = [words(n, f"p{k}_{i}_") for i, n in enumerate(sizes[k % 4])]
        if k % 3 == 0:
            body.insert(1, "Les.")
        passage = "\n".join(body)
        before, behind = ("Les.", "", "x\nLes.")[k % 3], ("", "Les.")[k % 2]
        docs += [(100 + k, f"{words(9, f'a{k}_')}\n{passage}\n{words(9, f'b{k}_')}"), (200 + k, f"{words(9, f'c{k}_')}\n{before}\n{passage}\n{behind}\n{words(9, f'd{k}_')}")]
        docs += [(300 + k, f"{before}\n{passage}")]
    found, before = run(spark, docs), dict(docs)
    for k in [*range(8), *range(100, 124)]:
        assert found[k]["text"] == before[k]
    for k in range(24):
        start, end = ("Les.", "", "x\nLes.")[k % 3], ("", "Les.")[k % 2]
        assert found[200 + k]["text"] == f"{words(9, f'c{k}_')}\n{start}\n{end}\n{words(9, f'd{k}_')}"
        assert not any(f"p{k}_" in line for line in found[300 + k]["text"].split("\n"))


def test_against_brute_force(spark):
    """Random documents of passages, hot lines, blank ones and lines of their own, cut and compared line by line in plain Python."""
    rng = random.Random(6)
    pool = [words(rng.choice([1, 3, 8, 14, 30, 45]), f"l{k}_") for k in range(30)] + ["", "hot", "hot"]
    passages = [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(12)]
    docs = []
    for k in range(160):
        body = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            body += rng.choice(passages) if kind < 0.5 else [rng.choice(pool)] if kind < 0.75 else [words(rng.randint(1, 20), f"own{k}_{len(body)}_")]
        docs.append((k, "\n".join(body)))
    docs += [(k, "\n".join(words(3, f"long{j % 97}_") for j in range(3000))) for k in (200, 201)] + [(300, ""), (301, None)]
    found = {i: (r["text"], r["n_removed"]) for i, r in run(spark, docs).items()}
    want = brute(docs)
    assert sum(n for _, n in want.values()) > 300
    assert found == want
