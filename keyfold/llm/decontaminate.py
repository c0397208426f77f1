"""Benchmark decontamination: a prefix-filtered set join with exact windows.

Items are cut into windows of WINDOW consecutive words (a shorter item is one
window). Shingles of SHINGLE words are ordered by rarity, measured over all
documents. A window has to be contained whole, so that its necessary prefix is its
rarest shingle alone: documents are joined on that, at the window's offset. The
length and positional bounds drop places where the window would not fit into the
text, and the words themselves (their bytes) are compared for the rest.

The benchmark is the stated query side. It is taken in blocks of BLOCK windows, so
that what a task holds is bounded whatever its size; every block meets all documents.
With one block nothing is shuffled; with more, a row's hit ranges meet by doc_id and MD5
of the text, and a row that stands there several times is put out as often.

Defined results, whatever the number of blocks: every row gives a row, also where a doc_id
is repeated or null, with the hits of its own text; null, empty or wordless texts have 0 words and no hits; a very long text
is searched whole, in one step; an empty benchmark hits nothing, an empty table of documents gives no rows; a null or
wordless item has no windows; repeated windows and items all count; items
are counted by item_id, a null one is ignored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, grams, ragged, steps, table

WINDOW, SHINGLE = 13, 3
#: Windows that one block of the benchmark holds at most.
BLOCK = 200_000


def _inside() -> np.ndarray:
    """Bytes of words, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`, after lower-casing."""
    out = np.zeros(256, bool)
    out[48:58] = out[97:123] = out[128:] = True
    return out


class Block:
    """Windows of some items, with the words they hold."""

    def __init__(self, ids: list, texts: list[str]):
        self.items, words, at, size, owner = [], [], [], [], []
        for item, text in zip(ids, texts, strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            w = Words(data, np.array([0, len(data)]), _inside())
            n = len(w.start)
            if item is None or not n:
                continue
            held = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
            for k in range(max(1, n - WINDOW + 1)):
                at.append(len(words) + k)
                size.append(min(n, WINDOW))
                owner.append(len(self.items))
            words += held
            self.items.append(item)
        self.text, self.at, self.size, self.owner = words, np.array(at, np.int64), np.array(size, np.int64), np.array(owner, np.int64)
        joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        w = Words(joined, np.array([0, len(joined)]), _inside(), lower=False)
        self.hashes = w.hashes()
        # the shingles of windows; a window shorter than a shingle has one
        width = np.minimum(self.size, SHINGLE)
        count = self.size - width + 1
        self.window = np.repeat(np.arange(len(self.at)), count)
        self.offset = ragged(np.zeros(len(count), np.int64), count)
        self.key = shingle_hashes(self.hashes, self.at[self.window] + self.offset, width[self.window])
        self.width = width[self.window]
        self.vocabulary = np.unique(self.key)

    def prefixes(self, frequency: np.ndarray) -> None:
        """Keeps each window's rarest shingle (frequency: of the vocabulary)."""
        known = frequency[np.searchsorted(self.vocabulary, self.key)]
        order = np.lexsort((self.key, known, self.window))
        first = order[np.unique(self.window[order], return_index=True)[1]]
        first = first[known[first] > 0]  # in no document: no match either
        first = first[np.argsort(self.key[first], kind="stable")]
        self.p_key, self.p_window, self.p_offset = self.key[first], self.window[first], self.offset[first]


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Hash of the width words from each place."""
    out = np.zeros(len(at), np.uint64)
    for n in np.unique(width):
        here = width == n
        place = at[here]
        got = np.zeros(len(place), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                got = got * np.uint64(0xC6A4A7935BD1E995) + words[place + k]
        out[here] = got + np.uint64(n)
    return out


def doc_shingles(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all shingles of a width, none across two rows."""
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.flatnonzero(own[: len(words) - width + 1] == own[width - 1 :])
    return shingle_hashes(words, at, np.full(len(at), width)), at


class Filter:
    """Which hashes may be in a sorted array: a bit table in front of a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(16, int(len(keys) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(keys)] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the x that are there, and the place of each among the keys."""
        at = np.flatnonzero(self.seen[self._slot(x)])
        place = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        ok = self.keys[place] == x[at] if len(at) else np.zeros(0, bool)
        return at[ok], place[ok]


def pieces(text: str) -> Iterator[str]:
    """An item's text in pieces of at most BLOCK windows, each window in one of them."""
    if len(text) // 2 <= BLOCK:
        yield text
        return
    data = np.frombuffer(text.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), _inside())
    for k in range(0, max(len(w.start) - WINDOW + 1, min(len(w.start), 1)), BLOCK):
        last = min(k + BLOCK + WINDOW - 1, len(w.start)) - 1
        yield data[w.start[k] : w.end[last]].tobytes().decode()


def blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """The items, block by block: rows come to the driver one partition at a time, and a long item lies in several blocks."""
    ids, texts, windows = [], [], 0
    for row in benchmark.toLocalIterator():
        for text in pieces(row[1] or ""):
            ids.append(row[0])
            texts.append(text)
            windows += max(1, len(text) // 2)
            if windows >= BLOCK:
                yield ids, texts
                ids, texts, windows = [], [], 0
    yield ids, texts


def frequencies(documents: DataFrame, held, widths: list[int]) -> np.ndarray:
    """Occurrences over all documents of a block's shingles."""

    def run(batches):
        block = held.value
        known, total = Filter(block.vocabulary), np.zeros(len(block.vocabulary), np.int64)
        for batch in batches:
            for _, _, data, off in steps(batch.column(0)):
                w = Words(data, off, _inside())
                words = w.hashes()
                for width in widths:
                    total += np.bincount(known.find(doc_shingles(words, w.rows, width)[0])[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    counts = documents.select("text").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(len(held.value.vocabulary), np.int64)
    for k, n in counts.toLocalIterator():  # at most one row for each shingle of the block
        out[k] = n
    return out


def hits(documents: DataFrame, held, widths: list[int], of) -> DataFrame:
    """Rows (doc_id, of, n_words, starts, stops, items): the ranges of words that windows of the block cover; of: a string of the row."""

    def run(batches):
        block = held.value
        known = Filter(np.unique(block.p_key))
        low = np.searchsorted(block.p_key, known.keys, "left")
        many = np.searchsorted(block.p_key, known.keys, "right") - low
        for batch in batches:
            for first, n, data, off in steps(batch.column(1)):
                w = Words(data, off, _inside())
                words = w.hashes()
                begin, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for width in widths if len(known.keys) else ():
                    key, place = doc_shingles(words, w.rows, width)
                    at, k = known.find(key)
                    entry = ragged(low[k], many[k])
                    begin.append(np.repeat(place[at], many[k]) - block.p_offset[entry])
                    window.append(block.p_window[entry])
                begin, window = np.concatenate(begin), np.concatenate(window)
                inner = np.repeat(np.arange(n), np.diff(w.rows))  # positional and length bounds, in the row of the shingle
                size = block.size[window]
                ok = (begin >= 0) & (begin + size <= len(words))
                begin, window, size = begin[ok], window[ok], size[ok]
                ok = inner[begin] == inner[begin + size - 1]
                for k in range(WINDOW):  # hashes of the words, then their bytes
                    far = np.minimum(k, size - 1)
                    ok &= words[begin + far] == block.hashes[block.at[window] + far]
                begin, window, size = begin[ok], window[ok], size[ok]
                true = [all(w.data[w.start[b + j] : w.end[b + j]].tobytes() == block.text[a + j] for j in range(s)) for b, a, s in zip(begin, block.at[window], size, strict=True)]
                ok = np.array(true, bool)
                begin, window, size = begin[ok], window[ok], size[ok]
                order = np.lexsort((begin, inner[begin]))
                begin, window, size = begin[order], window[order], size[order]
                row, cut = inner[begin], np.searchsorted(inner[begin], np.arange(n + 1))
                local = begin - w.rows[row]
                items = [sorted({block.items[i] for i in block.owner[window[a:b]]}) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, n) for k in (0, 2)), pa.array(np.diff(w.rows)), *(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x)) for x in (local, local + size)), pa.array([list(map(str, i)) for i in items], pa.list_(pa.string()))],
                    ["doc_id", "of", "n_words", "starts", "stops", "items"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", of.alias("of")).mapInArrow(run, f"doc_id {kind}, of string, n_words bigint, starts array<bigint>, stops array<bigint>, items array<string>")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items, contaminated) of all documents, one for each row."""
    sc, found = documents.sparkSession.sparkContext, None
    waiting = blocks(benchmark.select("item_id", "text"))
    taken, n_blocks = next(waiting), 0
    following = next(waiting, None)
    more = following is not None
    of = F.md5("text") if more else F.lit(None).cast("string")
    while taken is not None:
        block = Block(*taken)
        held = sc.broadcast(block)
        widths = sorted({int(x) for x in np.unique(block.width)})
        counted = frequencies(documents, held, widths) if len(block.vocabulary) else np.zeros(0, np.int64)
        block.prefixes(counted)
        block.window = block.offset = block.key = block.width = None
        part = hits(documents, sc.broadcast(block), widths, of)
        found = part if found is None else found.union(part)
        n_blocks += 1
        taken, following = following, next(waiting, None)
    if more:
        # a set: the hits of repeated rows are one before they are shuffled
        held = F.collect_set(F.when(F.size("starts") > 0, F.struct("starts", "stops", "items"))).alias("held")
        found = found.groupBy("doc_id", "of").agg(F.first("n_words").alias("n_words"), held, F.count(F.lit(1)).alias("n_rows"))
        found = found.select("doc_id", "n_words", *(F.flatten(f"held.{c}").alias(c) for c in ("starts", "stops", "items")), F.explode(F.sequence(F.lit(1), F.expr(f"n_rows div {n_blocks}"))))
        ranges = F.array_sort(F.arrays_zip("starts", "stops"))
    else:
        ranges = F.arrays_zip("starts", "stops")  # in order already
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    covered = F.aggregate(
        ranges, start, lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["stops"] - F.greatest(a["end"], r["starts"]))).alias("n"), F.greatest(a["end"], r["stops"]).alias("end"))
    )["n"]
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", covered.alias("n_hit"), items.alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_decontaminate: all documents against all items of benchmark."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k : k + least(len(w), {WINDOW}) - 1], ' ') AS g, least(len(w), {WINDOW}) AS n
       FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
