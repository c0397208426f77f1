"""Line dedup over content-defined chunks of lines.

Every line has a 64-bit hash, and so has every pair of neighbouring lines; both are counted
over all the data. A document's lines are cut into chunks where the content says so: between
neighbours that do not always stand together (the pair is rarer than one of its lines), so
that a passage has edges wherever it stands, whatever repeated line is beside it; inside,
after a line at which the rolling hash over the last WINDOW line hashes is 0 modulo MEAN;
a repeated line of OWN_WORDS words or more, a passage by itself, is a chunk of its own.
A chunk is at most MOST lines long. A run is a stretch of lines whose pairs all occur more
than once; a repeated passage lies in one run.

A chunk of at least MIN_WORDS words (LONE_WORDS if it is a single line) whose hash occurs again
is compared, byte for byte, with the first chunk of that hash (least doc_id, then place); if equal,
it is a repetition and its lines are removed. A smaller chunk in a run of RUN_WORDS words or more
is a repetition where it occurs again with the same lines before or behind it, as many as make
MIN_WORDS words (their 128-bit hash is compared): a short line goes with its passage, not alone.

The first occurrence always stays. Line and chunk hashes are counted with map-side
combining, so that a line that a third of all documents share is one number; what is
joined back is split by Spark where a hash is hot.

Defined results: a null text stays null (0 lines); a very long text is cut whole; an empty table gives no rows; lines are divided by ``\\n`` and
compared as they are, a trailing carriage return included; an empty text is one empty
line, which is never removed; a document of which everything is removed has the empty
text; a repeated row (doc_id and text) is the same document and is cut like it, rows of one doc_id with
different texts are different documents; a row with a null doc_id stays as it is; other
columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, save, table

WINDOW, MEAN, MOST = 2, 4, 64
MIN_WORDS, LONE_WORDS, OWN_WORDS, RUN_WORDS = 12, 24, 40, 40


def line_hashes(text: str) -> np.ndarray:
    lines = text.encode().split(b"\n")
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hashes of each line with the next one."""
    with np.errstate(over="ignore"):
        return mix(mix(hashes[:-1], 10) * np.uint64(0x9E3779B97F4A7C15) + hashes[1:], 11)


def counted_lines(documents: DataFrame) -> DataFrame:
    """Rows (line, n): how often a batch has each line and pair of lines, by hash."""

    def run(batches):
        for batch in batches:
            found = [line_hashes(t) for t in batch.column(0).to_pylist() if t]
            if found:
                line, many = np.unique(np.concatenate([*found, *map(pair_hashes, found)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(line.view(np.int64)), pa.array(many)], ["line", "n"])

    return documents.select("text").mapInArrow(run, "line bigint, n bigint")


def cut(hashes: np.ndarray, many: np.ndarray, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Starts of the chunks of a document; many, pairs: how often its lines and pairs of lines occur (1: once)."""
    n = len(hashes)
    starts = np.ones(n, bool)
    starts[1:] = (pairs != many[1:]) | (pairs != many[:-1])
    # the rolling hash does not look back over such an edge
    rolling = hashes.copy()
    inner = ~starts
    with np.errstate(over="ignore"):
        for k in range(1, WINDOW):
            rolling[k:] = np.where(inner[k:], rolling[k:] * np.uint64(0x9E3779B97F4A7C15) + hashes[: n - k], rolling[k:])
            inner[1:] &= inner[:-1]
    starts[1:] |= (mix(rolling, 9) % np.uint64(MEAN) == 0)[:-1]
    own = np.flatnonzero((many > 1) & (words >= OWN_WORDS))
    starts[own] = True
    starts[own[own + 1 < n] + 1] = True
    at = np.flatnonzero(starts)
    size = np.diff(np.append(at, n))
    return np.concatenate([np.arange(a, a + s, MOST) for a, s in zip(at, size, strict=True)])


def beside(lines: list[str], total: np.ndarray, low: int, high: int, a: int, b: int) -> list[str]:
    """A chunk's lines with the digest of those before and of those behind it, in its run (low, high); total: words up to each line."""
    out, body = [], "\n".join(lines[a:b])
    first = min(a - 1, int(np.searchsorted(total, total[b] - MIN_WORDS, "right")) - 1)
    if first >= low:
        out.append(f"<{xxhash.xxh3_128_hexdigest(chr(10).join(lines[first:a]).encode())}\n{body}")
    last = max(b + 1, int(np.searchsorted(total, total[a] + MIN_WORDS)))
    if last <= high:
        out.append(f">{xxhash.xxh3_128_hexdigest(chr(10).join(lines[b:last]).encode())}\n{body}")
    return out


def occurrences(hashes: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each hash occurs, by the sorted ones that occur more than once."""
    if not len(known):
        return np.ones(len(hashes), np.int64)
    place = np.minimum(np.searchsorted(known, hashes.view(np.int64)), len(known) - 1)
    return np.where(known[place] == hashes.view(np.int64), n[place], 1)


def chunks(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, of, start, stop, chunk, body) of the chunks of repeated lines that count; rows have `known`."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            held = batch.column(3)
            bound, flat = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten()
            known, times = (flat.field(c).to_numpy() for c in ("line", "n"))
            for at, (doc, of, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                hashes = line_hashes(text)
                own = slice(bound[at], bound[at + 1])
                order = np.argsort(known[own])
                many, pairs = (occurrences(x, known[own][order], times[own][order]) for x in (hashes, pair_hashes(hashes)))
                lines = text.split("\n")
                words = np.array([len(x.split()) if r else 0 for x, r in zip(lines, many > 1, strict=True)])
                total = np.concatenate([[0], np.cumsum(words)])
                begin = cut(hashes, many, pairs, words)
                edges = np.concatenate([[0], np.flatnonzero(pairs < 2) + 1, [len(lines)]])
                for a, b in zip(begin, [*begin[1:], len(lines)], strict=True):
                    if many[a] < 2:
                        continue
                    if total[b] - total[a] >= (MIN_WORDS if b - a > 1 else LONE_WORDS):
                        bodies = ["\n".join(lines[a:b])]
                    else:
                        k = np.searchsorted(edges, a, "right")
                        low, high = edges[k - 1], edges[k]
                        bodies = beside(lines, total, low, high, a, b) if total[high] - total[low] >= RUN_WORDS else []
                    for body in bodies:
                        for x, v in zip(out, (doc, of, a, b, xxhash.xxh3_64_intdigest(body.encode()) - 2**63, body), strict=True):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 5, pa.string()), strict=True)], ["doc_id", "of", "start", "stop", "chunk", "body"])

    return documents.select("doc_id", "of", "text", "known").mapInArrow(run, "doc_id bigint, of bigint, start bigint, stop bigint, chunk bigint, body string")


def known_lines(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, of, known): a document's lines and pairs of lines that occur more than once in all the data, and how often."""

    def run(batches):
        for batch in batches:
            found = [line_hashes(t) for t in batch.column(2).to_pylist()]
            found = [np.unique(np.concatenate([x, pair_hashes(x)])) for x in found]
            ids, of = (np.repeat(batch.column(k).to_numpy(), [len(x) for x in found]) for k in (0, 1))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(of), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "of", "line"])

    lines = documents.select("doc_id", "of", "text").mapInArrow(run, "doc_id bigint, of bigint, line bigint")
    often = counted_lines(documents).groupBy("line").agg(F.sum("n").alias("n")).where("n > 1")
    return lines.join(often, "line").groupBy("doc_id", "of").agg(F.collect_set(F.struct("line", "n")).alias("known"))


def repetitions(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, of, ranges array<struct<start, stop>>) of the lines to remove; of: hash of the text."""
    named = documents.where("text <> '' AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("of"), "text")
    found = save(chunks(named.join(known_lines(named), ["doc_id", "of"])))
    heads = found.groupBy("chunk").agg(F.min(F.struct("doc_id", "of", "start")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = heads.select("chunk", *(F.col(f"head.{c}").alias(c) for c in ("doc_id", "of", "start")))
    first = found.join(heads, ["chunk", "doc_id", "of", "start"]).groupBy("chunk").agg(
        F.first(F.struct("doc_id", "of", "start")).alias("head"), F.first("body").alias("head_body")  # one row, or equal ones of a repeated row
    )
    again = found.join(first, "chunk").where("body = head_body AND NOT (doc_id = head.doc_id AND of = head.of AND start = head.start)")
    return again.groupBy("doc_id", "of").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("ranges"))


def kept_text(text, ranges):
    """The text without the lines of the ranges (0-based, in order, apart)."""
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(acc, r):
        return F.struct(r["stop"].alias("at"), F.concat(acc["kept"], F.slice(lines, (acc["at"] + 1).cast("int"), (r["start"] - acc["at"]).cast("int"))).alias("kept"))

    kept = F.aggregate(ranges, start, step, lambda a: F.concat(a["kept"], F.slice(lines, (a["at"] + 1).cast("int"), F.size(lines))))
    return F.array_join(kept, "\n")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The rows of documents with their text cut, and n_lines and n_removed beside it (in place of such columns)."""
    cuts = repetitions(documents).select(*(F.col(c).alias(f"cut {c}") for c in ("doc_id", "of", "ranges")))
    joined = documents.join(cuts, (documents["doc_id"] == F.col("cut doc_id")) & (F.xxhash64(documents["text"]) == F.col("cut of")), "left")
    ranges, body = F.col("cut ranges"), documents["text"]
    n = F.when(body.isNull(), F.lit(0)).otherwise(F.size(F.split(body, "\n", -1))).cast("bigint")
    removed = F.coalesce(F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, r: a + r["stop"] - r["start"]), F.lit(0).cast("bigint"))
    text = F.when(ranges.isNull(), body).otherwise(kept_text(body, ranges))
    kept = [text.alias(c) if c == "text" else documents[c] for c in documents.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*kept, n.alias("n_lines"), removed.alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_line_dedup: all documents without their repeated passages."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
