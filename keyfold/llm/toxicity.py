"""Toxicity scores by a factorization machine over hashed terms.

A text is its set of words and beginnings of words (lower case, hashed to 2**BITS
terms; the whole text counts). The score is the logistic function of

    b + sum_i w_i + sum_{i<j} <v_i, v_j>

over its terms, the pairwise part in linear time from the sums of v and of v
squared; it gives weight to pairs, such as an insult with the mention of a group,
that additive weights miss. A term has weights if it tells the classes apart by itself (z of at
least MIN_Z on the training sample, the best TERMS) or together with another: among texts
that hold some frequent term it shifts the share of toxic ones (z of at least PAIR_Z, the best
PAIR_TERMS, among the FREQUENT most frequent terms). The latter finds words that tell nothing singly, as a
group's name does, or two words of which only one, or neither, stands in toxic texts. Other terms have no
weights, so that a long text does not drown in noise.

The machine is fitted on at most SAMPLE labelled rows, about, chosen by a hash of the
id, on the driver; equal term sets count once.

Defined results: a null, empty or wordless text has the score of no terms at all; very long texts
count whole; repeated rows each get a row (and teach once); several labels of a doc_id: the largest counts; null
labels and ids do not teach; with no label of both kinds every score is the share of positive labels (0 without
labels); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, lists, mix, only_ids, save, steps, table

#: Labelled rows that the machine is fitted on, about.
SAMPLE = 12_000
BITS, TERMS, RANK = 18, 768, 8
MIN_Z, CUT = 3.5, 0.3
#: Terms that are looked at in pairs, those that pairs may add, and the least z of a pair: of some million pairs hardly one gets there by chance.
FREQUENT, PAIR_TERMS, PAIR_Z = 1536, 128, 6.5
#: Beginnings of longer words, in bytes, that are terms too: they tell inflected forms.
HEADS = (5, 7)


def _inside() -> np.ndarray:
    out = np.zeros(256, bool)
    out[48:58] = out[97:123] = out[128:] = True
    return out


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of all rows of a step, and row offsets in them."""
    w = Words(data, off, _inside())
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(w.rows))
    found = [(row << BITS) | (mix(w.hashes(), 8) >> np.uint64(64 - BITS)).astype(np.int64)]
    for head in HEADS:
        longer = w.end - w.start > head
        found.append(((row << BITS) | (mix(w.hashes(head), 8 + head) >> np.uint64(64 - BITS)).astype(np.int64))[longer])
    both = np.unique(np.concatenate(found))
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(off)))


def term_sets(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, terms array<bigint>)."""

    def run(batches):
        for batch in batches:
            for first, n, data, off in steps(batch.column(1)):
                held, cut = terms(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), lists(held, cut)], ["doc_id", "terms"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, terms array<bigint>")


@dataclass
class Machine:
    place: np.ndarray  # of each term among the weighted ones, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, held: np.ndarray, cut: np.ndarray) -> np.ndarray:
        n = len(cut) - 1
        row = np.repeat(np.arange(n), np.diff(cut))
        at = self.place[held]
        row, at = row[at >= 0], at[at >= 0]
        z = self.bias + np.bincount(row, self.weights[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = 40, batch: int = 512, rate: float = 0.05, shrink: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss by Adam over shuffled batches."""
    rng = np.random.default_rng(11)
    share = y.mean()
    p = [np.array([np.log(share / (1 - share))]), np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], RANK))]
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            part = x[order[a : a + batch]].astype(np.float64)
            sums = part @ p[2]
            z = p[0] + part @ p[1] + 0.5 * (sums**2 - part @ p[2] ** 2).sum(1)
            gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[order[a : a + batch]]) / len(part)
            back = part.T @ gap
            steps_ = [np.array([gap.sum()]), back + shrink * p[1], part.T @ (gap[:, None] * sums) - back[:, None] * p[2] + shrink * p[2]]
            t += 1
            for k, g in enumerate(steps_):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        rate *= 0.93
    return float(p[0][0]), p[1], p[2]


def teaches(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 != 2


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", use: Column | None = None) -> Machine:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (teaches(F.col("doc_id")) if use is None else use))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    n = known.count()
    share = int(min(1.0, SAMPLE / max(1, n)) * 1_000_000)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    sets = term_sets(only_ids(documents.select("doc_id", "text"), chosen.select("doc_id"), "doc_id"))
    sets = sets.join(F.broadcast(chosen), "doc_id").withColumn("same", F.xxhash64("terms")).dropDuplicates(["same", "y"])  # about SAMPLE rows
    sets = save(sets.select("terms", F.col("y").cast("double").alias("y")))
    n, n1 = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    place, n0 = np.full(1 << BITS, -1, np.int64), n - n1
    if not n0 or not n1:
        share = float(np.clip(n1 / max(1, n), 1e-6, 1 - 1e-6))
        return Machine(place, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, RANK)))
    each = sets.select("y", F.explode("terms").alias("term"))
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).where("n >= 3").toPandas()  # at most 2**BITS rows
    both, pos = counts["n"].to_numpy() / n, counts["pos"].to_numpy()
    z = np.abs(pos / n1 - (counts["n"].to_numpy() - pos) / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    order = np.lexsort((counts["term"].to_numpy(), -z))[:TERMS]
    best = counts["term"].to_numpy()[order[z[order] >= MIN_Z]]
    best = np.concatenate([best, pair_terms(sets, counts["term"].to_numpy(), counts["n"].to_numpy(), best)])
    if not len(best):
        return Machine(place, float(np.log(n1 / n0)), np.zeros(0), np.zeros((0, RANK)))
    place[best] = np.arange(len(best))
    return Machine(place, *fit_machine(*matrix(sets, best)))


def matrix(sets: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample's rows by chosen terms, 0 or 1, and their labels."""
    place = np.full(1 << BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    kept = F.array_intersect("terms", F.array(*map(F.lit, chosen.tolist())))
    rows = sets.select(kept.alias("terms"), "y").toPandas()
    held = [np.asarray(t, np.int64) for t in rows["terms"]]
    row = np.repeat(np.arange(len(held)), [len(t) for t in held])
    x = np.zeros((len(held), len(chosen)), np.float32)
    x[row, place[np.concatenate([np.zeros(0, np.int64), *held])]] = 1
    return x, rows["y"].to_numpy(np.float64)


def pair_terms(sets: DataFrame, term: np.ndarray, count: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Terms besides the known ones that shift the share of toxic texts among those with another frequent term, and that term."""
    often = term[np.lexsort((term, -count))][:FREQUENT]
    if len(often) < 2:
        return term[:0]
    x, y = matrix(sets, often)
    both, toxic = x.T @ x, x.T @ (x * y[:, None].astype(np.float32))  # texts with i and j, and toxic ones of them
    n, pos = both.diagonal()[:, None], toxic.diagonal()[:, None]
    rest, expected = n - both, pos / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = toxic / both - (pos - toxic) / rest
        z = np.abs(gap) / np.sqrt(expected * (1 - expected) * (1 / both + 1 / rest))
    # few texts on a side or one class alone say nothing
    z[~np.isfinite(z) | (both < 8) | (rest < 8)] = 0
    new = ~np.isin(often, known)
    found = np.where(new[None, :], z, 0).max(0)
    best = np.lexsort((often, -found))[:PAIR_TERMS]
    best = best[found[best] >= PAIR_Z]
    partners = z[:, best].argmax(0)
    return often[[k for k in dict.fromkeys([*best, *partners]) if new[k]]]


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """Rows (doc_id, score) of all documents."""
    sent = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            for first, n, data, off in steps(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(sent.value.scores(*terms(data, off)))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_toxicity: a score for every whole text of documents."""
    documents = table(spark, sf_dir, "documents")
    machine = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, machine).select(
        "doc_id", F.coalesce(~teaches(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
