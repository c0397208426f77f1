"""Language identification by hierarchical discrimination.

Texts become relative frequencies of hashed character 1- to 4-grams (letters in lower
case, everything else a single blank; the whole text counts). A first set of linear
support vector machines, one against the rest, picks the language family; inside
it one machine for each pair of languages votes, and ties go by the sum of
margins. A linear machine on relative frequencies is a mean of its weights over the
n-grams of a text, so that a text of any length is scored in one pass.

Machines are fitted on at most SAMPLE rows of each language (chosen by a hash of
the id, so that the choice does not depend on order), on the driver.

Defined results: a null or empty text or one without a letter is `und` with score 0; a very long text counts
whole; repeated rows each get a row (and each teaches); rows with
a null language or id do not teach; with no usable row every text is `und`; equal votes go to the greater sum of
margins, then to the language that comes first; other columns are
ignored; an empty table gives no rows. A sampled row is 2**BITS 32-bit floats on the driver: 16 KB, SAMPLE of them for each language.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LETTER, classes, code_points
from .common import steps, table

#: Rows of each language that the machines are fitted on, about.
SAMPLE = 500
BITS, ORDERS = 12, 4
#: Text bytes of one step: each byte gives up to ORDERS n-grams.
STEP = 512 << 10
#: Language families by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg"],
    "finnic": ["fi", "et"],
}


def family(lang: str) -> str:
    return next((f for f, held in FAMILIES.items() if lang in held), lang)


@lru_cache(1)
def lowered() -> np.ndarray:
    """Each code point's lower case if it is a letter, else a blank."""
    out = np.where(classes() == LETTER, np.arange(0x110000), 32).astype(np.uint32)
    for c in range(0x2000):
        low = chr(c).lower()
        if out[c] != 32 and len(low) == 1:
            out[c] = ord(low)
    return out


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all n-grams of a step, row offsets in them, and letters of each row."""
    points, at = code_points(data)
    rows = np.searchsorted(at, off)
    low = lowered()[points]
    blank = low == 32
    sums = np.concatenate([[0], np.cumsum(~blank)])
    # a blank opens every row; of other blanks one stays in each run
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    first = rows[:-1][rows[:-1] < rows[1:]]
    keep[first[blank[first]]] = False
    low, kept = low[keep], np.concatenate([[0], np.cumsum(keep)])[rows]
    n = np.diff(kept)
    own = np.arange(len(low)) + np.repeat(np.arange(len(n)) + 1, n)  # with one more place for each row's opening blank
    text = np.full(len(low) + len(n), 32, np.uint64)
    text[own] = low
    cut = kept + np.arange(len(kept))
    begin = np.repeat(cut[:-1], np.diff(cut))
    bins, valid = [], []
    value = np.zeros(len(text), np.uint64)
    place = np.arange(len(text))
    with np.errstate(over="ignore"):
        for k in range(ORDERS):
            past = np.zeros(len(text), np.uint64)
            past[k:] = text[: len(text) - k] if k else text
            value = value * np.uint64(0x100000001B3) + past + np.uint64(k + 1)
            bins.append(((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
            valid.append(place - begin >= k)
    every, ok = np.stack(bins, 1), np.stack(valid, 1)
    count = np.concatenate([[0], np.cumsum(ok.sum(1))])
    return every[ok], count[cut], np.diff(sums[rows])


def histograms(documents: DataFrame) -> DataFrame:
    """Rows (lang, freq BINARY): relative frequencies of hashed n-grams, 32-bit floats."""

    def run(batches):
        for batch in batches:
            for first, n, data, off in steps(batch.column(1)):
                bins, cut, _ = ngrams(data, off)
                for a in range(0, n, 256):
                    b = min(n, a + 256)
                    row = np.repeat(np.arange(b - a), np.diff(cut[a : b + 1]))
                    freq = np.bincount((row << BITS) + bins[cut[a] : cut[b]], minlength=(b - a) << BITS).reshape(b - a, -1)
                    freq = (freq / np.maximum(1, freq.sum(1, keepdims=True))).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first + a, b - a), pa.array([r.tobytes() for r in freq], pa.binary())],
                        ["lang", "freq"],
                    )

    return documents.select("lang", "text").mapInArrow(run, "lang string, freq binary")


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-3, rounds: int = 200) -> np.ndarray:
    """A linear machine (squared hinge, L2) by accelerated gradient steps; y is -1 or 1; the last column of x is all ones."""
    y, weight = y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    step = np.float32(1 / (2 * float(weight @ np.einsum("ij,ij->i", x, x)) + strength))
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        gap = np.maximum(np.float32(0), 1 - y * (x @ v))
        new = v - step * (-2 * ((weight * gap * y) @ x) + np.float32(strength) * v)
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


@dataclass
class Model:
    """Weights (bins x machines), their biases, and what each machine tells apart."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of margins."""
        n, f = len(margins), len(self.families)
        top = margins[:, :f].argmax(1) if f else np.zeros(n, np.int64)
        sure = 1 / (1 + np.exp(-3 * margins[np.arange(n), top])) if f > 1 else np.ones(n)
        names, score = np.full(n, "und", object), np.zeros(n)
        for k, fam in enumerate(self.families):
            rows = np.flatnonzero(top == k)
            held = self.languages[fam]
            votes, sums = np.zeros((len(rows), len(held))), np.zeros((len(rows), len(held)))
            weakest = np.full((len(rows), len(held)), 9.0)
            for j, (a, b) in enumerate(self.pairs):
                if a in held and b in held:
                    m = margins[rows, f + j]
                    for lang, own in ((held.index(a), m), (held.index(b), -m)):
                        votes[:, lang] += own > 0
                        sums[:, lang] += own
                        weakest[:, lang] = np.minimum(weakest[:, lang], own)
            best = (votes + 1e-3 * np.tanh(sums)).argmax(1)
            names[rows] = np.array(held, object)[best]
            score[rows] = sure[rows] / (1 + np.exp(-3 * weakest[np.arange(len(rows)), best]))
        return names.tolist(), np.clip(score, 0, 1)


def teaches(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 3 != 1


def fit(documents: DataFrame, use: Column | None = None) -> Model:
    """Fits on rows with a language (and `use`, by default the contract's training rows)."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (teaches(F.col("doc_id")) if use is None else use))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").toLocalIterator()}
    if not counts:
        return Model()
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, SAMPLE / n) * 1_000_000)).otherwise(share)
    sample = histograms(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)).toArrow()
    lang = np.array(sample.column("lang").to_pylist(), object)
    x = np.ones((len(lang), (1 << BITS) + 1), np.float32)
    for k, row in enumerate(sample.column("freq")):
        x[k, :-1] = np.frombuffer(row.as_py(), np.float32)
    del sample
    centre, spread = x[:, :-1].mean(0), x[:, :-1].std(0)
    scale = (1 / (spread + 1e-4) / np.sqrt(max(1, (spread > 0).sum()))).astype(np.float32)
    x[:, :-1] -= centre
    x[:, :-1] *= scale
    langs = sorted(set(lang))
    fams = sorted({family(k) for k in langs})
    of = np.array([family(k) for k in lang])
    share_of = {k: 1 / (lang == k).sum() for k in langs}
    even = np.array([share_of[k] for k in lang])
    machines = [fit_machine(x, np.where(of == k, 1.0, -1.0), even) for k in fams] if len(fams) > 1 else [np.zeros(x.shape[1])]
    pairs = [(a, b) for a, b in combinations(langs, 2) if family(a) == family(b)]
    for a, b in pairs:
        here = (lang == a) | (lang == b)
        machines.append(fit_machine(x[here], np.where(lang[here] == a, 1.0, -1.0), even[here]))
    w = np.stack(machines, 1)
    weights = w[:-1] * scale[:, None]
    return Model(fams, {k: [g for g in langs if family(g) == k] for k in fams}, pairs, weights.astype(np.float32), w[-1] - centre @ weights)


def predict(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, lang_pred, score) of all documents; keep: the columns that stay instead of doc_id."""
    keep = keep or ["doc_id"]
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for first, n, data, off in steps(batch.column(len(keep)), STEP):
                bins, cut, letters = ngrams(data, off)
                size = np.diff(cut)
                margins = np.tile(m.bias, (n, 1))
                some = np.flatnonzero(size)
                for k in range(m.weights.shape[1]):
                    if len(some):
                        margins[some, k] += np.add.reduceat(m.weights[:, k][bins], cut[some], dtype=np.float64) / size[some]
                names, score = m.decide(margins)
                names = [x if l else "und" for x, l in zip(names, letters, strict=True)]
                kept = [batch.column(k).slice(first, n) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(np.where([x == "und" for x in names], 0.0, score))], [*keep, "lang_pred", "score"])

    fields = "".join(f"`{c}` {documents.schema[c].dataType.simpleString()}, " for c in keep)
    return documents.select(*keep, F.col("text").alias("text to score")).mapInArrow(run, f"{fields}lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_language_id: the language of every whole text of documents."""
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, fit(documents))
    return found.select("doc_id", F.coalesce(~teaches(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
