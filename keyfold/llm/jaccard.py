"""N-gram Jaccard join with several global token orders.

A document is its set of distinct word shingles. Two sets x, y with a Jaccard
similarity of at least t share all but ``miss(|x|)`` shingles of x, so that under
*any* global order of all shingles one of the first ``miss + 1`` of x (its prefix) is
among those of y. A pair must share a prefix shingle under each of three orders:

* order 1, by hash: shingles ``miss + 1 + miss / 2`` deep are counted over all
  documents; a document of which too few are met anywhere else has no partner;
* a share of all shingles, the same for every document: a document drops out of
  which more than ``miss`` of these are its own, so that few whole sets are moved;
* order 2, by rarity: for what is left all shingles are counted; a document with
  more than ``miss`` shingles of its own drops out, the others
  are joined on the prefixes of this order. Documents joined so, directly or
  through others, form a group;
* order 3, by a second hash: inside a group (of near copies, mostly, since its documents share rare shingles), blocks of at most BLOCK documents meet
  pairwise; pairs that share prefixes of orders 1, 2 and 3 and fit in size are
  verified on the whole sets.

Copies of one set are one document until the end. Counts are combined before they
are shuffled, hot shingles never gather their documents, and a block pair emits at
most one link for each document and component found in it.

Defined results: null, empty and wordless texts have no shingles and link with
nothing (component_id is their own doc_id); very long texts count whole (a text is one numpy step, at
some 60 bytes of memory for each of text); an empty table gives no rows; repeated rows link as copies do and
count once; rows of one doc_id with different texts are different sets; a
null doc_id keeps a row and links with nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, components, grams, lists, mix, only_ids, parts, save, scratch, steps, table, with_ids

#: Documents that one side of a block pair holds at most (in the mean).
BLOCK = 1024


def _inside() -> np.ndarray:
    out = np.ones(256, bool)
    out[9:14] = out[32] = False
    return out


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Steps (first row, rows, distinct shingles in the order of their hashes, offsets)."""
    for first, count, data, off in steps(texts):
        w = Words(data, off, _inside())
        found, row = grams(w.hashes(), w.rows, n)
        order = np.lexsort((found, row))
        found, row = found[order], row[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        yield first, count, found[new], np.searchsorted(row[new], np.arange(count + 1))


class Threshold:
    """A similarity of percent / 100 in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def miss(self, n):
        """Shingles of a set of n that a partner may lack."""
        return n * (100 - self.percent) // 100

    def miss_sql(self, n: str) -> str:
        return f"cast(floor({n} * {100 - self.percent} / 100) as bigint)"

    def share(self) -> int:
        """Hundredths of all shingles that are counted before whole sets are: of these two in three must be met."""
        return min(100, 3 * (100 - self.percent))


def summaries(documents: DataFrame, n: int, t: Threshold) -> DataFrame:
    """Rows (doc_id, n, fp_a, fp_b, head): set size, fingerprint, first shingles of order 1."""

    def run(batches):
        for batch in batches:
            for first, count, found, off in sets_of(batch.column(1), n):
                size = np.diff(off)
                miss = t.miss(size)
                take = np.minimum(size, miss + 1 + miss // 2)  # also where miss is 0: a larger set may hold this one
                rank = np.arange(len(found)) - np.repeat(off[:-1], size)
                head = found[rank < np.repeat(take, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, count), pa.array(size), *map(pa.array, fingerprints(found, off)), lists(head, np.concatenate([[0], np.cumsum(take)]))],
                    ["doc_id", "n", "fp_a", "fp_b", "head"],
                )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, fp_a bigint, fp_b bigint, head array<bigint>")


def fingerprints(found: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found, k), dtype=np.uint64)]) for k in (5, 6)]
        return [(s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums]


def whole_sets(documents: DataFrame, n: int, t: Threshold) -> DataFrame:
    """Rows (rep, copies, n, tokens, first, third): whole sets, and their prefixes under orders 1 and 3.

    Rows of documents have (rep, copies, fp_a, fp_b, text); a text that is not the set of the fingerprint is left out.
    """

    def run(batches):
        for batch in batches:
            for first, count, found, off in sets_of(batch.column(4), n):
                size = np.diff(off)
                a, b = fingerprints(found, off)
                held = (a == batch.column(2).to_numpy()[first : first + count]) & (b == batch.column(3).to_numpy()[first : first + count])
                keep = t.miss(size) + 1
                row = np.repeat(np.arange(count), size)
                rank = np.arange(len(found)) - np.repeat(off[:-1], size)
                head = rank < keep[row]
                other = np.lexsort((mix(found, 3), row))
                cut = np.concatenate([[0], np.cumsum(np.minimum(keep, size))])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, count) for k in (0, 1)), pa.array(size), lists(found, off), lists(found[head], cut), lists(found[other][head], cut)],
                    ["rep", "copies", "n", "tokens", "first", "third"],
                ).filter(pa.array(held))

    return documents.select("rep", "copies", "fp_a", "fp_b", "text").mapInArrow(run, "rep bigint, copies bigint, n bigint, tokens array<bigint>, first array<bigint>, third array<bigint>")


def shared(rows: DataFrame, tokens: str) -> DataFrame:
    """Rows (rep, token, df) for the shingles that at least two of the rows hold."""
    each = rows.select("rep", F.explode(tokens).alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    return each.join(counts, "token")


class Sparse:
    """Token lists of some documents as local column numbers."""

    def __init__(self, tokens: list[np.ndarray]):
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.concatenate(tokens) if len(tokens) else np.zeros(0, np.int64)
        held, self.column = np.unique(flat, return_inverse=True)
        self.width = len(held)
        self.row = np.repeat(np.arange(len(tokens)), self.size)

    def meet(self, columns: int = 4096) -> np.ndarray:
        """Which documents share a token, as a square matrix."""
        out = np.zeros((len(self.size),) * 2, bool)
        many = np.bincount(self.column, minlength=self.width) > 1
        number = np.cumsum(many) - 1
        use = many[self.column]
        row, column = self.row[use], number[self.column[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(many.sum()), columns):
            a, b = np.searchsorted(column, [at, at + columns])
            dense = np.zeros((len(self.size), columns), np.float32)
            dense[row[a:b], column[a:b] - at] = 1
            out |= dense @ dense.T > 0
        return out

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        """Common tokens of document i with each of the others."""
        mark = np.zeros(self.width, np.int64)
        mark[self.column[self.begin[i] : self.begin[i + 1]]] = 1
        size = self.size[others]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1]) + np.repeat(self.begin[others] - (ends - size), size)
        sums = np.concatenate([[0], np.cumsum(mark[self.column[flat]])])
        return sums[ends] - sums[ends - size]


def block_links(percent: int):
    """Links of one block pair: for each document linked, the least one of its component here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep").sort_values(["n", "rep"], ignore_index=True)
        n, rep = pdf["n"].to_numpy(), pdf["rep"].to_numpy()
        mask = np.triu(np.ones((len(pdf),) * 2, bool), 1)
        mask &= (n[None, :] * percent <= n[:, None] * 100)  # length bound: columns are the larger sets
        for order in ("first", "second", "third"):
            if mask.any():
                mask &= Sparse([*pdf[order]]).meet()
        parent = np.arange(len(pdf))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        if mask.any():
            whole = Sparse([*pdf["tokens"]])
            for i in np.flatnonzero(mask.any(1)):
                others = np.flatnonzero(mask[i])
                common = whole.overlaps(i, others)
                for j in others[100 * common >= percent * (n[i] + n[others] - common)]:
                    a, b = root(i), root(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        top = np.array([root(k) for k in range(len(pdf))], np.int64)
        linked = top != np.arange(len(pdf))
        return pd.DataFrame({"a": rep[linked], "b": rep[top[linked]]})

    return run


def links(documents: DataFrame, reps: DataFrame, n: int, t: Threshold, step: Scratch) -> DataFrame:
    """Rows (a, b) that connect what is linked, between the sets of reps (rep, doc_id, fp_a, fp_b, copies, n, head).

    They read tables of `step`; what only earlier steps read is gone by then.
    """
    with scratch(documents.sparkSession) as early:
        kept = step.save(rare_prefixes(documents, reps, n, t, early))
    posted = kept.select("rep", F.explode("second").alias("token"))
    heads = posted.groupBy("token").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("df")).where("df >= 2")
    groups = step.save(components(posted.join(heads, "token").select(F.col("rep").alias("a"), "b").distinct()))
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
    placed = kept.join(groups.join(sizes, "component"), kept["rep"] == F.col("node")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n_blocks")))
    facing = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
    facing = facing.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "n", "first", "second", "third", "tokens")
    return facing.groupBy("component", "i", "j").applyInPandas(block_links(t.percent), "a bigint, b bigint")


def met_in_share(sets: DataFrame, t: Threshold) -> DataFrame:
    """Rows (rep) of the sets that may have a partner, by the shingles that fall into the share.

    A shingle falls into it for all sets or for none, so that a set with a partner lacks at most ``miss`` of its own there.
    """
    part = sets.select("rep", "n", F.filter("tokens", lambda s: F.pmod(s, F.lit(100)) < t.share()).alias("part"))
    met = shared(part, "part").groupBy("rep").agg(F.count(F.lit(1)).alias("met"))
    tried = part.select("rep", "n", F.size("part").alias("tried"))
    return tried.join(met, "rep", "left").where(f"coalesce(met, 0) >= tried - {t.miss_sql('n')}").select("rep")


def rare_prefixes(documents: DataFrame, reps: DataFrame, n: int, t: Threshold, step: Scratch) -> DataFrame:
    """Rows (rep, n, first, second, third, tokens) of the sets that may have a partner: their prefixes and the shingles they share."""
    miss = t.miss_sql("n")
    near = shared(reps, "head").groupBy("rep").agg(F.count(F.lit(1)).alias("met"))
    alive = near.join(reps.drop("head"), "rep").where(f"met >= 1 + floor({miss} / 2)").select("rep", "doc_id", "fp_a", "fp_b", "copies")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with scratch(documents.sparkSession) as early:
        alive = early.save(alive)
        cuts = parts(alive, "rep")
        sets = []
        for cut in cuts:
            found = early.save(whole_sets(with_ids(texts, alive.where(cut), "doc_id"), n, t))
            once = early.save(found.where("copies > 1").dropDuplicates(["rep"]))  # of repeated rows one counts
            sets.append(found.where("copies = 1").union(once).drop("copies"))
        ids = early.save(met_in_share(reduce(DataFrame.union, sets), t))
        left = reduce(DataFrame.union, [step.save(only_ids(found, ids.where(cut), "rep")) for found, cut in zip(sets, cuts, strict=True)])
    counted = shared(left, "tokens").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by"))
    own = F.col("n") - F.size("by")  # shingles of its own come first in the order by rarity
    return counted.join(left.drop("tokens"), "rep").where(F.expr(f"size(by) >= n - {miss}")).select(
        "rep", "n", "first", "third",
        F.transform("by", lambda s: s["token"]).alias("tokens"),
        F.transform(F.slice("by", F.lit(1), (F.expr(miss) + 1 - own).cast("int")), lambda s: s["token"]).alias("second"),
    )


def join(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of all documents, one for each row."""
    t = Threshold(percent)
    base = save(summaries(documents, n, t))
    some = base.where("n > 0 AND doc_id IS NOT NULL")
    # a set has a number of its own: one doc_id may stand for several texts
    reps = some.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("head").alias("head"))
    repeated = save(some.groupBy("fp_a", "fp_b", "doc_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    reps = reps.join(repeated, ["fp_a", "fp_b", "doc_id"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    reps = save(reps.withColumn("rep", F.monotonically_increasing_id()))
    with scratch(documents.sparkSession) as step:
        found = save(components(links(documents, reps, n, t, step)))
    sets = reps.select("fp_a", "fp_b", "rep", "doc_id")
    named = sets.join(found, F.col("rep") == F.col("node")).groupBy("component").agg(F.min("doc_id").alias("least"))
    whole = sets.join(found.join(named, "component"), F.col("rep") == F.col("node"), "left").select("fp_a", "fp_b", F.coalesce("least", "doc_id").alias("component"))
    return base.select("doc_id", "n", "fp_a", "fp_b").join(whole, ["fp_a", "fp_b"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_jaccard_join: 3-word shingles of all documents, linked at 0.9."""
    return join(table(spark, sf_dir, "documents"), 3, 90)


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
