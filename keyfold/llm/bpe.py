"""BPE encoding and decoding with a contiguous rank array.

Every whole text is split into pretokens (numpy, by Unicode class), the distinct
pretokens of a step are encoded together, and ids are laid out for all occurrences.
A short word is held as one row of a contiguous array of part ids with the array
of adjacent merge ranks beside it: the least rank is found by a scan, its boundary
is deleted, and the two neighbouring ranks are refreshed. Words of one length form
one array, so that each scan serves all of them; a word over LONG bytes takes a
heap instead, so that no word costs quadratic time.

Defined results: null text is empty (no ids, empty decoded text); the special
token's string inside a text becomes its id, as the library does by default; rows
are kept as they are, repeated and null ids included; a very long text is a step of its own and a very long word takes
the heap; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ragged, steps, table

#: Longest word, in bytes, that the rank arrays take.
LONG = 48
NONE = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: White space of the splitting pattern.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            span = np.arange(*m.span())
            out[span + 0x800 * (span >= 0xD800)] = code
    out[WHITE] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each one starts (with the end)."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.append(at, len(data))


def find_special(data: np.ndarray, off: np.ndarray, special: bytes) -> np.ndarray:
    """Byte positions of the special string, none across two rows."""
    raw, found, at = data.tobytes(), [], 0
    while special and (at := raw.find(special, at)) >= 0:
        k = np.searchsorted(off, at, "right")
        if k >= len(off) or off[k] >= at + len(special):
            found.append(at)
            at += len(special)
        else:
            at = int(off[k])
    return np.array(found, np.int64)


def contraction(points: np.ndarray) -> np.ndarray:
    """Length of the contraction that an apostrophe could begin at each place, or 0."""
    pad = np.append(points, [0, 0])
    one, two = pad[1:-1], pad[2:]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    return np.where(points == 39, np.where(short, 2, np.where(long, 3, 0)), 0)


def pretoken_starts(points: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Where pretokens start; hard: places that start a text or follow or are a special token."""
    if not len(points):
        return np.zeros(0, np.int64)
    kind = classes()[points]
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    white = kind == SPACE
    ends = np.append(hard[1:], True)
    start = np.where(white, (before != SPACE) | ((after != SPACE) & ~ends), (before != kind) & (np.roll(points, 1) != 32))
    start |= hard
    # contractions: an apostrophe that starts a pretoken takes its letters along
    size = np.where(start, contraction(points), 0)
    at = np.flatnonzero(size)
    if len(at):
        stop = np.minimum(at + size[at], len(points))
        following = np.append(np.flatnonzero(hard), len(points))
        fits = following[np.searchsorted(following, at, "right")] >= at + size[at]
        at, stop = at[fits], stop[fits]
        start[at + 1] = False
        start[stop[stop < len(points)]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Byte-level BPE ranks read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in visible]
        letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for s, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = np.array([(vocab[a] << 16) | vocab[b] for a, b in merges], np.int64)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rank = {int(p): k for k, p in reversed([*enumerate(pairs)])}
        # a table of slots for array look-ups: each pair in the first free slot after its own
        self.bits = 18
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        for p, k in self.rank.items():
            at, n = int(self._slot(np.int64(p))), 1
            while self.slots[at] >= 0:
                at, n = (at + 1) % len(self.slots), n + 1
            self.slots[at], self.ranks[at] = p, k
            self.probes = max(self.probes, n)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _slot(self, pair):
        return ((pair * 0x9E3779B1) >> 13) & ((1 << self.bits) - 1)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they do not merge."""
        pair = (left.astype(np.int64) << 16) | right
        at = self._slot(pair)
        held = self.slots[at]
        out = np.where(held == pair, self.ranks[at], NONE)
        open_ = np.flatnonzero((held != pair) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at.ravel()[open_] = slot = (at.ravel()[open_] + 1) % len(self.slots)
            held = self.slots[slot]
            hit = held == pair.ravel()[open_]
            out.ravel()[open_[hit]] = self.ranks[slot[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def long_word(self, word: bytes) -> list[int]:
        """A word of any length: a heap of ranks over linked parts."""
        ids = [int(self.of_byte[b]) for b in word]
        left, right = [*range(-1, len(ids) - 1)], [*range(1, len(ids) + 1)]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := self.rank.get(ids[k] << 16 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[k], ids[j], right[k] = int(self.result[r]), -1, right[j]
            if right[j] < len(ids):
                left[right[j]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y < len(ids) and (q := self.rank.get(ids[x] << 16 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (large_binary): flat ids and the count of each word."""
        off = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
        size = np.diff(off)
        counts, parts = np.zeros(len(words), np.int64), []
        for n in np.unique(size[(size > 0) & (size <= LONG)]):
            rows = np.flatnonzero(size == n)
            ids = self.of_byte[data[off[rows][:, None] + np.arange(n)]]
            ranks = self.look(ids[:, :-1], ids[:, 1:])
            while len(rows):
                if ids.shape[1] > 1:
                    at = ranks.argmin(1)
                    least = ranks[np.arange(len(rows)), at]
                    live = least < NONE
                else:
                    live = np.zeros(len(rows), bool)
                done = ~live
                if done.any():
                    counts[rows[done]] = ids.shape[1]
                    parts.append((rows[done], ids[done]))
                    rows, ids, ranks = rows[live], ids[live], ranks[live]
                    if not len(rows):
                        break
                    at, least = at[live], least[live]
                every, width = np.arange(len(rows)), ids.shape[1]
                column = np.arange(width - 1)
                ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
                ids[every, at] = self.result[least]
                column = np.arange(width - 2)
                ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
                inner = at > 0
                ranks[every[inner], at[inner] - 1] = self.look(ids[every[inner], at[inner] - 1], ids[every[inner], at[inner]])
                inner = at < width - 2
                ranks[every[inner], at[inner]] = self.look(ids[every[inner], at[inner]], ids[every[inner], at[inner] + 1])
        for k in np.flatnonzero(size > LONG):
            word = data[off[k] : off[k + 1]].tobytes()
            got = [self.special[word]] if word in self.special else self.long_word(word)
            counts[k] = len(got)
            parts.append((np.array([k]), np.array([got], np.int32)))
        for s, i in self.special.items():
            for k in np.flatnonzero(size == len(s)):
                if data[off[k] : off[k + 1]].tobytes() == s:
                    parts.append((np.array([k]), np.array([[i]], np.int32)))
                    counts[k] = 1
        begin = np.cumsum(counts) - counts
        flat = np.zeros(counts.sum(), np.int32)
        for rows, ids in parts:
            rows_ok = counts[rows] == ids.shape[1]
            flat[begin[rows[rows_ok]][:, None] + np.arange(ids.shape[1])] = ids[rows_ok]
        return flat, counts


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def text_pretokens(data: np.ndarray, off: np.ndarray, special: dict[bytes, int], find=pretoken_starts):
    """Distinct pretokens (large_binary), the code of each pretoken, and pretoken offsets of rows."""
    points, at = code_points(data)
    hard = np.zeros(len(points) + 1, bool)
    hard[np.searchsorted(at, off)] = True
    whole = np.zeros(len(points), bool)
    for s in special:
        found = np.searchsorted(at, find_special(data, off, s))
        if len(found):
            hard[found] = hard[found + len(s)] = True
            whole[(found[:, None] + np.arange(len(s))).ravel()] = True
    starts = find(points, hard[:-1])
    starts = starts[~whole[starts] | hard[:-1][starts]]
    cuts = np.append(at[starts], len(data))
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data.tobytes())])
    coded = every.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(cuts, off) if len(starts) else np.zeros(len(off), np.int64)


def encode_step(vocab: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all rows of a step, and the offsets of rows in them."""
    words, codes, rows = text_pretokens(data, off, vocab.special)
    flat, counts = vocab.words(words)
    begin = np.cumsum(counts) - counts
    ids = flat[ragged(begin[codes], counts[codes])]
    return ids, np.concatenate([[0], np.cumsum(counts[codes])])[rows]


def decode_rows(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The UTF-8 bytes of each row's ids (a broken sequence becomes the replacement character)."""
    out = vocab.flat[ragged(vocab.offsets[ids], vocab.lengths[ids])].tobytes()
    cuts = np.concatenate([[0], np.cumsum(vocab.lengths[ids])])[offsets]
    return [out[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode(documents: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, ids array<int>, decoded string) of every text."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for first, n, data, off in steps(batch.column(1)):
                ids, cut = encode_step(vocab, data, off)
                decoded = [b.decode() for b in decode_rows(vocab, ids, cut)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(documents: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): what encode() and decoding give, without the bulk."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for first, n, data, off in steps(batch.column(1)):
                ids, cut = encode_step(vocab, data, off)
                raw = ids.astype("<u4").view(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(np.diff(cut)),
                        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]),
                        pa.array([hashlib.sha256(b).hexdigest() for b in decode_rows(vocab, ids, cut)]),
                    ],
                    ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_bpe: encodes and decodes every whole text of documents."""
    return digests(table(spark, sf_dir, "documents"), default_path())
