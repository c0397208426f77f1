"""Token counts by compiled finite-state transducers.

Two deterministic transducers stand for the tokenizer:

* ``Splitter``: eight states over character symbols (class, one character of
  lookahead, hard boundaries); each transition says whether a pretoken starts. The
  text is cut into chunks of CHUNK characters; for every chunk the map from each
  state to the state after it is built for all chunks at once, the maps are
  composed by a parallel prefix scan, and each chunk then runs from its own state.
* ``Counter``: bytes of a pretoken; each transition carries the number of tokens
  that it adds (or, where parts merge, takes back). A state holds, for each suffix
  that may still grow into a token, its place in the token trie, the token before
  it and the tokens gained since; a byte leads to the one token that can end there
  next to its predecessor. States are compiled when first met and kept for the
  process, to a bound; a pretoken always starts in the reset state, so that its map
  is a constant, and counts of a text add up by prefix sums.

Defined results: null text counts 0 tokens and 0 bytes; the special token's string
in a text counts 1, as the library does by default; repeated ids each get a row;
rows without an id too; other columns are ignored; an empty table gives no rows; a very long text is counted whole, in
steps of its own, and so is a very long word: transitions are dropped at KEPT of them, inside a word too.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import LETTER, NUMBER, SPACE, Vocabulary, classes, contraction, default_path, text_pretokens, vocabulary
from .common import steps, table

CHUNK = 64
#: Compiled transitions that a process keeps before it starts anew.
KEPT = 300_000

NEVER = 1 << 40

# states of the splitter: after a letter, number, other, space, other white space,
# and inside a contraction with one or two letters to go; RESET starts a text
AFTER_LETTER, AFTER_NUMBER, AFTER_OTHER, AFTER_BLANK, AFTER_WHITE, ONE_LEFT, TWO_LEFT, CLOSED = range(8)
# symbols: kind (letter, number, other, blank, white) * 2 + white before a word, apostrophes by length; + HARD at a boundary
KINDS, APOSTROPHE2, APOSTROPHE3, HARD = 5, 10, 11, 12


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start flag by symbol * 8 + state."""
    to, starts = np.zeros((24, 8), np.uint8), np.zeros((24, 8), bool)
    for symbol in range(24):
        hard, base = symbol >= HARD, symbol % HARD
        for state in range(8):
            kind = 2 if base >= APOSTROPHE2 else base // 2
            nxt = kind
            if hard:
                begins = True
            elif state in (ONE_LEFT, TWO_LEFT):
                begins, nxt = False, CLOSED if state == ONE_LEFT else ONE_LEFT
            elif kind in (3, 4):
                begins = state not in (AFTER_BLANK, AFTER_WHITE) or base % 2 == 1
            else:
                begins = state == CLOSED or state not in (kind, AFTER_BLANK)
            if begins and base >= APOSTROPHE2:
                nxt = ONE_LEFT if base == APOSTROPHE2 else TWO_LEFT
            to[symbol, state], starts[symbol, state] = nxt, begins
    return to.ravel(), starts.ravel()


def symbols(points: np.ndarray, hard: np.ndarray) -> np.ndarray:
    kind = classes()[points]
    out = np.full(len(points), 4, np.uint8)
    out[kind == LETTER], out[kind == NUMBER] = 0, 2
    white = kind == SPACE
    word_next = np.append((~white[1:]) & ~hard[1:], False)
    out[white] = np.where(points[white] == 32, 6, 8) + word_next[white]
    size = contraction(points)
    at = np.flatnonzero(size)
    following = np.append(np.flatnonzero(hard), len(points))
    at = at[following[np.searchsorted(following, at, "right")] >= at + size[at]]
    out[at] = np.where(size[at] == 2, APOSTROPHE2, APOSTROPHE3)
    return out + HARD * hard.astype(np.uint8)


def scan_starts(points: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Pretoken starts by chunk state maps and their parallel prefix composition."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    to, starts = splitter()
    chunks = -(-n // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.int64)
    padded[:n] = symbols(points, hard)
    lanes = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T) * 8
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for k in range(CHUNK):
        maps = to[lanes[k][:, None] + maps]
    shift = 1
    while shift < chunks:  # maps[i] becomes the composition of chunks 0..i
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.int64), 1)
        shift *= 2
    state = np.concatenate([[CLOSED], maps[:-1, CLOSED]])
    flags = np.zeros((CHUNK, chunks), bool)
    for k in range(CHUNK):
        at = lanes[k] + state
        flags[k], state = starts[at], to[at]
    return np.flatnonzero(flags.T.ravel()[:n])


class Counter:
    """Bytes to token counts, compiled on demand."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.next, self.token = vocab, [{}], [None]
        for i, word in enumerate(vocab.bytes):
            if not word or word in vocab.special:
                continue
            node = 0
            for b in word:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token.append(None)
                node = self.next[node][b]
            self.token[node] = i
        # for each token, the parts at its right (left) end while it is built, each with the rank that ends it
        of = {w: i for i, w in enumerate(vocab.bytes)}
        made = {int(t): (pair >> 16, pair & 0xFFFF, k) for pair, k in vocab.rank.items() for t in (vocab.result[k],) if of[vocab.bytes[t]] == t}
        self.ends, self.begins = {}, {}
        for spines, side in ((self.ends, 1), (self.begins, 0)):
            for i in range(vocab.size):
                part, until, spine = i, NEVER, []
                while True:
                    spine.append((part, until))
                    if part not in made:
                        break
                    until, part = made[part][2], made[part][side]
                spines[i] = spine
        self.clear()

    def clear(self) -> None:
        self.states, self.ids, self.moves = [((0, -1, 0),)], {((0, -1, 0),): 0}, {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are an encoding of their own bytes.

        A merge has a higher rank than those of its parts, so that merges happen in
        the order of their ranks: the tokens stay apart unless some part at the end of
        the left one and some part at the start of the right one would merge before
        either is merged within its own token (at equal ranks the leftmost goes first).
        """
        if left < 0:
            return True
        rank = self.vocab.rank
        for x, x_until in self.ends[left]:
            for y, y_until in self.begins[right]:
                q = rank.get(x << 16 | y)
                if q is not None and q < x_until and q <= y_until:
                    return False
        return True

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        grown, found = [], None
        for node, before, gained in self.states[state]:
            child = self.next[node].get(byte)
            if child is None:
                continue
            grown.append((child, before, gained))
            token = self.token[child]
            if found is None and token is not None and self.may_follow(before, token):
                found = (token, gained + 1)
        token, base = found
        key = (*((c, b, g - base) for c, b, g in grown if self.next[c]), (0, token, 0))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = move = (self.ids[key], base)
        return move

    def count(self, word: bytes) -> int:
        state, total, moves = 0, 0, self.moves
        for b in word:
            move = moves.get(state << 8 | b)
            if move is None:
                if len(moves) >= 2 * KEPT:  # within one word: only the state in hand is kept
                    held = self.states[state]
                    self.clear()
                    moves, state = self.moves, self.ids.setdefault(held, len(self.states))
                    if state == len(self.states):
                        self.states.append(held)
                move = self.compile(state, b)
            state, gain = move
            total += gain
        return total

    def counts(self, words: list[bytes]) -> np.ndarray:
        if len(self.moves) > KEPT:
            self.clear()
        special, count = self.vocab.special, self.count
        return np.fromiter((1 if w in special else count(w) for w in words), np.int64, len(words))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_step(made: Counter, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    words, codes, rows = text_pretokens(data, off, made.vocab.special, scan_starts)
    sums = np.concatenate([[0], np.cumsum(made.counts(words.to_pylist())[codes])])
    return np.diff(sums[rows])


def token_counts(documents: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit) of every text."""

    def run(batches):
        made = counter(path)
        for batch in batches:
            for first, n, data, off in steps(batch.column(1)):
                tokens = count_step(made, data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit)],
                    ["key", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_token_counts: tokens of every whole text of documents."""
    return token_counts(table(spark, sf_dir, "documents"), default_path())
