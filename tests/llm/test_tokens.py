"""Encoding, decoding and token counts against the library."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyfold.llm import bpe, transducer
from keyfold.llm.common import steps

PATH = bpe.default_path()
EDGES = [
    "", " ", "\n", "   a", "a   ", "a \n b", "don't I'LL we'll  'tis '", "'s's're", "x'<|endoftext|>s", "<|endoftext|>", "a<|endoftext|> b", "  <|endoftext|>  ", "<|endoftext", "a" * 5000, "ab" * 400, " " * 3000 + "x",
    "é中　 \u0085!", "1٣½ Ⅷ", "🙂🙂 á", "\x00\x1c\x1f",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(texts):
    vocab, out = bpe.vocabulary(PATH), []
    for first, n, data, off in steps(pa.array(texts, pa.string())):
        ids, cut = bpe.encode_step(vocab, data, off)
        out += [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        assert [b.decode() for b in bpe.decode_rows(vocab, ids, cut)] == texts[first : first + n]
    return out


def counted(texts):
    made, out = transducer.counter(PATH), []
    for _, _, data, off in steps(pa.array(texts, pa.string())):
        out += transducer.count_step(made, data, off).tolist()
    return out


def check(library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(texts) == want
    assert counted(texts) == [len(x) for x in want]


def test_edges(library):
    check(library, EDGES)


def test_every_token_text(library):
    texts = [b.decode("utf-8", "ignore") for b in bpe.vocabulary(PATH).bytes]
    check(library, ["".join(texts[k :: 997]) for k in range(997)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list(" \n\t'strevmdlLAZz019.,!?éñ中　\u0085<|>")), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=8))
def test_any_text(texts):
    check(Tokenizer.from_file(PATH), texts)


def test_pair_rule_is_the_encoding():
    made = transducer.counter(PATH)
    words = made.vocab.bytes
    for k in range(3000):
        left, right = (k * 7919) % 50000, (k * 104729) % 2000
        assert made.may_follow(left, right) == (made.vocab.long_word(words[left] + words[right]) == [left, right])


def test_queries(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*EDGES, None, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumn("n_tokens", F.lit("clash"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    found = {r["doc_id"]: r for r in bpe.digests(df, PATH).collect()}
    assert len(found) == len(rows)
    for i, t, _ in rows:
        assert found[i]["n_tokens"] == len(want[i])
        assert found[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want[i])).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    for r in transducer.token_counts(df, PATH, limit=100).collect():
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(want[r["doc_id"]]), len((rows[r["doc_id"]][1] or "").encode()), len(want[r["doc_id"]]) > 100)
    plain = {r["doc_id"]: r for r in bpe.encode(df, PATH).collect()}
    assert all(plain[i]["ids"] == want[i] and plain[i]["decoded"] == (t or "") for i, t, _ in rows)
    assert bpe.digests(df.where("false"), PATH).count() == transducer.token_counts(df.where("false"), PATH).count() == 0


def test_transitions_dropped_within_a_word(monkeypatch):
    """A word may need more transitions than are kept: the count is the same."""
    made = transducer.Counter(bpe.vocabulary(bpe.default_path()))
    words = [b"abcabcabdx" * 40, bytes(range(256)) * 2, b" antidisestablishmentarianism", b"x" * 300]
    want = [made.count(w) for w in words]
    monkeypatch.setattr(transducer, "KEPT", 4)
    made.clear()
    assert [made.count(w) for w in words] == want and len(made.moves) <= 9
    assert want == [len(made.vocab.long_word(w)) for w in words]
