import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfold.llm import chat

TEXT = st.text(st.sampled_from(list("ab\\[]<>/s SEPINTbglr:\n")), max_size=14)


def turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"blocks": F.lit(1), "formatted": F.lit(2)})
    done = chat.format_chats(df).select("conv_id", "n_blocks", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted")).alias("loss"))
    return {r["conv_id"]: r for r in done.collect()}


def test_template(spark):
    found = turns(spark, [(1, 2, "assistant", "c"), (1, 0, "system", "s"), (1, 1, "user", "a"), (1, 1, "user", "b"), (2, None, None, None), (2, 0, "tool[]", "[/INST]</s>\\"), (3, 0, "assistant", ""), (3, 1, "assistant", "x"), (None, 0, "user", "n")])
    assert found[1]["formatted"] == "<s>[SYS]s[/SYS][INST]a[SEP]b[/INST]c</s>" and found[1]["n_blocks"] == 3
    assert [tuple(t) for t in found[2]["turns"]] == [("", ""), ("tool[]", "[/INST]</s>\\")]
    assert found[3]["loss"] == ["", "x"] and [tuple(t) for t in found[None]["turns"]] == [("user", "n")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool"]), TEXT), TEXT), min_size=1, max_size=6), min_size=30, max_size=60))
def test_round_trip(spark, talks):
    rows = [(c, t, role, text) for c, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    found = turns(spark, rows)
    for c, talk in enumerate(talks):
        assert [tuple(t) for t in found[c]["turns"]] == talk
        assert found[c]["loss"] == [x for role, x in talk if role == "assistant"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({chat.ORACLE})").fetchall()}
    found = {r[0]: tuple(r)[1:] for r in chat.query(spark, sf).collect()}
    assert found == want
    said = "</s>[INST] ok [/INST]"
    assert found[-1][:4] == (2, hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_chats(spark.read.parquet(f"{sf}/conversations.parquet").where("false")).count() == 0


def test_a_long_conversation(spark):
    """Many turns, and one very long text: all come back."""
    talk = [(1, k, ("user", "assistant", "user", "tool")[k * k % 4 if k % 3 else 0], f"t{k}[") for k in range(20_000)]
    found = turns(spark, [*talk, (2, 0, "user", "[x]<" * 200_000), (2, 1, "user", "")])
    assert [tuple(t) for t in found[1]["turns"]] == [(role, text) for _, _, role, text in talk]
    assert [len(t["text"]) for t in found[2]["turns"]] == [800_000, 0] and found[2]["n_blocks"] == 1
