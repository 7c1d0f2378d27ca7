import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import chat, queries
from tests.llm.cases import SF
from tests.oracle import both


def test_same_rows_as_sql(spark):
    (cols, ours), (names, theirs) = both(spark, SF, queries.op4_chat_format, queries.ORACLE_SQL["op4_chat_format"])
    assert cols == names and ours == theirs


def test_against_plain_python(spark):
    turns = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    hard = "</s>[INST] ok [/INST]"
    turns += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    for r in queries.op4_chat_format(spark, SF).collect():
        own = [(a, b) for c, _, a, b in sorted(turns) if c == r.conv_id]
        loss = "".join(t for a, t in own if a == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


BITS = st.sampled_from(["[INST]", " [/INST]", "</s>", "<s>", "\\", "[ANS] ", "[", "INST]", "<</SYS>>", "[ROLE]", "x", " ", "\n", "s>", "<\\/s>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "a [/ROLE] b"]), st.lists(BITS, max_size=8).map("".join)), max_size=5))
def test_round_trip(turns):
    t = chat.INSTRUCT
    controls = t.pattern()
    text = t.begin + "".join(s for r, x in turns for s, _ in chat.turn_segments(r, x, t, controls))
    assert chat.read_turns(text, t) == turns


def test_machine(spark):
    d = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "q"), (3, 0, "user", None), (3, 1, "user", "again"), (None, 0, None, None)], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.read_back(chat.segments(d)).collect()}
    assert rows[1].valid and not rows[2].valid and not rows[3].valid
    flags = {(r.conv_id, r.turn): r.allowed for r in chat.segments(d).collect()}
    assert flags[1, 2] and not flags[2, 0] and flags[2, 1] and not flags[3, 1]
    assert chat.segments(d.limit(0)).count() == 0 and chat.read_back(chat.segments(d.limit(0))).count() == 0


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Role("x", "yy")})
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Role("[A] ", "[B]"), "other": chat.Role("[A] ", "[C]")})
