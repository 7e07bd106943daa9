"""Chat formatting against a plain version of its own, on odd rows and odd texts."""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pytest

from gridloom.llm.chat import PROBE, PROBE_ID, Template, chat_formatting, format_chats
from gridloom.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "a<\\/s>b</s>c [INST"),
    (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nhi <\\\\/s>"),
    (1, 2, "user", None),
    (None, None, None, None),
    (None, 1, "assistant", "퟿ x"),
    (2, 0, "assistant", "<"),
    (2, 0, "assistant", "<"),
    (2, 1, "we ird\nro<|im_end|>le", "[/INST][\\INST]|im_end|>"),
    (3, 0, "", ""),
    (4, 0, "system", "s"),
    (4, 1, "user", "q\U0001f600é"),
    (4, 2, "assistant", "a$1\\"),
    (4, 3, "tool", "t"),
    (4, 4, "assistant", "b"),
    (5, 1, "assistant", "late"),
    (5, -1, "user", "early"),
]


def digest(text):
    return sha256(text.encode()).hexdigest()


def by_conversation(rows):
    held = defaultdict(list)
    for conv, turn, role, text in [*rows, (PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)]:
        held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [(r, t) for *_, r, t in sorted(v)] for k, v in held.items()}


def machine(roles, template):
    state = template.start
    for i, role in enumerate(roles):
        if role not in template.turns.get(state, {}):
            return False, i
        state = template.turns[state][role]
    return state in template.ends, None


def test_round_trip_of_odd_conversations(spark):
    want, t = by_conversation(ROWS), Template()
    got = {r.conv_id: r for r in chat_formatting(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        r, learnt = got[conv], "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == digest("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), digest(learnt))
        assert (r.valid, r.bad_turn) == machine([role for role, _ in turns], t)


def test_segments_hold_no_control_string_but_marks(spark):
    t = Template()
    for r in format_chats(spark.createDataFrame(ROWS, SCHEMA)).collect():
        assert len(r.segments) == 3 * r.n_turns
        for head, text, tail in zip(*[iter(r.segments)] * 3):
            assert head.text.startswith(t.opening) and tail.text == t.closing and not head.loss and not tail.loss
            assert not any(c in text.text for c in t.forbidden)
            assert not any(c in head.text[len(t.opening) :] for c in t.forbidden)
            assert text.loss == (head.text == f"{t.opening}assistant\n")


def test_empty_table_and_extra_columns(spark):
    empty = chat_formatting(spark.createDataFrame([], SCHEMA)).collect()
    assert [r.conv_id for r in empty] == [PROBE_ID] and empty[0].valid
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = [(1, 0, "user", "x", "a", 1, 2), (1, 1, "assistant", "y", "b", 3, 4)]
    odd = spark.createDataFrame(clash, SCHEMA + ", segments string, _row int, n_turns int")
    assert {r.conv_id: r.n_turns for r in chat_formatting(odd).collect()} == {1: 2, PROBE_ID: 2}


def test_long_conversation_and_long_text(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}</s>" * (20_000 if i == 7 else 1)) for i in range(3000)]
    r = chat_formatting(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 1").first()
    assert r.valid and r.turns_sha256 == digest("".join(f"{role}\n{text}\n" for _, _, role, text in rows))


def test_other_templates(spark):
    t = Template(opening="[T]", between="|", closing="[E]", controls=("[E]",), learnt=("bot", "critic"), turns={"start": {"you": "a"}, "a": {"bot": "b"}, "b": {"critic": "c"}}, ends=("b", "c"))
    rows = [(1, 0, "you", "[T]x|[E]"), (1, 1, "bot", "[E]"), (1, 2, "critic", "no"), (2, 0, "you", "only")]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, SCHEMA), t).collect()}
    assert got[1].valid and not got[2].valid and got[2].bad_turn is None
    assert "".join(s.text for s in got[1].segments) == "[T]you|[\\T]x|[\\E][E][T]bot|[\\E][E][T]critic|no[E]"
    assert [s.loss for s in got[1].segments[1::3]] == [False, True, True]


@pytest.mark.parametrize("wrong", [{"controls": ("<\\x",)}, {"controls": ("a<b", "<s>")}, {"between": "<"}, {"controls": ("x",)}, {"closing": "end"}])
def test_templates_that_could_not_be_read_back_are_refused(wrong):
    if wrong == {"closing": "end"}:
        wrong = {"closing": "\nend"}
    with pytest.raises(ValueError):
        Template(**wrong)


def test_sql(spark, sf_dir, duck, collected):
    assert collected(QUERIES["op11_chat_formatting"](spark, sf_dir)) == duck(ORACLES["op11_chat_formatting"])
