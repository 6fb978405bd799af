import hashlib
import itertools

import pytest

from otindex.llm.chat_format import ESCAPE, Template, escaped, format_chats, read_chats, unescaped

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string"


@pytest.mark.parametrize(
    "text",
    ["", "</s>[INST] ok [/INST]", ESCAPE, ESCAPE * 3 + "</s>", "<<s>s>", "<<SYS>><</SYS>>", "<|im_end|>\n", "[[INST]", f"<{ESCAPE}/s>"],
)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    template = Template()
    for line_feed in (False, True):
        out = escaped(text, template.escape_pattern(), line_feed)
        assert unescaped(out, line_feed) == text
        assert not any(c in out for c in template.controls)
        assert not (line_feed and "\n" in out)


def test_conversations_survive_the_round_trip(spark):
    tricky = ["", None, "héllo 🙂", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", ESCAPE + "n", "x" * 5000]
    rows = [
        (c if c < 5 else None, t, ("user", "assistant", "system\n", None)[(c + t) % 4], tricky[(c * 3 + t) % len(tricky)], "p")
        for c, t in itertools.product(range(6), range(40))
    ]
    rows += [rows[0], (1, 3, "assistant", "tie", "p"), (1, None, "assistant", "no turn", None)]
    out = {r["conv_id"]: r for r in read_chats(format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(out) == 6
    for conv in {r[0] for r in rows}:
        turns = sorted(
            (r for r in rows if r[0] == conv),
            key=lambda r: [(x is not None, x if x is not None else 0 if i == 1 else "") for i, x in enumerate(r[:4])][1:],
        )
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        row = out[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_the_mask_holds_assistant_texts_only(spark):
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes é", ""), (1, 2, "assistant", "", "")]
    part = format_chats(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    texts = [r["formatted"].encode()[a:b].decode() for r in part for a, b in zip(r["loss_starts"], r["loss_ends"])]
    assert texts == ["yes é", ""]


def test_empty_table(spark):
    assert read_chats(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ties_beyond_the_bounds_of_the_tasks(spark):
    """Turns that differ only after the characters that bound the tasks still come in full order."""
    rows = [(1, 0, "user", "x" * 200 + str(k % 7), "") for k in range(300)] + [(1, 0, "user" * 40 + "b", "t", ""), (1, 0, "user" * 40 + "a", "t", "")]
    out = read_chats(format_chats(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()
    said = "".join(f"{r[2]}\n{r[3]}\n" for r in sorted(rows, key=lambda r: (r[2], r[3])))
    assert len(out) == 1 and out[0]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
