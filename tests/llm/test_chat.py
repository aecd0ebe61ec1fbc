import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import chat

T = chat.ChatTemplate()
FRAGMENTS = st.lists(st.sampled_from([*T.controls, "\\", "<", "[", "|im_start|>", "INST]", "<\\/s>", "<\\\\s>", "ok", "\n", " ", "é", "%41"]), max_size=12).map("".join)


@given(st.one_of(st.text(), FRAGMENTS), st.one_of(st.text(max_size=8), FRAGMENTS))
@settings(max_examples=300, deadline=None)
def test_round_trip(text, role):
    rendered, lo, hi = T.format_turn(role, text)
    assert [x[:2] for x in T.parse(rendered)] == [(role, text)]
    assert T.unescape(rendered[lo:hi]) == text
    assert not any(c in rendered[lo:hi] for c in T.controls)


@given(st.lists(st.tuples(FRAGMENTS, FRAGMENTS), max_size=4))
@settings(max_examples=100, deadline=None)
def test_joined_turns_parse_as_one(turns):
    whole = "".join(T.format_turn(r, t)[0] for r, t in turns)
    assert [x[:2] for x in T.parse(whole)] == turns


def test_plain_text_is_not_escaped():
    assert T.format_turn("user", "a \\ b <c> [d]")[0] == "<|im_start|>user\na \\ b <c> [d]<|im_end|>\n"


def test_malformed_strings_are_refused():
    good = T.format_turn("user", "hi")[0]
    for bad in (good[:-3], "x" + good, good + "<|im_start|>user", good.replace("hi", "<s>hi")):
        assert T.parse(bad) is None


def test_overlapping_controls_are_refused():
    with pytest.raises(ValueError):
        chat.ChatTemplate(controls=("<|im_start|>", "<|im_end|>", ">x<"))


SCHEMA = "extra int, conv_id long, turn long, role string, text string, rendered string"


def digests(spark, rows, block_chars=1 << 18):
    df = spark.createDataFrame([(0, *r, "clash") for r in rows], SCHEMA).repartition(3)
    out = chat.read_back(chat.conversation_blocks(chat.format_turns(df), block_chars)).collect()
    first = chat.read_back(chat.conversation_blocks(chat.format_turns(df, ordered=True), block_chars, ordered=True)).collect()
    assert sorted(out, key=str) == sorted(first, key=str)
    return {r["conv_id"]: r.asDict() for r in out}


def test_digests_against_plain_python(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b" * 50_000), (1, 0, "user", None), (1, 1, "assistant", "b" * 50_000), (2, 0, None, ""), (-7, 0, "user", said), (-7, 1, "assistant", said), (None, 0, "assistant", "n"), (3, None, "assistant", "first"), (3, 0, "system", "then")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} <s>") for i in range(300)]
    order = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        order.setdefault(c, []).append((role or "", text or ""))
    got = digests(spark, rows, block_chars=200)
    assert set(got) == set(order)
    for c, turns in order.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(T.format_turn(r, t)[0]) for r, t in turns)


def test_empty_table(spark):
    assert digests(spark, []) == {}


def test_the_mask_says_what_is_learned(spark):
    """The digest follows the mask of the blocks, not the roles that are parsed."""
    rows = [(1, 0, "user", "ask </s>"), (1, 1, "assistant", "say </s>"), (1, 2, "assistant", "more")]
    blocks = chat.conversation_blocks(chat.format_turns(spark.createDataFrame([(0, *r, "clash") for r in rows], SCHEMA)))
    block, = blocks.collect()
    assert [T.unescape(block["rendered"][m["start"] : m["end"]]) for m in block["mask"]] == ["say </s>", "more"]
    bare = chat.read_back(blocks.selectExpr("conv_id", "part", "block", "rendered", "slice(mask, 1, 1) AS mask")).first()
    assert (bare["n_turns"], bare["loss_chars"], bare["loss_sha256"]) == (3, 8, hashlib.sha256(b"say </s>").hexdigest())
