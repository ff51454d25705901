import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm.chat import CONTROL, PART, PartVisitor, escape, format_conversations, format_turns, parse_turns, unescape

pieces = st.lists(st.sampled_from([*CONTROL, "\\", "n", "\n", "<", "[", "x", "|", ">", "/", "assistant", "é😀"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(pieces | st.just("assistant"), pieces), max_size=4))
def test_round_trip(turns):
    text, loss, _ = format_turns([{"role": r, "parts": [{"type": "text", "text": t}]} for r, t in turns], PartVisitor())
    assert parse_turns(text) == turns
    assert [unescape(text[x["start"] : x["end"]]) for x in loss] == [t for r, t in turns if r == "assistant"]


def test_parts(spark):
    rows = [
        (1, 0, "user", [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 1.01, None), ("document", None, "c.pdf", None, None, None, 3)]),
        (1, 1, "assistant", [("text", "fine", None, None, None, None, None)]),
        (2, None, None, None),
        (2, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{PART}>")
    got = {r["conv_id"]: r for r in format_conversations(df, parts_col="parts").collect()}
    one = got[1]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 26), ("document", "c.pdf", 768)]
    for a in one["attachments"]:
        assert one["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>")
    assert escape("see <|image|> ") in one["formatted"]
    assert [one["formatted"][x["start"] : x["end"]] for x in one["loss"]] == ["fine"]
    assert got[2]["n_turns"] == 2 and parse_turns(got[2]["formatted"]) == [("", ""), ("", "")]
    assert format_conversations(df.limit(0), parts_col="parts").count() == 0
    with pytest.raises(ValueError):
        PartVisitor().visit({"type": "video"})
