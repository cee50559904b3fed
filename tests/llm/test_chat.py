"""Spans of chat templates that are only called: round trips, loss masks, rewritten history."""

import hashlib

from helpers import store
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

TEXTS = st.text(alphabet="<|\\im_startend>ok\n é", max_size=30)
SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def spans(turns, template=chat.marked_turns, **options):
    r = chat.Renderer(template, **options)
    return [r.add(role, text) for role, text in turns]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>", "\\n", ""]) | TEXTS, TEXTS), max_size=6))
def test_round_trip(turns):
    out = chat.marked_turns(turns)
    assert chat.read_turns(out) == turns
    got = spans(turns)
    assert "".join(s.piece for s in got) == out and not any(s.rewrites for s in got)
    assert [chat.unescape(s.piece[s.text_start : s.text_end]) for s in got] == [t for _, t in turns]
    short = spans(turns, work=0, tail=1)
    assert [(s.piece, s.start, s.text_start, s.text_end, s.rewrites) for s in short] == [(s.piece, s.start, s.text_start, s.text_end, s.rewrites) for s in got]


@given(TEXTS)
def test_escape(text):
    safe = chat.escape(text)
    assert "<|" not in safe and chat.unescape(safe) == text


def hiding(turns):
    """Drops the thoughts of all turns but the last, as templates of reasoning models do."""
    return "".join(f"[{r}]{t.split('</think>')[-1] if i < len(turns) - 1 else t}[/]" for i, (r, t) in enumerate(turns))


def test_rewritten_history_is_found():
    got = spans([("user", "q"), ("assistant", "<think>x</think>a"), ("user", "p"), ("assistant", "b")], hiding)
    assert [s.rewrites for s in got] == [False, False, True, False]
    third = got[2]
    assert third.start == len("[user]q[/][assistant]") and third.piece == "a[/][user]p[/]"
    assert third.piece[third.text_start : third.text_end] == "p"


def test_generation_prompt_counts_as_history():
    got = spans([("user", "q"), ("assistant", "a")], lambda turns: "".join(f"{r}:{t};" for r, t in turns) + "assistant:")
    assert [s.rewrites for s in got] == [True, False]  # "assistant:" stands before the first turn, and is part of the second


def test_text_left_out_or_repeated():
    assert all(s.text_start == s.text_end for s in spans([("user", "q")], lambda turns: "x" * len(turns)))
    assert all(s.text_start == s.text_end for s in spans([("user", "q")], lambda turns: "".join(t + t for _, t in turns)))


def wanted(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    both = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(both.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.marked_turns(turns))


def test_query_equals_plain_reading(spark, tmp_path):
    rows = [
        (1, 1, "assistant", "b <|im_end|> c", "x"), (1, 0, "user", "a", "x"), (2, 0, None, None, "x"), (3, 0, "assistant", "é" * 200_000, "x"),
        (None, 0, "user", "n", "x"), (None, None, "system", "s", "x"), (4, 0, "user", "t", "x"), (4, 0, "assistant", "t", "x"), (4, 0, "user", "t", "x"),
        *[(5, i, ("user", "assistant")[i % 2], f"turn {i}", "x") for i in range(300)],
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:6] for r in chat.op12(spark, store(tmp_path, conversations=df)).collect()}
    by = {}
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    by[-1] = [("user", chat.PLANTED), ("assistant", chat.PLANTED)]
    assert got == {c: wanted(t) for c, t in by.items()}


def test_long_conversations_need_linear_work(spark):
    calls = []

    def counting(turns):
        calls.append(len(turns))
        return chat.marked_turns(turns)

    turns = [("user", "abc")] * 5000
    got = spans(turns, counting, work=10_000)
    assert got[-1].start + len(got[-1].piece) == len(chat.marked_turns(turns)) and max(calls[1000:]) <= chat.TAIL + 3


def test_format_turns_tiles_the_output(spark, tmp_path):
    rows = [(i % 7, i, ("user", "assistant")[i % 2], f"text <|{i}", "x") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in sorted(chat.format_turns(df).collect(), key=lambda r: (r.conv_id, r.position)):
        assert r.span_start == len(out.get(r.conv_id, "")) and r.span_end == r.span_start + len(r.piece)
        out[r.conv_id] = out.get(r.conv_id, "") + r.piece
        assert chat.unescape(out[r.conv_id][r.text_start : r.text_end]).startswith("text <|")
    assert out == {c: chat.marked_turns([(r[2], r[3]) for r in rows if r[0] == c]) for c in range(7)}


def test_empty_table(spark, tmp_path):
    got = chat.op12(spark, store(tmp_path, conversations=spark.createDataFrame([], SCHEMA))).collect()
    assert [r.conv_id for r in got] == [-1] and got[0].n_turns == 2


def numbered(turns):
    """Numbers its turns, so every turn depends on how many stand before it."""
    return "".join(f"{i}[{r}]{t}[/]" for i, (r, t) in enumerate(turns))


def closing(turns):
    """Drops the second turn's text once a turn says so, however far behind."""
    over = any(t == "forget" for _, t in turns)
    return "".join(f"[{r}]{'' if over and i == 1 else t}[/]" for i, (r, t) in enumerate(turns))


def test_prefixes_are_whole_at_any_size():
    """Templates that look back to any turn, behind far more output than a few turns give."""
    turns = [("user", f"{i} " + "x" * 1_000_000) for i in range(20)]
    got = spans(turns, numbered)
    assert "".join(s.piece for s in got) == numbered(turns) and not any(s.rewrites for s in got)
    assert got[-1].piece.startswith("19[user]")
    late = spans([*turns, ("user", "forget")], closing)[-1]
    assert late.rewrites and late.start == len(closing(turns[:1])) + len("[user]")


def test_whole_and_short_prefixes_give_equal_digests(spark):
    rows = [(i % 3, i, ("user", "assistant")[i % 2], f"turn {i} <|im_end|>", "x") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(chat.digests(df).collect()) == sorted(chat.digests(df, work=None).collect())


def test_digests_call_the_template_with_whole_prefixes(spark):
    """A rewrite of a turn that lies behind the tail shows in the digests."""

    def recalling(turns):
        return chat.marked_turns([(r, "" if t == "turn 3" and turns[-1][1] == "forget" else t) for r, t in turns])

    rows = [(1, i, "user", "forget" if i == 40 else f"turn {i}", "x") for i in range(41)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.n_rewrites for r in chat.digests(df, template=recalling).collect()] == [1]
    assert [r.n_rewrites for r in chat.digests(df, work=0, template=recalling).collect()] == [0]  # what a shorter prefix cannot see
