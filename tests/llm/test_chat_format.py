import hashlib

import duckdb
import pytest
from corpus_rows import SMALL

from errorlens.llm import chat_format as C
from errorlens.llm.chat_format import Turn

CONV = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", ""),
    (2, 1, "assistant", "### assistant: \\</turn>\n"), (2, 0, "user", "ends with \\"),
    (3, None, "user", "no turn"), (3, 0, None, "no role"), (3, 0, "a: b\\", "tie"), (3, 0, "a: b\\", "tie"),
    (None, 0, "assistant", "no id"), (4, 0, "assistant", "漢字 🙂 \x00"), (5, 0, "assistant", "x" * 300_000),
]


def frame(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, CONV)
    for c in ("pos", "start", "end", "piece", "body_start", "state", "_uid"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def by_hand(rows):
    """What `digests` has to give, from the rows alone."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_odd_rows(spark):
    got = C.digests(C.format_conversations(frame(spark, ODD))).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == by_hand(ODD)
    pieces = C.format_conversations(frame(spark, ODD)).where("conv_id = 2").orderBy("pos").collect()
    assert [C.read_turn(r["piece"]) for r in pieces] == [("user", "ends with \\"), ("assistant", "### assistant: \\</turn>\n")]
    whole = "".join(r["piece"] for r in pieces)
    assert whole == "### user: ends with \\\\</turn>\n### assistant: \\### assistant: \\\\\\</turn>\n</turn>\n"
    assert whole[pieces[1]["body_start"]:pieces[1]["body_end"]] == "\\### assistant: \\\\\\</turn>\n"


def test_empty_table(spark):
    assert C.format_conversations(frame(spark, [])).count() == 0
    assert C.digests(C.format_conversations(frame(spark, []))).count() == 0


def test_query_equals_sql(spark):
    from errorlens.llm.queries import oracle_sql, queries
    got = queries()["op12_chat_format"](spark, SMALL).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = con.sql(oracle_sql()["op12_chat_format"]).df()
    cols = list(want.columns)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want.values.tolist()))
    assert -7 in set(got["conv_id"])


def steps(template, turns, loss=("assistant",)):
    state = C.Rendering(template, loss)
    return [state.add(t) for t in turns], state


def rebuilt(done):
    out = ""
    for s in done:
        out = out[:s.start] + s.piece
    return out


TURNS = [Turn("system", "s")] + [Turn("user" if i % 2 else "assistant", f"text {i}") for i in range(300)]


def numbered(turns):
    return "".join(f"[{i}] {r}: {t}\n" for i, (r, t) in enumerate(turns))


def last_thoughts(turns):
    """Thoughts of all turns but the last are taken out."""
    return "<s>" + "".join(f"{r}: {t if i == len(turns) - 1 else t.split('|')[-1]};" for i, (r, t) in enumerate(turns))


def after_user(turns):
    return "".join((">" if i and turns[i - 1].role == "user" else "-") + t + "\n" for i, (_, t) in enumerate(turns))


@pytest.mark.parametrize("template", [C.marked_turns, numbered, last_thoughts, after_user, lambda turns: "constant"])
def test_steps_rebuild_the_whole_rendering(template):
    done, state = steps(template, TURNS)
    assert rebuilt(done) == template(TURNS)
    # a template that looks back a bounded way is rendered in blocks, others with all turns
    assert (len(state.context) <= C.BLOCK_TURNS) == (template is not numbered)


def test_bodies_are_the_texts():
    for template in (C.marked_turns, numbered, after_user):
        done, _ = steps(template, TURNS)
        whole = template(TURNS)
        assert [whole[s.body[0]:s.body[1]] for s, t in zip(done, TURNS) if s.body] == \
            [t.text for t in TURNS if t.role == "assistant"]


def test_rewritten_history_is_seen():
    turns = [Turn("user", "q"), Turn("assistant", "think|answer"), Turn("user", "more")]
    done, _ = steps(last_thoughts, turns)
    assert [s.rewritten for s in done] == [False, False, True]
    # the output before the thought stays
    assert done[2].start == len("<s>user: q;assistant: ") and rebuilt(done) == last_thoughts(turns)
    assert not any(s.rewritten for s in steps(C.marked_turns, turns)[0])


def test_a_text_that_the_template_changes_has_no_body():
    trimmed = lambda turns: "".join(f"<{t.strip().upper() if t.strip() else 'none'}>" for _, t in turns)
    done, _ = steps(trimmed, [Turn("assistant", "  ok "), Turn("assistant", "")])
    assert trimmed([Turn("assistant", "  ok ")])[done[0].body[0]:done[0].body[1]] == "OK"
    twice = lambda turns: "".join(f"{t}/{t}." for _, t in turns)
    done, _ = steps(twice, [Turn("assistant", "abc")])
    assert done[0].body == (0, 7)


def test_a_long_conversation_is_rendered_in_blocks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} " * 20) for i in range(3000)]
    got = C.digests(C.format_conversations(frame(spark, rows))).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == by_hand(rows)
    seen = []
    state = C.Rendering(lambda turns: seen.append(len(turns)) or C.marked_turns(turns), ("assistant",))
    for _, _, role, text in rows:
        state.add(Turn(role, text))
    assert max(seen) <= C.BLOCK_TURNS
