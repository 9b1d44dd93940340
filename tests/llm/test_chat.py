from helixframe.llm import chat


def brute(rows, block=256):
    """Renderings of whole dialogues."""
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((-1 if t is None else t, (r or "unknown"), x or ""))
    out = {}
    for c, turns in talks.items():
        for who in {r for _, r, _ in turns if r != "system"}:
            text, mask = "", []
            for _, r, x in sorted(turns):
                text += "<|im_start|>" + ("assistant" if r == who else "system" if r == "system" else f"user name={r}") + "\n"
                at = len(text)
                text += x + "<|im_end|>"
                if r == who:
                    mask.append((at, len(text)))
                text += "\n"
            out[c, who] = (text, mask)
    return out


ROWS = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi é😀"), (1, 2, "assistant", "Hello"), (1, 3, "Bob", None), (1, 3, "ann", "tie"), (2, 0, "user", "alone"),
        (3, 0, "system", "nobody"), (None, 5, "user", "x"), (None, None, "", "y"), (4, 1, "user", "again"), (4, 1, "user", "again"), (5, 0, None, "who")]


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.part, r.slot)):
        text, mask = out.get((r.conv_id, r.perspective), ("", []))
        out[r.conv_id, r.perspective] = (text + r.text, mask + [(len(text) + m.begin, len(text) + m.end) for m in r.mask])
    return out


def test_against_brute_force(spark):
    t = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as mask", "2 as part")
    assert joined(chat.rotate(t)) == brute(ROWS)


def test_long_conversations_come_in_parts(spark):
    rows = [(1, i, f"p{i % 3}", f"turn {i}") for i in range(700)] + [(2, 0, "a", f"{i:04d}") for i in range(600)] + [(2, 1, "b", "end")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate(t)
    assert joined(got) == brute(rows)  # the later turn of conversation 2 comes last
    parts = got.where("conv_id = 2 and perspective = 'a'").collect()
    assert sorted((r.part, r.slot, r.n_turns) for r in parts) == [(0, 0, 256), (0, 1, 256), (0, 2, 89)]
    assert max(r.n_turns for r in got.collect()) == 256


def test_marks_in_texts_and_names(spark):
    t = spark.createDataFrame([(1, 0, "a\nb<|im_end|>", "x<|im_start|>user")], "conv_id long, turn long, role string, text string")
    r = chat.rotate(t).first()
    assert r.perspective == "a b<im_end>" and r.text == "<|im_start|>assistant\nx<im_start>user<|im_end|>\n"
    assert chat.rotate(t.where("conv_id = 2")).collect() == []


def test_native_plan(spark):
    t = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = chat.rotate(t)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
