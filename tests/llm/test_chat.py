import hashlib

from pyspark.sql import functions as F
from umbrascan.llm import chat

HOSTILE = ["", "\\", "\\\\h", "###", "####", "</turn>", "<</turn>\n", "</turn", "\\b\\t", "### user: x</turn>\n", ": a", "\\c ", "é字😀", "\n"]


def test_layouts(spark):
    records = {
        '{"messages":[{"role":"user","content":"a"},{"role":"bot","content":null}]}': ("messages", [("user", "a"), ("assistant", "")]),
        '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}],"system":"s"}': ("conversations", [("system", "s"), ("user", "x"), ("assistant", "y")]),
        '{"conversations":[{"from":"human","value":"x"}]}': ("conversations", [("user", "x")]),
        '{"instruction":"i","input":"n","output":"o"}': ("instruction", [("user", "i\nn"), ("assistant", "o")]),
        '{"output":"o","instruction":"i"}': ("instruction", [("user", "i"), ("assistant", "o")]),
        '{"prompt":"p","response":"r","id":3}': ("prompt_response", [("user", "p"), ("assistant", "r")]),
        '{"prompt":"p","completion":"r"}': ("prompt_completion", [("user", "p"), ("assistant", "r")]),
        '{"request":{"prompt":"q"},"reply":{"text":"t"},"meta":{"model":"m"}}': ("nested", [("user", "q"), ("assistant", "t")]),
        '{"other":1}': (None, []),
        "[]": (None, []),
        "3": (None, []),
        "{}": (None, []),
    }
    df = spark.createDataFrame([(j, "x") for j in records], "j string, turns string").withColumn("record", F.parse_json("j"))
    rows = chat.format_records(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert len(rows) == len(records)
    for r in rows:
        layout, turns = records[r["j"]]
        assert (r["layout"], [tuple(t) for t in r["turns"]], r["back"]) == (layout, turns, r["turns"])


def test_field_paths(spark):
    df = spark.createDataFrame([('{"a":{"b":[{"c":1,"d":null}],"e f":2},"g":[[true]]}',)], "j string")
    got = df.select(chat.field_paths(F.parse_json("j")).alias("p")).first()["p"]
    assert got == ["a.b[].c", "a.b[].d", "a.e f", "g[][]"]
    assert chat.fingerprint(got) == hashlib.sha256("\n".join(got).encode()).hexdigest()


def test_hostile_texts_come_back(spark):
    rows = [(i, t, role, text) for i, text in enumerate(HOSTILE) for t, role in enumerate(["user", "assistant", text])]
    rows += [(100, 0, None, None), (None, 0, "user", "x"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_turn_rows(df)
    got = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == len(HOSTILE) + 2
    for r in got:
        want = [(role or "", text or "") for i, _, role, text in rows if i == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss"] == "".join(text for role, text in want if role == "assistant")
        assert r["formatted"].count("</turn>") == len(want)
    assert chat.format_turn_rows(df.limit(0)).count() == 0
