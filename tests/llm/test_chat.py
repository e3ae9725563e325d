import hashlib

import pytest
from pyspark.sql import functions as F

from codelode.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


ROWS = [
    (-7, 0, "user", "</s>[INST] ok [/INST]", "x"), (-7, 1, "assistant", "</s>[INST] ok [/INST]", "x"),
    (1, 0, "system", "be & brief &amp; <s>", None), (1, 1, "user", None, None), (1, 2, "assistant", "", None),
    (1, 3, "assistant", "a&lt;s>b [CTX] 𝄞 [/INST]", None), (1, 3, "assistant", "a&lt;s>b [CTX] 𝄞 [/INST]", None),
    (2, None, None, "lost turn", None), (2, 5, "tool[/INST]", "[INST", None), (2, 6, "assistant", "</s" * 3, None),
    (None, 0, "assistant", "no id", None),
] + [(3, i, "system" if i == 4 else ("assistant" if i % 2 else "user"), f"turn {i} " + "word " * (i % 90), None) for i in range(200)] + [
    (4, 0, "user", "w " * 5000, None), (4, 1, "assistant", "v " * 6000, None), (4, 2, "user", "short", None),
]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_windows(df)).collect()}
    assert got == expected(ROWS)


def test_windows(spark):
    df = spark.createDataFrame([r for r in ROWS if r[0] == 3], SCHEMA)
    rows = chat.format_windows(df, budget=300, history=80).orderBy("window").collect()
    assert [r.window for r in rows] == list(range(len(rows))) and len(rows) > 10
    system = next(r.window for r in rows if "<s>[INST]system" in r.text)
    for r in rows:
        assert r.tokens <= 300 and r.repeated == r.text.count("<s>[CTX]")
        assert r.text.startswith("<s>[CTX]system") == (r.window != system)
        assert all(r.text[x.stop:x.stop + 4] == "</s>" for x in r.loss)
        assert len(r.loss) == r.text.count("<s>[INST]assistant")
    assert any(r.repeated > 1 for r in rows)


def test_empty_table(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("text", ["&lt;s>", "<s><s>", "[/INST][CTX]", "&amp;#91;INST]", "<</s>"])
def test_escape(spark, text):
    row = spark.range(1).select(chat.escape(F.lit(text)).alias("a")).select("a", chat.unescape(F.col("a")).alias("b")).first()
    assert row.b == text and not any(c in row.a for c in ("<s>", "</s>", "[INST]", "[/INST]", "[CTX]"))
