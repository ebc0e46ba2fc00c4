"""Chat formatting read back exactly, whatever the texts say."""

from pyspark.sql import functions as F

from gondola.llm import chat

ROWS = [
    (1, 0, "system", "be <|end|> kind"),
    (1, 1, "user", "hi \\ there"),
    (1, 1, "user", "hi \\ there"),
    (1, 2, "user", None),
    (1, 3, "assistant", "<|turn|>user<|text|> \\| é😀"),
    (1, 4, "assistant", ""),
    (1, 5, "assistant", "x<"),
    (1, 6, "user", "|y"),
    (2, None, None, "no role, no turn"),
    (2, 0, "assistant", "\\### Assistant: </turn> ok"),
    (None, 0, "user", "null id"),
    (3, 0, "assis<|text|>tant", "odd role"),
    (4, 0, "assistant", "z" * 300_000),
]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    made = chat.format_conversations(df.repartition(4)).cache()
    got = {
        r.conv_id: r
        for r in made.select(
            "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")
        ).collect()
    }
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].learned == "".join(r[3] or "" for r in own if r[2] == "assistant")
        blocks = 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:], strict=False))
        assert got[conv].formatted.count(chat.TURN) == blocks == got[conv].formatted.count(chat.END)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_very_many_turns(spark):
    n = 60_000
    rows = spark.range(n).selectExpr(
        "1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('é<|', id) AS text"
    )
    made = chat.format_conversations(rows)
    got = made.select(
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"), F.size(chat.read_turns(F.col("formatted"))).alias("turns")
    ).first()
    assert got.turns == n
    assert got.learned == "".join(f"é<|{i}" for i in range(1, n, 2))
