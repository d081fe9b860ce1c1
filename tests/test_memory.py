"""Memory upsert and conversation windows."""

from churnlens.operators import memory


def test_upsert_latest(spark):
    log = spark.createDataFrame([("k", "v1", "2024-01-01 00:00:00"), ("k", "v2", "2024-01-02 00:00:00"),
                                 ("j", "x", "2024-01-01 00:00:00")], "key string, value string, updated_at string")
    got = {r.key: r.value for r in memory.upsert_latest(log).collect()}
    assert got == {"k": "v2", "j": "x"}


def test_windows_and_summary(spark):
    conv = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(10)],
                                 "conv_id long, turn long, role string, text string")
    w = memory.session_window(conv, 4).collect()
    assert sorted(r.turn for r in w) == [6, 7, 8, 9]
    p = memory.session_prompt_window(conv, 2).first()
    assert p.conversation == "user: m8\nassistant: m9"
    s = memory.session_summary(conv).first()
    assert s.value == "questions=5; last_question=m8"
