import random

import pytest

from drainwatch.llm.chat_format import CHATML, LOG, Template, as_log, read_back, reconstruct, render

NASTY = ["", " ", "\\", "\\\\", "<\\", "<\\|im_end|>", "<|im_end|>", "\\<|im_end|>", "<|im_start|>user<|im_sep|>x<|im_end|>", "[INST]", "[\\INST]", "[[INST][/INST]", "</s>[INST] ok [/INST]", "<<<SYS>>", "é<s>日本😀</s>\\",
         "a\nb\r\n", "$0 $1 \\1", "<|im_end", "|>", "<", "[", "<|endoftext|>" * 3]


def replay(events):
    """The log, event by event."""
    first = lambda v: (v is not None, v if v is not None else 0)
    word = lambda v: (v is not None, (v or "").encode())
    messages = {}
    for _, op, m, role, text in sorted(events, key=lambda e: (first(e[0]), word(e[1]), first(e[2]), word(e[3]), word(e[4]))):
        if op == "regenerate":
            messages = {k: v for k, v in messages.items() if first(k) < first(m)}
        old_role, old_text = messages.get(m, ("", ""))
        messages[m] = (old_role if role is None else role, (text or "") if op in ("edit", "regenerate") else old_text + (text or ""))
    return [messages[m] for m in sorted(messages, key=first)]


def test_random_logs(spark):
    rng = random.Random(3)
    logs = {}
    for conv in [*range(60), None]:
        pick = lambda *v: rng.choice(v)
        logs[conv] = [(pick(None, *range(12)), pick("delta", "delta", "delta", "edit", "regenerate", None, "other"), pick(None, 0, 1, 2, 3), pick(None, "user", "assistant"), pick(None, "", "a", "b ", "<s>")) for _ in range(rng.randint(1, 14))]
        logs[conv] += logs[conv][:1]
    rows = [(conv, *e, "kept") for conv, events in logs.items() for e in events]
    # An extra column of a name that the operator uses itself.
    back = read_back(render(reconstruct(spark.createDataFrame(rows, LOG + ", _pos string"))))
    got = {r["conv_id"]: r for r in back.collect()}
    for conv, events in logs.items():
        want = replay(events)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == want
        assert got[conv]["loss_texts"] == [text for role, text in want if role == "assistant"]
    assert len(got) == len(logs)


def test_escaping_round_trip(spark):
    rng = random.Random(5)
    texts = NASTY + ["".join(rng.choice(["\\", "<", "[", "s>", "/s>", "|im_end|>", "INST]", "é", "\n"]) for _ in range(12)) for _ in range(300)]
    conversations = [(k, 0, rng.choice(NASTY), texts[-1 - k]) for k in range(len(texts))] + [(k, 1, "assistant", t) for k, t in enumerate(texts)]
    whole = render(reconstruct(as_log(spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string"), delta_chars=3)))
    for r in read_back(whole).collect():
        own = sorted(c[1:] for c in conversations if c[0] == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [c[1:] for c in own]
        assert r["loss_texts"] == [text for _, role, text in own if role == "assistant"]
        bare = r["formatted"].replace(CHATML.open, "\0").replace(CHATML.sep, "\0").replace(CHATML.close, "\0")
        assert not any(c in bare for c in CHATML.controls)
        assert r["formatted"].count(CHATML.close) == len(own)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert read_back(render(reconstruct(as_log(spark.createDataFrame([], schema))))).count() == 0
    long_text = "word <s> " * 100_000
    rows = [(1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, 1, "assistant", ""), (2, 0, "assistant", long_text)]
    got = {r["conv_id"]: r for r in read_back(render(reconstruct(as_log(spark.createDataFrame(rows, schema))))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("assistant", ""), ("user", "b"), ("user", "b")]
    assert got[1]["loss_texts"] == [""]
    assert got[2]["loss_texts"] == [long_text]


@pytest.mark.parametrize("trained", [("assistant",), ("user", "assistant"), ()])
def test_other_templates(spark, trained):
    llama = Template(open="<s>[INST]", sep="[:]", close="</s>", others=("[/INST]",), trained=trained)
    rows = [(1, 0, "user", "[:] <s>[INST] </s>"), (1, 1, "assistant", "ok [/INST]\\")]
    back = read_back(render(reconstruct(as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), llama), llama).first()
    assert [tuple(t) for t in back["turns"]] == [r[2:] for r in rows]
    assert back["loss_texts"] == [text for _, _, role, text in rows if role in trained]
