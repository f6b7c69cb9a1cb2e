import random

from tallyweave.llm import chat_events


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, message_id long, role string, payload string, last string, chat string")


def fold(log):
    """One conversation, event by event."""
    order, state, gone = [], {}, set()
    for seq, kind, message, role, payload in sorted(set(log), key=lambda e: (e[0], e[1] or "", e[4] or "")):
        if message not in state:
            state[message] = {"role": None, "content": "", "first": seq}
            order.append(message)
        m = state[message]
        m["role"] = m["role"] or role
        if kind == "delta":
            m["content"] += payload or ""
        elif kind == "edit":
            m["content"] = payload or ""
        elif kind == "regenerate":
            m["content"] = ""
            gone |= {x for x in order if m["first"] < state[x]["first"] < seq}
    kept = [m for m in order if m not in gone]
    return "".join(f"<|im_start|>{state[m]['role'] or 'unknown'}\n{state[m]['content']}<|im_end|>\n" for m in kept), len(kept), len(gone)


def test_against_a_fold(spark):
    r = random.Random(6)
    logs = {}
    for conv in range(60):
        log = []
        for seq in range(r.randrange(1, 30)):
            message = r.randrange(5)
            log.append((seq * 2, r.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "ping"]), message, f"role{message}", r.choice(["a", "b ", None, "c"])))
        logs[conv] = log
    rows = [(c, s, k, m, role, p, "x", "y") for c, log in logs.items() for s, k, m, role, p in log]
    r.shuffle(rows)
    got = {x["conv_id"]: (x["chat"], x["n_messages"], x["n_dropped"]) for x in chat_events.rendered(events(spark, rows + rows[:50])).collect()}
    assert got == {c: fold(log) for c, log in logs.items()}


def test_awkward(spark):
    rows = [(None, 1, "start", 1, "user", None), (1, None, "start", 1, "user", None), (1, 1, "start", None, "user", None), (2, 1, None, 1, None, None), (3, 5, "delta", 1, None, "late " * 30_000)]
    got = {x["conv_id"]: x["chat"] for x in chat_events.rendered(events(spark, [(*r, None, None) for r in rows])).collect()}
    assert got[2] == "<|im_start|>unknown\n<|im_end|>\n" and got[3].startswith("<|im_start|>unknown\nlate late") and set(got) == {2, 3}
    assert chat_events.rendered(events(spark, [])).count() == 0


def test_logs_end_in_their_turns(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} " * (t * 7)) for c in range(20) for t in range(4)] + [(50, 0, None, None)]
    log = chat_events.conversation_log(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {x["conv_id"]: x["chat"] for x in chat_events.rendered(log.repartition(5)).collect()}
    want = {}
    for c, _, role, text in turns:
        want[c] = want.get(c, "") + f"<|im_start|>{role or 'unknown'}\n{text or ''}<|im_end|>\n"
    assert got == want


def test_oracle_sql(spark):
    from tests.llm.helpers import same_as_sql

    assert same_as_sql(spark, "op8_chat_events")
