"""Chat windows against a plain reading of the conversations: whole turns back, budgets kept, each target once."""

import collections
import hashlib
import random

import pytest

from tickloom.llm import bpe, chat

SHAPE = "conv_id long, turn long, role string, text string, stretch string"
ODD = ["", "##", "### Assistant:\n", "</turn>\n", "</turn", "<|endoftext|>", "\\", "\\n", "a\\", "#", "<", "####", "é😀\n\n", r"\### Assistant: </turn> ok", "### user:\nx</turn>\n"]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), None]:
        n = rng.randint(1, 30)
        for k in range(n):
            role = "system" if k == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "tool: x\n", None, "system"] if rng.random() < 0.1 else ["user", "assistant"])
            text = None if rng.random() < 0.05 else rng.choice(ODD) + " ".join("".join(rng.choices("etaoinshr#<|", k=5)) for _ in range(rng.choice([0, 3, 20, 90]))) + rng.choice(ODD)
            rows.append((c, None if rng.random() < 0.03 else k - 2, role, text, "taken"))
    rows += [(50, 1, "user", "same", "x")] * 3 + [(51, k, "assistant", "word " * 400, "x") for k in range(4)] + [(52, 0, "system", "rule " * 200, "x")] + [(52, k, "user", "hi", "x") for k in range(1, 5)]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text, _ in rows:
        out[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize("text", [*ODD, *(a + b for a in ODD for b in ODD)])
def test_turns_read_back(text):
    written = chat.written_turn("user", text) + chat.written_turn(text, text) + chat.written_turn("", "")
    assert [(r, t) for r, t, _, _ in chat.read_turns(written)] == [("user", text), (text, text), ("", "")]
    assert "##" not in chat.escape(text) and "</turn>" not in chat.escape(text) and "<|" not in chat.escape(text)


@pytest.mark.parametrize("budget,history,stretch,hot", [(300, 80, 1024, 16384), (300, 0, 1024, 16384), (120, 60, 5, 16384), (300, 80, 6, 7), (2048, 512, 1024, 1)])
def test_windows(spark, budget, history, stretch, hot):
    rows = conversations()
    df = spark.createDataFrame(rows, SHAPE)
    got = chat.chat_windows(df, budget=budget, history=history, stretch=stretch, hot_rows=hot).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    tok = bpe.tokenizer(None)
    want = in_order(rows)
    assert set(by) == set(want)
    for c, windows in by.items():
        windows.sort(key=lambda r: (r.stretch, r.window))
        all_turns = want[c]
        new, seen, targets = [], None, []
        for w in windows:
            turns = [(r, t) for r, t, _, _ in chat.read_turns(w.text)]
            assert len(turns) == w.n_turns > w.n_repeated
            assert w.n_tokens == len(tok.encode(w.text, add_special_tokens=False).ids)
            fresh = turns[w.n_repeated :]
            system = next(((r, t) for r, t in new if r == "system"), None)
            cost = lambda x: len(tok.encode(chat.written_turn(*x), add_special_tokens=False).ids)
            kept = system is not None and 2 * cost(system) <= budget
            if kept:
                assert turns[0] == system
            old = turns[int(kept) : w.n_repeated]
            assert old == new[len(new) - len(old) :] and sum(map(cost, old)) <= history
            assert w.n_tokens <= budget or (len(fresh) == 1 and not old)
            new += fresh
            targets += [chat.unescape(w.text[s.a : s.b]) for s in w.loss]
        assert new == all_turns
        assert targets == [t for r, t in all_turns if r == "assistant"]
    hot_or_not = chat.chat_windows(df, budget=budget, history=history, stretch=stretch).collect()
    assert sorted(map(str, got)) == sorted(map(str, hot_or_not))


@pytest.mark.parametrize("hot", [4, 16384])
def test_digests(spark, hot):
    rows = conversations(8)
    got = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(rows, SHAPE), budget=200, history=50, stretch=8, hot_rows=hot).collect()}
    want = in_order(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_conversations_are_cut_while_they_come(spark):
    rows = [(1, k, "system" if k == 0 else "user" if k % 2 else "assistant", f"turn {k}", "x") for k in range(5000)]
    df = spark.createDataFrame(rows, SHAPE)
    one = chat.chat_windows(df, stretch=10_000)
    assert max(r.n_tokens for r in one.collect()) <= 2048
    new = [t[1] for w in sorted(one.collect(), key=lambda r: (r.stretch, r.window)) for t in chat.read_turns(w.text)[w.n_repeated :]]
    assert new == [f"turn {k}" for k in range(5000)]
    spread = chat.chat_windows(df, stretch=500, hot_rows=100)
    assert sorted(map(str, spread.collect())) == sorted(map(str, chat.chat_windows(df, stretch=500).collect()))


def test_no_rows_and_a_huge_turn(spark):
    assert chat.chat_windows(spark.createDataFrame([], SHAPE)).collect() == [] and chat.conversation_digests(spark.createDataFrame([], SHAPE)).collect() == []
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "long " * 50_000, "x"), (1, 2, "user", "bye", "x")]
    got = sorted(chat.chat_windows(spark.createDataFrame(rows, SHAPE)).collect(), key=lambda r: r.window)
    assert [(w.n_turns - w.n_repeated, w.n_tokens > 2048) for w in got] == [(1, False), (1, True), (1, False)]
