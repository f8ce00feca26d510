"""Windows against a plain walk over the turns."""

import hashlib
import random

from cellgrove.llm import chat

HARD = [r"\### Assistant: </turn> ok", "\\", "\\\\", "### * user: x</turn>\n", "", None, "a\nb", "é" * 9000, "# < : *", "one two three " * 100]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def conversations(seed=4):
    rng, rows = random.Random(seed), []
    for c in range(40):
        first = rng.random() < 0.4
        for t in range(rng.choice([1, 2, 3, 8, 60])):
            role = "system" if first and t == 0 else rng.choice(["user", "assistant", "assistant", "tool: *#<\\"])
            rows.append((c, t, role, rng.choice(HARD) if rng.random() < 0.5 else "w " * rng.randrange(300)))
    return [*rows, (None, 0, "user", "x"), (None, None, None, None), (3, 0, "user", "twice"), (3, 0, "user", "twice")]


def test_round_trip_and_mask(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, window string")
    got = {r.conv_id: r for r in chat.report(df).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss))


def test_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("user", "assistant")[t % 2 == 0], "w " * (20 if t % 7 else 30)) for t in range(1, 200)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=100, history=45).orderBy("window").collect()
    assert len(out) > 10
    for n, w in enumerate(out):
        turns = w.formatted.split("</turn>\n")[:-1]
        assert turns[0].endswith("system: be kind") and turns[0].startswith("### * ") == (n > 0)
        repeated = [t for t in turns[1:] if t.startswith("### * ")]
        assert n == 0 or 1 <= len(repeated) <= chat.HISTORY_TURNS
        assert sum(len(t.split(": ")[1].split()) for t in turns) <= 100
        assert len(w.loss) == sum(t.startswith("### assistant") for t in turns)


def test_budget_counts_a_long_system_turn(spark):
    turns = [(1, 0, "system", "s " * 400)] + [(1, t, ("user", "assistant")[t % 2 == 0], "w " * 60) for t in range(1, 41)]
    turns += [(2, 0, "system", "s " * 90), (2, 1, "user", "w " * 30), (2, 2, "assistant", "w " * 600), (2, 3, "user", "w " * 30)]
    turns += [(3, 0, "system", "s " * 600), (3, 1, "user", ""), (3, 2, "assistant", "w")]
    rng = random.Random(6)
    turns += [(4, t, "user", "w " * rng.randrange(0, 200)) for t in range(300)]
    out = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    size = lambda t: len(t.split(": ", 1)[1].split())
    filled = []
    for w in out:
        turns = w.formatted.split("</turn>\n")[:-1]
        own = [t for t in turns if not t.startswith("### * ")]
        total, system = sum(map(size, turns)), size(turns[0]) if "system: " in turns[0] else 0
        assert total <= chat.BUDGET or (sum(size(t) > 0 for t in own) == 1 and total <= system + max(map(size, own))), (w.conv_id, w.window, total)
        filled += [sum(map(size, own))] if w.conv_id == 4 else []
    assert sum(filled) / len(filled) > 0.5 * (chat.BUDGET - chat.HISTORY)


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.report(empty).count() == 0
