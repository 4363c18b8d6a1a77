import random
from hashlib import sha256

from pyspark.sql import functions as F

from logweave.llm.chat_format import BUDGET, HISTORY, HISTORY_TURNS, MARKS, PART, PROBE, digests, escape, unescape, windows, with_probe

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return out


def rows():
    out = []
    odd = ["", None, PROBE, "\\l\\h\\\\", "<0><1>", "</turn>\n### user: x", "é😀\r\n\t", "\\", "a" * 9000, "w " * 5000]
    for i, x in enumerate(odd):
        out += [(i, 0, "user", x), (i, 1, "assistant", x)]
    for i in range(300):
        out.append((50, i, "system" if not i else ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i * 7 % 120)))
    out += [(60, 3, "assistant", "same"), (60, 3, "assistant", "same"), (60, 3, None, "x"), (60, None, "ro: le#<", "y"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    return out


def test_reads_back_whole(spark):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == expected(rows())


def test_windows(spark):
    ws = windows(spark.createDataFrame(rows(), SCHEMA)).where("conv_id = 50").orderBy("window").collect()
    assert len(ws) > 5
    assert all(w.formatted.startswith("### system: turn 0") for w in ws)
    assert all(w.tokens <= BUDGET and not w.over_budget for w in ws)
    assert all(1 <= w.context_turns <= 3 for w in ws[1:])
    assert any(w.context_turns > 1 for w in ws[1:])
    for w in ws:
        for s in w.loss:
            assert w.formatted[s.start + s.length :].startswith("</turn>\n")


def test_probe_and_edges(spark):
    empty = spark.createDataFrame([], SCHEMA + ", nr int, window string")
    assert digests(empty).count() == 0
    one = {r.conv_id: r for r in digests(with_probe(empty)).collect()}[-7]
    assert (one.n_turns, one.loss_chars) == (2, len(PROBE))
    df = spark.createDataFrame([("\\l<#\\\\h",)], "t string")
    assert df.select(unescape(escape(F.col("t")))).first()[0] == "\\l<#\\\\h"
    clash = spark.createDataFrame([(1, 0, "assistant", "a", 7, 8, 9)], SCHEMA + ", tokens int, before int, conv int")
    assert digests(clash).count() == 1


def plain(turns, budget, history, history_turns):
    """Windows of one conversation, turn after turn: (first own turn, own turns, repeated turns, tokens)."""
    tokens = [len(x.split()) + MARKS for _, x in turns]
    system = tokens[0] if turns[0][0] == "system" else 0
    out, begin = [], 0
    for i in range(1, len(turns) + 1):
        room = budget if begin == 0 else budget - history - system
        if i < len(turns) and i % PART and sum(tokens[begin : i + 1]) <= room:
            continue
        back = 0
        while begin and back < min(history_turns, begin) and sum(tokens[begin - back - 1 : begin]) <= history:
            back += 1
        # history ends where the window before it begins, and never holds the system turn
        back = min(back, begin - out[-1][0] if out else 0, begin - bool(system) if begin else 0)
        lead = bool(system and begin)
        out.append((begin, i - begin, back + lead, sum(tokens[begin - back : i]) + lead * system))
        begin = i
    return out


def test_windows_are_as_full_as_whole_turns_let_them_be(spark):
    rng = random.Random(4)
    convs = {
        1: [("user", "w " * 40)] * 2000,
        2: [("system", "s " * 900)] + [("assistant", "w " * rng.randrange(300)) for _ in range(700)],
        3: [("user", "w " * rng.choice([1, 5, 900, 1500, 2044, 2500])) for _ in range(150)],
        4: [("system", "s " * 3000), ("user", "x"), ("assistant", "y")],
        5: [("assistant", "one")],
    }
    rows = [(c, i, r, x) for c, turns in convs.items() for i, (r, x) in enumerate(turns)]
    got = windows(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "window").collect()
    for c, turns in convs.items():
        mine = [(w.window, w.turns - w.context_turns, w.context_turns, w.tokens) for w in got if w.conv_id == c]
        assert mine == plain(turns, BUDGET, HISTORY, HISTORY_TURNS)
    full = [w.tokens for w in got if w.conv_id == 1]
    assert sum(full) / len(full) > 0.85 * BUDGET
    assert max(full) <= BUDGET
    for w in got:
        long = w.conv_id == 4 or w.conv_id == 3 and "w " * 1700 in w.formatted
        assert w.over_budget == (w.tokens > BUDGET)
        assert long or not w.over_budget
