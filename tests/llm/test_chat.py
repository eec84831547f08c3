import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import chat
from quire.llm.queries import q_chat

SCHEMA = "conv_id long, turn long, role string, text string, n_turns int, block string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "own") for r in rows], SCHEMA)


def n_tokens(text):
    return sum(-(-len(w) // 6) for w in re.findall(r"[^\W_]+", text)) + len(re.findall(r"[^\w\s]|_", text))


def ordered(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def plan(turns, budget, history, history_turns, block):
    """(with_system, h, s, e) of every window by one walk over all turns."""
    size = [n_tokens(x) + chat.MARK_TOKENS for _, x in turns]
    at = [sum(size[:i]) for i in range(len(size) + 1)]
    system = turns[0][0] == "system"
    out = []
    for i in range(len(turns)):
        new_block = i == 0 or at[i] // (block * budget) != at[i - 1] // (block * budget)
        if not new_block:
            beside, h, s = out[-1]
            if at[i + 1] - at[h] + (size[0] if beside else 0) <= budget:
                continue
        beside = system and i > 0
        base = size[0] if beside else 0
        low = 1 if system else 0
        h = i
        while h - 1 >= low and h - 1 >= i - history_turns and at[i] - at[h - 1] <= history and at[i + 1] - at[h - 1] + base <= budget:
            h -= 1
        out.append((beside, h, i))
    return [(b, h, s, e) for (b, h, s), e in zip(out, [s for _, _, s in out[1:]] + [len(turns)])]


def talks(long=400):
    rng = random.Random(4)
    marks = [m for p in chat.MARKS.values() for m in p] + list(chat.OTHER) + ["\\", "<\\s>", "[\\\\INST]", "<<\\SYS>>", "<", "[", "<<s>", "\n", "é", "𝔸"]
    words = "alpha beta gamma delta to be or not".split()
    say = lambda n: "".join(rng.choice(marks) if rng.random() < 0.2 else rng.choice(words) + " " for _ in range(n))
    rows = []
    for c in range(30):
        if c % 3 == 0:
            rows.append((c, 0, "system", say(rng.randint(0, 12))))
        for t in range(1, rng.randint(1, 30)):
            rows.append((c, t, ["user", "assistant"][t % 2] if rng.random() < 0.9 else rng.choice(["tool", "system", "ro<s>le[", "[TEXT]"]), say(rng.randint(0, 25))))
    for t in range(long):
        rows.append((100, t, "system" if t == 0 else ["user", "assistant"][t % 2], say(rng.randint(0, 9))))
    rows += [(101, 0, "user", say(4000)), (101, 1, "assistant", "yes"), (101, 2, "user", say(900)), (101, 3, "assistant", say(3000))]
    rows += [(102, None, None, None), (102, None, "assistant", None), (102, 3, "assistant", ""), (102, 3, "assistant", ""), (102, 3, "user", "tie"), (102, 3, "user", "tie")]
    rows += [(None, 1, "assistant", "no id"), (None, None, "user", "first"), (103, 0, "assistant", "x" * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("budget,history,turns,block", [(60, 20, 3, 4), (100, 0, 0, 2), (40, 40, 9, 1), (2048, 512, 4, 64)])
def test_windows_match_one_walk(spark, monkeypatch, budget, history, turns, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = talks()
    got = {}
    out = chat.format_windows(table(spark, rows), budget, history, turns)
    out = out.withColumn("said", chat.read_turns(F.col("text"))).withColumn("lost", chat.read_loss(F.col("text"), F.col("loss")))
    for r in out.collect():
        got.setdefault(r["conv_id"], []).append(r)
    want = ordered(rows)
    assert set(got) == set(want)
    for c, said in want.items():
        windows = sorted(got[c], key=lambda r: (r["block"], r["nth"]))
        expected = plan(said, budget, history, turns, block)
        assert len(windows) == len(expected)
        for r, (beside, h, s, e) in zip(windows, expected):
            shown = ([said[0]] if beside else []) + said[h:e]
            assert [tuple(x) for x in r["said"]] == shown
            assert r["n_turns"] == len(shown) and r["n_repeated"] == len(shown) - (e - s)
            assert r["lost"] == [x for role, x in said[s:e] if role == "assistant"]
            assert r["n_tokens"] == sum(n_tokens(x) + chat.MARK_TOKENS for _, x in shown)
            assert r["n_tokens"] <= budget or (h == s and e == s + 1)


def test_escaping_is_reversible_and_leaves_no_mark(spark):
    marks = [m for p in chat.MARKS.values() for m in p] + list(chat.OTHER)
    rng = random.Random(1)
    texts = marks + ["<\\" + m[1:] for m in marks] + ["".join(rng.choice(["<", "[", "\\", "s>", "/s>", "INST]", "<SYS>>", "TEXT]", "$1"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(m in r["e"] for m in marks)


def test_query_reads_everything_back(spark, tmp_path):
    rows = talks(60)
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in q_chat(spark, str(tmp_path)).collect()}
    want = ordered(rows)
    want[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(want)
    for c, said in want.items():
        r, lost = got[c], "".join(x for role, x in said if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(lost), sha(lost))
        assert r["formatted_chars"] >= sum(len(x) for _, x in said)


def test_empty_table(spark):
    assert chat.read_back(chat.format_windows(table(spark, []))).count() == 0
