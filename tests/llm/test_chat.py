"""Chat windows: exact round trip, windows and masks against a plain version."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeflow.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def tokens(text):
    return len(re.findall(r"[A-Za-z0-9]{1,6}|[^A-Za-z0-9\x20\x09-\x0D]", text)) + 3


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def conversations(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(own, key=key)] for c, own in found.items()}


def plain_windows(turns, budget, history):
    """[(repeated turns, own turns)] of a conversation."""
    lead = turns[:1] if turns[0][0] == "system" else []
    room = max(1, budget - history - sum(tokens(t) for _, t in lead))
    at, cells, placed = 0, {}, []
    for role, text in turns[len(lead):]:
        n = tokens(text)
        first = cells.setdefault(at // room, at)
        placed.append((at, at if at + n - first > room and at > first else first, (role, text)))
        at += n
    windows = []
    for w in sorted({w for _, w, _ in placed} | ({0} if lead else set())):
        again = (lead if w else []) + [t for s, _, t in placed if w - history <= s < w]
        windows.append((again, (lead if not w else []) + [t for _, x, t in placed if x == w]))
    return windows


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    bits = ["word", " ", "<|end|>", "<|", "|>", "\\", "<\\|user|>", "<\\\\|", "\n", "é", "漢字", "x" * 40, "</turn>", "### User:", "$1"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
    found = []
    for conv in range(40):
        lead = rnd.random() < 0.5
        for turn in range(rnd.randint(1, 30)):
            role = "system" if lead and not turn else rnd.choice(["user", "assistant", "assistant", "tool|> <", "system", None, ""])
            found.append((conv, turn, role, rnd.choice([None, text(), text()])))
    found += [(50, 0, "assistant", "same")] * 3 + [(50, 0, "assistant", "other"), (50, None, "user", "first")]
    found += [(None, 1, "user", "nobody's"), (None, 2, "assistant", "answer"), (51, 0, "system", "only a system turn"), (52, 0, "system", "s " * 2000), (52, 1, "assistant", "a")]
    found += [(53, k, "assistant" if k % 2 else "user", f"turn {k} " * (k % 9)) for k in range(2000)]
    found += [(54, 0, "user", "<" * 100_000 + "\\" * 100_000), (54, 1, "assistant", "long " * 300_000)]
    rnd.shuffle(found)
    return found


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (60, 20), (10, 0)])
def test_windows_equal_plain_version(spark, rows, budget, history):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", start int, window string")
    got = chat.format_windows(turns, budget, history).withColumns({"turns": chat.read_turns(F.col("formatted")), "targets": chat.read_targets(F.col("formatted"), F.col("loss"))}).collect()
    by_conv = {}
    for r in sorted(got, key=lambda r: r.window):
        pairs = [(t.role, t.text) for t in r.turns]
        by_conv.setdefault(r.conv_id, []).append((pairs[: r.n_repeated], pairs[r.n_repeated :]))
        assert r.targets == [t for role, t in pairs[r.n_repeated :] if role == "assistant"]
        assert r.n_tokens == sum(tokens(t) for _, t in pairs) and r.over_budget == (r.n_tokens > budget)
    assert by_conv == {c: plain_windows(t, budget, history) for c, t in conversations(rows).items()}
    # only a turn that breaks the budget alone, with what is repeated beside it, may do so
    lead = lambda r: r.turns[0].role == "system"
    assert all(len(r.turns) - r.n_repeated <= 1 + lead(r) for r in got if r.over_budget)


def test_digest_reads_everything_back(spark, rows):
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(chat.format_windows(spark.createDataFrame(rows, TURNS), 100, 30)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, turns in conversations(rows).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned))
    assert got == want


def test_empty_table(spark):
    assert chat.digest(chat.format_windows(spark.createDataFrame([], TURNS))).collect() == []


def test_one_exchange_and_no_python(spark, rows):
    plan = chat.digest(chat.format_windows(spark.createDataFrame(rows, TURNS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("<|\\>a\n$"), max_size=12), min_size=1, max_size=30))
def test_escapes_are_reversible(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escape(F.col("text")).alias("safe"))
    for r in rows.withColumn("back", chat.unescape(F.col("safe"))).collect():
        assert r.back == r.text and "<|" not in r.safe
