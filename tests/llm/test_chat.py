"""Conversations from event logs against a direct fold, and the template against a direct reading."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from rampfield.llm.chat import KINDS, digests, event_log, folded, read_back, rendered

LOG = "conv_id bigint, turn bigint, message string, seq bigint, kind string, role string, text string"
TURNS = "conv_id bigint, turn bigint, role string, text string"
AWKWARD = [
    "\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y", "\\h\\b\\e\\c", "######", "##", "</turn", ">\n", "\\", "\\\\###", "",
    "é😀" * 300, "a: b", ": ", "</turn></turn>", "###: </turn>\n", "\n\n", "x" * 5000,
]


def direct_fold(events):
    """One event after the other."""
    lists = {}
    for conv, turn, message, seq, kind, role, text in events:
        lists.setdefault((conv, turn, message), []).append((seq, kind, text, role))
    low = lambda x: (x is not None, x if x is not None else 0)
    word = lambda x: (x is not None, x or "")
    out = set()
    for key, own in lists.items():
        own.sort(key=lambda e: (low(e[0]), word(e[1]), word(e[2]), word(e[3])))
        text, named, opened, alive, known = "", None, False, True, False
        for _, kind, piece, role in own:
            if kind not in KINDS:
                continue
            known = True
            if kind == "open":
                text, named, opened, alive = "", role, True, True
            elif kind == "delta":
                text += piece or ""
            elif kind == "edit":
                text = piece or ""
            elif kind == "regenerate":
                text = ""
            else:
                alive = False
            if not opened and named is None:
                named = role
        if known and alive:
            out.add((*key, named, text))
    return out


def test_fold_equals_one_event_at_a_time(spark):
    rng = random.Random(3)
    events = [
        (rng.choice([1, 2, None]), rng.choice([0, 1, None]), rng.choice("ab"), rng.choice([*range(9), None]),
         rng.choice([*KINDS, *KINDS, "delta", "delta", None, "odd"]), rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", "", None]))
        for _ in range(160)
    ]
    got = folded(spark.createDataFrame(events, LOG)).collect()
    assert {tuple(r) for r in got} == direct_fold(events) and len(got) == len({tuple(r)[:3] for r in got})


@pytest.mark.parametrize("span", [1, 3, 64])
def test_texts_roles_and_mask_come_back(spark, span):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(AWKWARD)]
    rows += [(2, k, r, "t" + r) for k, r in enumerate(["a: b", "a:", "###", "\\c", "</turn>", "", "assistant", ": : "])]
    rows += [(3, 0, None, None), (None, None, "assistant", "no number"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit(1) for n in ("message", "seq", "kind", "p", "own", "part")})
    parts = rendered(folded(event_log(turns, piece=7)), span=span)
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", sha256((x or "").encode()).hexdigest(), x or ""))
    want = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in want.items()}
    order = lambda r: (r["part"] is not None, r["part"] or 0)
    read, text, learned = {}, {}, {}
    for r in sorted(read_back(parts).collect(), key=order):
        read.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
        learned.setdefault(r["conv_id"], []).extend(r["learned"])
    for r in sorted(parts.collect(), key=order):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["formatted"]
    assert read == want
    assert learned == {c: [x for r, x in v if r == "assistant"] for c, v in want.items()}
    # a direct reading of the text, without the library
    for c, whole in text.items():
        assert [m for m in re.findall(r"### (?:.|\n)*?</turn>\n", whole)] and whole.count("###") == whole.count("</turn>") == len(want[c])
    sums = {r["conv_id"]: r for r in digests(parts).collect()}
    for c, v in want.items():
        own = "".join(x for r, x in v if r == "assistant")
        assert sums[c]["n_turns"] == len(v) and sums[c]["loss_chars"] == len(own) and sums[c]["formatted_chars"] == len(text[c])
        assert sums[c]["turns_sha256"] == sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest()
        assert sums[c]["loss_sha256"] == sha256(own.encode()).hexdigest()


def test_log_needs_its_fold(spark):
    """Deltas alone would give other texts: drafts before a regeneration, pieces before an edit."""
    rows = [(1, 0, "user", "question of some length"), (1, 1, "assistant", "answer of some length")]
    log = event_log(spark.createDataFrame(rows, TURNS), piece=4)
    deltas = {r["turn"]: "".join(e["text"] for e in sorted(r["e"])) for r in log.filter("kind = 'delta'").groupBy("turn").agg(
        F.collect_list(F.struct("seq", "text")).alias("e")).collect()}
    assert deltas[0] != rows[0][3] and deltas[1] != rows[1][3]
    assert {(r["turn"], r["text"]) for r in folded(log).collect()} == {(0, rows[0][3]), (1, rows[1][3])}


def test_empty_table_and_no_python(spark):
    turns = spark.createDataFrame([], TURNS)
    out = digests(rendered(folded(event_log(turns))))
    assert out.collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
