"""Ranked search against a direct scoring of every document, and its bounds."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampfield.llm import lexical
from rampfield.llm.lexical import Asked, bounds, counted, gain, length_norm, search, sliced, term_weight
from rampfield.llm.words import ALNUM, VISIBLE, U, word_hashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOW))


def direct(docs, queries, top=10):
    lists = [(i, words(t)) for i, t in docs]
    n = sum(bool(w) for _, w in lists)
    total = sum(len(w) for _, w in lists)
    df = {}
    for _, w in lists:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for q, t in queries:
        asked.setdefault(q, set()).update(words(t))
    out = set()
    for q, terms in asked.items():
        scored = []
        for i, w in lists:
            m = 10 + (90 * len(w) * n) // total if total else 0
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 8 * m))
                for t in terms if t in w
            )
            if s > 0:
                scored.append((-s, (i is not None, i if i is not None else 0), i))
        out |= {(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:top])}
    return out


def texts(rng, n, longest=60):
    vocabulary = [f"w{k}" for k in range(60)] + ["Ärger", "ÄRGER", "naïve", "日本", "x" * 700, "x" * 699 + "y"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randint(0, longest))).upper() if k % 3 else
            " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, longest))) for k in range(n)]


@pytest.mark.parametrize("round_terms", [200_000, 5])
def test_search_equals_scoring_every_document(spark, table, round_terms):
    rng = random.Random(1)
    docs = [(k, t) for k, t in enumerate(texts(rng, 500))]
    docs += [(1000, "w3 " * 4000 + "w59"), (1001, None), (1002, ""), (1003, " .!\n"), (None, docs[7][1])]
    docs += [(2000 + k, "w50 w51 w52 copied passage") for k in range(40)]
    queries = [(k, t) for k, t in enumerate(texts(rng, 12, 20))]
    queries += [(50, "copied passage w50"), (51, None), (52, "!!"), (53, "unknown term"), (54, "w1 w1 W1"), (54, "w2"), (55, "x" * 700)]
    asked = spark.createDataFrame(queries, "item_id bigint, text string").withColumn("query", F.lit(3))
    got = search(table(docs).repartition(7), asked, round_terms=round_terms)
    assert {(r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect()} == direct(docs, queries)


def test_repeated_rows_string_ids_and_ties(spark, table):
    docs = [("b", "one two"), ("a", "one two"), ("a", "one two"), ("c", "two one one"), ("d", "other")]
    asked = spark.createDataFrame([("q", "one two")], "item_id string, text string")
    got = search(table(docs, "string"), asked, top=2).collect()
    best = sorted(((r["rank"], r["id"]) for r in got))
    assert [r for r, _ in best] == [1, 2] and len({r["score"] for r in got}) in (1, 2)
    full = search(table(docs, "string"), asked).collect()
    assert sorted(r["id"] for r in full) == ["a", "a", "b", "c"] and sorted(r["rank"] for r in full) == [1, 2, 3, 4]


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    for docs, asked in ((table([]), some), (table([(1, "word")]), none), (table([(1, None), (2, "!")]), some)):
        assert search(docs, asked).collect() == []


def test_sums_are_never_below_scores(monkeypatch):
    """With few bits, so that false presences are common."""
    monkeypatch.setattr(lexical, "BITS", 2)
    rng = random.Random(5)
    lists = [words(t) for t in texts(rng, 200, 300)]
    lists = sorted((w for w in lists if w), key=len)
    raw = [" ".join(w).encode() for w in lists]
    h, n = word_hashes(raw, ALNUM)
    bits, slices = sliced(*counted(h, n), len(lists))
    terms = sorted({t for w in lists for t in w})[:50]
    docs, total = len(lists), sum(map(len, lists))
    weights = np.array([term_weight(sum(t in w for w in lists), docs) for t in terms])
    of = np.array([k for q in range(20) for k in range(q, q + 5)])
    asked = Asked([t.encode() for t in terms], word_hashes([t.encode() for t in terms], ALNUM)[0], weights, of, np.arange(21) * 5, docs, total)
    got = bounds({"sizes": n, "bits": bits, "slices": slices}, asked)
    loose = 0
    for q in range(20):
        for d, w in enumerate(lists):
            m = length_norm(len(w), docs, total)
            score = sum(int(weights[k]) * gain(w.count(terms[k]), m) for k in of[q * 5 : q * 5 + 5] if terms[k] in w)
            assert got[q, d] >= score
            loose += got[q, d] > score
    assert loose


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    raw = ["".join(rng.choices("abAB01 \t.é\n", k=rng.randint(0, 900))) for _ in range(300)] + ["a" * 511, "a" * 512, "a" * 513, "a" * 513 + "b", "x" * 3_000_000, ""]
    a, b = "a", "b"
    for _ in range(9):
        a, b = a + b, b + a
    raw += [a, b]
    for alphabet, pattern in ((ALNUM, TERM), (VISIBLE, re.compile(r"[^\x20\x09-\x0D]+"))):
        lists = [pattern.findall(t.translate(LOW)) for t in raw]
        h, n = word_hashes([t.encode() for t in raw], alphabet)
        assert n.tolist() == [len(x) for x in lists] and h.dtype == U
        known = {}
        for w, k in zip((w for x in lists for w in x), h.tolist()):
            assert known.setdefault(w, k) == k
        assert len(set(known.values())) == len(known)
