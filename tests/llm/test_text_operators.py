"""Line dedup, decontamination, quality and licences: edge cases and brute-force comparisons."""

import hashlib
import random
import re
from collections import Counter

import pytest

from rampfield.llm.decontamination import contamination, proximity_hits
from rampfield.llm.licenses import licences
from rampfield.llm.line_dedup import drop_repeated_lines
from rampfield.llm.quality import chi2_cdf, chi2_quantile, quality

LONG = "A line that is certainly long enough"


def test_lines_keep_one_holder_and_count_documents(table):
    docs = table([
        (1, f"{LONG}\nown"), (2, f"  {LONG.upper()}\t\nx\n{LONG}"), (3, f"{LONG}"), (4, "short\nshort"), (5, "short"),
        (6, "short"), (7, None), (8, ""), (9, "twice is not three times\n"), (10, "twice is not three times"),
    ])
    got = {r.id: (r.n_lines, r.n_dropped, r.kept) for r in drop_repeated_lines(docs).collect()}
    assert got[1] == (2, 1, "own") and got[2] == (3, 2, "x") and got[3] == (1, 0, LONG)
    assert got[4] == (2, 0, "short\nshort") and got[7] == (1, 0, "") and got[8] == (1, 0, "")
    assert got[9] == (2, 0, "twice is not three times\n")


def test_line_ties_nulls_and_repeated_rows(table):
    docs = table([(None, LONG), (None, LONG), (None, LONG), (1, "é" * 20), (1, "é" * 20), (2, "é" * 20), (2, "É" * 20)])
    got = sorted((r.id or 0, r.n_dropped, r.kept) for r in drop_repeated_lines(docs).collect())
    # all holders of the first line have no id and keep it; É is not é, so only three documents hold the second
    assert got == [(0, 0, LONG)] * 3 + [(1, 1, "")] * 2 + [(2, 0, "É" * 20), (2, 0, "é" * 20)]
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_later_batches_meet_stored_runs(spark, tmp_path):
    """Days of documents added one after the other, the runs saved and loaded between them."""
    from pyspark.sql import functions as F

    from rampfield.llm.line_dedup import LineRuns, line_table
    from rampfield.llm.storage import packed, text_key

    rng = random.Random(3)
    days = [[(10 * d + k, "\n".join(f"line number {rng.randrange(12)} of the stock of lines" for _ in range(5))) for k in range(6)] for d in range(5)]
    hashed = lambda rows: line_table(
        packed(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").withColumns(text_key()), 20, 1
    ).select("h1", "h2", "id", "first")
    runs = LineRuns(2)
    for d, rows in enumerate(days):
        fresh = {(r["h1"], r["h2"]) for r in runs.add(hashed(rows)).collect()}
        earlier = {(r["h1"], r["h2"]) for x in days[:d] for r in hashed(x).collect()}
        assert fresh == {(r["h1"], r["h2"]) for r in hashed(rows).collect()} - earlier
        runs.save(f"{tmp_path}/{d}")
        runs = LineRuns.load(spark, f"{tmp_path}/{d}")
    # every key lies in one run of first sightings
    keys = [(r["h1"], r["h2"]) for level in runs.first.values() for run in level for r in run.collect()]
    assert len(keys) == len(set(keys))
    every = hashed([x for rows in days for x in rows])
    want = {(r["h1"], r["h2"]): (r["n"], r["last"]) for r in every.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("bigint")).alias("n"), F.max("id").alias("last")).collect()}
    for least in (1, 3, 8):
        got = runs.repeated(least).collect()
        assert {(r["h1"], r["h2"]): (r["n_docs"], r["last"]) for r in got} == {k: v for k, v in want.items() if v[0] >= least} and len(got) == len({(r["h1"], r["h2"]) for r in got})


def test_one_document_repeating_a_line_counts_once(table):
    docs = table([(1, "\n".join([LONG] * 50_000)), (2, LONG), (3, "other text of some length")])
    assert {r.n_dropped for r in drop_repeated_lines(docs).collect()} == {0}


def brute_contamination(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids:
                    hit |= set(range(k, k + n))
                    found |= ids
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("round_words", [1_000_000, 25])
def test_contamination_matches_brute_force(spark, table, round_words):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [
        (1, f"zero {passage.upper()}! end"), (2, "one two three four five six seven eight nine"), (3, "rare-word, x"), (4, None),
        (5, ""), (6, f"{passage} {passage}"), (7, "a a a a a a a a a a a a a"), (8, "the rare word"), (9, "Größe größe"),
    ]
    items = [("i1", passage), ("i10", passage + " thirteen"), ("i2", "rare word"), ("i3", "a " * 11), ("i4", None), ("i5", "?!"), ("i6", "GRößE")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in contamination(table(docs), bench, round_words=round_words).collect()}
    assert got == brute_contamination(docs, items)
    none = contamination(table(docs), bench.limit(0)).collect()
    assert len(none) == len(docs) and all(r.n_hit == 0 and r["items"] == [] for r in none)
    assert contamination(table(docs).limit(0), bench).count() == 0


def brute_near(docs, items, slop, missing, size=10):
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    texts = {i: words(t) for i, t in docs}
    cf, out = Counter(w for t in texts.values() for w in t), {i: set() for i in texts}
    for item, passage in items:
        p = words(passage)
        n = min(size, len(p))
        for win in (p[k : k + n] for k in range(len(p) - n + 1)):
            spare = missing if n == size else 0
            pivots = sorted(range(n), key=lambda k: (cf[win[k]], k))[: spare + 1]
            for i, t in texts.items():
                starts = {q - o for o in pivots for q, w in enumerate(t) if w == win[o]}
                near = lambda s, o: win[o] in t[max(0, s + o - slop) : max(0, s + o + slop + 1)]  # noqa: B023, E731
                if any(sum(near(s, o) for o in range(n)) >= n - spare for s in starts):
                    out[i].add(item)
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("round_words", [1_000_000, 120])
def test_near_passages_are_found_from_texts(spark, table, round_words):
    w = [f"w{k}" for k in range(30)]
    changed = [x if k % 8 else f"new{k}" for k, x in enumerate(w)]
    inserted = [y for k, x in enumerate(w) for y in ([x, "and"] if k % 9 == 4 else [x])]
    docs = [
        (1, " ".join(["a b", *w, "c"])), (2, " ".join(["a b", *changed, "c"])), (3, " ".join(["zero", *inserted])), (4, " ".join(w[::-1])),
        (5, " ".join(x if k % 4 else "no" for k, x in enumerate(w))), (6, "short old item"), (7, "short item"), (8, "item of short words"), (9, ""),
    ]
    rng = random.Random(8)
    docs += [(100 + k, " ".join(f"w{rng.randrange(14)}" for _ in range(60))) for k in range(20)]
    items = [("long", " ".join(w)), ("short", "short item"), ("loop", "w1 w2 w1 w2 w3 w1 w2 w1 w2 w3 w4")]
    found = contamination(table(docs), spark.createDataFrame(items, "item_id string, text string"), round_words=round_words, slop=2).collect()
    near = {r.id: r.near_items for r in found}
    assert near[1] == near[2] == near[3] == ["long"] and near[4] == near[5] == [] and near[6] == near[7] == ["short"]
    if round_words > 1000:
        assert near == brute_near(docs, items, 2, 1)
    assert {r.id for r in found if "long" in r["items"]} == {1}


def test_proximity_allows_gaps(spark):
    posting = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 0, 8), (1, 9, 9, 0), (2, 9, 9, 50)], "term bigint, k1 bigint, k2 bigint, pos int")
    asked = spark.createDataFrame([("q", 1, 0, 1), ("q", 2, 1, 2)], "query string, term bigint, offset int, rank int")
    assert [(r.k1, r.start) for r in proximity_hits(posting, asked, 2).collect()] == [(0, 5)]
    assert proximity_hits(posting, asked, 1).count() == 0
    assert proximity_hits(posting, asked, 0).count() == 0


def test_base_statistics_match_brute_force(table):
    texts = [
        None, "", "   ", "one two", "a b c d e " * 4, "x\nx\n \n\nx y", "é# 日本 *$%&|<>", "l1 w w w w w w w\nl2\nl1 w w w w w w w",
        " ".join(f"w{k}" for k in range(20_000)), "a b c d e f g a b c d e h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6",
    ]
    docs = [(k, t) for k, t in enumerate(texts)]
    got = {r.id: r for r in quality(table(docs)).collect()}
    for k, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)), k
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_rejects_outliers_only(spark, table):
    words = [f"w{k}{'x' * (k % 5)}" for k in range(400)]
    good = [(k, " ".join(words[(7 * k + 13 * j) % 400] for j in range(80 + k % 60))) for k in range(300)]
    bad = [(1000 + k, " ".join(f"{words[(k + j) % 400]}###" for j in range(100))) for k in range(10)]
    got = {r.id: r.kept for r in quality(table(good + bad), least=50).collect()}
    assert not any(got[k] for k, _ in bad) and sum(got[k] for k, _ in good) >= 297
    assert quality(table([]).limit(0)).count() == 0


def test_chi_squared():
    assert chi2_cdf(chi2_quantile(0.975, 5), 5) == pytest.approx(0.975)
    assert chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_licences_are_found_and_others_left_alone(table):
    docs = [
        (1, "some words\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."),
        (3, "the license of the driver was taken by the police in may"), (4, None), (5, ""),
        (6, "This work is licensed under the GNU General Public License, version 3."),
        (7, "A permit, free of charge, was the subject of the contract and of the law."),
    ] + [(100 + k, f"plain text number {k} with words about nothing much, and of the and for with\nline {k}") for k in range(60)]
    got = {r.id: r.families for r in licences(table(docs + docs[:1])).collect()}
    assert got[1] == ["MIT"] and got[2] == ["Apache-2.0", "CC-BY-NC-4.0"] and got[6] == ["GPL-3.0"]
    assert all(got[k] == [] for k in got if k not in (1, 2, 6))


def test_words_hash_is_independent_of_blocks():
    from rampfield.llm import words as W

    text = ("Some WORDS, größe\x0b" * 300_000).encode()
    h, n = W.word_hashes([b"some words, ", text, b""], W.VISIBLE)
    assert n.tolist() == [2, 900_000, 0]
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert hashlib.sha256(h[2:5].tobytes()).digest() == hashlib.sha256(h[-3:].tobytes()).digest()
