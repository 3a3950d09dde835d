"""Similarity join, suffix dedup and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from rampfield.llm import suffix_dedup as sd
from rampfield.llm.components import components
from rampfield.llm.ngram_join import similar_groups


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(docs):
    sets, up = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(rng, n, length, edits):
    base = [f"w{rng.randrange(10_000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_groups_match_brute_force(table, seed, monkeypatch):
    from rampfield.llm import ngram_join

    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 500)
    monkeypatch.setattr(ngram_join, "QUERY_TOKENS", 700)
    rng = random.Random(seed)
    texts = near_copies(rng, 60, 60, 6) + near_copies(rng, 30, 12, 2) + near_copies(rng, 20, 200, 9)
    passage = " ".join(f"p{k}" for k in range(55))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(99999)}' for _ in range(12))}" for _ in range(30)]
    texts += [None, "", " \n", "a b", "A  B", "a b c d e", "a b c d e f", texts[0], texts[0], "one"]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = {r.id: (r.n, r.first) for r in similar_groups(table(docs)).collect()}
    assert got == brute_groups(docs)


def test_similar_groups_nulls_repeats_and_empty(table):
    text = "some words that are the same in all of the rows"
    rows = similar_groups(table([(None, text), (5, text), (5, text), (None, None), (7, "")])).collect()
    assert sorted((r.id or 0, r.n, r["first"] or 0) for r in rows) == [(0, 0, 0), (0, 7, 5), (5, 7, 5), (5, 7, 5), (7, 0, 7)]
    assert similar_groups(table([]).limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 199)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 160)}, 199: 199, 200: 199}


def brute_repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for k in range(len(b) - size + 1):
            seen[b[k : k + size]] = seen.get(b[k : k + size], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("size,gram,group,text", [(20, 10, 2000, 10**6), (20, 10, 2000, 60), (20, 10, 2, 10**6), (30, 12, 3, 200)])
def test_repeats_match_brute_force(table, monkeypatch, size, gram, group, text):
    monkeypatch.setattr(sd, "TEXT", text)
    rng = random.Random(size + group)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common, line = word(70), word(size - 4)
    texts = [word(rng.randrange(150)) + rng.choice([common[rng.randrange(30) :], line, "", common]) + word(rng.randrange(60)) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", "a" * 300, "ab" * 100, "x" * size, "x" * (size + 1), "y" * (size - 1), "\x00" * 50]
    docs = list(enumerate(texts))
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.drop_repeats(table(docs), size=size, gram=gram, group=group).collect()}
    assert [got[k] for k, _ in docs] == brute_repeats(texts, size)


def test_long_texts_are_cut_without_loss(table, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 1000)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(9000))
    texts = [long, "-" + long[2100:2900] + "+", long[500:530]]
    doc, pos, *_ = sd.anchors([t.encode() for t in texts], 40, 20)
    at = {d: {int(p) for p in pos[doc == d]} for d in range(3)}
    assert not at[2]
    # both copies of every shared string hold one anchor at the same place in it
    for s in range(800 - 40 + 1):
        assert any(2100 + s + k in at[0] and 1 + s + k in at[1] for k in range(21)), s


def test_shared_prefixes_are_exact():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 300):
        x = rng.integers(97, 99, n).astype(np.uint8)
        order, bwt = sd.burrows_wheeler(x, 12)
        ring = bytes(np.tile(x, 12 // n + 2))
        got = sd.shared_prefixes(bwt, 12)
        for k in range(1, n):
            assert got[k] == (ring[order[k] : order[k] + 12] == ring[order[k - 1] : order[k - 1] + 12])
        assert not got[0]


def test_repeats_of_empty_table(table):
    assert sd.drop_repeats(table([]).limit(0)).count() == 0


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(9)
    plain = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = plain(14)
    line = "this is a line that many documents have"
    rows = [(k, plain(30) + ("\n" + line if k % 3 == 0 else ""), "en", "s", 0) for k in range(40)]
    rows += [(100 + k, plain(30) + " you absolute zorgle " + plain(5), "en", "s", 0) for k in range(20)]
    rows += [(200, rows[1][1], "en", "s", 0), (201, rows[1][1] + " tail", "en", "s", 0), (202, f"{plain(8)} {item} {plain(4)}", "en", "s", 0)]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 0, 0) for k in range(40)] + [(100 + k, 0, 1) for k in range(20)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(r.doc_id for r in c.run(spark, str(tmp_path)).collect())
    assert got == sorted([*range(40), 300, 300, 301])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in c.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(c.COLUMNS), name
    assert sum(line in (r.text or "") for r in docs.collect()) == 1
