"""The hash tree against a direct one, and its layout."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampfield.llm.merkle import address, fold, laid_out, layout, manifest, proof_digest, proofs, siblings, tree_size

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(level):
    """Levels from the leaves to the root."""
    out = [level]
    while len(level) > 1:
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
        out.append(level)
    return out


def way(levels, at):
    steps = []
    for level in levels[:-1]:
        a = at - at % 3
        steps.append((level[a:at], level[at + 1 : a + 3]))
        at //= 3
    return steps


def direct(rows):
    """{(doc_id, leaf): (subroot, root, proof)}; rows are tuples of COLUMNS."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        ordered = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (ordered, grown([leaf_of(r) for r in ordered]))
    top = grown([trees[s][1][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        ordered, levels = trees[s]
        for k, r in enumerate(ordered):
            steps = way(levels, k) + way(top, j)
            text = "".join("".join(b) + "".join(a) for b, a in steps)
            out.append((r[0], levels[0][k], levels[-1][0], top[-1][0], h(text)))
    return out


def run(spark, rows, block_levels, presented=None):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    df = df.withColumns({n: F.lit(7) for n in ("g", "n", "rank", "node", "block", "steps", "part", "id")})
    found = proofs(manifest(df, presented=presented, block_levels=block_levels))
    return found.select(
        "id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof"), fold(F.col("claim"), F.col("steps")).alias("folded")
    ).collect()


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 7])
def test_addresses_are_a_permutation_with_the_upper_half_first(levels):
    places = [address(levels, d, np.arange(3**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(tree_size(levels)))
    above = levels - levels // 2
    upper = np.concatenate(places[:above])
    assert levels == 1 or set(upper.tolist()) == set(range(tree_size(above)))
    # every subtree under the upper half is one stretch
    if levels > 1:
        bottom = levels // 2
        under = [np.concatenate([places[above + d][j * 3**d : (j + 1) * 3**d] for d in range(bottom)]) for j in range(3**above)]
        assert all(x.max() - x.min() + 1 == len(x) == tree_size(bottom) for x in under)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 9, 10, 26, 27])
def test_block_holds_every_level_without_holes(k):
    leaves = [h(str(j)) for j in range(k)]
    levels = grown(leaves)
    nodes, root = laid_out(leaves, len(levels) - 1)
    assert root == levels[-1][0]
    assert len(nodes) == 32 * sum(map(len, levels))
    places = layout(len(levels) - 1, k)
    for level, at in zip(levels, places):
        assert [nodes[32 * p : 32 * p + 32].hex() for p in at] == level
    for step, (before, after) in enumerate(siblings(nodes, len(levels) - 1, k)):
        assert [(b, a) for b, a in zip(before, after)] == [
            ("".join(levels[step][j - j % 3 : j]), "".join(levels[step][j + 1 : j - j % 3 + 3])) for j in range(len(levels[step]))
        ]


@pytest.mark.parametrize("block_levels", [1, 2, 6])
def test_tree_equals_a_direct_one(spark, block_levels):
    rows = [(k, "hot" if k % 3 else f"s{k % 5}", "en", k, f"text {k}\nä") for k in range(200)]
    rows += [(None, None, None, None, None), (5, None, "en", 1, ""), (None, "hot", "de", 2, "x" * 100_000), (7, "é", "fr", 3, "a"),
             (900, "same", "en", 1, "twice"), (900, "same", "en", 1, "twice"), (900, "same", "en", 1, "other"), (0, "", "en", 0, "\n")]
    got = run(spark, rows, block_levels)
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, direct(rows)))
    assert all(r["folded"] == r["root"] for r in got)


def test_change_is_seen_by_every_changed_row_only(spark):
    rows = [(k, f"s{k % 4}", "en", 1, "a\nb" if k % 3 else "ab") for k in range(60)]
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = run(spark, rows, 2, {"text": shown})
    changed = {k for k, _, _, _, t in rows if zlib.crc32(str(k).encode()) % 2 == 0 and "\n" in t}
    assert changed and {r["id"] for r in got if r["folded"] != r["root"]} == changed


def test_empty_table_and_lone_row(spark):
    assert run(spark, [], 6) == []
    one = run(spark, [(1, "s", "en", 1, "t")], 6)[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded"] and one["proof"] == h("")
