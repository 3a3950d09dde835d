"""Quality statistics of texts, and outliers among them by robust distances.

Each language and source gets its own centre and scatter of transformed statistics, by the
minimum covariance determinant: of all subsets with the wanted share of the rows the one whose
covariance has the smallest determinant. It is sought from several deterministic starts; from
each, concentration steps keep the rows nearest to the present centre and estimate anew as long
as that lowers the determinant, and the start with the smallest wins. One reweighting step
follows. Documents far from their centre by Mahalanobis distance are rejected. Thresholds
inside a group come from counts of distance classes, so a group of any size is only ever
aggregated, and rows meet the few estimates by a broadcast of checked size or by salted keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import once
from .storage import packed, stored

#: fixed values: white space between words, and symbols
GAP, SYMBOLS, WINDOW = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]", 5
#: transformed statistics and the least standard deviation that each is given
FEATURES = {"length": 0.1, "word_length": 0.02, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.15}
D = len(FEATURES)


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def base_statistics(rows: DataFrame, *keep: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = rows.select(*keep, "text", once(word_list(F.col("text"))).alias("words"))
    a = a.select(
        *keep, F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("bigint").alias("n_symbols"), lines.alias("lines"),
        once(F.transform("words", lambda w: F.xxhash64(w))).alias("h"),
    )
    at = F.when(F.size("h") >= WINDOW, F.sequence(F.lit(0), F.size("h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    a = a.select(
        *keep, "n_words", "word_chars", "n_symbols", F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        once(F.transform(at, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).alias("g"),
    )
    # windows in order of their hash, only where one occurs twice
    paired = F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    stats = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    a = a.select(*keep, *stats, once(paired).alias("s"))
    twin = F.transform(
        "s", lambda x, i: F.when((x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]), x["i"])
    )
    a = a.select(*keep, *stats, once(F.sort_array(F.array_compact(twin))).alias("p"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        "p", start,
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )
    return a.select(*keep, *stats, F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def transformed() -> list[Column]:
    """Statistics on scales where most documents spread evenly; all finite."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(words + 1), F.log((F.col("word_chars") + 1) / words),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi2_cdf(x: float, d: int) -> float:
    """By the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, d: int) -> float:
    """What the scatter of the nearest ``share`` of normal rows has to be multiplied with."""
    return share / chi2_cdf(chi2_quantile(share, d), d + 2)


def grouped(stats: DataFrame, least: int) -> DataFrame:
    """Adds ``key``: language and source, or language, or all, the first with ``least`` good rows."""
    pair, lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    counts = stats.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("m"))
    sizes = stored(
        counts.join(by_lang.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")))
        .select(
            pair.alias("pair"),
            F.when(F.col("n") >= least, F.concat(F.lit("2"), pair)).when(F.col("m") >= least, F.concat(F.lit("1"), lang))
            .otherwise("0").alias("key"),
        )
    )
    return stats.withColumn("pair", pair).join(sizes, "pair", "left").drop("pair").withColumn("key", F.coalesce("key", F.lit("0")))


#: estimates (a few hundred bytes each) that are broadcast; more are joined by salted keys
BROADCAST_ROWS, SALTS = 20_000, 32
STARTS = ("median", "low", "high", "tanh", "signs")


def _quantiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(key, k, a column for each share) of values (key, k, x, n), from counts of classes of a thousandth."""
    counts = values.groupBy("key", "k", F.round(F.col("x") * 1000).cast("bigint").alias("b")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("key", "k")
    upto = F.sum("n").over(w.orderBy("b"))
    ranked = counts.select("key", "k", "b", upto.alias("upto"), F.sum("n").over(w).alias("all"))
    found = [(F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("b"))) / 1000).alias(name) for name, p in shares.items()]
    return ranked.groupBy("key", "k").agg(*found)


def with_estimates(table: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """Rows (key, f) joined with the estimates of their group; a group of any size is spread over tasks.

    ``few`` says that there are at most ``BROADCAST_ROWS`` estimates.
    """
    if few:
        return table.join(F.broadcast(now), "key")
    # a row is dealt by its values; equal rows have been counted into one
    salted = table.withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(SALTS)))
    return salted.join(now.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["key", "salt"]).drop("salt")


def _matrix(cell) -> Column:
    return F.array(*[cell(i, j) for i in range(D) for j in range(D)])


def _inverse(matrix: Column) -> Column:
    """(a, det): inverse, row by row in one array, and determinant of a positive definite matrix.

    By Gauss-Jordan steps in place; the determinant is the product of their pivots.
    """

    def step(acc: Column, k: Column) -> Column:
        a = acc["a"]
        pivot = F.get(a, k * (D + 1))

        def cell(x: Column, m: Column) -> Column:
            i, j = F.floor(m / D).cast("int"), m % D
            row, column = F.get(a, k * D + j), F.get(a, i * D + k)
            return (
                F.when((i == k) & (j == k), 1 / pivot).when(i == k, x / pivot).when(j == k, -x / pivot)
                .otherwise(x - column * row / pivot)
            )

        return F.struct(F.transform(a, cell).alias("a"), (acc["det"] * pivot).alias("det"))

    start = F.struct(matrix.alias("a"), F.lit(1.0).alias("det"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(D - 1)), start, step)


def _distance() -> Column:
    """Squared Mahalanobis distance of ``f`` from ``centre`` with ``inverse``."""
    diff = [F.col("f")[i] - F.col("centre")[i] for i in range(D)]
    return sum((diff[i] * diff[j] * F.col("inverse")[i * D + j] for i in range(D) for j in range(D)), F.lit(0.0))


def _estimate(subset: DataFrame, factor: float, *by: str) -> DataFrame:
    """(by, centre, inverse, det) of rows (by, f, n), n of each; scatter times ``factor`` plus the least variances."""
    f, n = F.col("f"), F.col("n")
    sums = subset.groupBy(*by).agg(
        F.sum(n).alias("n"), *[F.sum(n * f[i]).alias(f"s{i}") for i in range(D)],
        *[F.sum(n * f[i] * f[j]).alias(f"q{i}{j}") for i in range(D) for j in range(i, D)],
    )
    least = [v * v for v in FEATURES.values()]

    def cov(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        value = (F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n")) * factor
        return value + F.lit(least[i]) if i == j else value

    # rounding makes the estimate independent of the order of sums
    centre = F.array(*[F.round(F.col(f"s{i}") / F.col("n"), 9) for i in range(D)])
    return sums.select(*by, centre.alias("centre"), once(_matrix(lambda i, j: F.round(cov(i, j), 12))).alias("m")).select(
        *by, "centre", once(_inverse(F.col("m"))).alias("v")
    ).select(*by, "centre", F.transform(F.col("v.a"), lambda x: F.round(x, 6)).alias("inverse"), F.col("v.det").alias("det"))


def _starts(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(key, start, centre, inverse): where concentration begins, from counted rows (key, f, n); whether they are few.

    Medians and both quartiles with the deviations from the medians; medians with the
    covariances of the standardised rows' hyperbolic tangents, and of their directions.
    """
    each = rows.select("key", F.posexplode("f").alias("k", "x"), "n")
    middle = stored(_quantiles(each, {"median": 0.5, "low": 0.25, "high": 0.75}))
    few = len(STARTS) * middle.count() <= BROADCAST_ROWS
    off = each.join(F.broadcast(middle) if few else middle, ["key", "k"])
    spread = stored(_quantiles(off.select("key", "k", "n", F.abs(F.col("x") - F.col("median")).alias("x")), {"mad": 0.5}))
    named = F.create_map(*[c for i, v in enumerate(FEATURES.values()) for c in (F.lit(i), F.lit(v * v))])
    scaled = middle.join(spread, ["key", "k"]).withColumn("s", F.sqrt(F.pow(1.4826 * F.col("mad"), 2) + named[F.col("k")]))
    by_k = scaled.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "median", "low", "high", "s"))).alias("c"))
    column = lambda name: F.transform("c", lambda x: x[name]).alias(name)
    at = stored(by_k.select("key", column("median"), column("low"), column("high"), column("s")))
    plain = _matrix(lambda i, j: 1 / F.pow(F.col("s")[i], 2) if i == j else F.lit(0.0))
    centres = F.array(*[F.struct(F.lit(n).alias("start"), F.col(n).alias("centre")) for n in ("median", "low", "high")])
    simple = at.select("key", F.explode(centres).alias("c"), plain.alias("inverse")).select("key", "c.start", "c.centre", "inverse")
    z = F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda i: (F.get("f", i) - F.get("median", i)) / F.get("s", i))
    size = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)) + 1e-9
    shapes = F.array(
        F.struct(F.lit("tanh").alias("start"), F.transform("z", F.tanh).alias("f")),
        F.struct(F.lit("signs").alias("start"), F.transform("z", lambda x: x / size).alias("f")),
    )
    turned = with_estimates(rows, at, few).select("key", "n", once(z).alias("z")).select("key", "n", F.explode(shapes).alias("c"))
    fitted = _estimate(turned.select("key", "n", "c.start", "c.f"), 1.0, "key", "start")
    shaped = fitted.join(at, "key").select(
        "key", "start", F.col("median").alias("centre"),
        _matrix(lambda i, j: F.col("inverse")[i * D + j] / F.col("s")[i] / F.col("s")[j]).alias("inverse"),
    )
    return simple.unionByName(shaped), few


def _nearest(far: DataFrame, share: float, *by: str) -> DataFrame:
    """(by, limit): the distance class that completes the share."""
    w = Window.partitionBy(*by)
    counts = far.groupBy(*by, "b").agg(F.sum("n").alias("n"))
    ranked = counts.select(*by, "b", F.sum("n").over(w.orderBy("b")).alias("upto"), F.sum("n").over(w).alias("all"))
    return ranked.filter(F.col("upto") >= share * F.col("all")).groupBy(*by).agg(F.min("b").alias("limit"))


def smallest_determinants(rows: DataFrame, share: float, steps: int) -> DataFrame:
    """(key, start, centre, inverse, det, converged): of each group the best of all starts.

    A start ends when a step no longer lowers its determinant; one that still does after
    ``steps`` steps is marked as not converged.
    """
    factor, by = consistency(share, D), ["key", "start"]
    begun, few = _starts(rows)
    now = stored(begun.withColumn("det", F.lit(math.inf)))
    ended: list[DataFrame] = []
    for _ in range(steps):
        far = with_estimates(rows, now, few).select(*by, "f", "n", F.floor(256 * F.log1p(F.greatest(F.lit(0.0), _distance()))).alias("b"))
        limits = _nearest(far, share, *by)
        # the limit joins the estimate, so that rows are dealt with one of each start
        chosen = with_estimates(rows, now.join(limits if few else stored(limits), by), few).select(
            *by, "f", "n", F.floor(256 * F.log1p(F.greatest(F.lit(0.0), _distance()))).alias("b"), "limit"
        )
        new = _estimate(chosen.filter("b <= limit"), factor, *by).withColumnRenamed("det", "new_det")
        both = stored(new.join(now.select(*by, F.col("centre").alias("c0"), F.col("inverse").alias("i0"), "det"), by))
        better = F.col("new_det") < F.col("det") * (1 - 1e-9)
        ended.append(both.filter(~better).select(*by, F.col("c0").alias("centre"), F.col("i0").alias("inverse"), "det", F.lit(True).alias("converged")))
        now = both.filter(better).select(*by, "centre", "inverse", F.col("new_det").alias("det"))
        if now.isEmpty():
            break
    every = now.withColumn("converged", F.lit(False))
    for e in ended:
        every = every.unionByName(e)
    # of equal determinants the start that comes first
    order = F.array_position(F.array(*[F.lit(s) for s in STARTS]), F.col("start"))
    best = F.min_by(F.struct("start", "centre", "inverse", "det", "converged"), F.struct("det", order))
    return stored(every.groupBy("key").agg(best.alias("m")).select("key", "m.*"))


def robust_estimates(table: DataFrame, share: float, steps: int) -> DataFrame:
    """(key, centre, inverse, converged) by minimum covariance determinant of rows (key, f)."""
    # equal rows are counted once, so that a group of copies is one row
    rows = stored(table.groupBy("key", "f").agg(F.count("*").alias("n")))
    best = smallest_determinants(rows, share, steps)
    near = with_estimates(rows, best.select("key", "centre", "inverse"), best.count() <= BROADCAST_ROWS).filter(_distance() <= chi2_quantile(0.975, D))
    return stored(_estimate(near.select("key", "f", "n"), consistency(0.975, D), "key").join(best.select("key", "converged"), "key"))


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    share: float = 0.55, cutoff: float = 0.99999, steps: int = 30, least: int = 200,
) -> DataFrame:
    """(id, base statistics, base_failed, distance, converged, kept) of every document.

    ``distance`` is the squared robust distance from the document's group; beyond the ``cutoff``
    quantile of the chi-squared law, or with ``base_failed``, it is not kept. Groups under
    ``least`` rows join their language, languages under it the whole; null languages and
    sources are groups like others. Where no row passes the base rules there is nothing to
    estimate and ``distance`` is null. ``converged`` tells whether the group's estimate had
    settled after ``steps`` steps. Null texts have no words and fail. Equal rows get equal results.
    """
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "i"), (text_col, "t"), (lang_col, "lang"), (source_col, "source"))])
    rows = docs.select(F.col("i").alias("id"), F.col("t").cast("string").alias("text"), "lang", "source")
    stats = stored(base_statistics(rows, "id", "lang", "source").withColumn("base_failed", base_failed()))
    table = stored(grouped(stats, least).withColumn("f", F.array(*transformed())))
    fitted = robust_estimates(table.filter(~F.col("base_failed")).select("key", "f"), share, steps)
    limit = chi2_quantile(cutoff, D)
    few = fitted.count() <= BROADCAST_ROWS
    judged = table.join(F.broadcast(fitted) if few else fitted, "key", "left").withColumn("distance", _distance())
    return judged.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("distance", 4).alias("distance"), "converged",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"),
    )
