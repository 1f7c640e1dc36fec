"""Quality rules: base counts, then robust multivariate outliers for each language and source.

All of it is DataFrame expressions. The statistics are transformed, fixed-point
numbers, so sums are exact and reruns agree. For each (lang, source) the minimum
covariance determinant is sought from several starts by concentration steps: mean
and covariance of the half with the least Mahalanobis distances so far, distances
anew, and so on until no group's half changes. Of a group's halves, one from each start, the
one with the least determinant is kept; a row whose distance by it is beyond the cut is
rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table, unused, words_of

SYMBOLS = "[#*$%&|<>]"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT = 50, 50  # words; percent of words in repeated windows
#: Dimensions are stored as whole numbers of 1 / SCALE.
SCALE = 1000
#: A histogram of statistics is cut into ranges of 2 ** RANGE_BITS bins.
RANGE_BITS = 6
#: Least standard deviation of each dimension: most texts have no symbol and no repeat at all. Each is so small that
#: its dimension can reject a row by itself: beside texts without any, a fifth of the words in repeated windows is too
#: much, and so is a repeated line for each 24 words.
FLOORS = (0.05, 0.15, 0.07, 0.1)
#: Parameter: groups below this many rows are judged by the estimates of their language, and those in turn by all rows,
#: as a half of a few rows has no covariance to speak of. With 1 each group is judged by its own rows.
MIN_GROUP = 60
#: Starts: medians with the floors, medians with the floors and tenfold floors by turns (dimensions of many zeros
#: weigh less, then more), mean and covariance of all rows.
STARTS = 4
#: Squared distance: the 0.999 quantile of chi-square with four degrees, times the consistency factor of the half's
#: covariance, 0.5 / P(chi-square with six degrees <= the median of that with four).
CUT = 18.467 * 2.109
#: Concentration steps at most. Halves are whole bins of distance, so that a group may go back and forth between two.
STEPS = 30


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the five base counts (long), which replace no column: give rows without these names. A null text counts as empty.

    Repeated windows are found by sorting a text's three-word windows, so the
    work on a text grows as n log n.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words_, lines_, hashes, windows, twice = unused(docs.columns, "words", "lines", "hashes", "windows", "twice")
    df = docs.withColumns({words_: words_of(F.col(text_col)), lines_: lines})
    n = F.size(words_)
    window = lambda i: F.xxhash64(F.get(words_, i), F.get(words_, i + 1), F.get(words_, i + 2))
    df = df.withColumn(hashes, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)))
    again = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn(windows, F.when(again, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(x["h"] == F.get(windows, k)["h"], F.lit(False))
    df = df.withColumn(twice, F.sort_array(F.transform(F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    # a window adds the words that the one before it doesn't cover: three, or as many as the step between them
    step = F.transform(twice, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(twice, k - 1), x - 3)))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(words_, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(lines_) - F.size(F.array_distinct(lines_)),
        "n_repeat_words": F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)),
    }
    # a generator, so that a filter on a count is not pushed below and evaluated on copies of all of this
    return df.select(*[f"`{c}`" for c in docs.columns], F.inline(F.array(F.struct(*[x.cast("long").alias(k) for k, x in counts.items()]))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def dimensions() -> list[Column]:
    """Transformed statistics as whole numbers: log word length, log symbol share, repeat share, duplicate lines."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    raw = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(F.lit(20.0) * F.col("n_symbols") / n),
        F.sqrt(F.col("n_repeat_words") / n),
        F.log1p(F.lit(20.0) * F.col("n_dup_lines") / n),
    ]
    return [F.round(x * SCALE).cast("long") for x in raw]


def _sums(d: int) -> list[str]:
    """Columns of a group's sums: rows, dimensions, products."""
    return ["m", *[f"s{i}" for i in range(d)], *[f"p{i}{j}" for i in range(d) for j in range(i + 1)]]


def _moments(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Number of rows and exact sums of the dimensions and of their products for each group."""
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    products = [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count("*").alias("m"), *sums, *products)


def _factor(moments: DataFrame, d: int) -> DataFrame:
    """Means and the Cholesky factor of the covariance, floors added to its diagonal; keeps the group keys and the sums."""
    n = F.col("m").cast("double")
    df = moments.withColumns({f"mu{i}": F.col(f"s{i}") / n for i in range(d)})
    for i in range(d):
        for j in range(i + 1):
            cov = F.col(f"p{i}{j}").cast("double") / n - F.col(f"mu{i}") * F.col(f"mu{j}")
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + (FLOORS[i] * SCALE) ** 2
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(1e-6))) if i == j else cov / F.col(f"l{j}{j}"))
    return df


def _distance(d: int, p: str = "") -> Column:
    """Squared Mahalanobis distance of columns {p}x* by {p}mu* and {p}l*, by forward substitution."""
    z: list[Column] = []
    for i in range(d):
        v = F.col(f"{p}x{i}") - F.col(f"{p}mu{i}")
        for k in range(i):
            v = v - F.col(f"{p}l{i}{k}") * z[k]
        z.append(v / F.col(f"{p}l{i}{i}"))
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def _half(measured: DataFrame, keys: list[str], d: int, share: float) -> DataFrame:
    """Rows with their bin of distance -> sums over the least bins in which ``share`` of the group's rows are.

    Sums for each bin stand in for a sort, so that rows are read once and a group of any size needs only
    its histogram; bins are fixed-point numbers of a bounded range, so that is of bounded length.
    """
    bins = _moments(measured, [*keys, "bin"], d)
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumns({"_to": F.sum("m").over(up), "_all": F.sum("m").over(Window.partitionBy(*keys))})
    inside = bins.where(F.col("_to") - F.col("m") < share * F.col("_all"))
    return inside.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _sums(d)])


def _half_of_many(measured: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Rows -> (keys, limit): the least bin up to which ``share`` of the group's rows are; of many bins, ranges are summed first, and a window holds a group's ranges or the bins of one of them."""
    bins = measured.groupBy(*keys, "bin").agg(F.count("*").alias("n")).withColumn("range", F.shiftright("bin", RANGE_BITS))
    ranges = bins.groupBy(*keys, "range").agg(F.sum("n").alias("_n"))
    up = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumns({"_to": F.sum("_n").over(up), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    ranges = ranges.where((F.col("_to") >= share * F.col("_all")) & (F.col("_to") - F.col("_n") < share * F.col("_all"))).select(*keys, "range", (F.col("_to") - F.col("_n")).alias("_base"), "_all")
    inside = bins.join(ranges, [*keys, "range"])
    up = Window.partitionBy(*keys, "range").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_to", F.col("_base") + F.sum("n").over(up))
    return inside.where(F.col("_to") >= share * F.col("_all")).groupBy(*keys).agg(F.min("bin").alias("limit"))


def _starts(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """(keys, start, mu*, l*) of the starts, each with its number."""
    values = rows.select(*keys, F.posexplode(F.array(*[f"x{i}" for i in range(d)])).alias("dim", "bin"))
    middle = _half_of_many(values, [*keys, "dim"], 0.5)
    middle = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("dim") == i, F.col("limit"))).cast("double").alias(f"mu{i}") for i in range(d)])
    names = [*keys, "start", *[f"mu{i}" for i in range(d)], *[f"l{i}{j}" for i in range(d) for j in range(i + 1)]]
    wide = [lambda i: 1.0, lambda i: 10.0 if i % 2 else 1.0, lambda i: 1.0 if i % 2 else 10.0]
    flat = [middle.withColumns({"start": F.lit(k)} | {f"l{i}{j}": F.lit(FLOORS[i] * SCALE * w(i) if i == j else 0.0) for i in range(d) for j in range(i + 1)}).select(*names) for k, w in enumerate(wide)]
    whole = _factor(_moments(rows, keys, d), d).withColumn("start", F.lit(len(wide))).select(*names)
    return flat[0].unionByName(flat[1]).unionByName(flat[2]).unionByName(whole)


def mcd(rows: DataFrame, keys: list[str], d: int, steps: int = STEPS, share: float = 0.5) -> DataFrame:
    """Estimates (keys, mu*, l*) of each group of rows with dimensions x0..; keys hold no null.

    Steps end when every half has the sums of the one before, by their hash, or after
    ``steps``. The determinant, of the covariance with its floors, is the square of the product
    of the factor's diagonal; of equal ones the first start's estimate is kept.
    """
    names = [*[f"mu{i}" for i in range(d)], *[f"l{i}{j}" for i in range(d) for j in range(i + 1)]]
    own = [*keys, "start", "now"]
    estimate = stage_table(_starts(rows, keys, d).withColumn("now", F.lit(0).cast("long")), "mcd-estimate")
    for _ in range(steps):
        measured = rows.join(estimate.select(*own, *names), keys)  # a row for each group and start, as small as its file says
        measured = measured.withColumn("bin", F.floor(F.log2(_distance(d) + 1e-3) * 16).cast("int")).select(*own, *[f"x{i}" for i in range(d)], "bin")
        half = _factor(_half(measured, own, d, share), d)
        estimate = stage_table(half.withColumnRenamed("now", "before").withColumn("now", F.xxhash64(*_sums(d))), "mcd-estimate")
        if estimate.where("now != before").isEmpty():
            break
    log_det = sum((F.log(f"l{i}{i}") for i in range(1, d)), F.log("l00"))
    best = estimate.groupBy(*keys).agg(F.min(F.struct(F.round(log_det, 9).alias("log_det"), "start", *names)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{n}").alias(n) for n in names])


def apply_rules(docs: DataFrame, cut: float = CUT, steps: int = STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """Documents (text, lang, source, any others) -> plus the base counts, base_failed, distance, kept.

    A row that fails a base rule is rejected and doesn't shape the estimates, nor
    get a distance. Null texts are empty and fail. Null lang or source are groups of
    their own. Rows that repeat are judged alike. Columns of the added names are
    replaced, all others kept whatever their names. No rows give no rows.
    """
    added = [*STATS, "base_failed", "distance", "kept"]
    df = text_statistics(docs.drop(*added)).withColumn("base_failed", base_failed())
    return judge(df, dimensions(), cut, steps, min_group)


def judge(df: DataFrame, values: list[Column], cut: float = CUT, steps: int = STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """Rows with lang, source and base_failed, and their dimensions -> distance and kept."""
    d = len(values)
    (p,) = unused(df.columns, "_")
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    level = {f"{p}lang": F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")), f"{p}source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))}
    rows = df.where(~F.col("base_failed")).select(level[f"{p}lang"].alias("g_lang"), level[f"{p}source"].alias("g_source"), *[x.alias(f"x{i}") for i, x in enumerate(values)])
    rows = stage_table(rows, "rule-statistics")
    sizes = rows.groupBy("g_lang", "g_source").agg(F.count("*").alias("_n"))
    by_lang = sizes.groupBy("g_lang").agg(F.sum("_n").alias("_n_lang"))
    # each group's estimates come from itself, from its language or from all rows, as size allows
    use = sizes.join(by_lang, "g_lang").select(
        "g_lang", "g_source",
        F.when(F.col("_n") >= min_group, F.concat_ws("\x00", "g_lang", "g_source")).when(F.col("_n_lang") >= min_group, F.col("g_lang")).otherwise(F.lit("*")).alias("g"),
    )
    use = stage_table(use, "rule-groups")
    own = rows.withColumn("g", F.concat_ws("\x00", "g_lang", "g_source"))
    wider = rows.withColumn("g", F.explode(F.array(F.col("g_lang"), F.lit("*"))))
    needed = use.select("g").distinct()
    pool = own.unionByName(wider).join(needed, "g", "left_semi").select("g", *[f"x{i}" for i in range(d)])
    estimates = mcd(stage_table(pool, "rule-pool"), ["g"], d, steps)
    params = use.join(estimates, "g").drop("g").withColumnsRenamed({"g_lang": f"{p}of_lang", "g_source": f"{p}of_source"})
    params = params.withColumnsRenamed({c: f"{p}{c}" for c in params.columns if not c.startswith(p)})
    out = df.withColumns(level | {f"{p}x{i}": x for i, x in enumerate(values)})
    out = out.join(params, (F.col(f"{p}lang") == F.col(f"{p}of_lang")) & (F.col(f"{p}source") == F.col(f"{p}of_source")), "left")
    distance = F.when(~F.col("base_failed"), F.round(_distance(d, p), 6))
    out = out.select(*[f"`{c}`" for c in df.columns], distance.alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut))
