"""Quality rules: robust multivariate outliers, with DataFrame functions only.

Every text gives five counts (words, their characters, symbols, repeated lines, words in repeated 8-word windows)
and one more (words equal to the word before).  Texts that fail the base rules go.  Of the others, a vector of
transformed statistics is held against a minimum-covariance-determinant estimate of its language and source:

1. starts: median and median absolute deviation of each component; mean and covariance of all rows; and those of the rows'
   standardised components drawn in by tanh;
2. concentration steps, from each start: the SUBSET share of a group's rows with the smallest Mahalanobis distances gives the
   next mean and covariance.  After SCREENING steps a group goes on with its start of the least determinant, until the
   determinant falls no more (MAX_STEPS at most; some eight are usual); what is kept is the estimate of the least determinant;
3. reweighting: all rows under the 97.5 % point of chi-square give the final estimate;
4. rows beyond the chi-square point of REJECT are rejected.

Most clean texts have no symbol and no repetition at all, so covariances are regularised, as in the minimum regularised
covariance determinant: the squares of FLOOR are added to their diagonals.  FLOOR is what one chance event changes in a text of
some hundred to three hundred words, which no rule should take for a trait of its own: the mean length of twenty words varies by a
tenth; one symbol in 1,000 characters is the root of 1/1000; one repeated line among 70, or one repeated 8-word window in
600 words, is the root of 1/70; one doubled word in 280 the root of 1/280.  REJECT leaves about one of a million clean rows
of normal statistics outside.  SUBSET lets two fifths of a group be junk.  None of them is fitted to labels.

Results don't depend on partitions or their order: components are rounded to units of 1/UNIT, so all sums are sums of integers,
and the quantiles are those of counted bins (of a relative width of 1/BINS, all rows of a bin counting alike, which is also what
ties do; covariances are made consistent by the share of rows that really was used).

Texts are read once; the vectors, some 60 bytes a row, go to the shared folder, and each step is two partial
aggregations over them, so a source with a third of all rows costs no more than others.
A language and source with fewer than MIN_ROWS rows is pooled with its language's other small sources, these if
still too few with all such; what is too few even then has no estimate, and is kept unless the base rules fail it (the
covariance of five components means little on fewer rows).

Nulls: null text has no words (base_failed); a null language or source is a value of its own; a null id stays null.
Empty tables give empty results; repeated rows and ties are judged alike; very long texts are read whole, each within its row;
other columns are ignored.
"""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, attach, kept, scratch, stored, table, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_ROWS, SUBSET, REJECT = 60, 0.6, 1 - 1e-6
SCREENING, MAX_STEPS, UNIT, BINS = 2, 30, 4096, 512
#: log mean word length; square roots of the shares of symbols, repeated lines, repeated windows, words like the one before
VECTOR = ("x0", "x1", "x2", "x3", "x4")
FLOOR = (0.12, 0.03, 0.12, 0.12, 0.06)
PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]


def chi2_cdf(x: float, k: int) -> float:
    """Series of the lower incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_point(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float, k: int) -> float:
    """What a covariance of the share of rows with the smallest distances is multiplied with, for normal rows."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_point(share, k), k + 2)


def consistent(share: Column) -> Column:
    """consistency of a column of shares, between points a hundredth apart; shares under a half count as a half."""
    points = F.array(*[F.lit(round(consistency(i / 100, len(VECTOR)), 9)) for i in range(50, 101)])
    at = F.least(F.greatest(share, F.lit(0.5)), F.lit(1.0)) * 100 - 50
    low = F.least(F.floor(at), F.lit(49)).cast("int")
    return F.element_at(points, low + 1) * (1 - (at - low)) + F.element_at(points, low + 2) * (at - low)


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns of keep, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_adjacent (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        *keep, words(text).alias("_w"), lines.alias("_l"), F.length(F.regexp_replace(text, SPACES, "")).alias("word_chars"),
        F.when(text.rlike(r"[#*$%&|<>]"), F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).otherwise(0).alias("n_symbols"),
    )
    df = df.withColumns({"n_words": F.size("_w"), "_k": F.transform("_w", lambda w: F.xxhash64(w))})
    at = F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1))
    df = df.withColumn("_h", F.when(F.col("n_words") > WINDOW, F.transform(at, lambda i: F.xxhash64(F.slice("_k", i, F.lit(WINDOW))))))
    df = df.withColumn("_s", F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = lambda x, j: (F.get("_s", j - 1)["h"] == x["h"]) | (F.get("_s", j + 1)["h"] == x["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, j: F.coalesce(twice(x, j), F.lit(False))), lambda x: x["i"])))
    gaps = F.transform("_p", lambda p, j: F.least(F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return df.select(
        *keep, *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_k", lambda k, i: F.coalesce(F.get("_k", i - 1) == k, F.lit(False)))).cast("long").alias("n_adjacent"),
    )


def vectors(stats: DataFrame) -> DataFrame:
    """stats with the vector's components, in units of 1/UNIT."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_adjacent", "n_words"))
    return stats.withColumns({x: F.round(v * UNIT).cast("long") for x, v in zip(VECTOR, values)})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def grouped(df: DataFrame, lang_col: str, source_col: str, min_rows: int) -> DataFrame:
    """df with group: of language and source, or pooled where these have few rows; null without an estimate."""
    name = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("~"))
    df = df.withColumns({"_lang": name(lang_col), "_full": F.concat(name(lang_col), F.lit("/"), name(source_col))})
    n = df.where("NOT base_failed").groupBy("_lang", "_full").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < min_rows, F.col("n"))
    of_lang = n.groupBy("_lang").agg(F.coalesce(F.sum(small), F.lit(0)).alias("nl")).withColumnRenamed("_lang", "_l")
    rest = of_lang.agg(F.sum(F.when(F.col("nl") < min_rows, F.col("nl")))).first()[0] or 0
    n = stored(n, "mcd_counts", n.count())
    names = n.join(of_lang, F.col("_lang") == F.col("_l"))
    pool = F.when(F.col("n") >= min_rows, F.col("_full")).when(F.col("nl") >= min_rows, F.concat(F.lit("lang "), F.col("_lang"))).when(F.lit(rest >= min_rows), F.lit("all"))
    names = stored(names.select(F.col("_full").alias("_f"), pool.alias("group")), "mcd_groups", n.count())
    return attach(df, names, F.col("_full") == F.col("_f"), "left").drop("_lang", "_full", "_f")


N_VECTOR = range(len(VECTOR))
#: regularisation of a covariance's diagonal, in squared units
ADDED = [(f * UNIT) ** 2 for f in FLOOR]
NO_DETERMINANT = 1e300


def moments(df: DataFrame, share: str, keys: tuple[str, ...] = ("group", "start")) -> DataFrame:
    """Per key n, the mean m, the inverse a of the consistent, regularised covariance, and the logarithm of its determinant.

    share: an aggregate of the share of rows that df is.  Expressions are text here, as thousands of column objects a step take the driver seconds.
    """
    sums = [f"sum({VECTOR[i]}) AS s{i}" for i in N_VECTOR] + [f"sum({VECTOR[i]} * {VECTOR[j]}) AS q{i}{j}" for i, j in PAIRS]
    g = df.groupBy(*keys).agg(*map(F.expr, ["count(*) AS n", f"{share} AS _share", *sums])).withColumn("_c", consistent(F.col("_share")))
    g = g.selectExpr(*keys, "_c", "n", *[f"s{i} / n AS m{i}" for i in N_VECTOR], *[f"q{i}{j}" for i, j in PAIRS])
    return estimate(g, [f"m{i}" for i in N_VECTOR], {(i, j): f"(q{i}{j} / n - m{i} * m{j}) * _c" for i, j in PAIRS}, keys)


def estimate(g: DataFrame, mean: list[str], cov: dict[tuple[int, int], str], keys: tuple[str, ...]) -> DataFrame:
    full = {p: f"greatest({v}, 0D) + {ADDED[p[0]]!r}D" if p[0] == p[1] else v for p, v in cov.items()}
    return swept(g.selectExpr(*keys, *[f"cast({m} as double) AS m{i}" for i, m in enumerate(mean)], *["cast(%s as double) AS a%d%d" % (full[p], *p) for p in PAIRS]))


def swept(g: DataFrame) -> DataFrame:
    """a: a symmetric positive definite matrix; replaced by its inverse, with logdet (the pivots' logarithms)."""
    at = lambda i, j: "a%d%d" % (min(i, j), max(i, j))
    rest = [c for c in g.columns if c not in {at(*p) for p in PAIRS}]
    logdet = "0D"
    for k in N_VECTOR:
        d = at(k, k)
        new = {at(i, j): f"-1 / {d}" if i == k == j else f"{at(i, j)} / {d}" if k in (i, j) else f"{at(i, j)} - {at(i, k)} * {at(k, j)} / {d}" for i, j in PAIRS}
        g = g.selectExpr(*rest, *[f"{v} AS {c}" for c, v in new.items()], f"{logdet} + ln({d}) AS logdet")
        logdet = "logdet"
    return g.selectExpr(*rest, *[f"-{at(*p)} AS {at(*p)}" for p in PAIRS], "logdet")


def distance(df: DataFrame, g: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """df with d2, the squared Mahalanobis distance from its group's estimate (a row for each start that g has)."""
    parts = [f"m{i}" for i in N_VECTOR] + ["a%d%d" % p for p in PAIRS]
    names = ["start"] * ("start" in g.columns)
    g = g.selectExpr("group AS _g", *names, *parts)
    d2 = " + ".join(f"{1 if i == j else 2} * a{i}{j} * ({VECTOR[i]} - m{i}) * ({VECTOR[j]} - m{j})" for i, j in PAIRS)
    columns = [F.col(f"`{c}`") for c in df.columns]
    return attach(df, g, F.col("group") == F.col("_g"), how, rows).select(*columns, *names, F.expr(f"greatest(round({d2}, 6), 0D)").alias("d2"))


def quantile_bins(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Per key the lowest value at or under which at least the share of rows is, and the share that is (counted values, a window over them)."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    along = W.partitionBy(*keys).orderBy(value)
    n = n.withColumns({"_below": F.sum("_n").over(along), "_all": F.sum("_n").over(W.partitionBy(*keys))})
    enough = F.col("_below") >= F.ceil(F.col("_all") * share)
    best = n.groupBy(*keys).agg(F.min(F.when(enough, F.struct(value, "_below"))).alias("_best"), F.first("_all").alias("_all"))
    return best.select(*keys, F.col(f"_best.{value}").alias("cut"), (F.col("_best._below") / F.col("_all")).alias("share"))


def centres(core: DataFrame, groups: int) -> DataFrame:
    """Per group the medians m and the spreads d (median absolute deviation for normal rows) of the components, to 8 units."""
    each = lambda df, v: df.select("group", F.posexplode(F.array(*[v(i) for i in N_VECTOR])).alias("i", "v"))
    wide = lambda q, name: q.groupBy("group").agg(*[F.max(F.when(F.col("i") == i, F.col("cut"))).alias(f"{name}{i}") for i in N_VECTOR])
    middle = stored(wide(quantile_bins(each(core, lambda i: F.floor(F.col(VECTOR[i]) / 8) * 8 + 4), ["group", "i"], "v", 0.5), "m"), "mcd_middle", groups)
    off = attach(core, middle.withColumnRenamed("group", "_g"), F.col("group") == F.col("_g"), rows=groups)
    spread = wide(quantile_bins(each(off, lambda i: F.floor(F.abs(F.col(VECTOR[i]) - F.col(f"m{i}")) / 8) * 8), ["group", "i"], "v", 0.5), "d").withColumnRenamed("group", "_g")
    both = middle.join(spread, F.col("group") == F.col("_g"))
    return both.select("group", *[f"m{i}" for i in N_VECTOR], *[(F.col(f"d{i}") * 1.4826).alias(f"d{i}") for i in N_VECTOR])


def starts(core: DataFrame, groups: int) -> DataFrame:
    """The estimates (group, start, m, a, logdet) from which concentration sets out; their determinants don't count."""
    middle = stored(centres(core, groups), "mcd_centres", groups)
    diagonal = {(i, j): f"d{i} * d{i}" if i == j else "0D" for i, j in PAIRS}
    first = estimate(middle.withColumn("start", F.lit(0)), [f"m{i}" for i in N_VECTOR], diagonal, ("group", "start"))
    second = moments(core.withColumn("start", F.lit(1)), "max(1D)")
    # components drawn in by tanh, in units, and their moments brought back to the scale of the components
    width = [f"sqrt(d{i} * d{i} + {ADDED[i]!r}D)" for i in N_VECTOR]
    near = attach(core, middle.withColumnRenamed("group", "_g"), F.col("group") == F.col("_g"), rows=groups)
    drawn = near.selectExpr("group AS _g", *[f"cast(round(tanh(({x} - m{i}) / {width[i]}) * {UNIT}) as long) AS {x}" for i, x in enumerate(VECTOR)])
    sums = [f"sum({x}) AS s{i}" for i, x in enumerate(VECTOR)] + [f"sum({VECTOR[i]} * {VECTOR[j]}) AS q{i}{j}" for i, j in PAIRS]
    back = middle.join(drawn.groupBy("_g").agg(*map(F.expr, ["count(*) AS n", *sums])), F.col("group") == F.col("_g")).withColumn("start", F.lit(2))
    mean = [f"s{i} / n / {UNIT}" for i in N_VECTOR]
    cov = {(i, j): f"(q{i}{j} / n / {UNIT**2} - {mean[i]} * {mean[j]}) * {width[i]} * {width[j]}" for i, j in PAIRS}
    third = estimate(back, [f"m{i} + {mean[i]} * {width[i]}" for i in N_VECTOR], cov, ("group", "start"))
    return stored(reduce(DataFrame.unionByName, (first, second, third)).withColumn("logdet", F.lit(NO_DETERMINANT)), "mcd_starts", 3 * groups)


def concentrated(core: DataFrame, g: DataFrame, rows: int, subset: float, name: str) -> DataFrame:
    """g after a concentration step of the estimates that moved in the one before; one whose determinant doesn't fall stays, for good."""
    near = distance(core, g.where("moved").drop("moved"), rows).withColumn("_bin", F.floor(F.log1p("d2") * BINS).cast("long"))
    cut = quantile_bins(near, ["group", "start"], "_bin", subset).toDF("_g", "_s", "cut", "share")
    inner = attach(near, cut, (F.col("group") == F.col("_g")) & (F.col("start") == F.col("_s")), rows=rows).where("_bin <= cut")
    new = moments(inner, "first(share)")
    values = [f"m{i}" for i in N_VECTOR] + ["a%d%d" % p for p in PAIRS] + ["logdet"]
    new = new.select(F.col("group").alias("_g"), F.col("start").alias("_s"), F.struct(*values).alias("_new"))
    both = g.select("group", "start", F.struct(*values).alias("_old")).join(new, (F.col("group") == F.col("_g")) & (F.col("start") == F.col("_s")), "left")
    fell = F.coalesce(F.col("_new.logdet") < F.col("_old.logdet") - 1e-9, F.lit(False))
    return stored(both.select("group", "start", F.when(fell, F.col("_new")).otherwise(F.col("_old")).alias("_v"), fell.alias("moved")).select("group", "start", "_v.*", "moved"), name, rows)


def estimates(core: DataFrame, groups: int, subset: float = SUBSET) -> DataFrame:
    """The estimate (group, start, m, a, logdet) of the least determinant of each group of core (group, components)."""
    g, rows = starts(core, groups).withColumn("moved", F.lit(True)), 3 * groups
    for step in range(MAX_STEPS):
        if step == SCREENING:
            first = F.row_number().over(W.partitionBy("group").orderBy("logdet", "start"))
            g, rows = g.withColumn("_k", first).where("_k = 1").drop("_k"), groups
        g = concentrated(core, g, rows, subset, f"mcd_{step}")
        if step >= SCREENING and g.where("moved").isEmpty():
            break
    return g.drop("moved")


def outliers(df: DataFrame, subset: float = SUBSET, reject: float = REJECT) -> DataFrame:
    """df (group, base_failed, x0 to x4 in units) with d2 and kept."""
    core = df.where("NOT base_failed AND group IS NOT NULL").select("group", *VECTOR)
    groups = core.select("group").distinct().count()
    with scratch(df.sparkSession):
        g = estimates(core, groups, subset)
        near = distance(core, g, groups).where(F.col("d2") <= chi2_point(0.975, len(VECTOR)))
        g = kept(moments(near, "max(0.975D)").coalesce(1), "mcd_final")
    out = distance(df, g.drop("start"), groups, "left")
    inside = F.coalesce(F.col("d2") <= chi2_point(reject, len(VECTOR)), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, language and source of each row, its statistics, base_failed, group, d2 and kept; other columns are left out."""
    df = vectors(statistics(docs, text_col, (*keep, lang_col, source_col))).withColumn("base_failed", base_failed())
    return outliers(grouped(stored(df, "quality_vectors"), lang_col, source_col, min_rows))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_adjacent", F.col("group").alias("estimate"), "d2")
