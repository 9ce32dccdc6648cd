"""Quality rules: base counts, then robust multivariate outliers per language and source.

All of it is DataFrame and SQL expressions. The outlier test is a deterministic
minimum-covariance-determinant estimate for each (language, source). From each of STARTS
starts, concentration steps repeat "estimate mean and covariance of the closest share of the
group, measure Mahalanobis distances again", and the start whose covariance has the least
determinant counts; a last step re-estimates from everything within a chi-square cutoff.

To the sums of a group are added those of PRIOR rows like its language's, and to these of
PRIOR rows like all: one rule for groups of every size, which counts for little in a large
one. What a step needs from a group is sums of a row's products for each bin of distances, so
that they are aggregated before the shuffle and a source with a third of all rows is no
single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinweave.workspace import Workspace

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
_SPAN = 8

#: Features are rounded to multiples of 1/GRID, so that sums of products do not depend on
#: the order of addition and a verdict does not depend on the partitioning.
GRID = 4096
#: Histogram bins for each doubling of a squared distance.
BINS = 32
N_FEATURES = 4
#: Least standard deviation of each feature: what differs by less is ordinary variation. Most
#: texts have no symbols, no repeated lines and no repeated words, so three of the four may have
#: no spread of their own.
FLOOR = (0.16, 0.065, 0.16, 0.16)
#: Share of a group that a concentration step keeps.
CORE = 0.75
STEPS = 6
#: Median of the chi-square distribution with four degrees of freedom, its 0.75 and 0.975
#: quantiles, and the chi-square mass with six degrees below the 0.75 quantile.
CHI2_CORE, CHI2_WEIGHT, CORE_MASS6 = 5.385269, 11.143287, 0.504800
STARTS = 3
#: Rows like the language's, or like all, that count with those of a group.
PRIOR = 30.0
#: A document is rejected beyond the 0.999 quantile of chi-square with four degrees of freedom.
REJECT = 18.466827
MAX_BROADCAST, SALTS = 8 << 20, 32


def base_counts(text: Column) -> list[tuple[str, Column]]:
    """Named columns, in the order in which each may use the ones before."""
    whole = F.coalesce(text, F.lit(""))
    windows = F.when(
        F.size("_words") >= _SPAN,
        F.transform(F.sequence(F.lit(1), F.size("_words") - (_SPAN - 1)), lambda i: F.xxhash64(F.slice("_words", i, _SPAN))),
    ).otherwise(F.array().cast("array<bigint>"))
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.filter(
        "_placed",
        lambda x, i: ((i > 0) & (F.get("_placed", i - 1)["h"] == x["h"]))
        | (F.get("_placed", i + 1)["h"] == x["h"]),
    )
    repeats = F.array_sort(F.transform("_twice", lambda x: x["i"]))
    covered = F.aggregate(
        F.transform(
            "_repeats", lambda p, i: F.least(F.lit(_SPAN), F.coalesce(F.get("_repeats", i + 1) - p, F.lit(_SPAN)))
        ),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    no_placed = F.lit(None).cast("array<struct<h:bigint,i:int>>")
    return [
        ("_words", F.filter(F.split(whole, WORD_BREAK), lambda w: w != "")),
        ("_lines", F.filter(F.split(whole, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))),
        ("_windows", windows),
        ("n_words", F.size("_words").cast("long")),
        ("word_chars", F.char_length(F.array_join("_words", "")).cast("long")),
        ("n_symbols", F.char_length(F.regexp_replace(whole, SYMBOLS, "")).cast("long")),
        ("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
        ("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed).otherwise(no_placed)),
        ("_twice", twice),
        ("_repeats", repeats),
        ("n_repeat_words", F.when(F.col("_placed").isNull(), F.lit(0).cast("long")).otherwise(covered)),
    ]


def features() -> list[Column]:
    """Log mean word length, and square roots of three shares."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    raw = [
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_dup_lines") + F.lit(10.0))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return [F.round(x * GRID) / GRID for x in raw]


def _pairs() -> list[tuple[int, int]]:
    return [(a, b) for a in range(N_FEATURES) for b in range(a + 1)]


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


SUMS = ["n", *[f"s{a}" for a in range(N_FEATURES)], *[f"s{a}{b}" for a, b in _pairs()]]
PARAMS = [*[f"m{a}" for a in range(N_FEATURES)], *[f"l{a}{b}" for a, b in _pairs()]]


def _moments() -> list[Column]:
    x = [F.col(f"x{a}") for a in range(N_FEATURES)]
    return [
        F.count("*").cast("double").alias("n"),
        *[F.sum(x[a]).alias(f"s{a}") for a in range(N_FEATURES)],
        *[F.sum(x[a] * x[b]).alias(f"s{a}{b}") for a, b in _pairs()],
    ]


def _with_prior(moments: DataFrame) -> DataFrame:
    """Sums of (lang_key, grp, start) with PRIOR rows like the language's and like all."""
    total = lambda prefix: [F.sum(c).alias(f"{prefix}{c}") for c in SUMS]
    add = lambda own, more: [(F.col(f"{own}{c}") + F.col(f"{more}{c}") * F.coalesce(F.try_divide(F.lit(PRIOR), F.col(f"{more}n")), F.lit(0.0))).alias(f"{own}{c}") for c in SUMS]
    whole = moments.groupBy("start").agg(*total("w_"))
    langs = moments.groupBy("lang_key", "start").agg(*total("g_"))
    langs = langs.join(F.broadcast(whole), "start").select("lang_key", "start", *add("g_", "w_"))
    return moments.join(langs, ["lang_key", "start"]).select("lang_key", "grp", "start", *add("", "g_"))


def _estimate(moments: DataFrame, widen: float) -> DataFrame:
    """Mean and inverse Cholesky factor for each group and start.

    Covariances are multiplied by ``widen``, the consistency factor for the share that was
    kept, and the squared FLOOR is added to the variances.
    """
    out = _with_prior(moments).withColumns({f"m{a}": F.try_divide(F.col(f"s{a}"), F.col("n")) for a in range(N_FEATURES)})
    out = out.withColumns({
        f"c{a}{b}": F.lit(widen) * (F.try_divide(F.col(f"s{a}{b}"), F.col("n")) - F.col(f"m{a}") * F.col(f"m{b}"))
        + F.lit(FLOOR[a] ** 2 if a == b else 0.0)
        for a, b in _pairs()
    })
    for a, b in _pairs_by_column():
        left = F.col(f"c{a}{b}") - _sum([F.lit(0.0), *[F.col(f"l{a}{k}") * F.col(f"l{b}{k}") for k in range(b)]])
        out = out.withColumn(
            f"l{a}{b}", F.sqrt(F.greatest(left, F.lit(1e-9))) if a == b else left / F.col(f"l{b}{b}")
        )
    return out.select("lang_key", "grp", "start", *PARAMS)


def _pairs_by_column() -> list[tuple[int, int]]:
    return [(a, b) for b in range(N_FEATURES) for a in range(b, N_FEATURES)]


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for a in range(N_FEATURES):
        inner = _sum([F.lit(0.0), *[F.col(f"l{a}{k}") * F.col(f"z{k}") for k in range(a)]])
        rows = rows.withColumn(f"z{a}", (F.col(f"x{a}") - F.col(f"m{a}") - inner) / F.col(f"l{a}{a}"))
    return rows.withColumn("d2", _sum([F.col(f"z{a}") * F.col(f"z{a}") for a in range(N_FEATURES)]))


def _bin(value: Column) -> Column:
    return F.floor(F.log2(F.greatest(value, F.lit(2.0**-20))) * BINS).cast("int")


def _core(rows: DataFrame, share: float) -> DataFrame:
    """For each group and start the sums over the closest ``share`` of its rows.

    Rows are taken by bins of distance, up to the first by which the share has come. A group
    has some 1,500 bins at most, whatever its size.
    """
    bins = rows.groupBy("lang_key", "grp", "start", _bin(F.col("d2")).alias("bin")).agg(*_moments())
    by = Window.partitionBy("grp", "start")
    bins = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    near = bins.where(F.col("upto") - F.col("n") < F.col("all") * share)
    return near.groupBy("lang_key", "grp", "start").agg(*[F.sum(c).alias(c) for c in SUMS])


def _medians(points: DataFrame) -> DataFrame:
    """Coordinate-wise medians, spreads from the quartiles, no correlation."""
    long = points.select(
        "lang_key", "grp", F.posexplode(F.array(*[F.col(f"x{a}") for a in range(N_FEATURES)])).alias("a", "x")
    ).groupBy("lang_key", "grp", "a", F.floor(F.col("x") * 128).alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("grp", "a")
    placed = long.select(
        "lang_key", "grp", "a", "bin", F.sum("n").over(by.orderBy("bin")).alias("upto"), F.sum("n").over(by).alias("all")
    )

    def at(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("bin"))) / F.lit(128.0)

    found = placed.groupBy("lang_key", "grp", "a").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("wide"))
    one = lambda a, c: F.max(F.when(F.col("a") == a, F.col(c)))
    return found.groupBy("lang_key", "grp").agg(
        F.lit(0).alias("start"),
        *[one(a, "mid").alias(f"m{a}") for a in range(N_FEATURES)],
        *[
            (F.sqrt(one(a, "wide") * one(a, "wide") + FLOOR[a] ** 2) if a == b else F.lit(0.0)).alias(f"l{a}{b}")
            for a, b in _pairs()
        ],
    )


def _starts(points: DataFrame, looked: _Looked, work: Workspace) -> DataFrame:
    """Estimates to start from: medians and quartiles, the half closest to these, and all rows."""
    medians = work.table(_medians(points), "medians")
    half = _estimate(_core(_distance(looked.join(points, medians.drop("lang_key"), ["grp"])), 0.5).withColumn("start", F.lit(1)), 1.0)
    every = _estimate(points.groupBy("lang_key", "grp").agg(F.lit(2).alias("start"), *_moments()), 1.0)
    return medians.unionByName(half).unionByName(every)


class _Looked:
    """Joins of rows with a small table by group.

    The table is broadcast if the groups' names and numbers stay under MAX_BROADCAST bytes.
    Otherwise rows are salted and the table repeated for each salt, so that a group with a
    third of all rows meets it in many tasks.
    """

    def __init__(self, groups: DataFrame) -> None:
        size = groups.agg(F.sum(F.lit(STARTS) * (F.octet_length("grp") + 8 * 20))).first()[0] or 0
        self.small = size <= MAX_BROADCAST

    def join(self, rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        if self.small:
            return rows.join(F.broadcast(table), keys, how)
        rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.join(table, [*keys, "_salt"], how).drop("_salt")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """Base counts, ``base_failed``, ``distance2`` and ``kept`` for each row.

    ``keep`` names input columns to carry along. Words are maximal runs without ASCII white
    space. ``base_failed`` holds under 20 words or if over 30 % of the words lie in 8-word
    windows that occur twice in the text. Of the other rows, those whose statistics lie further
    than REJECT from their group's robust centre are not kept.

    A null or empty text has no words and fails. Null languages and sources are values like
    any other. Repeated rows count as often as they occur. Quartiles and shares are taken at
    whole bins, and rows that tie in a bin are taken together. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "quality")
    carried = [c for c in (keep or []) if c != id_col]
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.struct(*carried).alias("_carried") if carried else F.lit(None).cast("string").alias("_carried"),
        F.to_json(F.array(F.col(lang_col).cast("string"))).alias("lang_key"),
        F.to_json(F.array(F.col(source_col).cast("string"))).alias("source_key"),
        F.col(text_col).alias("_text"),
    )
    counted = base_counts(F.col("_text"))
    for name, value in counted:
        rows = rows.withColumn(name, value)
    names = [n for n, _ in counted if not n.startswith("_")]
    rows = rows.select("_id", "_carried", "lang_key", "source_key", *names).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    ).withColumns({f"x{a}": x for a, x in enumerate(features())})
    rows = work.table(rows, "counts")

    rows = rows.withColumn("grp", F.concat("lang_key", "source_key"))
    points = rows.where("not base_failed").select("lang_key", "grp", *[f"x{a}" for a in range(N_FEATURES)])
    points = work.table(points, "points")
    groups = work.table(points.select("lang_key", "grp").distinct(), "groups")
    looked = _Looked(groups)
    measure = lambda params: _distance(looked.join(points, params.drop("lang_key"), ["grp"]))
    params = work.table(_starts(points, looked, work), "starts")
    widen = CORE / CORE_MASS6
    for k in range(STEPS):
        params = work.table(_estimate(_core(measure(params), CORE), widen), f"step-{k}")
    spread = _sum([F.log(F.col(f"l{a}{a}")) for a in range(N_FEATURES)])
    least = params.groupBy("lang_key", "grp").agg(F.min_by(F.struct("start", *PARAMS), F.struct(F.round(spread, 9), "start")).alias("p"))
    params = least.select("lang_key", "grp", "p.*")
    near = measure(params).where(F.col("d2") <= CHI2_WEIGHT).groupBy("lang_key", "grp").agg(*_moments())
    far = groups.join(near.select("grp"), "grp", "left_anti").select("lang_key", "grp", *[F.lit(0.0).alias(c) for c in SUMS])  # the prior alone
    params = _estimate(near.unionByName(far).withColumn("start", F.lit(0)), 1.0)
    params = work.table(params, "final").drop("lang_key", "start")

    out = _distance(looked.join(rows, params, ["grp"], "left"))
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return out.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_carried.{c}").alias(c) for c in carried],
        *names,
        "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= REJECT)).alias("kept"),
        distance.alias("distance2"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
