"""Statistics of per-query scores: ranks, resampling and regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.plans.lineage import cut
from corpuslens.plans.numbering import average_ranks, with_index

PRIME = 2_147_483_647


def scrambled(x: Column) -> Column:
    """A pseudo-random number below PRIME from an integer, in operations that any SQL engine has and no overflow."""
    y = F.pmod(x, F.lit(PRIME))
    for add in (7, 101, 977):
        y = F.pmod(y * y + 3 * y + add, F.lit(PRIME))
    return y


def draws(spark, replicates: int, n: int, size: int) -> DataFrame:
    """_b, _i, _idx: for each replicate _b, `size` draws of a place in 0..n-1, with replacement."""
    x = F.col("id") * 7919 + 12345
    r = spark.range(replicates * size, numPartitions=max(8, replicates * size // 2_000_000)).withColumn("_idx", F.pmod(scrambled(x), F.lit(max(1, n))))
    return r.select(F.floor(F.col("id") / size).cast("bigint").alias("_b"), F.pmod("id", F.lit(size)).alias("_i"), "_idx")


def placed(values: DataFrame, order: str) -> DataFrame:
    """`values` with _idx from 0 in the order of `order`."""
    return with_index(values, [order])


#: Rows of a few doubles that every task may hold while it draws from them: at most about 20 MB.
SHARED_ROWS = 250_000


def _drawn_rows(values: DataFrame, columns: list[str], n: int, replicates: int, size: int, reduce, schema: str) -> DataFrame:
    """The rows that `reduce` makes of (numbers of some replicates, their drawn rows as replicates x size x columns).

    For values whose number n was checked against SHARED_ROWS: they are broadcast, and each task draws for its replicates
    by the same hash as `draws`.
    """
    spark = values.sparkSession
    rows = sorted(values.select("_idx", *columns).collect())
    shared = spark.sparkContext.broadcast(np.array([r[1:] for r in rows], dtype="float64").reshape(n, len(columns)))
    step = max(1, 2_000_000 // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.column("id").to_numpy()[at : at + step]
                y = ((b[:, None] * size + np.arange(size)) * 7919 + 12345) % PRIME
                for add in (7, 101, 977):
                    y = (y * y + 3 * y + add) % PRIME
                yield reduce(b, matrix[y % n])

    return spark.range(replicates, numPartitions=min(replicates, max(8, replicates * size // 4_000_000))).mapInArrow(run, schema)


def replicate_means(values: DataFrame, columns: list[str], order: str, replicates: int, size: int | None = None, shared_rows: int = SHARED_ROWS) -> DataFrame:
    """_b and the mean of each column over the replicate's draws.

    Up to `shared_rows` values are held by every task; more are joined with the draws by their places. Null values are left
    out of a mean, for which the join is used.
    """
    p = cut(placed(values.select(order, *columns), order))
    counts = p.agg(F.count("*").alias("n"), F.count(F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) > 0, 1)).alias("gaps")).first()
    n = counts["n"]
    if not n:
        return p.select(F.lit(0).cast("bigint").alias("_b"), *columns).limit(0)
    if n <= shared_rows and not counts["gaps"] and (size or n):

        def means(b: np.ndarray, drawn: np.ndarray) -> pa.RecordBatch:
            m = drawn.mean(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(b), *(pa.array(m[:, k]) for k in range(len(columns)))], names=["_b", *columns])

        return _drawn_rows(p, columns, n, replicates, size or n, means, ", ".join(["_b bigint", *(f"`{c}` double" for c in columns)]))
    drawn = draws(values.sparkSession, replicates, n, size or n)
    return drawn.join(p, "_idx").groupBy("_b").agg(*[F.avg(c).alias(c) for c in columns])


def paired_bootstrap(values: DataFrame, a: str, b: str, order: str, replicates: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """mean_diff, ci_lo, ci_hi, p_a_gt_b of the mean of a - b, by resampling the pairs."""
    d = cut(values.select(order, (F.col(a) - F.col(b)).alias("diff")))
    boot = replicate_means(d, ["diff"], order, replicates)
    ci = boot.agg(
        F.percentile("diff", F.lit(alpha / 2)).alias("ci_lo"), F.percentile("diff", F.lit(1 - alpha / 2)).alias("ci_hi"),
        F.avg((F.round("diff", 12) > 0).cast("double")).alias("p_a_gt_b"),
    )
    return d.agg(F.avg("diff").alias("mean_diff")).join(F.broadcast(ci))  # one row each


def summary(trials: DataFrame, columns: list[str]) -> DataFrame:
    """method, n_trials, mean, q025, q975, std of each column."""
    long = trials.select(F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("method").agg(
        F.count("*").alias("n_trials"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("q025"),
        F.percentile("v", F.lit(0.975)).alias("q975"), F.stddev_samp("v").alias("std"),
    )


def spearman(values: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """relationship, n, spearman_rho: Pearson's correlation of average ranks, for each (name, x, y) of columns."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("relationship"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for n, x, y in pairs])).alias("p")
    long = cut(values.select(each).select("p.*").where("x IS NOT NULL AND y IS NOT NULL").select("relationship", F.round("x", 9).alias("x"), F.round("y", 9).alias("y")))
    sides = [long.select(F.concat("relationship", F.lit(f"|{c}")).alias("side"), F.col(c).alias("v")) for c in ("x", "y")]
    ranks = cut(average_ranks(sides[0].unionByName(sides[1]), "side", "v"))
    for c in ("x", "y"):
        own = ranks.select(F.col("side").alias(f"side_{c}"), F.col("v").alias(c), F.col("rank").alias(f"r{c}"))
        long = long.withColumn(f"side_{c}", F.concat("relationship", F.lit(f"|{c}"))).join(own, [f"side_{c}", c])
    return long.groupBy("relationship").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman_rho"))


def with_p_value(rho: DataFrame) -> DataFrame:
    """`spearman`'s rows with the two-sided p-value of Student's t with n - 2 degrees of freedom."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(float(x), int(k)) for x, k in zip(r, n, strict=True)], dtype="float64")

    return rho.withColumn("p_value", p("spearman_rho", "n"))


def t_two_sided(r: float, n: int) -> float:
    if not n > 2 or r != r:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return incomplete_beta(df / 2, 0.5, 1 - r * r)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1) if f != 1 else front


def wilcoxon(values: DataFrame, a: str, b: str) -> DataFrame:
    """n_nonzero, w_plus, w_minus, w, tie_sum, a_wins, b_wins, ties: the signed-rank statistic of a - b, zeros dropped.

    tie_sum is the sum of t^3 - t over groups of equal differences, for the variance.
    """
    d = values.select(F.round(F.col(a) - F.col(b), 9).alias("d"))
    nonzero = d.where("d <> 0").select("d", F.abs("d").alias("size"))
    ranks = average_ranks(nonzero.withColumn("_all", F.lit(1)), "_all", "size").select("size", F.col("rank").alias("r"))
    groups = nonzero.groupBy("size", "d").agg(F.count("*").alias("m")).join(ranks, "size")
    tied = nonzero.groupBy("size").agg(F.count("*").alias("t"))
    plus, minus = (F.coalesce(F.sum(F.when(c, F.col("r") * F.col("m"))), F.lit(0.0)) for c in (F.col("d") > 0, F.col("d") < 0))
    w = groups.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_nonzero"), plus.alias("w_plus"), minus.alias("w_minus"), F.least(plus, minus).alias("w"))
    ties = tied.agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).cast("double").alias("tie_sum"))
    w = w.join(F.broadcast(ties))
    wins = d.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("a_wins", F.col("d") > 0), ("b_wins", F.col("d") < 0), ("ties", F.col("d") == 0))])
    return w.join(F.broadcast(wins))  # one row each


def wilcoxon_p(n: int, w: float, tie_sum: float) -> float:
    """The two-sided p-value by the normal approximation with tie correction, without continuity correction."""
    variance = n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * variance)) if variance > 0 else float("nan")


def stratify(values: DataFrame, by: str, order: str, means: list[str]) -> DataFrame:
    """stratum (0 to 2), n_queries and the mean of each column in thirds by rank, ties broken by `order`.

    The cuts are those of quantile bins over ranks: r goes to 0, 1 or 2 as 3 (r - 1) reaches n - 1 and 2 (n - 1).
    """
    keep = values.select(order, F.round(by, 9).alias("_by"), *[m for m in means if m != order])
    ranked = cut(with_index(keep, ["_by", order], "r"))
    ranked = ranked.withColumn("n", F.lit(ranked.count()))
    bin_ = (3 * F.col("r") >= F.col("n") - 1).cast("int") + (3 * F.col("r") >= 2 * (F.col("n") - 1)).cast("int")
    return ranked.groupBy(bin_.alias("stratum")).agg(F.count("*").alias("n_queries"), *[F.avg(m).alias(m) for m in means])


def moments(values: DataFrame, xs: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """The sums from which a regression of y on xs is solved: one pass, whatever the number of rows."""
    cols = [*xs, y]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols]]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return values.groupBy(*(by or [])).agg(*sums)


def solve(row: dict, xs: list[str], y: str, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Intercept and coefficients for xs standardised by `mean` and `std`, from the sums of `moments`."""
    k = len(xs)
    gram, right = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
    gram[0, 0], right[0] = row["n"], row[f"s_{y}"]
    for i, a in enumerate(xs):
        gram[0, i + 1] = gram[i + 1, 0] = (row[f"s_{a}"] - row["n"] * mean[i]) / std[i]
        right[i + 1] = (row[f"s_{a}_{y}"] - mean[i] * row[f"s_{y}"]) / std[i]
        for j in range(i, k):
            s = row[f"s_{a}_{xs[j]}"] - mean[i] * row[f"s_{xs[j]}"] - mean[j] * row[f"s_{a}"] + row["n"] * mean[i] * mean[j]
            gram[i + 1, j + 1] = gram[j + 1, i + 1] = s / (std[i] * std[j])
    return np.linalg.lstsq(gram, right, rcond=None)[0]


def centre(row: dict, xs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population standard deviations; a constant column keeps a deviation of 1."""
    mean = np.array([row[f"s_{a}"] / row["n"] for a in xs])
    std = np.sqrt(np.maximum([row[f"s_{a}_{a}"] / row["n"] for a in xs] - mean**2, 0))
    return mean, np.where(std > 0, std, 1.0)


def ols(values: DataFrame, xs: list[str], y: str) -> DataFrame:
    """feature, coef, r2: ordinary least squares of y on standardised xs, and the share of y's variance that it explains."""
    row = moments(values, xs, y).first().asDict()
    coef, r2 = [float("nan")] * (len(xs) + 1), float("nan")
    if row["n"]:
        mean, std = centre(row, xs)
        coef = solve(row, xs, y, mean, std)
        right = [(row[f"s_{x}_{y}"] - mean[i] * row[f"s_{y}"]) / std[i] for i, x in enumerate(xs)]
        total = row[f"s_{y}_{y}"] - row[f"s_{y}"] ** 2 / row["n"]
        r2 = float(np.dot(coef[1:], right) / total) if total > 0 else float("nan")
    return values.sparkSession.createDataFrame([(n, float(c), r2) for n, c in zip(["Intercept", *xs], coef, strict=True)], "feature string, coef double, r2 double")


def ols_bootstrap(values: DataFrame, xs: list[str], y: str, order: str, replicates: int = 10_000, shared_rows: int = SHARED_ROWS) -> DataFrame:
    """feature, coef, ci_lo, ci_hi, p_boot, sig: OLS with percentile intervals over resampled rows.

    The features are standardised once. Each replicate is reduced to its moment sums by Spark; only the small systems
    are solved in Python. p_boot is the one-sided share of replicates on the other side of 0 (1 for a coefficient of 0).
    """
    values = cut(values.select(order, *xs, y))
    row = moments(values, xs, y).first().asDict()
    mean, std = centre(row, xs)
    coef = solve(row, xs, y, mean, std)
    names = ["Intercept", *xs]
    p = cut(placed(values.select(order, *xs, y), order))
    if row["n"] <= shared_rows:

        def fitted(b: np.ndarray, drawn: np.ndarray) -> pa.RecordBatch:
            x = np.concatenate([np.ones((*drawn.shape[:2], 1)), (drawn[:, :, :-1] - mean) / std], axis=2)
            own = [np.linalg.lstsq(a.T @ a, a.T @ v, rcond=None)[0] for a, v in zip(x, drawn[:, :, -1], strict=True)]
            columns = [pa.array(np.repeat(b, len(names))), pa.array(names * len(own)), pa.array(np.concatenate(own))]
            return pa.RecordBatch.from_arrays(columns, names=["b", "feature", "boot"])

        boot = _drawn_rows(p, [*xs, y], row["n"], replicates, row["n"], fitted, "b bigint, feature string, boot double")
        return _intervals(boot, names, coef)
    sums = moments(draws(values.sparkSession, replicates, row["n"], row["n"]).join(p, "_idx"), xs, y, ["_b"])

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [solve(r, xs, y, mean, std) for r in batch.to_dict("records")]
            yield pd.DataFrame({"b": np.repeat(batch["_b"].to_numpy(), len(names)), "feature": names * len(own), "boot": np.concatenate(own) if own else []})

    boot = sums.mapInPandas(solved, "b bigint, feature string, boot double")
    return _intervals(boot, names, coef)


def _intervals(boot: DataFrame, names: list[str], coef: np.ndarray) -> DataFrame:
    points = F.broadcast(boot.sparkSession.createDataFrame([(n, float(c)) for n, c in zip(names, coef, strict=True)], "feature string, coef double"))
    beyond = F.avg((F.col("boot") * F.signum("coef") <= 0).cast("double"))
    out = boot.join(points, "feature").groupBy("feature", "coef").agg(
        F.percentile("boot", F.lit(0.025)).alias("ci_lo"), F.percentile("boot", F.lit(0.975)).alias("ci_hi"), beyond.alias("p")
    )
    p_boot = F.round(F.when(F.col("coef") == 0, 1.0).otherwise(F.col("p")), 4)
    return out.select("feature", "coef", "ci_lo", "ci_hi", p_boot.alias("p_boot"), stars(p_boot).alias("sig"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
