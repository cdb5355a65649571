"""Conditional-independence tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from causeway.functions.columns import fisher_z, partial_correlation_1
from causeway.functions.tails import chi2_tail, gamma_quantile, normal_two_sided
from causeway.operators.moments import Moments, moments

#: The power of each member of the family.
POWERS = {"chi2": 1.0, "g2": 0.0, "freeman_tukey": -0.5, "modify_log_likelihood": -1.0, "neyman": -2.0, "cressie_read": 2 / 3}


# --- continuous ------------------------------------------------------------


def partial_correlation(m: Moments, x: int, y: int, given: list[int]) -> float:
    """Correlation of two columns given others, from the moments alone."""
    at = [x, y, *given]
    c = m.corr[np.ix_(at, at)]
    try:
        p = np.linalg.inv(c)
    except np.linalg.LinAlgError:
        p = np.linalg.pinv(c)
    return float(np.clip(-p[0, 1] / math.sqrt(abs(p[0, 0] * p[1, 1])), -0.99999, 0.99999))


def fisherz_p(m: Moments, x: int, y: int, given: list[int]) -> float | None:
    """p-value of independence; None where n is too small for the statistic."""
    spare = m.n - len(given) - 3
    if spare <= 0:
        return None
    r = partial_correlation(m, x, y, given)
    return normal_two_sided(math.sqrt(spare) * 0.5 * math.log1p(2 * r / (1 - r)))


def fisherz_test(df: DataFrame, x: str, y: str, z: list[str] = ()) -> float | None:
    return fisherz_p(moments(df, [x, y, *z]), 0, 1, list(range(2, 2 + len(z))))


def fisherz_statistic(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """One row (n, r, statistic) for no conditioning column or one, without leaving the plan."""
    cols = [F.col(f"`{c}`") for c in ((x, y) if z is None else (x, y, z))]
    rows = df.select(*[c.alias(n) for c, n in zip(cols, "xyz", strict=False)]).na.drop("any")
    xy = F.corr("x", "y")
    r = xy if z is None else partial_correlation_1(xy, F.corr("x", "z"), F.corr("y", "z"))
    return rows.agg(F.count(F.lit(1)).alias("n"), r.alias("r")).select("n", "r", fisher_z(F.col("r"), F.col("n"), int(z is not None)).alias("statistic"))


# --- discrete --------------------------------------------------------------


def contingency(df: DataFrame, x: str, y: str, z: list[str] = ()) -> DataFrame:
    """z..., x, y, observed, expected of every cell: all pairs of the levels that a stratum has.

    One aggregation of the rows; everything after it runs on cells.
    """
    zs = [f"z{i}" for i in range(len(z))]
    cells = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip([*z, x, y], [*zs, "x", "y"], strict=True)]).groupBy(*zs, "x", "y").agg(F.count(F.lit(1)).alias("observed"))
    return _with_expected(cells, zs)


def _with_expected(cells: DataFrame, zs: list[str]) -> DataFrame:
    of_x = cells.groupBy(*zs, "x").agg(F.sum("observed").alias("in_x"))
    of_y = cells.groupBy(*zs, "y").agg(F.sum("observed").alias("in_y"))
    total = cells.groupBy(*zs).agg(F.sum("observed").alias("in_all"), F.array_sort(F.collect_set("y")).alias("ys"))
    grid = _on(of_x, total, zs).withColumn("y", F.explode("ys")).drop("ys")
    grid = _on(_on(grid, of_y, [*zs, "y"]), cells, [*zs, "x", "y"], "left")
    return grid.select(*zs, "x", "y", F.coalesce("observed", F.lit(0)).cast("double").alias("observed"), (F.col("in_x") * F.col("in_y") / F.col("in_all")).alias("expected"))


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; without keys, the right side is one row and is attached as it is."""
    if not keys:
        return left.join(F.broadcast(right.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"), how).drop("_one")
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_{k}" for k in keys])


def divergence_term(observed: Column, expected: Column, power: float) -> Column:
    """One cell's contribution to the power divergence."""
    none = observed == 0
    if power == 1:
        return (observed - expected) * (observed - expected) / expected
    if power == 0:
        return F.when(none, F.lit(0.0)).otherwise(2 * observed * F.log(observed / expected))
    if power == -1:
        return F.when(none, F.lit(float("inf"))).otherwise(2 * expected * F.log(expected / observed))
    ratio = observed * (F.pow(observed / expected, F.lit(power)) - 1) / (0.5 * power * (power + 1))
    return F.when(none, F.lit(float("nan"))).otherwise(ratio) if power < 0 else ratio


def power_divergence(df: DataFrame, x: str, y: str, z: list[str] = (), power: float | str = 0.0) -> DataFrame:
    """One row (statistic, dof). Tables of two rows and two columns get Yates' correction.

    Strata add up; a stratum with one level of x or y adds nothing.
    """
    return _divergence(contingency(df, x, y, z), [f"z{i}" for i in range(len(z))], [], power)


def _divergence(cells: DataFrame, zs: list[str], by: list[str], power: float | str) -> DataFrame:
    power = POWERS[power] if isinstance(power, str) else power
    shape = cells.groupBy(*zs).agg(F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny")).withColumn("dof", (F.col("nx") - 1) * (F.col("ny") - 1))
    cells = _on(cells, shape, zs).filter("dof > 0")
    gap = F.col("expected") - F.col("observed")
    corrected = F.when(F.col("dof") == 1, F.col("observed") + F.signum(gap) * F.least(F.lit(0.5), F.abs(gap))).otherwise(F.col("observed"))
    of_stratum = cells.groupBy(*zs, "dof").agg(F.sum(divergence_term(corrected, F.col("expected"), power)).alias("statistic"))
    return of_stratum.groupBy(*by).agg(F.coalesce(F.sum("statistic"), F.lit(0.0)).alias("statistic"), F.coalesce(F.sum("dof"), F.lit(0)).cast("long").alias("dof"))


def discrete_test(df: DataFrame, x: str, y: str, z: list[str] = (), power: float | str = 0.0) -> tuple[float, int, float]:
    """(statistic, dof, p)."""
    row = power_divergence(df, x, y, z, power).first()
    return row["statistic"], row["dof"], chi2_tail(row["statistic"], row["dof"])


def discrete_tests(df: DataFrame, tests: list[tuple[str, str, list[str]]], power: float | str = 0.0) -> list[tuple[float, int, float]]:
    """discrete_test() of many (x, y, z) by one aggregation of the rows; counts of a task are merged before they are sent.

    Levels are told apart by their text.
    """
    kinds = dict(df.dtypes)

    def level(c: str) -> Column:
        v = F.col(f"`{c}`")
        return (v + 0.0 if kinds[c] in ("double", "float") else v).cast("string")  # -0.0 is 0.0

    asked = [F.struct(F.lit(i).alias("test"), F.array(*[level(c) for c in z]).cast("array<string>").alias("given"), level(x).alias("x"), level(y).alias("y")) for i, (x, y, z) in enumerate(tests)]
    keys = ["test", "given"]
    cells = df.select(F.inline(F.array(*asked))).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("observed"))
    found = {r["test"]: (r["statistic"], r["dof"]) for r in _divergence(_with_expected(cells, keys), keys, ["test"], power).collect()}
    out = [found.get(i, (0.0, 0)) for i in range(len(tests))]
    return [(statistic, dof, chi2_tail(statistic, dof)) for statistic, dof in out]


# --- kernel ----------------------------------------------------------------


def _blocks(df: DataFrame, x: str, y: str, block: int) -> tuple[DataFrame, int, int]:
    """Blocks (b, xs, ys) of the rows that have both values, the number of rows, and the number of blocks.

    A row's block is a hash of its values and of its number among equal rows, so a
    task that runs again after a lost executor makes the same blocks.
    """
    rows = df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y")).na.drop("any")
    counted = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    n = counted.agg(F.sum("n")).first()[0] or 0
    k = max(1, -(-n // block))
    rows = counted.select("x", "y", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).withColumn("b", F.pmod(F.xxhash64("x", "y", "i"), F.lit(k)).cast("int"))
    return rows.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("rows")).select("b", F.col("rows.x").alias("xs"), F.col("rows.y").alias("ys")), n, k


def _block_pairs(blocks: DataFrame, k: int) -> DataFrame:
    """Every pair of blocks once, each block with itself too: block b meets the next k // 2 ones around the circle,
    so all blocks have as many partners."""
    half = k // 2
    left = blocks.select(*[F.col(c).alias(f"{c}_1") for c in blocks.columns], F.explode(F.sequence(F.lit(0), F.lit(half))).alias("step"))
    if k % 2 == 0:
        left = left.filter((F.col("step") < half) | (F.col("b_1") < half))
    left = left.withColumn("b_2", ((F.col("b_1") + F.col("step")) % k).cast("int")).drop("step")
    return left.join(blocks.select(*[F.col(c).alias(f"{c}_2") for c in blocks.columns]), "b_2")


def _gap_medians(pairs: DataFrame) -> list[float]:
    """Median of the positive squared gaps between rows, of x and of y; 1 where there is none.

    Positive doubles order as their bits do, so four passes over the block pairs
    count 16 bits each, of the gaps that agree with the median in all higher bits.
    No gap leaves its task, and at most 65,536 counters a median do.
    """
    slots = [(c, side) for c in range(2) for side in range(2)]  # the lower and the upper middle of each
    prefix, rank = dict.fromkeys(slots, 0), {}
    for level in range(4):
        shift = 48 - 16 * level
        wanted = sorted({(c, prefix[c, side]) for c, side in slots})

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, level: int = level, wanted: list = wanted) -> Iterator[pa.RecordBatch]:
            held = {w: np.zeros(1 << 16, dtype=np.int64) for w in wanted}
            for x1, x2, y1, y2, same in _pairs(batches):
                for c, (a, b) in enumerate(((x1, x2), (y1, y2))):
                    gaps = (a[:, None] - b[None, :]) ** 2
                    gaps = gaps[np.triu_indices(len(a), 1)] if same else gaps.ravel()
                    bits = gaps[gaps > 0].view(np.int64)
                    for column, high in wanted:
                        if column == c:
                            own = bits if level == 0 else bits[bits >> (shift + 16) == high]
                            held[column, high] += np.bincount((own >> shift) & 0xFFFF, minlength=1 << 16)
            for (column, high), counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"c": pa.array(np.full(len(at), column, np.int32)), "high": pa.array(np.full(len(at), high, np.int64)), "bin": pa.array(at.astype(np.int32)), "n": pa.array(counts[at])})

        counts = {w: np.zeros(1 << 16, dtype=np.int64) for w in wanted}
        for r in pairs.mapInArrow(count, "c int, high long, bin int, n long").groupBy("c", "high", "bin").agg(F.sum("n").alias("n")).collect():
            counts[r["c"], r["high"]][r["bin"]] = r["n"]
        for c, side in slots:
            below = np.cumsum(counts[c, prefix[c, side]])
            if level == 0:
                rank[c, side] = (below[-1] - 1 + side) // 2
            at = int(np.searchsorted(below, rank[c, side], side="right")) if below[-1] else 0
            rank[c, side] -= below[at - 1] if at else 0
            prefix[c, side] = prefix[c, side] << 16 | at
    value = {s: float(np.array([prefix[s]], dtype=np.int64).view(np.float64)[0]) for s in slots}
    return [(value[c, 0] + value[c, 1]) / 2 or 1.0 for c in range(2)]


def hsic_test(df: DataFrame, x: str, y: str, alpha: float = 0.05, normalize: bool = True, block: int = 1024, exact: bool = False) -> dict:
    """Hilbert-Schmidt independence test with Gaussian kernels of median width and a gamma limit.

    Returns statistic, threshold and independent (0/1). The kernels are replaced by
    incomplete Cholesky factors, so the work grows with the rows. With exact, in time quadratic in the
    rows, the kernel matrices still never exist: pairs of row blocks give the counts that find the
    widths, then row sums, then the centred products. Under six rows the limit is
    not defined, and the columns count as independent.
    """
    from causeway.operators.frame import standardise

    if normalize:
        df = standardise(df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")), ["x", "y"])
        x, y = "x", "y"
    if not exact:
        return _hsic_by_factors(df, x, y, alpha)
    blocks, n, k = _blocks(df, x, y, block)
    if n < 6:
        return {"statistic": 0.0, "threshold": math.inf, "independent": 1}
    blocks = blocks.persist()
    try:
        pairs = _block_pairs(blocks, k)
        width = [math.sqrt(0.5 * m) for m in _gap_medians(pairs)]

        def kernels(x1, x2, y1, y2):
            return (np.exp(-((a[:, None] - b[None, :]) ** 2) / 2 / w**2) for a, b, w in ((x1, x2, width[0]), (y1, y2, width[1])))

        def row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    k, m = kernels(*(np.array(r[c]) for c in ("xs_1", "xs_2", "ys_1", "ys_2")))
                    sides = [(r["b_1"], 1)] if r["b_1"] == r["b_2"] else [(r["b_1"], 1), (r["b_2"], 0)]
                    for b, axis in sides:
                        yield pa.RecordBatch.from_pydict({"b": pa.array([b] * k.shape[1 - axis], pa.int32()), "i": pa.array(range(k.shape[1 - axis]), pa.int32()), "kx": k.sum(axis=axis), "ky": m.sum(axis=axis)})

        sums = pairs.mapInArrow(row_sums, "b int, i int, kx double, ky double").groupBy("b", "i").agg(F.sum("kx").alias("kx"), F.sum("ky").alias("ky"))
        sums = sums.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("i", "kx", "ky"))).alias("s")).select("b", F.col("s.kx").alias("kx"), F.col("s.ky").alias("ky")).persist()
        total = sums.agg(*[F.sum(F.aggregate(c, F.lit(0.0), lambda a, v: a + v)).alias(c) for c in ("kx", "ky")]).first()
        tx, ty = total["kx"] / n**2, total["ky"] / n**2
        joined = pairs.join(sums.withColumnsRenamed({"b": "b_1", "kx": "kx_1", "ky": "ky_1"}), "b_1").join(sums.withColumnsRenamed({"b": "b_2", "kx": "kx_2", "ky": "ky_2"}), "b_2")

        def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    k, m = kernels(*(np.array(r[c]) for c in ("xs_1", "xs_2", "ys_1", "ys_2")))
                    kc, mc = (a - np.array(r[f"{c}_1"])[:, None] / n - np.array(r[f"{c}_2"])[None, :] / n + t for a, c, t in ((k, "kx", tx), (m, "ky", ty)))
                    product, same = kc * mc, r["b_1"] == r["b_2"]
                    times = 1 if same else 2
                    squares = product**2
                    yield pa.RecordBatch.from_pydict({"s": [times * product.sum()], "q": [times * squares.sum() - (np.trace(squares) if same else 0.0)]})

        got = joined.mapInArrow(centred, "s double, q double").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).first()
        sums.unpersist()
    finally:
        blocks.unpersist()
    return _hsic_outcome(n, got["s"], got["q"], (total["kx"], total["ky"]), alpha)


def _hsic_by_factors(df: DataFrame, x: str, y: str, alpha: float) -> dict:
    from causeway.operators import lowrank

    rows = lowrank.numbers(df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")), ["x", "y"]).persist()
    try:
        if len(rows.limit(6).collect()) < 6:
            return {"statistic": 0.0, "threshold": math.inf, "independent": 1}
        return _hsic_outcome(*lowrank.hsic_moments(rows, ["x", "y"], [math.sqrt(0.5 * m) for m in lowrank.gap_medians(rows, ["x", "y"])]), alpha)
    finally:
        rows.unpersist()


def _hsic_outcome(n: int, trace: float, squares: float, sums: tuple[float, float], alpha: float) -> dict:
    """Without dependence, n times the statistic is close to a gamma variable with these two moments (of the statistic).

    A constant column has moments of zero but for rounding, and is independent of all.
    """
    ordered = n * (n - 1)
    off_x, off_y = ((s - n) / ordered for s in sums)
    null_mean = (1 - off_x) * (1 - off_y) / n
    null_variance = 2 * (n - 4) * (n - 5) / (ordered * (n - 2) * (n - 3)) * squares / ordered
    statistic = trace / n
    if n * null_mean < 1e-12 or n * n * null_variance < 1e-24:
        return {"statistic": statistic, "threshold": 0.0, "independent": 1}
    threshold = gamma_quantile(1 - alpha, null_mean**2 / null_variance, n * null_variance / null_mean)
    return {"statistic": statistic, "threshold": threshold, "independent": int(statistic < threshold)}


def _pairs(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for r in batch.to_pylist():
            yield *(np.array(r[c]) for c in ("xs_1", "xs_2", "ys_1", "ys_2")), r["b_1"] == r["b_2"]


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of the sorted distinct values; the window runs over the levels, not the rows."""
    levels = df.select(F.col(f"`{column}`").alias("value")).filter("value is not null").distinct()
    return levels.withColumn("code", F.dense_rank().over(W.Window.orderBy("value")) - 1)
