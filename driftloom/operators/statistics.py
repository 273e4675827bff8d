"""Ranking statistics, intervals, calibration and gates as DataFrame aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.sources.store import written

Z95 = 1.96


def rank_auc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by average ranks; null unless both classes occur. Ranks come from counts per distinct score."""
    per = rows.groupBy(*by, F.col(score).alias("x")).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    below = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    total = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * F.col("rank")).alias("r"))
    return total.select(*by, "n", F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auroc"))


def average_precision(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Step integral of precision over recall, from the highest score down; tied scores are one step."""
    per = rows.groupBy(*by, F.col(score).alias("x")).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    down = W.partitionBy(*by).orderBy(F.desc("x"))
    part = per.withColumn("precision", F.sum("p").over(down) / F.sum("n").over(down))
    return part.groupBy(*by).agg((F.sum(F.col("precision") * F.col("p")) / F.sum("p")).alias("average_precision"))


def risk_coverage(rows: DataFrame, by: list[str], score: str, harm: str, tolerance: float = 1e-12) -> DataFrame:
    """(…, threshold, coverage, risk): what is published when scores up to each distinct score are, and the harm among it.

    Neighbouring scores no further apart than ``tolerance`` are one, under the largest of them.
    """
    each = rows.groupBy(*by, F.col(score).alias("x")).agg(F.count("*").alias("n"), F.sum(harm).alias("h"))
    up, whole = W.partitionBy(*by).orderBy("x"), W.partitionBy(*by)
    step = each.select(*by, "x", F.sum("n").over(up).alias("n"), F.sum("h").over(up).alias("h"), F.sum("n").over(whole).alias("all"), F.lead("x").over(up).alias("next"))
    ends = step.where(F.col("next").isNull() | ~(F.col("next") - F.col("x") <= tolerance))
    return ends.select(*by, F.col("x").alias("threshold"), (F.col("n") / F.col("all")).alias("coverage"), (F.col("h") / F.col("n")).alias("risk"))


def strict_coverage(curve: DataFrame, by: list[str], target: float) -> DataFrame:
    """(…by, coverage): the largest coverage of a ``risk_coverage`` curve with at most ``target`` harm; 0 without one."""
    return curve.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("risk") <= target, F.col("coverage"))), F.lit(0.0)).alias("coverage"))


def gate_grid(rows: DataFrame, by: list[str], score: str, harm: str, steps: int = 200) -> DataFrame:
    """(…by, step, threshold, coverage, risk) at 0, 1 / steps, …, 1: what scores below the threshold publish; nothing has no risk.

    A row counts at the first threshold above its score, so what meets the grid are ``steps`` + 2 counts per group.
    """
    # 0 lies below the first threshold, ``steps`` + 1 above the last; the comparison settles what the division rounds.
    s = F.col(score).cast("double")
    near = F.greatest(F.lit(0), F.least(F.lit(steps + 1), F.floor(s * steps) + 1))
    first = F.when(s < (near - 1) / steps, near - 1).when(s < near / steps, near).otherwise(near + 1)
    counts = rows.where(s.isNotNull()).groupBy(*by, F.greatest(F.lit(0), F.least(F.lit(steps + 1), first)).cast("int").alias("_at")).agg(F.count("*").alias("n"), F.sum(harm).alias("h"))
    void = rows.where(s.isNull()).groupBy(*by, F.lit(steps + 1).alias("_at")).agg(F.count("*").alias("n"), F.sum(harm).alias("h"))
    cells = counts.unionByName(void)
    grid = cells.select(*by).distinct().withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(steps + 1)))).withColumns({"n": F.lit(0).cast("long"), "h": F.lit(0).cast("long")})
    full = cells.unionByName(grid).groupBy(*by, "_at").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    up, whole = W.partitionBy(*by).orderBy("_at"), W.partitionBy(*by)
    summed = full.select(*by, "_at", F.sum("n").over(up).alias("n"), F.sum("h").over(up).alias("h"), F.sum("n").over(whole).alias("all"))
    return summed.where(F.col("_at") <= steps).select(*by, F.col("_at").alias("step"), (F.col("_at") / steps).alias("threshold"), (F.col("n") / F.col("all")).alias("coverage"), F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0).alias("risk"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a proportion; (0, 1) without observations."""
    p = successes / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    scale = 1 + z * z / n
    return F.when(n == 0, 0.0).otherwise(F.greatest((centre - half) / scale, F.lit(0.0))), F.when(n == 0, 1.0).otherwise(F.least((centre + half) / scale, F.lit(1.0)))


def binomial_upper_tail(n: Column, k: Column) -> Column:
    """P(X >= k) of n fair draws: the first term by logarithms, each further one from the one before."""
    up_to = lambda m: F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int"))
    log_factorial = lambda m: F.aggregate(up_to(m), F.lit(0.0), lambda a, i: a + F.ln(i))
    low = F.greatest(k, F.lit(0)).cast("int")
    log_term = log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * F.ln(F.lit(2.0))
    start = F.struct(log_term.alias("t"), F.exp(log_term).alias("s"))

    def further(y: Column, i: Column) -> Column:
        t = y["t"] + F.ln((n - i + 1) / i)
        return F.struct(t.alias("t"), (y["s"] + F.exp(t)).alias("s"))

    rest = F.when(low < n, F.sequence(low + 1, n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k > n, 0.0).when(k <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(rest, start, further, lambda y: y["s"])))


def digest_places(rows: DataFrame, by: list[str], row_id: str, salt: str = "", ranges: int = 4096) -> DataFrame:
    """``rows`` with ``place``, from 1: the order of their SHA-256 within a group; rows of one id go by no order of their own.

    Digests are evenly spread, so their first bits cut a group into ranges. Places are counted within a range, and a range
    adds what lies before it: a group of any size is sorted by many tasks, and ``ranges`` numbers of it meet in one.
    """
    digest = F.sha2(F.concat(F.lit(salt), F.col(row_id).cast("string")), 256)
    cut = F.shiftright(F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") * ranges, 24).cast("int")
    marked = rows.withColumn("_digest", digest).withColumn("_range", F.coalesce(cut, F.lit(0)))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = marked.groupBy(*by, "_range").agg(F.count("*").alias("_n")).select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), before.alias("_before"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = marked.join(counts, same).withColumn("place", F.row_number().over(W.partitionBy(*by, "_range").orderBy("_digest")) + F.col("_before"))
    return placed.drop("_digest", "_range", "_before", "_at", *(f"_by_{c}" for c in by))


#: percentile_approx is off by at most a rank in this many.
RANK_ACCURACY = 10_000


def flags_at_count(rows: DataFrame, score: str, row_id: str, share: float, by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``flag``: the round-half-even(share n) highest scores; ties by SHA-256 of the row id, null scores last.

    Approximate ranks give two scores between which the cut lies. Scores beyond them are decided by them; those between
    are counted by value, and only rows that share the score at the cut are put in order of digests, in ranges. A pair of
    scores that does not hold the cut after all, as with many nulls, is not used: then all scores of the group are counted.
    """
    by = by or []
    plain = rows.withColumns({f"_k_{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by})  # keys in which null is a value
    by = [f"_k_{c}" for c in by]
    of_group = lambda frame, other: frame.join(other, by) if by else frame.crossJoin(other)  # noqa: E731 - without groups one row
    step = 2 / RANK_ACCURACY
    near = F.percentile_approx(score, [max(0.0, 1 - share - step), min(1.0, 1 - share + step)], RANK_ACCURACY)
    whole = plain.groupBy(*by).agg(F.count("*").alias("_n"), near.alias("_near")).select(*by, F.bround(F.col("_n") * F.lit(share)).cast("long").alias("_most"), F.col("_near")[0].alias("_low"), F.col("_near")[1].alias("_high"))
    seen = of_group(plain, whole).groupBy(*by).agg(F.max("_most").alias("_most"), F.max("_low").alias("_low"), F.max("_high").alias("_high"), F.count_if(F.col(score) > F.col("_high")).alias("_above"), F.count_if(F.col(score) >= F.col("_low")).alias("_within"))
    holds = (F.col("_above") < F.col("_most")) & (F.col("_within") >= F.col("_most"))
    ends = seen.select(*by, "_most", F.when(holds, F.col("_low")).alias("_low"), F.when(holds, F.col("_high")).alias("_high"), F.when(holds, F.col("_above")).otherwise(0).alias("_above"))
    banded = of_group(plain, ends)
    inside = F.coalesce(F.col(score).between(F.col("_low"), F.col("_high")), F.col("_low").isNull())
    values = banded.where(inside).groupBy(*by, F.col(score).alias("_x")).agg(F.count("*").alias("_m"), F.max("_most").alias("_most"), F.max("_above").alias("_above"))
    upto = F.col("_above") + F.sum("_m").over(W.partitionBy(*by).orderBy(F.desc_nulls_last("_x")))
    cut = values.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_most")) & (F.col("_upto") - F.col("_m") < F.col("_most"))).select(*by, F.col("_x").alias("_cut"), (F.col("_most") - F.col("_upto") + F.col("_m")).alias("_left"), F.lit(True).alias("_some"))
    marked = plain.join(cut, by, "left") if by else plain.join(cut, F.lit(True), "left")  # one row at most
    some = F.coalesce("_some", F.lit(False))
    tied = some & F.col(score).eqNullSafe(F.col("_cut"))
    over = F.coalesce(some & (F.col("_cut").isNull() & F.col(score).isNotNull() | (F.col(score) > F.col("_cut"))), F.lit(False))
    at_cut = digest_places(marked.where(tied), by, row_id).withColumn("flag", F.col("place") <= F.col("_left")).drop("place")
    out = marked.where(~tied).withColumn("flag", over).unionByName(at_cut)
    return out.select(*rows.columns, "flag")


def digest_split(rows: DataFrame, document: str, ranges: int = 4096) -> DataFrame:
    """``rows`` with ``calibration``: documents at even places of the order of their MD5.

    Digests are evenly spread, so their first bits cut the order into ranges; places are counted within a range, and a
    range adds what lies before it. One number per range meets in one place.
    """
    digest = F.md5(F.col(document).cast("string"))
    cut = F.floor(F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("int")
    each = rows.select(document).distinct().withColumn("_digest", digest).withColumn("_range", cut)
    before = each.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = each.withColumn("_k", F.row_number().over(W.partitionBy("_range").orderBy("_digest", document)) - 1).join(F.broadcast(before), "_range")  # ``ranges`` rows at most
    return rows.join(place.select(document, ((F.col("_k") + F.col("_before")) % 2 == 0).alias("calibration")), document)


def multiplicity(unit: Column, replicate: Column, seed: int = 20260811) -> Column:
    """Poisson(1) weight of a resampled unit, from a hash: the bootstrap needs no shared generator and no second pass."""
    u = F.pmod(F.xxhash64(F.lit(seed), unit, replicate), F.lit(1 << 30)) / float(1 << 30)
    out, total, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(1, 9):
        total += term
        out = F.when(u >= total, k).otherwise(out)
        term /= k
    return out


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, replicates: int = 200, by: list[str] | None = None) -> DataFrame:
    """(…by, mean, low, high): the mean of all values with the percentile interval of means over resampled clusters.

    A replicate draws as many clusters as there are. Clusters alike in number and sum of values (at six decimals) are one
    cell of which counts are drawn. Nulls do not count, nor do clusters without a value.
    """
    by = by or []
    part = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("m"))
    key = F.concat_ws("/", F.col("m").cast("string"), F.round(F.col("s") * 1_000_000).cast("long").cast("string"))
    cells = written(part.groupBy(*by, key.alias("cell")).agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("s").alias("s")), "clusters")
    drawn = multinomial(cells, by, "cell", "n", replicates)
    means = drawn.groupBy(*by, "replicate").agg((F.sum(F.col("w") * F.col("s") / F.col("n")) / F.sum(F.col("w") * F.col("m") / F.col("n"))).alias("m"))
    interval = means.groupBy(*by).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    centre = cells.groupBy(*by).agg((F.sum("s") / F.sum("m")).alias("mean"))
    return centre.join(interval, by) if by else centre.crossJoin(interval)  # a row each


def fixed_effects_slope(rows: DataFrame, unit: str, x: str, y: str, levels: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Within-unit OLS slope; units without all ``levels`` are left out."""
    by = by or []
    whole = W.partitionBy(*by, unit)
    kept = rows.withColumn("_n", F.count("*").over(whole))
    kept = kept.where(F.col("_n") == levels) if levels else kept
    d = kept.withColumn("_x", F.col(x) - F.avg(x).over(whole)).withColumn("_y", F.col(y) - F.avg(y).over(whole))
    return d.groupBy(*by).agg((F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") * F.col("_x"))).alias("slope"))


DIRECTIONS = ("max", "min")


def confusion_at_thresholds(rows: DataFrame, by: list[str], metric: str, label: str, direction: str = "max") -> DataFrame:
    """(…, threshold, tp, fp, fn, tn) at the midpoints of neighbouring distinct metrics and just beyond both ends.

    ``max`` raises an alarm above the threshold, ``min`` below it. All thresholds come from one pass over counts per metric.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}, not {direction}")
    per = rows.groupBy(*by, F.col(metric).alias("x")).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    order, whole = W.partitionBy(*by).orderBy("x"), W.partitionBy(*by)
    step = per.withColumn("n0", F.sum("n").over(order)).withColumn("p0", F.sum("p").over(order)).withColumn("np", F.sum("p").over(whole)).withColumn("nn", F.sum("n").over(whole)).withColumn("next", F.lead("x").over(order))
    mids = step.select(*by, F.coalesce((F.col("x") + F.col("next")) / 2, F.col("x") + 1e-9).alias("threshold"), "n0", "p0", "np", "nn")
    lowest = step.groupBy(*by).agg((F.min("x") - 1e-9).alias("threshold"), F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("p0"), F.max("np").alias("np"), F.max("nn").alias("nn"))
    over = [F.col("np") - F.col("p0"), F.col("nn") - F.col("n0") - F.col("np") + F.col("p0"), F.col("p0"), F.col("n0") - F.col("p0")]
    tp, fp, fn, tn = over if direction == "max" else [over[2], over[3], over[0], over[1]]
    return mids.unionByName(lowest).select(*by, "threshold", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))


CALIBRATION_MODES = ("recall_floor", "alarm_budget", "youden", "f1", "utility")


def calibrate(confusions: DataFrame, by: list[str], mode: str, target: float = 0.0, weight: float = 0.5) -> DataFrame:
    """(…by, threshold, score, alarm_rate, precision, recall, f1, n, base_rate): the best threshold of a mode per group; the least of equally good ones.

    ``recall_floor`` has the fewest alarms among recalls of ``target`` and more, ``alarm_budget`` the highest recall among alarm
    rates of ``target`` and less, ``youden`` the largest recall less alarm rate, ``f1`` the largest F1, and ``utility`` the
    largest weight * recall - (1 - weight) * alarm rate. Where nothing meets the target the score is null: a recall floor
    then takes the highest recall, and what is left has the least threshold and rates of 0.
    """
    if mode not in CALIBRATION_MODES:
        raise ValueError(f"mode is one of {', '.join(CALIBRATION_MODES)}, not {mode}")
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    precision, recall, alarm = share(tp, tp + fp), share(tp, tp + fn), share(tp + fp, tp + fp + fn + tn)
    rated = confusions.select(*by, "threshold", alarm.alias("alarm_rate"), precision.alias("precision"), recall.alias("recall"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), share(tp + fn, tp + fp + fn + tn).alias("base_rate"))
    p, r, al = F.col("precision"), F.col("recall"), F.col("alarm_rate")
    rated = rated.withColumn("f1", share(2 * p * r, p + r))
    score = {"recall_floor": F.when(r >= target, -al), "alarm_budget": F.when(al <= target, r), "youden": r - al, "f1": F.col("f1"), "utility": weight * r - (1 - weight) * al}[mode]
    near = r if mode == "recall_floor" else F.lit(0.0)
    key = F.struct(score.isNotNull().alias("met"), F.coalesce(score, near).alias("score"), -F.col("threshold"))
    row = F.struct("threshold", score.cast("double").alias("score"), "alarm_rate", "precision", "recall", "f1", "n", "base_rate")
    best = rated.groupBy(*by).agg(F.max_by(row, key).alias("b"))
    void = F.col("b.score").isNull() & ((F.lit(mode) != "recall_floor") | (F.col("b.recall") == 0))
    return best.select(*by, "b.threshold", "b.score", *(F.when(void, 0.0).otherwise(F.col(f"b.{c}")).alias(c) for c in ("alarm_rate", "precision", "recall", "f1")), "b.n", "b.base_rate")


def calibrate_pairs(pairs: DataFrame, by: list[str], metric: str, regression: str, mode: str, target: float = 0.0, direction: str = "max", harm_above: float = 0.05, weight: float = 0.5) -> DataFrame:
    """``calibrate`` from pairs with a metric and a regression of utility: a pair is harmful whose regression, either way, exceeds ``harm_above``. Pairs that lack one are left out."""
    rows = pairs.dropna(subset=[metric, regression]).withColumn("_harm", (F.abs(regression) > harm_above).cast("long"))
    return calibrate(confusion_at_thresholds(rows, by, metric, "_harm", direction), by, mode, target, weight)


def gate_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` have blocked (boolean), harmful (boolean), fidelity: coverage, harm recall and precision, false blocks, published harm and fidelity."""
    b, h = F.col("blocked"), F.col("harmful")
    share = lambda part, whole: F.when(F.count_if(whole) > 0, F.count_if(part) / F.count_if(whole))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (F.count_if(~b) / F.count("*")).alias("coverage"), share(b & h, h).alias("harm_recall"), share(b & h, b).alias("harm_precision"), share(b & ~h, ~h).alias("false_block"), share(~b & h, ~b).alias("published_harm"), F.avg(F.when(~b, F.col("fidelity"))).alias("published_fidelity"))


def threshold_grid(rows: DataFrame, graph: str, queries: str, harm: str, target: float, points: int = 19) -> DataFrame:
    """(tg, tq, coverage, harm_rate) of the grid cell with the largest coverage, then tg + tq, whose published harm is within ``target``.

    Scores fall into grid bins first, so what meets the grid is one count per pair of bins.
    """
    level = lambda c: F.least(F.floor(F.col(c) * (points + 1)), F.lit(points)).cast("int")
    bins = rows.groupBy(level(graph).alias("g"), level(queries).alias("q")).agg(F.count("*").alias("n"), F.sum(harm).alias("h"))
    grid = rows.sparkSession.range(1, points + 1).select(F.col("id").cast("int").alias("i")).crossJoin(rows.sparkSession.range(1, points + 1).select(F.col("id").cast("int").alias("j")))
    cells = grid.join(F.broadcast(bins), (F.col("g") < F.col("i")) & (F.col("q") < F.col("j")), "left").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    total = bins.agg(F.sum("n").alias("all"))
    scored = cells.crossJoin(total).where("n > 0").select((F.col("i") / (points + 1.0)).alias("tg"), (F.col("j") / (points + 1.0)).alias("tq"), (F.col("n") / F.col("all")).alias("coverage"), (F.col("h") / F.col("n")).alias("harm_rate")).where(F.col("harm_rate") <= target)
    best = F.max_by(F.struct("tg", "tq", "coverage", "harm_rate"), F.struct("coverage", F.round(F.col("tg") + F.col("tq"), 9), "tg"))
    return scored.agg(best.alias("b")).where("b is not null").select("b.*")


def monotone_share(rows: DataFrame, unit: str, x: str, y: str, by: list[str]) -> DataFrame:
    """Share of units whose y never falls from one level of x to the next."""
    step = rows.withColumn("_ok", F.coalesce(F.lead(y).over(W.partitionBy(*by, unit).orderBy(x)) >= F.col(y), F.lit(True)))
    return step.groupBy(*by, unit).agg(F.bool_and("_ok").alias("ok")).groupBy(*by).agg((F.count_if("ok") / F.count("*")).alias("monotone"))


def mean_rank(n: Column, by: list[str], value: str) -> Column:
    """Rank of a value among ``n``-fold rows, equal values sharing their mean rank."""
    up = W.partitionBy(*by).orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)
    return F.sum(n).over(up) - (F.sum(n).over(W.partitionBy(*by, value)) - 1) / 2.0


#: Levels of the tree of cells: bits of a cell's digest.
LEVELS = 32
#: Up to this expected number of successes a binomial draw is the exact quantile; beyond it, it is the rounded normal one.
EXACT_MEAN = 9
#: Successes that an exact quantile looks at; more have a chance of 1e-14 at that mean.
MOST_SUCCESSES = 40.0


def _uniform(digest: Column, start: int) -> Column:
    """A number strictly between 0 and 1 from eight hexadecimal digits."""
    return (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def binomial(m: Column, s: Column) -> Column:
    """Successes of m draws, of which each is one with probability s.a / s.n, from the uniform numbers s.u and s.v."""
    q = F.least(s["a"], s["n"] - s["a"]) / s["n"]
    start = F.pow(1 - q, m)
    first = F.struct(F.lit(0.0).alias("k"), start.alias("f"), start.alias("c"))

    def further(y: Column, j: Column) -> Column:
        f = y["f"] * (m - j + 1) / j * q / (1 - q)
        return F.when(s["u"] <= y["c"], y).otherwise(F.struct(j.cast("double").alias("k"), f.alias("f"), (y["c"] + f).alias("c")))

    exact = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(MOST_SUCCESSES)).cast("int")), first, further)["k"]
    normal = F.greatest(F.lit(0.0), F.least(m, F.round(m * q + F.sqrt(m * q * (1 - q)) * F.sqrt(-2 * F.log(s["u"])) * F.cos(F.lit(2 * math.pi) * s["v"]))))
    k = F.when(m == 1, F.when(s["u"] <= 1 - q, 0.0).otherwise(1.0)).when(m * q <= EXACT_MEAN, exact).otherwise(normal)
    return F.when((m == 0) | (s["a"] == 0), 0.0).when(s["a"] == s["n"], m).when(2 * s["a"] <= s["n"], k).otherwise(m - k)


def multinomial(cells: DataFrame, by: list[str], cell: str, n: str, replicates: int) -> DataFrame:
    """``cells`` once per ``replicate``, with ``w``: how often a row of the cell is drawn when as many rows are drawn as the group has.

    ``cells`` has a row per group and ``cell`` (a string), of ``n`` rows each. The bits of a cell's digest place it in a
    binary tree, and the draws of a node are split between its halves by a binomial draw, whose random numbers are digests
    of group, replicate and node. So a replicate is drawn from counts: the cost is cells x replicates x log(cells), rows
    are not numbered, and a group of very many rows is no more work than one of few. The draws of a group sum to its rows.
    Cells may be many, so their tables are merged, never sent to the driver for a broadcast.
    """
    group = F.concat_ws("|", *(F.col(c).cast("string") for c in by)) if by else F.lit("")
    c = written(cells.withColumn("_g", group).withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("|", "_g", cell)), 1, 8), 16, 10).cast("long")), "cells")
    prefix = F.expr(f"shiftright(_h, {LEVELS} - level)")
    tree = written(c.select("_g", "_h", n, F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).groupBy("_g", "level", prefix.alias("prefix")).agg(F.sum(n).cast("double").alias("n")), "tree")
    half = tree.where("level > 0 and prefix % 2 = 0").select("_g", (F.col("level") - 1).alias("level"), F.shiftright("prefix", 1).alias("prefix"), F.col("n").alias("a"))
    nodes = tree.join(half.hint("merge"), ["_g", "level", "prefix"]).where("a < n")  # only where a node has two halves is anything drawn
    places = c.select("_g", cell, "_h", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")).withColumn("prefix", prefix)
    step = F.struct("level", "prefix", "n", "a", F.expr(f"shiftright(_h, {LEVELS - 1} - level) & 1").alias("bit"))
    steps = places.join(nodes.hint("merge"), ["_g", "level", "prefix"]).groupBy("_g", cell).agg(F.sort_array(F.collect_list(step)).alias("steps"))  # LEVELS at most
    total = tree.where("level = 0").select("_g", F.col("n").alias("_total"))
    # A row becomes ``replicates`` long walks, so few bytes are much work: as many tasks as the session has for shuffles.
    # Keys in the join's own order would give no shuffle of their own, and few bytes one task.
    spread = c.join(steps.hint("merge"), ["_g", cell], "left").join(total, "_g").repartition(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")), cell, "_g")
    each = spread.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def seeded(s: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.col("_g"), F.col("replicate").cast("string"), s["level"].cast("string"), s["prefix"].cast("string")))
        return F.struct(s["n"].alias("n"), s["a"].alias("a"), s["bit"].alias("bit"), _uniform(digest, 1).alias("u"), _uniform(digest, 9).alias("v"))

    walk = F.aggregate(F.coalesce("_steps", F.array().cast("array<struct<n:double,a:double,bit:bigint,u:double,v:double>>")), F.col("_total"), lambda m, s: F.when(s["bit"] == 0, binomial(m, s)).otherwise(m - binomial(m, s)))
    return each.withColumn("_steps", F.transform("steps", seeded)).withColumn("w", walk.cast("long")).select(*cells.columns, "replicate", "w")


def value_cells(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(…by, cell, n, s): how many rows have each value, and their sum; values alike at six decimals are one. Nulls do not count."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.round(F.col(value) * 1_000_000).cast("long").cast("string").alias("cell")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("s"))


def resampled_means(cells: DataFrame, replicates: int, by: list[str]) -> DataFrame:
    """(…by, replicate, m): the mean of each replicate of as many rows, drawn with replacement, as the group has in ``value_cells``."""
    return multinomial(cells, by, "cell", "n", replicates).groupBy(*by, "replicate").agg((F.sum(F.col("w") * F.col("s") / F.col("n")) / F.sum("w")).alias("m"))


def iid_bootstrap(rows: DataFrame, value: str, replicates: int, by: list[str]) -> DataFrame:
    """(…by, n, mean, low, high): mean of the rows that have a value, with the percentile interval of resampled means."""
    cells = written(value_cells(rows, by, value), "values")
    ends = resampled_means(cells, replicates, by).groupBy(*by).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    whole = cells.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    return whole.join(ends, by) if by else whole.crossJoin(ends)  # a row each


def proportion_verdict(rows: DataFrame, exceeds: str, budget: float, replicates: int = 200) -> DataFrame:
    """(n, share, low, high, verdict): share of rows that exceed a tolerance, with the sorted replicates' int(0.025 B)-th and int(0.975 B)-th.

    VIOLATED if the interval lies above the budget, SATISFIED below it, INCONCLUSIVE otherwise. There are two values, so a
    replicate is one binomial draw.
    """
    cells = written(value_cells(rows.select(F.col(exceeds).cast("double").alias("x")), [], "x"), "values")
    ends = resampled_means(cells, replicates, []).agg(F.sort_array(F.collect_list("m")).alias("m")).select(F.col("m")[int(0.025 * replicates)].alias("low"), F.col("m")[int(0.975 * replicates)].alias("high"))  # as many as replicates
    whole = cells.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("share"))
    return whole.crossJoin(ends).withColumn("verdict", F.when(F.col("low") > budget, "VIOLATED").when(F.col("high") < budget, "SATISFIED").otherwise("INCONCLUSIVE"))


def cell_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per cell: attempts, failures by kind, mean and median drift of what succeeded, and the mean with each failure as full drift."""
    ok = F.col("status") == "ok"
    return rows.groupBy(*by).agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("valid"), F.count_if(F.col("status") == "parse_error").alias("parse_failures"), F.count_if(~F.coalesce("status", F.lit("")).isin("ok", "parse_error")).alias("other_failures"),
        F.avg(F.when(ok, F.col("drift"))).alias("mean_drift"), F.expr("percentile(case when status = 'ok' then drift end, 0.5)").alias("median_drift"), F.avg(F.when(ok, F.col("drift")).otherwise(1.0)).alias("failure_as_harm"),
    )


def auc_difference(rows: DataFrame, cluster: str, one: str, other: str, label: str, replicates: int) -> DataFrame:
    """(mean, low, high, used): the difference of two scores' areas under the ROC curve over resampled clusters; replicates of one class are left out."""
    # Rows of a cluster with the same scores and label count as one, so a replicate reads counts.
    alike = written(rows.groupBy(F.col(cluster).cast("string").alias("_c"), one, other, label).agg(F.count("*").alias("_n")), "alike")
    times = multinomial(alike.select("_c").distinct().withColumn("_one", F.lit(1)), [], "_c", "_one", replicates).where("w > 0")
    drawn = alike.join(times, "_c").withColumn("w", F.col("w") * F.col("_n"))
    each = drawn.select("replicate", "w", F.col(label).alias("y"), F.explode(F.array(F.struct(F.lit("one").alias("k"), F.col(one).alias("x")), F.struct(F.lit("other").alias("k"), F.col(other).alias("x")))).alias("s")).select("replicate", "w", "y", "s.*")
    per = each.groupBy("k", "replicate", "x").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p"))
    below = F.coalesce(F.sum("n").over(W.partitionBy("k", "replicate").orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = per.withColumn("rank", below + (F.col("n") + 1) / 2.0).groupBy("replicate", "k").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * F.col("rank")).alias("r"))
    area = F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p"))))
    gap = total.withColumn("a", area).groupBy("replicate").agg((F.max(F.when(F.col("k") == "one", F.col("a"))) - F.max(F.when(F.col("k") == "other", F.col("a")))).alias("d")).where("d is not null")
    return gap.agg(F.avg("d").alias("mean"), F.expr("percentile(d, 0.025)").alias("low"), F.expr("percentile(d, 0.975)").alias("high"), F.count("*").alias("used"))
