"""Aggregations over findings, runs and indexes: counters, trends, gates and quality metrics.

All are plain aggregations, which Spark combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved

#: Fixed values.
CATEGORIES = ["security", "performance", "quality", "bug_risk", "style", "documentation", "best_practices", "error_handling", "testing", "architecture"]
SEVERITY_RANK = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}
COMPARATORS = {
    "GREATER_THAN": lambda a, b: a > b, "GREATER_THAN_OR_EQUAL": lambda a, b: a >= b, "LESS_THAN": lambda a, b: a < b,
    "LESS_THAN_OR_EQUAL": lambda a, b: a <= b, "EQUAL": lambda a, b: a == b, "NOT_EQUAL": lambda a, b: a != b,
}


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def counters(issues: DataFrame, *by: str) -> DataFrame:
    """Unresolved findings, in all and by severity, and resolved ones."""
    open_ = ~F.col("resolved")
    sev = lambda s: count_where(open_ & (F.col("severity") == s)).alias(s.lower())
    return issues.groupBy(*by).agg(count_where(open_).alias("total"), *map(sev, ("HIGH", "MEDIUM", "LOW", "INFO")), count_where(F.col("resolved")).alias("resolved"))


def top_files(issues: DataFrame, n: int, unresolved_only: bool) -> DataFrame:
    """Files with the most findings (those of a branch count unresolved ones only, those of a project all)."""
    rows = issues.where(~F.col("resolved")) if unresolved_only else issues
    return rows.groupBy(F.coalesce("path", F.lit("unknown")).alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(n)


def by_category(issues: DataFrame) -> DataFrame:
    """Open findings for each of the fixed categories, zero included; ``code_quality`` counts as ``quality``."""
    name = F.when(F.col("category") == "code_quality", "quality").otherwise(F.col("category"))
    found = issues.where(~F.col("resolved")).groupBy(name.alias("category")).agg(F.count("*").alias("n"))
    keys = issues.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return keys.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def keep_first(rows: DataFrame, key: list[Column], id_col: str = "id") -> DataFrame:
    """Of the rows that agree in key (nulls agree) the one with the least id."""
    named = [c.alias(f"k{i}") for i, c in enumerate(key)]
    first = rows.groupBy(*named).agg(F.min(id_col).alias(id_col)).select(id_col)
    return rows.join(first, id_col, "left_semi")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[severity], F.lit(4))


def worst_severity(issues: DataFrame, *by: str) -> DataFrame:
    return issues.groupBy(*by).agg(F.min_by("severity", F.struct(severity_rank(F.col("severity")), F.col("severity"))).alias("worst"))


def letter(high: Column, medium: Column, low: Column, total: Column) -> Column:
    """A+ without findings, then by 3 * high + 2 * medium + low."""
    weight = 3 * high + 2 * medium + low
    return F.when(total == 0, "A+").when(weight <= 5, "A").when(weight <= 15, "B").when(weight <= 30, "C").when(weight <= 50, "D").otherwise("F")


def evaluate_gate(metrics: DataFrame, conditions: DataFrame) -> DataFrame:
    """metrics (id, metric, severity, category, value); conditions (gate, metric, severity, category, comparator, threshold, enabled).

    A condition fails when its comparison is true; a run with a failing condition is FAILED, one
    without enabled conditions SKIPPED, any other PASSED.  A metric that a run lacks counts 0.
    """


    def fails(value: Column) -> Column:
        out = F.lit(None).cast("boolean")
        for name, compare in COMPARATORS.items():
            out = F.when(F.col("comparator") == name, compare(value, F.col("threshold"))).otherwise(out)
        return F.coalesce(out, F.lit(False)).cast("long")

    # every condition counts as if the metric were 0; those that a run has are set right by the difference
    active = conditions.where("enabled").withColumn("_zero", fails(F.lit(0)))
    n, zero = active.agg(F.count("*"), F.coalesce(F.sum("_zero"), F.lit(0))).first()
    wanted = active.select(*(F.col(c).alias(f"_{c}") for c in ("metric", "severity", "category")), "comparator", "threshold", "_zero")
    same = (F.col("metric") == F.col("_metric")) & F.col("severity").eqNullSafe(F.col("_severity")) & F.col("category").eqNullSafe(F.col("_category"))
    met = metrics.join(wanted, same, "left")
    more = F.when(F.col("comparator").isNotNull(), fails(F.coalesce("value", F.lit(0))) - F.col("_zero")).otherwise(0)
    out = met.groupBy("id").agg((F.sum(more) + F.lit(zero)).alias("n_failed"))
    return out.select("id", F.when(F.lit(n) == 0, "SKIPPED").when(F.col("n_failed") > 0, "FAILED").otherwise("PASSED").alias("result"), "n_failed")


def trend(series: DataFrame, by: str, at: str, value: str, tie: str) -> DataFrame:
    """Second half against first half of a series in time, within 10 %: up, down or stable."""
    w = Window.partitionBy(by)
    rows = series.withColumn("i", F.row_number().over(w.orderBy(at, tie))).withColumn("n", F.count("*").over(w))
    half = F.floor(F.col("n") / 2)
    means = rows.groupBy(by).agg(F.max("n").alias("n"), F.avg(F.when(F.col("i") <= half, F.col(value))).alias("a"), F.avg(F.when(F.col("i") > half, F.col(value))).alias("b"))
    change = (F.col("b") - F.col("a")) / F.col("a")
    label = F.when(F.col("n") < 2, "stable").when(F.col("a") == 0, F.when(F.col("b") > 0, "up").otherwise("stable")).when(change > 0.1, "up").when(change < -0.1, "down").otherwise("stable")
    return means.select(by, label.alias("trend"))


def alive_on(created: Column, resolved: Column, resolved_at: Column, day: Column) -> Column:
    """Created on or before the day (unknown: always), and not resolved by then."""
    return F.coalesce(created <= day, F.lit(True)) & ~(resolved & F.coalesce(resolved_at <= day, F.lit(False)))


def daily_snapshots(issues: DataFrame, start: str, now: str, limit: int = 0) -> DataFrame:
    """Open and resolved findings at start and each day after it, and at the moment now; the last so many points (0: all).

    A finding adds one at the first point after it was created and moves over at the first after
    it was resolved, so points are joined with sums, never with all findings.  One without a
    creation date was always there.
    """
    day = 86_400_000_000
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    first, last = micros(F.lit(start)), micros(F.lit(now))
    whole = F.floor((last - first) / day)  # the last point a whole number of days after the start
    end = whole + F.when(first + whole * day < last, 1).otherwise(0)
    after = lambda c: F.when(micros(c) <= last, F.greatest(F.lit(0), F.least(F.ceil((micros(c) - first) / day), end)))
    came = F.when(F.col("created_at").isNull(), 0).otherwise(after(F.col("created_at")))
    gone = F.when(F.col("resolved") & F.col("resolved_at").isNotNull(), F.greatest(after(F.col("resolved_at")), came))
    sev = [("high", "HIGH"), ("medium", "MEDIUM"), ("low", "LOW")]
    is_ = lambda s: F.coalesce((F.col("severity") == s).cast("int"), F.lit(0))
    plus = issues.select(came.alias("at"), F.lit(1).alias("open"), F.lit(0).alias("done"), *[is_(s).alias(n) for n, s in sev])
    minus = issues.where(gone.isNotNull() & came.isNotNull() & after(F.col("resolved_at")).isNotNull()).select(gone.alias("at"), F.lit(-1).alias("open"), F.lit(1).alias("done"), *[(-is_(s)).alias(n) for n, s in sev])
    names = ["open", "done", *[n for n, _ in sev]]
    points = issues.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), end)).alias("at"))
    changes = plus.unionByName(minus).where(F.col("at").isNotNull()).groupBy("at").agg(*[F.sum(n).alias(n) for n in names])
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a row a point
    out = points.join(changes, "at", "left").select("at", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names])
    if limit:
        out = out.where(F.col("at") > end - limit)
    return out.select(F.timestamp_micros(F.least(first + F.col("at") * day, last)).alias("day"), *names)


#: How far above the baseline a mode may be in tokens, cost a case and 95th percentile of cost.
MOST = 1.10


def accepted(metrics: DataFrame, baseline: str) -> DataFrame:
    """metrics (mode, precision, recall, tokens, case_cost, p95_cost): for each mode what of the acceptance rules holds beside the baseline's."""
    b = metrics.where(F.col("mode") == baseline).select(*(F.col(c).alias(f"_{c}") for c in metrics.columns if c != "mode"))
    at_most = lambda c: (F.col(c) <= MOST * F.col(f"_{c}")).alias(f"{c}_ok")
    return metrics.join(F.broadcast(b.limit(1)), F.lit(True)).select(
        "mode", (F.col("precision") >= 0.6).alias("precision_ok"), (F.col("recall") >= 0.6).alias("recall_ok"),
        (F.col("precision") - F.col("_precision") >= -0.05).alias("precision_held"), (F.col("recall") - F.col("_recall") >= -0.05).alias("recall_held"), *map(at_most, ("tokens", "case_cost", "p95_cost")),
    )


def below(percent: Column, least: Column) -> Column:
    """Whether a share misses its threshold, rounding apart."""
    return percent + 1e-12 < least


def precision_recall(cases: DataFrame, *by: str) -> DataFrame:
    """cases (…, expected, published: arrays): set counts over all cases, and safe ratios."""
    each = cases.select(*by, F.size(F.array_intersect("expected", "published")).alias("tp"), F.size(F.array_except("published", "expected")).alias("fp"), F.size(F.array_except("expected", "published")).alias("fn"))
    total = each.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return total.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)))


def frequencies(rows: DataFrame, **counters: tuple[Column, int]) -> DataFrame:
    """The most frequent values of several columns: (counter, value, n), by count, then value.  Of a list its first five count."""
    parts = []
    for name, (column, most) in counters.items():
        if rows.select(column).schema[0].dataType.typeName() == "array":
            column = F.explode(F.slice(column, 1, 5))
        counted = rows.select(column.alias("value")).select(F.col("value").cast("string")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
        parts.append(counted.orderBy(F.desc("n"), "value").limit(most).select(F.lit(name).alias("counter"), "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dominant(rows: DataFrame, family: Column, share: float = 0.7) -> DataFrame:
    """The family of at least that share of the recognised rows, if any."""
    counted = rows.select(family.alias("family")).where("family is not null").groupBy("family").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total), F.col("n") >= share * F.col("total")).select("family", "n")


def evenly_spaced(rows: DataFrame, order: str, most: int = 100) -> DataFrame:
    """All rows if few, else so many at even distances in order: a counted prefix per partition, not one window over all."""
    n = rows.count()
    if n <= most:
        return rows
    from .ordering import with_index

    at = with_index(rows, order)
    # row i is the k-th pick if i == floor(k * n / most)
    k = F.ceil(F.col("index") * most / n)
    return at.where(F.floor(k * n / most) == F.col("index")).drop("index")


#: Hexadecimal digits of a member's own digest that name its leaf, from the finest level to the root.
LEVELS = (4, 2, 0)


def digest_tree(rows: DataFrame, frame: Column, *by: str) -> DataFrame:
    """by, seal, members: an order-independent digest of all frames of a group, however many they are.

    A tree of digests: frames meet by the first digits of their own digests, are sorted and
    digested there, and so on with the digests of a level, which meet by fewer digits.  No list
    holds more than a 65536th of a group, or the 256 digests of a branch.
    """
    now = rows.select(*by, frame.alias("_frame"), F.lit(1).cast("long").alias("_n")).withColumn("_at", F.sha2("_frame", 256))
    for digits in LEVELS:
        at = F.substring("_at", 1, digits).alias("_at")
        now = now.groupBy(*by, at).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_frame")), ";"), 256).alias("_frame"), F.sum("_n").alias("_n"))
    return now.select(*by, F.col("_frame").alias("seal"), F.col("_n").alias("members"))


def merkle(rows: DataFrame, id_col: str, digest: str, *by: str) -> DataFrame:
    """Order-independent digest of members, each framed by its length."""
    frame = F.concat(F.length(F.col(id_col).cast("string")).cast("string"), F.lit(":"), F.col(id_col).cast("string"), F.lit("="), F.col(digest))
    return digest_tree(rows, frame, *by)


# Files, changed lines and bytes that a change of a size class may have.
SIZE_CLASSES = {"small": (4, 800, 120_000), "medium": (15, 3_000, 450_000)}


def size_class(files: Column, lines: Column, size: Column) -> Column:
    """small, medium or large: the first class whose limits all hold."""
    out = None
    for name, limits in SIZE_CLASSES.items():
        fits = (files <= limits[0]) & (lines <= limits[1]) & (size <= limits[2])
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("large")


def fast_check(files: Column, lines: Column, size: Column, enabled: bool = True) -> Column:
    """Whether a change is small enough for the fast check, and the reason: the first limit that it exceeds."""
    limits = zip(("file count", "changed lines", "diff bytes"), (files, lines, size), SIZE_CLASSES["small"], strict=True)
    why = F.lit("within small PR thresholds") if enabled else F.lit("disabled")
    for what, value, most in reversed(list(limits)) if enabled else ():
        why = F.when(value > most, F.concat(F.lit(f"{what} "), value.cast("string"), F.lit(f" > {most}"))).otherwise(why)
    return F.struct((why == "within small PR thresholds").alias("fast"), why.alias("reason"))


#: Values of a group that are sorted together at the end, and the parts that an interval is cut into before.
SORTED, PARTS = 4096, 256


def exact_quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each name the value of rank ceil(share * n) of the group's n values (nulls apart; null if there are none); for numbers.

    Selection by counting: the interval that holds a rank is cut into PARTS, the part that holds
    it is found by counts, and so on, until it has SORTED values at most or is one value.  So a
    group of any size is never held or sorted as a whole.
    """
    kind = rows.schema[value].dataType
    v = rows.select(F.col(by).alias("g"), F.col(value).alias("v")).where("v is not null")
    ends = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.col("n") * share - 1e-9), F.lit(1)).alias("rank")) for name, share in shares.items())))
    # the rank counts from the first value of the interval [low, high]
    open_ = saved(ends.select("g", "low", "high", "n", ranks.alias("r")).select("g", "low", "high", "n", "r.name", "r.rank"), "quantiles")
    done = []
    while True:
        small = (F.col("n") <= SORTED) | (F.col("low") == F.col("high"))
        done.append(open_.where(small))
        open_ = saved(open_.where(~small), "quantiles")
        if open_.isEmpty():
            break
        d = F.col("v").cast("double")
        met = v.join(open_.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")) & d.between(F.col("low"), F.col("high")))
        part = F.least(F.floor((d - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1))
        counts = met.groupBy("g", "name", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min(d).alias("low"), F.max(d).alias("high"))
        before = F.sum("n").over(Window.partitionBy("g", "name").orderBy("part")) - F.col("n")  # PARTS rows at most
        found = counts.withColumn("before", before).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
        open_ = saved(found.select("g", "low", "high", "n", "name", (F.col("rank") - F.col("before")).alias("rank")), "quantiles")
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    one = last.where("low = high").select("g", "name", F.col("low").cast(kind).alias("v"))
    few = v.join(last.where("low < high").withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")) & F.col("v").cast("double").between(F.col("low"), F.col("high")))
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("g", "name").orderBy("v"))).where(F.col("at") == F.col("rank")).select("g", "name", "v")
    picked = one.unionByName(few).groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))
    groups = rows.select(F.col(by).alias("_g")).distinct()
    return groups.join(picked, F.col("g").eqNullSafe(F.col("_g")), "left").select(F.col("_g").alias(by), *shares)
