"""Rules by path, selection of plug-ins by evidence, the audit table, and a registry of transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import contract_glob, matches_any


@dataclass(frozen=True)
class Rule:
    """A rule of a project's settings: it enforces or suppresses findings below its paths (no globs: everywhere)."""

    name: str
    enforce: bool
    globs: tuple[str, ...] = ()
    enabled: bool = True


def rules_for(rules: list[Rule], path: Column) -> Column:
    """Names of the enabled rules that hold for a path, in the order of the settings: (enforced, suppressed)."""

    def names(enforce: bool) -> Column:
        mine = [F.when(matches_any(path, list(r.globs)) if r.globs else F.lit(True), r.name) for r in rules if r.enabled and r.enforce == enforce]
        return F.array_compact(F.array(*mine)) if mine else F.array().cast("array<string>")

    return F.struct(names(True).alias("enforced"), names(False).alias("suppressed"))


@dataclass(frozen=True)
class Plugin:
    """Chosen if one alternative holds: every glob of it meets a path, and every marker a text of such a path."""

    name: str
    alternatives: tuple[tuple[tuple[str, str], ...], ...] = field(default=())  # ((glob, marker or ""), …), …


def select_plugins(files: DataFrame, plugins: list[Plugin], evidence: int = 5) -> DataFrame:
    """files (path, text): (plugin, alternative, paths): chosen plug-ins by their first alternative, with a few paths as evidence.

    One pass over the files: every condition is an aggregate, combined before the shuffle; of each
    only the ``evidence`` least paths are kept (array_agg over the distinct least ones of a task).
    """
    conditions = [(p.name, a, i, glob, marker) for p in plugins for a, alternative in enumerate(p.alternatives) for i, (glob, marker) in enumerate(alternative)]
    if not conditions:
        return files.sparkSession.createDataFrame([], "plugin string, alternative int, paths array<string>")
    hits = [
        F.when(contract_glob(F.col("path"), glob) & (F.contains("text", F.lit(marker)) if marker else F.lit(True)), F.struct(F.lit(name).alias("plugin"), F.lit(a).alias("alternative"), F.lit(i).alias("condition")))
        for name, a, i, glob, marker in conditions
    ]
    found = files.select("path", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("path", "hit.*")
    # the least paths of each condition, by repeated minima rather than by one list of all
    least, rest = None, found
    for _ in range(evidence):
        one = rest.groupBy("plugin", "alternative", "condition").agg(F.min("path").alias("least"))
        least = one if least is None else least.unionByName(one)
        rest = rest.join(one, ["plugin", "alternative", "condition"]).where(F.col("path") > F.col("least")).drop("least")
    met = least.groupBy("plugin", "alternative").agg(F.count_distinct("condition").alias("met"), F.slice(F.sort_array(F.collect_set("least")), 1, evidence).alias("paths"))
    wanted = files.sparkSession.createDataFrame([(p.name, a, len(x)) for p in plugins for a, x in enumerate(p.alternatives)], "plugin string, alternative int, needed long")
    whole = met.join(F.broadcast(wanted), ["plugin", "alternative"]).where("met = needed")
    return whole.groupBy("plugin").agg(F.min(F.struct("alternative", "paths")).alias("first")).select("plugin", "first.*")


# --- the audit table: functions from tables to tables


def log_event(audit: DataFrame, event: DataFrame) -> DataFrame:
    """audit with new events, which begin as RECEIVED; an id that is known already is left alone."""
    fresh = event.join(audit.select("id"), "id", "left_anti").withColumn("status", F.lit("RECEIVED"))
    return audit.unionByName(fresh, allowMissingColumns=True)


def update_status(audit: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, status): the status of these events (the last by name if there are several)."""
    one = changes.groupBy("id").agg(F.max("status").alias("_status"))
    return audit.join(one, "id", "left").withColumn("status", F.coalesce("_status", "status")).select(*audit.columns)


def cleanup(audit: DataFrame, at: str, days: int, now: Column) -> DataFrame:
    """audit without events older than so many days."""
    return audit.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


# --- transforms by name

TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def transform(name: str):
    """Registers a function from DataFrame to DataFrame."""

    def take(f):
        if name in TRANSFORMS:
            raise ValueError(f"{name} is taken")
        TRANSFORMS[name] = f
        return f

    return take


def run_transforms(df: DataFrame, names: list[str], known: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """df through the named transforms (of TRANSFORMS, or of those given); each outcome is handled, abstained (unknown, or gave None) or failed (it raised; df goes on as it was)."""
    outcomes = {}
    for name in names:
        f, got = (TRANSFORMS if known is None else known).get(name), None
        try:
            got = f(df) if f else None
            outcomes[name] = "handled" if got is not None else "abstained"
        except Exception as e:  # a plug-in's fault is its own outcome
            outcomes[name] = f"failed: {type(e).__name__}"
        df = got if got is not None else df
    return df, outcomes
