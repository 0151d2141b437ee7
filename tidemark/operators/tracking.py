"""Findings followed from one version to the next."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold
from .joins import FAR

#: The passes of the match, in order: the columns that must be equal (and known).
PASSES = (("EXACT", ("fingerprint", "line", "line_hash")), ("SHIFTED", ("fingerprint", "line_hash")), ("EDITED", ("fingerprint", "line")), ("WEAK", ("fingerprint",)))
SCHEMA = "file string, raw_seq long, base_seq long, how string"


def _match_group(rows: list) -> list[tuple]:
    """Within a fingerprint of a file: in each pass every new finding, in order, takes the nearest free old one of its key (the first of equals)."""
    raws, bases = [r for r in rows if r.side == "raw"], [r for r in rows if r.side == "base"]
    used, done, out = set(), set(), []
    for how, key in PASSES:
        by: dict[tuple, list] = {}
        for b in bases:
            if b.seq not in used and not any(pd.isna(getattr(b, k)) for k in key):
                by.setdefault(tuple(getattr(b, k) for k in key), []).append(b)
        for r in raws:
            if r.seq in done or any(pd.isna(getattr(r, k)) for k in key):
                continue
            best, near = None, None
            for b in by.get(tuple(getattr(r, k) for k in key), ()):
                if b.seq not in used:
                    d = FAR if pd.isna(r.line) or pd.isna(b.line) else abs(r.line - b.line)
                    if near is None or d < near:
                        best, near = b, d
            if best is not None:
                used.add(best.seq)
                done.add(r.seq)
                out.append((r.file, r.seq, best.seq, how))
    out += [(r.file, r.seq, None, "NEW") for r in raws if r.seq not in done]
    return out + [(b.file, None, b.seq, "GONE") for b in bases if b.seq not in used]


def match(raws: DataFrame, bases: DataFrame) -> DataFrame:
    """(file, seq, fingerprint, line, line_hash) of both sides: SCHEMA rows.

    Keys that are unique on both sides in the first pass are matched by a join.  Every pass asks for
    equal fingerprints, so only fingerprints of a file that are open on both sides are folded, each
    on its own; all other rows are new or gone at once.
    """
    cols = ["file", "seq", "fingerprint", "line", "line_hash"]
    key = ["file", "fingerprint", "line", "line_hash"]
    full = F.col("fingerprint").isNotNull() & F.col("line").isNotNull() & F.col("line_hash").isNotNull()
    single = lambda df, n: df.where(full).groupBy(*key).agg(F.count("*").alias(f"n_{n}"), F.min("seq").alias(f"{n}_seq"))
    sure = single(raws, "raw").join(single(bases, "base"), key).where("n_raw = 1 and n_base = 1")
    exact = sure.select("file", "raw_seq", "base_seq", F.lit("EXACT").alias("how"))
    rest_raw = raws.select(*cols).join(sure.select(F.col("raw_seq").alias("seq"), "file"), ["file", "seq"], "left_anti").select(*cols, F.lit("raw").alias("side"))
    rest_base = bases.select(*cols).join(sure.select(F.col("base_seq").alias("seq"), "file"), ["file", "seq"], "left_anti").select(*cols, F.lit("base").alias("side"))
    rest = rest_raw.unionByName(rest_base)
    open_ = rest.where("fingerprint is not null").groupBy("file", "fingerprint").agg(F.count_distinct("side").alias("_sides")).where("_sides = 2").drop("_sides")
    folded = rest.join(open_, ["file", "fingerprint"], "left_semi").transform(fold, ["file", "fingerprint"], ["seq"], _match_group, SCHEMA)
    seq = lambda side: F.when(F.col("side") == side, F.col("seq"))
    alone = rest.join(open_, ["file", "fingerprint"], "left_anti").select("file", seq("raw").alias("raw_seq"), seq("base").alias("base_seq"), F.when(F.col("side") == "raw", "NEW").otherwise("GONE").alias("how"))
    return exact.unionByName(folded).unionByName(alone)


def track(previous: DataFrame, current: DataFrame, lines: DataFrame, sources: DataFrame) -> DataFrame:
    """One step of a review's history.

    previous, current: (file, seq, fingerprint, line, line_hash, resolved); lines: (file, line_hash) of
    the new contents; sources: (file) whose content is at hand.  Old findings without an anchor match by
    fingerprint alone, in order; the rest by ``match``.  A matched finding inherits its resolution; an
    unmatched old one is resolved only if the content is at hand and its anchor is gone from it.
    """
    loose, anchored = previous.where("line_hash is null and fingerprint is not null"), previous.where("line_hash is not null or fingerprint is null")
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("file", "fingerprint").orderBy("seq")))
    first = number(loose).select("file", "fingerprint", "_n", F.col("seq").alias("base_seq")).join(number(current).select("file", "fingerprint", "_n", F.col("seq").alias("raw_seq")), ["file", "fingerprint", "_n"])
    first = first.select("file", "raw_seq", "base_seq", F.lit("LOOSE").alias("how"))
    left = current.join(first.select("file", F.col("raw_seq").alias("seq")), ["file", "seq"], "left_anti")
    lost = loose.join(first.select("file", F.col("base_seq").alias("seq")), ["file", "seq"], "left_anti").select("file", F.lit(None).cast("long").alias("raw_seq"), F.col("seq").alias("base_seq"), F.lit("GONE").alias("how"))
    found = first.unionByName(match(left, anchored)).unionByName(lost)
    old = previous.select("file", F.col("seq").alias("base_seq"), F.col("line_hash").alias("_h"), F.col("resolved").alias("_was"))
    there = lines.select("file", F.col("line_hash").alias("_h")).distinct().withColumn("_there", F.lit(True))
    known = sources.select("file").distinct().withColumn("_known", F.lit(True))
    out = found.join(old, ["file", "base_seq"], "left").join(there, ["file", "_h"], "left").join(known, "file", "left")
    gone = (F.col("how") == "GONE") & F.col("_h").isNotNull() & F.coalesce("_known", F.lit(False)) & ~F.coalesce("_there", F.lit(False))
    return out.select("file", "raw_seq", "base_seq", "how", (F.coalesce("_was", F.lit(False)) | gone).alias("resolved"))


def classify(issues: DataFrame) -> DataFrame:
    """issues (…, scope, line_hash, places, found_line, context, found_context): whether a finding is confirmed by content, or for a person or model to see.

    Nothing is resolved here: a missing anchor is no proof.
    """
    reason = (
        F.when(F.col("scope") == "FILE", "file_scope").when(F.col("line_hash").isNull(), "no_anchor").when(F.coalesce(F.col("found_line"), F.lit(-1)) < 0, "anchor_missing")
        .when((F.col("scope") == "BLOCK") & (F.col("places") > 1), "partial_block").when(~F.col("context").eqNullSafe(F.col("found_context")), "context_changed")
    )
    return issues.withColumn("state", F.when(reason.isNull(), "CONFIRMED").otherwise("NEEDS_AI")).withColumn("why", F.coalesce(reason, F.lit("anchor_present")))


def sweep(issues: DataFrame) -> DataFrame:
    """A report: a reason for each finding; resolved is never set by it."""
    why = F.when(F.col("n_lines") == 0, "empty_file").when(F.col("scope") == "FILE", "file_scope").when(F.col("line_hash").isNull(), "no_anchor").when(F.col("anchor_there"), "anchor_present").otherwise("anchor_gone")
    return issues.select("id", F.lit(False).alias("resolved"), why.alias("why"))


def remap(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """lines (id, path, line) of the old file, hunks (path, old_start, old_count, new_start, lines) of the diff: the new line.

    Outside hunks a line moves by the difference of all hunks before it; inside, it goes with the
    hunk's lines, and a deleted one to the next that survives.  Hunks become a map of their old
    lines and running sums of their shifts; the distinct lines of a file and the ends of its
    hunks are read once, in order, so no line meets all hunks of its file.
    """
    starts = lambda mark: F.size(F.filter("lines", lambda x: F.startswith(x, F.lit(mark))))
    h = hunks.select("path", "old_start", "old_count", "new_start", "lines", (starts("+") - starts("-")).alias("shift"), (F.col("old_start") + F.greatest("old_count", F.lit(1))).alias("after"))
    ends = h.groupBy("path", "after").agg(F.sum("shift").alias("shift"))
    sums = ends.select("path", "after", F.sum("shift").over(Window.partitionBy("path").orderBy("after")).alias("moved"))
    body = h.where("old_count > 0").select("path", "old_start", "new_start", F.posexplode("lines").alias("p", "x"))
    earlier = Window.partitionBy("path", "old_start", "new_start").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a hunk
    before = lambda mark: F.coalesce(F.sum(F.when(F.startswith("x", F.lit(mark)), 0).otherwise(1)).over(earlier), F.lit(0))
    inside = body.select("path", "x", (F.col("old_start") + before("+")).alias("line"), (F.col("new_start") + before("-")).alias("in_hunk")).where(~F.startswith("x", F.lit("+"))).groupBy("path", "line").agg(F.max("in_hunk").alias("in_hunk"))
    asked = lines.select("path", "line").distinct()
    events = asked.select("path", F.col("line").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("moved")).unionByName(sums.select("path", F.col("after").alias("at"), F.lit(0).alias("kind"), F.col("moved").cast("long").alias("moved")))
    last = F.last("moved", ignorenulls=True).over(Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    shifted = events.withColumn("shift", last).where("kind = 1").select("path", F.col("at").alias("line"), "shift")
    moved = shifted.join(inside, ["path", "line"], "left").select("path", "line", F.coalesce("in_hunk", F.col("line") + F.coalesce("shift", F.lit(0))).cast("long").alias("new_line"))
    return lines.select("id", "path", "line").join(moved, ["path", "line"]).select("id", "new_line")


def map_upsert(branch: DataFrame, found: DataFrame) -> DataFrame:
    """found (origin, identity, seq) that a branch (origin, identity) doesn't have: by origin, then by identity, then the first of each identity."""
    fresh = found.join(branch.select("origin"), "origin", "left_anti")
    known = branch.where("identity is not null").select("identity").distinct()
    fresh = fresh.join(known, "identity", "left_anti")
    w = Window.partitionBy(F.coalesce(F.col("identity"), F.concat(F.lit("\u0001"), F.col("seq").cast("string")))).orderBy("seq")
    return fresh.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# --- state machines: folds over ordered events


ORDER = ["INGESTED", "PLANNED", "REVIEWED", "VALIDATED", "COMPLETED"]


def coverage_states(events: DataFrame) -> DataFrame:
    """events (hunk, seq, state): last state of each hunk and the number of illegal steps (anything but the next state, or EXCLUDED before COMPLETED)."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, s in enumerate(ORDER) for x in (s, i)])[F.col("state")], F.lit(99))
    w = Window.partitionBy("hunk").orderBy("seq")
    steps = events.withColumn("_r", rank).withColumn("_p", F.lag("_r").over(w))
    ok = F.when(F.col("_p").isNull(), F.col("_r") == 0).when(F.col("_r") == 99, F.col("_p") < 4).otherwise(F.col("_r") == F.col("_p") + 1)
    return steps.groupBy("hunk").agg(F.max_by("state", "seq").alias("state"), F.count(F.when(~ok, 1)).alias("illegal"))


def terminal_states(decisions: DataFrame) -> DataFrame:
    """decisions (candidate, seq, state, reason): the end of each candidate, and what is wrong with it, if anything."""
    ended = F.col("state").isin("published", "rejected")
    g = decisions.groupBy("candidate").agg(F.count_distinct(F.when(ended, F.col("state"))).alias("_s"), F.count_distinct(F.when(ended, F.col("reason"))).alias("_w"), F.max_by("state", "seq").alias("state"))
    fault = F.when(F.col("_s") > 1, "both_states").when(F.col("_w") > 1, "conflicting_reasons").when(F.col("_s") == 0, "not_terminal")
    return g.select("candidate", "state", fault.alias("fault"))


def expired(leases: DataFrame, now: Column, operations: DataFrame) -> DataFrame:
    """Leases (id, expires_at) that ran out and whose operation isn't going on."""
    return leases.where(F.col("expires_at") < now).join(operations.select("id"), "id", "left_anti")
