"""Relation graphs: building, grouping, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .folds import fold


def review_groups(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files (path) that hang together, in groups of two or more, named by their least path."""
    c = changed.select(F.col("path").alias("src")).distinct()
    inner = edges.join(c, "src", "left_semi").join(c.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return connected_components(inner, "src", "dst")


def build(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges inside a set of nodes (node), in both directions, the strongest of repeated ones."""
    n = nodes.select(F.col("node").alias("src")).distinct()
    inner = edges.join(n, "src", "left_semi").join(n.withColumnRenamed("src", "dst"), "dst", "left_semi").where("src <> dst")
    both = inner.select("src", "dst", "kind", "weight").unionByName(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.min("kind").alias("kind"))


def undirected(edges: DataFrame, cap: float = 8.0) -> DataFrame:
    """Undirected edges with the weight of the first and 0.2 of each repeated one, capped."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind", "weight")
    w = F.max("weight") + 0.2 * (F.sum("weight") - F.max("weight"))
    return e.groupBy("a", "b", "kind").agg(F.least(w, F.lit(cap)).alias("weight"))


#: Priorities of files, the most urgent first.
PRIORITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def batches(files: DataFrame, most_files: int = 15, most_tokens: int = 200_000) -> DataFrame:
    """files (review, path, component or null, strength, priority, tokens) of reviews: (review, path, batch).

    Components, the largest first (then the most urgent), are cut by number of files and tokens,
    their strongest files first; files without a component make one more line, by urgency; then
    batches of the same prevailing priority are put together as long as they fit.  Order decides,
    so a review is one fold (its files are bounded by what one request may change).
    """

    def cut(line: list) -> list[list]:
        out, now, used = [], [], 0
        for f in line:
            if now and (len(now) >= most_files or used + f.tokens > most_tokens):
                out.append(now)
                now, used = [], 0
            now.append(f)
            used += f.tokens
        return out + [now] * bool(now)

    def run(group: list) -> list[tuple]:
        urgency = {p: i for i, p in enumerate(PRIORITIES)}
        components: dict = {}
        for f in group:
            components.setdefault(None if f.component != f.component else f.component, []).append(f)
        alone = components.pop(None, [])
        line = []
        for files in sorted(components.values(), key=lambda c: (-len(c), min(urgency[f.priority] for f in c), min(f.path for f in c))):
            line += cut(sorted(files, key=lambda f: (-f.strength, urgency[f.priority], f.path)))
        line += cut(sorted(alone, key=lambda f: (urgency[f.priority], f.path)))
        merged, by_priority = [], {p: [] for p in PRIORITIES}
        for batch in line:
            names = [f.priority for f in batch]
            by_priority[min(set(names), key=lambda p: (-names.count(p), urgency[p]))].append(batch)
        for same in by_priority.values():
            now: list = []
            for batch in same:
                if now and (len(now) + len(batch) > most_files or sum(f.tokens for f in now + batch) > most_tokens):
                    merged.append(now)
                    now = []
                now = now + batch
            merged += [now] * bool(now)
        return [(f.review, f.path, i) for i, batch in enumerate(merged) for f in batch]

    return fold(files.select("review", "path", F.col("component").cast("double").alias("component"), F.col("strength").cast("double").alias("strength"), "priority", "tokens"), ["review"], ["path"], run, "review long, path string, batch long")


def imports(exports: DataFrame, uses: DataFrame) -> DataFrame:
    """exports (path, name), uses (path, name): relation facts, several exporters of a name left out as ambiguous."""
    one = exports.groupBy("name").agg(F.count_distinct("path").alias("_n"), F.min("path").alias("target")).where("_n = 1").drop("_n")
    return uses.withColumnRenamed("path", "source").join(one, "name").where("source <> target").select("source", "target", "name").distinct()


def contract_references(files: DataFrame) -> DataFrame:
    """files (path, text): JSON schema definitions and the ``$ref`` that name them: (source, target, name)."""
    declared = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r'"\$id"\s*:\s*"([^"]+)"'), F.lit(1))).alias("name"))
    used = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r'"\$ref"\s*:\s*"([^"#]+)'), F.lit(1))).alias("name"))
    return imports(declared, used)


def focus(packets: DataFrame, paths: list[str]) -> DataFrame:
    """packets (id, facts: array of (source, relation, target, path)): the facts that touch the paths, and the paths of these."""
    want = F.array(*[F.lit(p) for p in paths])
    kept = F.filter("facts", lambda f: F.array_contains(want, f["path"]))
    return packets.select("id", kept.alias("facts")).where(F.size("facts") > 0).withColumn("paths", F.array_sort(F.array_distinct(F.transform("facts", lambda f: f["path"]))))


def strength(edges: DataFrame, cap: float = 5.0) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    return both.groupBy("node").agg(F.least(F.sum("weight"), F.lit(cap)).alias("strength"))


def virtual_nodes(members: DataFrame, least: int, most: int, keep: int, order: Column) -> DataFrame:
    """members (key, node): groups of a size between the bounds become virtual nodes, the first so many in order."""
    sizes = members.groupBy("key").agg(F.count_distinct("node").alias("size")).where(F.col("size").between(least, most))
    chosen = sizes.orderBy(order, "key").limit(keep)
    return members.distinct().join(chosen, "key").select("key", "node", "size")
