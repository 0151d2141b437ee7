"""The graph that an index is inspected by: chunks, virtual nodes for files, symbols and parents, and typed, weighted edges.

Edges are additions in an order (files, then symbols, parents, and relations, each as the chunks
come); what is added again makes an edge heavier.  Virtual nodes and edges have caps in that
order: the cap's place is the order of the last one that first occurs within it, found by a
bounded top-n, and additions beyond it don't count.  No task orders them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved

# Relations in the order in which they are read; kind of edge, indexes that name its targets, weight, values of a chunk, targets of a value, kind of the node outside (none if null).
RELATIONS = [
    ("calls", "calls", ("member", "type"), 1.85, 45, 5, None),
    ("extends", "extends", ("type",), 2.35, 12, 1, "external_type"),
    ("implements", "implements", ("type",), 2.1, 20, 1, "external_type"),
    ("referenced_types", "referenced_type", ("type",), 1.7, 35, 2, "external_type"),
    ("imports", "imports", ("type",), 1.35, 35, 1, "import"),
]
# How well a kind of chunk serves as the target of a call, and of other relations.
CALL_KINDS = {"method": 0, "function": 0, "constructor": 1, "class": 2, "record": 2, "interface": 3, "enum": 3}
TYPE_KINDS = {"class": 0, "interface": 0, "record": 0, "enum": 0, "struct": 0, "trait": 0, "type": 0, "constructor": 1, "function": 2, "method": 3}
# Words that name no target.
COMMON_TOKENS = (
    "a an and any array as async await bool boolean byte char class const def dict double enum false float for from function get go if import int integer interface let list long map "
    "new none null number object of optional or return set short str string super this true tuple undefined unknown var void"
).split()
#: Weights of what holds chunks together, members of a group, and how many of them get an edge.
CONTAINS, SEQUENCE, SYMBOL, PARENT = (1.35, None, 80), (0.35, None, None), (1.1, 80, 40), (0.95, 100, 55)
AGAIN, HEAVIEST, TOKENS, OUTSIDE, CANDIDATES = 0.2, 8.0, 8, 0.72, 10
ORDER = ["o0", "o1", "o2", "o3", "o4"]


def key(value: Column) -> Column:
    """A name as it is looked up: lower case, dots for separators, no quotes or blanks around; null for common words."""
    bare = F.regexp_replace(value, r"^[\s`'\";:,()\[\]{}<>]+|[\s`'\";:,()\[\]{}<>]+$", "")
    dotted = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[\\/#:]", "."), r"\s+", ""), r"^\.+|\.+$", ""))
    return F.when((dotted != "") & ~dotted.isin(COMMON_TOKENS), dotted)


def tokens(value: Column) -> Column:
    """Keys that a value may be known by: its own, those of names in it, and of their last parts."""
    found = F.filter(F.regexp_extract_all(value, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*(?:[.#:/\\][A-Za-z_$][A-Za-z0-9_$]*)*)"), F.lit(1)), lambda m: ~F.lower(m).isin(COMMON_TOKENS))
    each = F.flatten(F.transform(found, lambda m: F.array(key(m), key(F.element_at(F.split(m, r"[.#:/\\]"), -1)))))
    return F.filter(F.array_distinct(F.concat(F.array(key(value)), each)), lambda k: k.isNotNull())


def last_part(value: Column) -> Column:
    return F.element_at(F.split(F.trim(value), "[./#]"), -1)


def synthetic(kind: str, *parts: Column) -> Column:
    return F.concat_ws("::", F.lit(kind), *(F.replace(F.coalesce(p, F.lit("")), F.lit("::"), F.lit("/")) for p in parts))


def _order(phase: int, *places: Column) -> list[Column]:
    """The order of an addition: phase, and up to four places in it."""
    return [F.lit(phase).cast("long").alias("o0"), *(p.cast("long").alias(f"o{i + 1}") for i, p in enumerate([*places, *[F.lit(0)] * (4 - len(places))]))]


def _groups(members: DataFrame, by: list[str], limits: tuple) -> DataFrame:
    """members (*by, seq, pos, id, …) of groups of a size within the limits, with the group's first place (f0, f1) and their rank (i) in it, those up to the limit; and the size."""
    _, most, edges = limits
    sizes = members.groupBy(*by).agg(F.count("*").alias("size"), F.min(F.struct("seq", "pos")).alias("_f"))
    if most:
        sizes = sizes.where(F.col("size").between(2, most))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("seq", "pos"))
    met = members.join(sizes.select(*(F.col(b).alias(f"_{b}") for b in by), "size", F.col("_f.seq").alias("f0"), F.col("_f.pos").alias("f1")), F.expr(" and ".join(f"{b} <=> _{b}" for b in by))).drop(*(f"_{b}" for b in by))
    return met.withColumn("i", rank).where(F.col("i") <= edges) if edges else met.withColumn("i", rank)


def _kept(nodes: DataFrame, cap: int | None) -> DataFrame:
    """The first ``cap`` (or all) distinct virtual nodes (id, title, kind, size), by the order of their first occurrence; the largest size of each."""
    first = nodes.groupBy("id").agg(F.min(F.struct(*ORDER)).alias("o"), F.min_by(F.struct("title", "kind"), F.struct(*ORDER)).alias("n"), F.max("size").alias("size"))
    return (first.orderBy("o").limit(cap) if cap is not None else first).select("id", "n.title", "n.kind", "size", *(F.col(f"o.{c}").alias(c) for c in ORDER))


def targets(nodes: DataFrame) -> DataFrame:
    """One row for each relation value of a chunk and target found: seq, field (number), at (value), label, id, branch, rank, target; target null if there is none.

    A name that many chunks have (30, or 6 for each target wanted) leads nowhere, so a value meets
    a bounded number of chunks.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    types = F.filter(F.concat(F.array("name", stem, F.when(F.col("namespace") != "", F.concat_ws(".", "namespace", "name"))), F.coalesce("names", F.array().cast("array<string>"))), lambda v: v != "")
    pairs = lambda kind, values: nodes.select(F.lit(kind).alias("index"), "seq", F.explode(F.array_distinct(F.flatten(F.transform(values, tokens)))).alias("token"))
    index = saved(pairs("type", types).unionByName(pairs("member", F.coalesce("members", F.array().cast("array<string>")))), "inspector-index")
    about = nodes.select("seq", F.col("id").alias("target"), F.col("branch").alias("t_branch"), F.col("path").alias("t_path"), F.col("kind").alias("t_kind"), F.coalesce("start_line", F.lit(10**9)).alias("t_line"), F.coalesce("title", "name", "id").alias("t_title"))
    place = F.create_map(*(F.lit(x) for i, (field, *_) in enumerate(RELATIONS) for x in (field, i)))
    most = F.create_map(*(F.lit(x) for field, _, _, _, n, _, _ in RELATIONS for x in (field, n)))
    values = nodes.select("seq", "id", "branch", "path", F.explode("relations").alias("r")).select("seq", "id", "branch", "path", F.col("r.field").alias("name"), F.posexplode("r.values").alias("at", "value")).where("value <> ''")
    values = saved(values.where(place[F.col("name")].isNotNull() & (F.col("at") < most[F.col("name")])).select("seq", "id", "branch", "path", place[F.col("name")].alias("field"), "at", "value"), "inspector-values")
    out = None
    for i, (_, _, indexes, _, _, wanted, _) in enumerate(RELATIONS):
        seen = index.where(F.col("index").isin(list(indexes))).select("token", F.col("seq").alias("tseq")).distinct()
        few = seen.groupBy("token").agg(F.count("*").alias("_n")).where(F.col("_n") < max(30, 6 * wanted)).select("token")
        asked = values.where(F.col("field") == i).select("*", F.posexplode(F.slice(tokens(F.col("value")), 1, CANDIDATES)).alias("tok", "token"))
        met = asked.join(seen.join(few, "token"), "token").join(about.withColumnRenamed("seq", "tseq"), "tseq")
        own = F.max(F.coalesce((F.col("branch") != "") & (F.col("branch") == F.col("t_branch")), F.lit(False))).over(Window.partitionBy("seq", "field", "at", "tok"))
        met = met.withColumn("_own", own).where(~F.col("_own") | (F.col("branch") == F.col("t_branch"))).where("id <> target")
        kinds = F.create_map(*(F.lit(x) for kv in (CALL_KINDS if i == 0 else TYPE_KINDS).items() for x in kv))
        rank = F.struct("tok", F.when(F.lit(RELATIONS[i][0] == "imports") & (F.col("path") == F.col("t_path")), 1).otherwise(0).alias("same"), F.coalesce(kinds[F.col("t_kind")], F.lit(8)).alias("kind"), "t_line", F.length("t_title").alias("n"), "t_title", "tseq")
        best = met.groupBy("seq", "field", "at", "target").agg(F.min(rank).alias("rank"))
        best = best.withColumn("i", F.row_number().over(Window.partitionBy("seq", "field", "at").orderBy("rank"))).where(F.col("i") <= wanted).drop("rank")
        out = best if out is None else out.unionByName(best)
    label = F.substring(F.regexp_replace(F.regexp_replace(F.trim("value"), r"\s+", " "), "^[`'\";]+|[`'\";]+$", ""), 1, 180)
    return values.withColumn("label", label).join(out, ["seq", "field", "at"], "left")


def build(nodes: DataFrame, max_edges: int | None = 1200, max_virtual: int | None = 240) -> tuple[DataFrame, DataFrame]:
    """(virtual nodes, edges) of chunks.

    nodes: seq (their order), id, branch, path, namespace, kind, title, name, names, members
    (arrays), parent, start_line, chunk, relations (array of field and values).  Virtual nodes:
    id, title, kind, size.  Edges: source, target, kind, weight, tokens.  Null names, parents and
    paths make no groups.  A cap of None is no cap.
    """
    nodes = saved(nodes, "inspector-nodes")
    place = lambda: F.struct(F.coalesce("start_line", F.lit(10**9)).alias("l"), F.coalesce("chunk", F.lit(10**9)).alias("c"), "id")
    # files: members in the order of lines
    filed = nodes.where("path <> ''").select(F.coalesce("branch", F.lit("")).alias("branch"), "path", "seq", F.lit(0).alias("pos"), "id", place().alias("place"))
    file_order = Window.partitionBy("branch", "path").orderBy("place")
    first = filed.groupBy("branch", "path").agg(F.min("seq").alias("f0"), F.count("*").alias("size"))
    placed = filed.withColumn("i", F.row_number().over(file_order)).withColumn("next", F.lead("id").over(file_order)).join(first, ["branch", "path"]).withColumn("v", synthetic("file", F.col("branch"), F.col("path")))
    placed = saved(placed, "inspector-files")
    # symbols and parents: members in the order of chunks
    named = nodes.select("seq", "id", F.posexplode(F.concat(F.array("name"), F.coalesce("names", F.array().cast("array<string>")))).alias("pos", "n")).select("seq", "id", "pos", last_part(F.col("n")).alias("symbol")).where("symbol <> ''")
    symbols = saved(_groups(named, ["symbol"], SYMBOL).withColumn("v", synthetic("symbol", F.col("symbol"))), "inspector-symbols")
    owned = nodes.where("parent <> ''").select(F.coalesce("branch", F.lit("")).alias("branch"), "parent", "seq", F.lit(0).alias("pos"), "id")
    parents = saved(_groups(owned, ["branch", "parent"], PARENT).withColumn("v", synthetic("parent", F.col("branch"), F.col("parent"))), "inspector-parents")
    found = saved(targets(nodes), "inspector-targets")
    outer = F.create_map(*(F.lit(x) for i, r in enumerate(RELATIONS) if r[6] for x in (i, r[6])))
    outside = found.where(F.col("target").isNull() & outer[F.col("field")].isNotNull() & (F.col("label") != "")).withColumn("token", F.coalesce(F.get(tokens(F.col("label")), F.lit(0)), key(F.col("label")))).where("token is not null")
    outside = outside.withColumn("v", F.concat_ws("::", outer[F.col("field")], F.replace(F.coalesce("branch", F.lit("")), F.lit("::"), F.lit("/")), F.replace("token", F.lit("::"), F.lit("/"))))
    virtual = (
        placed.select(F.col("v").alias("id"), F.element_at(F.split("path", "/"), -1).alias("title"), F.lit("file").alias("kind"), "size", *_order(1, F.col("f0")))
        .unionByName(symbols.select(F.col("v").alias("id"), F.col("symbol").alias("title"), F.lit("symbol").alias("kind"), "size", *_order(2, F.col("f0"), F.col("f1"))))
        .unionByName(parents.select(F.col("v").alias("id"), F.col("parent").alias("title"), F.lit("parent_class").alias("kind"), "size", *_order(3, F.col("f0"))))
        .unionByName(outside.select(F.col("v").alias("id"), last_part(F.col("label")).alias("title"), outer[F.col("field")].alias("kind"), F.lit(0).cast("long").alias("size"), *_order(4, F.col("seq"), F.col("field"), F.col("at"))))
    )
    kept = saved(_kept(virtual, max_virtual), "inspector-virtual")
    there = kept.select(F.col("id").alias("v"))
    none = F.lit(None).cast("string").alias("token")
    both = lambda a, b: (F.least(a, b).alias("source"), F.greatest(a, b).alias("target"))
    weights = F.create_map(*(F.lit(x) for i, r in enumerate(RELATIONS) for x in (i, r[3])))
    kinds = F.create_map(*(F.lit(x) for i, r in enumerate(RELATIONS) for x in (i, r[1])))
    relation = [kinds[F.col("field")].alias("kind")]
    added = (
        placed.where(F.col("i") <= CONTAINS[2]).join(there, "v").select(F.col("v").alias("source"), F.col("id").alias("target"), F.lit("file_contains").alias("kind"), F.lit(CONTAINS[0]).alias("weight"), none, *_order(1, F.col("f0"), F.lit(0), F.col("i")))
        .unionByName(placed.where("next is not null").select(*both("id", "next"), F.lit("file_sequence").alias("kind"), F.lit(SEQUENCE[0]).alias("weight"), none, *_order(1, F.col("f0"), F.lit(1), F.col("i"))))
        .unionByName(symbols.join(there, "v").select(*both("v", "id"), F.lit("same_symbol").alias("kind"), F.lit(SYMBOL[0]).alias("weight"), none, *_order(2, F.col("f0"), F.col("f1"), F.col("i"))))
        .unionByName(parents.join(there, "v").select(*both("v", "id"), F.lit("same_parent").alias("kind"), F.lit(PARENT[0]).alias("weight"), none, *_order(3, F.col("f0"), F.lit(0), F.col("i"))))
        .unionByName(found.where("target is not null").select(F.col("id").alias("source"), "target", *relation, weights[F.col("field")].alias("weight"), F.col("label").alias("token"), *_order(4, F.col("seq"), F.col("field"), F.col("at"), F.col("i"))))
        .unionByName(outside.join(there, "v").select(F.col("id").alias("source"), F.col("v").alias("target"), *relation, (weights[F.col("field")] * OUTSIDE).alias("weight"), F.col("label").alias("token"), *_order(4, F.col("seq"), F.col("field"), F.col("at"))))
    ).where("source <> target")
    added = saved(added, "inspector-added")
    edge, order = ["source", "target", "kind"], F.struct(*ORDER)
    if max_edges is not None:  # additions after the edge that fills the cap are not looked at
        firsts = added.groupBy(*edge).agg(F.min(order).alias("o")).orderBy("o").limit(max_edges)
        count, last = firsts.agg(F.count("*"), F.max("o")).first()
        if count == max_edges:
            added = added.where(order <= F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(ORDER, last, strict=True)))) if count else added.limit(0)
    sums = added.groupBy(*edge).agg(F.min_by("weight", order).alias("_first"), F.sum("weight").alias("_all"))
    # tokens: the first TOKENS distinct ones of an edge by their first place
    said = added.where("token is not null").groupBy(*edge, "token").agg(F.min(order).alias("o")).withColumn("r", F.row_number().over(Window.partitionBy(*edge).orderBy("o"))).where(F.col("r") <= TOKENS)
    said = said.groupBy(*edge).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]).alias("tokens"))
    weight = F.least(F.col("_first") + AGAIN * (F.col("_all") - F.col("_first")), F.greatest(F.lit(HEAVIEST), F.col("_first")))
    return kept.select("id", "title", "kind", "size"), sums.join(said, edge, "left").select(*edge, weight.alias("weight"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
