"""Analysis sessions of a repository: a snapshot is restored, batches of changed files are ingested, and relation facts come out.

A session's state are tables, one row a file, export, import binding, call and fact; a snapshot
is these tables as Parquet.  Ingesting a batch replaces the rows of its files and resolves again
what can have changed: the batch's files, and the files that import a module which the batch
defines, defined before, or defines in another place.  All other facts are carried over, so the
work of a batch follows the batch, and the outcome equals that of resolving everything anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bounded_tasks, saved

#: Files that a task parses.
FILES_A_TASK = 50_000
#: Imported names that stand for a module as a whole.
WHOLE = ["", "*", "default"]
SCHEMAS = {
    "files": "path string, module string",
    "exports": "path string, name string",
    "imports": "path string, specifier string, key string, imported string, local string, line int",
    "calls": "path string, local string, member string, line int",
    "facts": "kind string, source string, relation string, target string, path string, line int, imported string, local string, specifier string, related string",
}
#: What makes a relation the same, wherever its line has moved to.
IDENTITY = ["kind", "source", "relation", "target", "path", "imported", "local", "specifier", "related"]


def module_of(path: Column) -> Column:
    """a/b/c.py is a.b.c; a package's own file is the package."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")


def absolute(specifier: Column, module: Column) -> Column:
    """The module that a specifier names: leading dots go up from the importing module."""
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    above = F.slice(F.split(module, r"\."), F.lit(1), F.greatest(F.size(F.split(module, r"\.")) - dots, F.lit(0)))
    rest = F.regexp_replace(specifier, r"^\.+", "")
    return F.when(dots == 0, specifier).otherwise(F.array_join(F.filter(F.concat(above, F.array(rest)), lambda p: p != ""), "."))


def parse(files: DataFrame) -> dict[str, DataFrame]:
    """files (path, text): files, exports, imports and calls, by patterns over lines.

    Exports are definitions at the left margin and names bound by imports there, which others can
    import in turn.  ``import a.b`` binds ``a.b``.  Null text is an empty file.
    """
    named = files.select("path", module_of(F.col("path")).alias("module"), "text")
    lines = named.select("path", "module", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    text, from_, plain = F.col("text"), r"^\s*from\s+([.\w]+)\s+import\s+\(?([^()#]+)\)?", r"^\s*import\s+([^#]+)"
    names = lambda c: F.explode(F.split(F.trim(c), r"\s*,\s*"))
    each = lines.where(text.rlike(from_)).select("path", "module", "line", text, F.regexp_extract(text, from_, 1).alias("specifier"), names(F.regexp_extract(text, from_, 2)).alias("name"))
    each = each.unionByName(lines.where(text.rlike(plain)).select("path", "module", "line", text, F.lit(None).cast("string").alias("specifier"), names(F.regexp_extract(text, plain, 1)).alias("name")))
    first, alias = F.regexp_extract("name", r"^([.\w]+|\*)", 1), F.regexp_extract("name", r"\sas\s+(\w+)", 1)
    specifier = F.coalesce("specifier", first)
    bound = each.where(first != "").select(
        "path", specifier.alias("specifier"), absolute(specifier, F.col("module")).alias("key"), F.when(F.col("specifier").isNotNull(), first).otherwise("").alias("imported"),
        F.when(alias != "", alias).otherwise(first).alias("local"), "line", (~text.rlike(r"^\s")).alias("_top"),
    )
    imports = bound.drop("_top").distinct()
    define = r"^(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)"
    exports = lines.where(text.rlike(define)).select("path", F.regexp_extract(text, define, 1).alias("name")).unionByName(bound.where("_top and local <> '*'").select("path", F.col("local").alias("name")))
    call = r"([A-Za-z_]\w*(?:\.\w+)*)\s*\("
    found = lines.where(~text.rlike(from_) & ~text.rlike(plain) & ~text.rlike(r"^\s*(?:async\s+)?(?:def|class)\s")).select("path", "line", F.explode(F.regexp_extract_all(text, F.lit(call), F.lit(1))).alias("name"))
    calls = found.select("path", "line", F.explode(F.array(F.struct(F.col("name").alias("local"), F.lit("").alias("member")), F.struct(F.regexp_extract("name", r"^(.*)\.\w+$", 1).alias("local"), F.regexp_extract("name", r"\.(\w+)$", 1).alias("member")))).alias("c"))
    calls = calls.select("path", "c.local", "c.member", "line").where("local <> ''").join(imports.select("path", "local").distinct(), ["path", "local"], "left_semi").distinct()
    return {"files": named.select("path", "module"), "exports": exports.distinct(), "imports": imports, "calls": calls.select("path", "local", "member", "line")}


def resolve(state: dict[str, DataFrame], imports: DataFrame, calls: DataFrame) -> DataFrame:
    """Relation facts of these imports and calls against a state's files and exports.

    A module that several files define resolves to none of them.  A named import must be
    exported.  Where a file binds a local name more than once, calls go to the binding that is
    last by specifier, name and line.
    """
    files = state["files"]
    owner = files.groupBy(F.col("module").alias("key")).agg(F.min("path").alias("related"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    met = imports.join(owner, "key").where("related <> path").join(files, "path")
    exported = state["exports"].select(F.col("path").alias("related"), F.col("name").alias("imported"))
    bound = met.where(F.col("imported").isin(WHOLE)).unionByName(met.where(~F.col("imported").isin(WHOLE)).join(exported, ["related", "imported"], "left_semi").select(met.columns))
    bound = bound.withColumnRenamed("key", "target_module")
    no = F.lit("")
    fact = lambda kind, source, relation, target, *rest: [F.lit(kind).alias("kind"), source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"), "path", "line", *(c.alias(n) for c, n in zip(rest, ("imported", "local", "specifier"), strict=True)), "related"]
    target, module, local, imported = F.col("target_module"), F.col("module"), F.col("local"), F.col("imported")
    resolution = bound.select(*fact("module-resolution", module, "resolves-import", target, imported, local, F.col("specifier")))
    binding = bound.select(*fact("import-binding", F.concat_ws("::", module, local), "resolves-to", F.when(imported.isin("", "*"), target).otherwise(F.concat_ws("::", target, imported)), no, no, no))
    last = bound.groupBy("path", "local").agg(F.max_by(F.struct("module", "target_module", "imported", "related"), F.struct("specifier", "imported", "line")).alias("b")).select("path", "local", "b.*")
    name = F.when(F.col("member") != "", F.col("member")).when(~imported.isin(WHOLE), imported).otherwise(local)
    called = calls.join(last, ["path", "local"]).select(*fact("call-resolution", F.concat_ws("::", module, local), "calls-resolved-target", F.concat_ws("::", target, name), no, no, no))
    return resolution.unionByName(binding).unionByName(called).distinct()


def dealt(files: DataFrame) -> DataFrame:
    """files by path in tasks of some FILES_A_TASK, however they are stored: what a task gathers of them to leave out repeats stays bounded."""
    return files.repartition(max(1, -(-files.count() // FILES_A_TASK)), "path")


class Session:
    """The state after some batches, the facts before them, and the paths that they changed.  Sessions don't change; ingest() gives the next."""

    def __init__(self, state: dict[str, DataFrame], baseline: DataFrame, changed: DataFrame):
        self.state, self.baseline, self.changed = state, baseline, changed

    @classmethod
    def start(cls, spark: SparkSession) -> Session:
        state = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
        return cls(state, state["facts"], spark.createDataFrame([], "path string"))

    @classmethod
    def restore(cls, spark: SparkSession, folder: str) -> Session:
        """From a snapshot, whose facts are the baseline of the differences."""
        state = {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}
        return cls(state, state["facts"], spark.createDataFrame([], "path string"))

    def snapshot(self, folder: str) -> None:
        for name, table in self.state.items():
            table.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.parquet(f"{folder}/{name}")

    def ingest(self, batch: DataFrame) -> Session:
        """batch (path, text, deleted), a path once: its files replace those of the same paths, or delete them."""
        bounded_tasks(batch.sparkSession)
        paths = saved(batch.select("path").distinct(), "session-paths")
        fresh = parse(dealt(batch.where(~F.coalesce("deleted", F.lit(False))).select("path", "text")))
        state = {name: saved(self.state[name].join(paths, "path", "left_anti").select(table.columns).unionByName(table), f"session-{name}") for name, table in fresh.items()}
        modules = self.state["files"].join(paths, "path", "left_semi").select("module").union(state["files"].join(paths, "path", "left_semi").select("module"))
        again = state["imports"].join(modules.select(F.col("module").alias("key")).distinct(), "key", "left_semi").select("path")
        affected = saved(again.union(paths).distinct(), "session-affected")
        part = lambda name: state[name].join(affected, "path", "left_semi")
        facts = resolve(state, part("imports"), part("calls"))
        state["facts"] = saved(self.state["facts"].join(affected, "path", "left_anti").unionByName(facts).select(self.baseline.columns), "session-facts")
        return Session(state, self.baseline, self.changed.union(paths).distinct())

    def differences(self) -> DataFrame:
        """Facts of changed paths that the baseline lacks (added) and those that only it has (removed), by identity; removed ones tell the kind and relation they had."""
        touched = lambda facts: facts.join(self.changed, "path", "left_semi").select(self.baseline.columns)
        old, new = touched(self.baseline), touched(self.state["facts"])
        return new.join(old, IDENTITY, "left_anti").select(F.lit("added").alias("state"), *self.baseline.columns).unionByName(old.join(new, IDENTITY, "left_anti").select(F.lit("removed").alias("state"), *self.baseline.columns))

    def finish(self) -> DataFrame:
        """All facts (state current) and the differences."""
        return self.state["facts"].select(F.lit("current").alias("state"), *self.baseline.columns).unionByName(self.differences())


def packets(facts: DataFrame) -> DataFrame:
    """One row a file with facts: its paths (itself and those related) and its number of facts."""
    each = facts.select("path", F.explode(F.array_distinct(F.array("path", "related"))).alias("p")).distinct()
    return each.groupBy("path").agg(F.sort_array(F.collect_set("p")).alias("paths")).join(facts.groupBy("path").agg(F.count("*").alias("n_facts")), "path")


def origins(state: dict[str, DataFrame]) -> DataFrame:
    """(path, local, origin_path, origin_name, hops): where each bound name was first defined, through re-exports and aliases of any number.

    Hops are doubled by joins until no end is itself bound elsewhere; names bound in a circle
    have null origins.
    """
    bound = state["facts"].where("kind = 'module-resolution'").where(~F.col("imported").isin(WHOLE)).groupBy("path", "local").agg(F.max_by(F.struct("related", "imported"), F.struct("specifier", "imported", "line")).alias("b"))
    now = saved(bound.select("path", "local", F.col("b.related").alias("origin_path"), F.col("b.imported").alias("origin_name"), F.lit(1).cast("long").alias("hops")), "session-hops")
    n = now.count()
    for _ in range(max(1, n.bit_length()) + 1):
        onward = now.select(F.col("path").alias("origin_path"), F.col("local").alias("origin_name"), F.col("origin_path").alias("_p"), F.col("origin_name").alias("_n"), F.col("hops").alias("_h"))
        if now.join(onward, ["origin_path", "origin_name"], "left_semi").isEmpty():
            break
        longer = now.join(onward, ["origin_path", "origin_name"], "left")
        now = saved(longer.select("path", "local", F.coalesce("_p", "origin_path").alias("origin_path"), F.coalesce("_n", "origin_name").alias("origin_name"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops")), "session-hops")
    circle = F.col("hops") > n  # longer than any path without a circle
    return now.select("path", "local", *(F.when(~circle, F.col(c)).alias(c) for c in ("origin_path", "origin_name", "hops")))
