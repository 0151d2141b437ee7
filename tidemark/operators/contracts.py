"""Data contracts: fields that JSON schemas and GraphQL types declare, and the references to them.

JSON is parsed into variants and taken apart level by level, a job for each level of nesting, so
nodes, fields and references of any depth are rows.  GraphQL text is scanned once by a stack of
brackets (a small helper in Arrow batches); types are then followed along selected fields by
joins, a step for each field of the longest selection, so types that refer to each other in
circles cost nothing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved

# Root types of operations, where no schema block names others.
ROOTS = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}


def json_nodes(files: DataFrame) -> DataFrame:
    """(path, pointer, parent, name, value, kind) of every node below the roots of JSON files (path, text).

    pointer: as in references (#/a/0/b, with ~0 and ~1); value: of a string, else null; kind:
    object, array or leaf.  Text that isn't JSON, or null, has no nodes.
    """
    spark = files.sparkSession
    level = files.select("path", F.lit("#").alias("pointer"), F.try_parse_json("text").alias("v")).where("v is not null")
    out, step = None, F.concat_ws("/", "pointer", F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string")))
    while True:
        below = spark.sql("SELECT path, pointer, t.pos, t.key, t.value AS v FROM {level}, LATERAL variant_explode(v) AS t", level=level)
        kind = F.schema_of_variant("v")
        kind = F.when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), "array").otherwise("leaf")
        nodes = saved(below.select("path", step.alias("pointer"), F.col("pointer").alias("parent"), F.coalesce("key", F.col("pos").cast("string")).alias("name"), F.when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string")).alias("value"), kind.alias("kind"), "v"), "json-nodes")
        part = nodes.drop("v")
        out = part if out is None else out.unionByName(part)
        level = nodes.where("kind <> 'leaf'").select("path", "pointer", "v")
        if level.isEmpty():
            return out


def json_fields(nodes: DataFrame) -> DataFrame:
    """(path, owner, field, type): what stands under ``properties``, with the pointer of its schema and its type, if it names one."""
    fields = nodes.where(F.endswith("parent", F.lit("/properties"))).select("path", F.regexp_replace("parent", "/properties$", "").alias("owner"), F.col("name").alias("field"), "pointer")
    types = nodes.where("name = 'type'").select("path", F.col("parent").alias("pointer"), F.col("value").alias("type"))
    return fields.join(types, ["path", "pointer"], "left").select("path", "owner", "field", "type")


def normal_path(path: Column) -> Column:
    """A path without . and .. parts; null if it leaves the repository."""
    step = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when((F.get(parts, F.lit(0)) != "..") & ~F.startswith(path, F.lit("/")), F.array_join(parts, "/"))


def json_references(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(source, pointer, reference, target, fragment, found): each ``$ref`` to a known file, or the same one; found: the fragment names a node there (or the file as a whole)."""
    r = F.col("reference")
    used = nodes.where("name = '$ref' and value is not null").select(F.col("path").alias("source"), F.col("parent").alias("pointer"), F.trim("value").alias("reference")).where("reference <> ''")
    file = F.regexp_extract(r, "^([^#]*)", 1)
    folder = F.regexp_extract("source", "^(.*/)", 1)
    used = used.withColumn("target", F.when(file == "", F.col("source")).otherwise(normal_path(F.concat(folder, file)))).withColumn("fragment", F.when(r.contains("#"), F.concat(F.lit("#"), F.regexp_extract(r, "#(.*)$", 1))).otherwise(""))
    known = used.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    there = nodes.select(F.col("path").alias("target"), F.col("pointer").alias("fragment"), F.lit(True).alias("_there")).distinct()
    return known.join(there, ["target", "fragment"], "left").select("source", "pointer", "reference", "target", "fragment", (F.col("fragment").isin("", "#", "#/") | F.coalesce("_there", F.lit(False))).alias("found"))


_TOKEN = re.compile(r'"""(?:[^"]|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|#[^\n]*|\.\.\.|[A-Za-z_]\w*|[{}()\[\]:!@=|&$]|\n')
SCANNED = "path string, what string, owner string, name string, target string, segments array<string>, line int"


class _Scan:
    """One text, token by token."""

    def __init__(self, text: str):
        self.tokens, self.at, line = [], 0, 1
        for token in _TOKEN.findall(text):
            if token[0] not in '#"\n':
                self.tokens.append((token, line))
            line += token.count("\n")

    def see(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def skip(self, opening: str, closing: str) -> None:
        """Past a bracket and all up to its partner."""
        depth = 0
        while self.see():
            depth += (self.see() == opening) - (self.see() == closing)
            self.at += 1
            if not depth:
                return

    def to_block(self) -> bool:
        """To the next { of this definition; False if a new definition begins before."""
        while self.see() and self.see() != "{":
            if self.see() == "(":
                self.skip("(", ")")
            elif self.see() in ("type", "interface", "input", "extend", "schema", "query", "mutation", "subscription", "fragment", "enum", "union", "scalar", "directive"):
                return False
            else:
                self.at += 1
        return bool(self.see())

    def fields(self, owner: str, what: str) -> list[tuple]:
        out = []
        self.at += 1
        while self.see() not in ("}", ""):
            name, line = self.tokens[self.at]
            self.at += 1
            if name == "@":
                self.at += 1
                if self.see() == "(":
                    self.skip("(", ")")
            elif name == "(":
                self.at -= 1
                self.skip("(", ")")
            elif (name[0].isalpha() or name[0] == "_") and self.see() in ("(", ":"):
                if self.see() == "(":
                    self.skip("(", ")")
                while self.see() in (":", "["):
                    self.at += 1
                out.append((what, owner, name, self.see(), None, line))
                self.at += 1
        self.at += 1
        return out

    def selection(self, root: str) -> list[tuple]:
        out, path = [], [None]  # a place for each open bracket
        self.at += 1
        while path and self.see():
            token, line = self.tokens[self.at]
            self.at += 1
            if token == "}":
                path.pop()
            elif token == "{":
                path.append(None)
            elif token == "(":
                self.at -= 1
                self.skip("(", ")")
            elif token == "@":
                self.at += 1
            elif token == "...":  # what stands in a fragment has another owner
                if self.see() == "on":
                    self.at += 2
                elif self.see() not in ("@", "{"):
                    self.at += 1
                while self.see() == "@":
                    self.at += 2
                    if self.see() == "(":
                        self.skip("(", ")")
                if self.see() == "{":
                    self.skip("{", "}")
            elif token[0].isalpha() or token[0] == "_":
                if self.see() == ":":  # an alias
                    self.at += 1
                    token = self.see()
                    self.at += 1
                path[-1] = token
                out.append(("reference", root, token, None, list(path), line))
        return out

    def all(self) -> list[tuple]:
        out = []
        while self.see():
            word = self.see()
            self.at += 1
            if word in ("type", "interface", "input"):
                owner = self.see()
                self.at += 1
                if self.to_block():
                    out += self.fields(owner, "field")
            elif word == "schema":
                if self.to_block():
                    out += [("root", *f[1:]) for f in self.fields("", "root")]
            elif word in ROOTS or word == "{":
                if word == "{":
                    self.at -= 1
                if self.to_block():
                    out += self.selection(word if word in ROOTS else "query")
            elif word == "(":
                self.at -= 1
                self.skip("(", ")")
            elif word in ("fragment", "enum") and self.to_block():
                self.skip("{", "}")
        return out


def graphql_scan(files: DataFrame) -> DataFrame:
    """SCANNED rows of files (path, text): fields of types (owner, name, target type), roots of a schema (name, target), references (owner: kind of operation, segments)."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf["path"], pdf["text"]) if t for r in _Scan(t).all()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCANNED.split(", ")]).astype({"line": "Int32"})

    return files.select("path", "text").mapInPandas(run, SCANNED)


def graphql_references(scanned: DataFrame) -> DataFrame:
    """(source, root, segments, line, contract, owner, field, type): references whose every field is declared once, and the declaration that the last one selects."""
    scanned = saved(scanned, "graphql")
    declared = scanned.where("what = 'field'").groupBy("owner", F.col("name").alias("field")).agg(F.count_distinct("path").alias("n"), F.count("*").alias("k"), F.min(F.struct(F.col("path").alias("contract"), F.col("target").alias("type"))).alias("d")).where("k = 1").select("owner", "field", "d.contract", "d.type")
    named = scanned.where("what = 'root'").groupBy("name").agg(F.min("target").alias("type"))
    used = scanned.where("what = 'reference'").select(F.col("path").alias("source"), F.col("owner").alias("name"), "segments", "line").distinct()
    default = F.create_map(*(F.lit(x) for kv in ROOTS.items() for x in kv))
    now = used.join(named, "name", "left").select("source", "segments", "line", F.coalesce("type", default[F.col("name")]).alias("root")).withColumn("owner", F.col("root"))
    longest = used.agg(F.max(F.size("segments"))).first()[0] or 0
    out = None
    for depth in range(longest):
        met = now.withColumn("field", F.get("segments", F.lit(depth))).join(declared, ["owner", "field"])
        met = saved(met.select("source", "root", "segments", "line", "contract", "owner", "field", "type"), "graphql-step")
        ended = met.where(F.size("segments") == depth + 1)
        out = ended if out is None else out.unionByName(ended)
        now = met.where(F.size("segments") > depth + 1).select("source", "segments", "line", "root", F.col("type").alias("owner"))
    return out if out is not None else now.select("source", "root", "segments", "line", F.lit("").alias("contract"), "owner", F.lit("").alias("field"), F.lit("").alias("type"))
