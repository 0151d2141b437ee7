"""Queries of data contracts, over files made of the edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from .registry import query


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def schemas(edges):
    """Schemas that refer to each other, and to a definition that isn't there."""
    src, dst = F.col("src"), F.col("dst")
    text = _text('{"title": "s', src, '", "definitions": {"a/b": {"properties": {"x": {"$ref": "../d', dst % 10, "/./s", dst, '.json#/definitions/a~1b"}, "k', src % 4, '": {"type": "', F.col("kind"), '", "items": [{"$ref": " #/definitions/zz "}, 1, null]}}}}}')
    return edges.select(_text("schemas/d", src % 10, "/s", src, ".json").alias("path"), text.alias("text"))


@query("grf07_json_references", """WITH f AS (SELECT src, dst, 'schemas/d' || src % 10 || '/s' || src || '.json' AS path FROM edges)
SELECT f.path AS source, '#/definitions/a~1b/properties/x' AS pointer, '../d' || f.dst % 10 || '/./s' || f.dst || '.json#/definitions/a~1b' AS reference, t.path AS target, '#/definitions/a~1b' AS fragment, true AS found FROM f JOIN f t ON t.src = f.dst
UNION ALL SELECT path, '#/definitions/a~1b/properties/k' || src % 4 || '/items/0', '#/definitions/zz', path, '#/definitions/zz', false FROM f""", "edges")  # fmt: skip
def _(edges):
    files = schemas(edges)
    return C.json_references(C.json_nodes(files), files)


@query("grf07_json_fields", """WITH f AS (SELECT *, 'schemas/d' || src % 10 || '/s' || src || '.json' AS path FROM edges)
SELECT path, '#/definitions/a~1b' AS owner, 'x' AS field, NULL AS type FROM f UNION ALL SELECT path, '#/definitions/a~1b', 'k' || src % 4, kind FROM f""", "edges")
def _(edges):
    return C.json_fields(C.json_nodes(schemas(edges)))


@query("grf07_graphql", """WITH t AS (SELECT src, dst, kind, 'contracts/g' || src || '.graphql' AS contract FROM edges), u AS (SELECT * FROM t WHERE src % 2 = 0),
r AS (SELECT 'app/o' || src || '.ts' AS source, u.* FROM u)
SELECT source, 'Root' AS root, ['r' || src] AS segments, 2 AS line, contract, 'Root' AS owner, 'r' || src AS field, 'T' || src AS type FROM r
UNION ALL SELECT source, 'Root', ['r' || src, 'fimports'], 3, contract, 'T' || src, 'fimports', 'T' || dst FROM r WHERE kind = 'imports'
UNION ALL SELECT source, 'Root', ['r' || r.src, 'fimports', 's'], 3, d.contract, 'T' || d.src, 's', 'String' FROM r JOIN t d ON d.src = r.dst WHERE r.kind = 'imports'""", "edges")  # fmt: skip
def _(edges):
    src, dst = F.col("src"), F.col("dst")
    types = _text('"""The type { of', src, '"""\ntype T', src, " implements Node & Other @key(fields: \"s\") {\n  f", F.col("kind"), "(first: Int = 3, by: [By!]): [T", dst, "!]! @old # f: X\n  s: String!\n}\nextend type Root { r", src, ": T", src, " }\nenum E { A B }\n", F.when(src == 1, "schema { query: Root }").otherwise(""))
    used = _text("query Q($id: ID!) {\n  own: r", src, "(id: $id) @cached {\n    it: fimports(first: 2) { s ... on T1 { s } ...Part missing }\n  }\n}")
    files = edges.select(_text("contracts/g", src, ".graphql").alias("path"), types.alias("text")).unionByName(edges.where("src % 2 = 0").select(_text("app/o", src, ".ts").alias("path"), used.alias("text")))
    return C.graphql_references(C.graphql_scan(files))
