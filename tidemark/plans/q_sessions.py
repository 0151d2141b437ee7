"""Queries of repository sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..shared import new_path
from .registry import query

# Files made of the edges: each defines a function and imports from another file, in three ways by kind.
# In the second version a fifth of them are deleted, a fifth import another file, a fifth define another function.
_MODEL = """
WITH v AS (SELECT 1 AS v UNION ALL SELECT 2),
e AS (SELECT v, src, CASE WHEN v = 2 AND src % 5 = 1 THEN dst + 1 ELSE dst END AS dst, kind, CASE WHEN v = 2 AND src % 5 = 2 THEN (src + 1) % 3 ELSE src % 3 END AS fn FROM edges, v WHERE v = 1 OR src % 5 <> 0),
f AS (SELECT v, src, 'pkg/m' || src || '.py' AS path, 'pkg.m' || src AS module, fn, kind, dst, 'pkg.m' || dst AS specifier,
  CASE kind WHEN 'imports' THEN 'f' || (dst % 3) WHEN 'calls' THEN '' ELSE 'g' END AS imported, CASE kind WHEN 'calls' THEN 'h' ELSE 'g' END AS local FROM e),
x AS (SELECT v, path, 'f' || fn AS name FROM f UNION SELECT v, path, local FROM f),
b AS (SELECT f.*, t.path AS related, t.module AS tmodule FROM f JOIN f t ON f.v = t.v AND f.specifier = t.module AND f.path <> t.path
  WHERE f.imported = '' OR EXISTS (SELECT 1 FROM x WHERE x.v = f.v AND x.path = t.path AND x.name = f.imported)),
facts AS (SELECT v, 'module-resolution' AS kind, module AS source, 'resolves-import' AS relation, tmodule AS target, path, 2 AS line, imported, local, specifier, related FROM b
  UNION ALL SELECT v, 'import-binding', module || '::' || local, 'resolves-to', CASE imported WHEN '' THEN tmodule ELSE tmodule || '::' || imported END, path, 2, '', '', '', related FROM b
  UNION ALL SELECT v, 'call-resolution', module || '::' || local, 'calls-resolved-target', tmodule || '::' || CASE local WHEN 'h' THEN 'run' ELSE imported END, path, CASE local WHEN 'h' THEN 4 ELSE 3 END, '', '', '', related FROM b)
"""


def versions(edges):
    """(v, path, text, deleted)."""
    src, dst, kind = F.col("src"), F.col("dst"), F.col("kind")
    text = lambda to, fn: F.concat(F.lit("def f"), fn.cast("string"), F.lit("():\n"), F.when(kind == "imports", F.concat(F.lit("from pkg.m"), to.cast("string"), F.lit(" import f"), (to % 3).cast("string"), F.lit(" as g"))).when(kind == "calls", F.concat(F.lit("import pkg.m"), to.cast("string"), F.lit(" as h"))).otherwise(F.concat(F.lit("from pkg.m"), to.cast("string"), F.lit(" import g"))), F.lit("\n    return g()\n    h.run()\n"))
    path = F.concat(F.lit("pkg/m"), src.cast("string"), F.lit(".py"))
    old = edges.select(F.lit(1).alias("v"), "src", path.alias("path"), text(dst, src % 3).alias("text"), F.lit(False).alias("deleted"))
    new = edges.where("src % 5 < 3").select(F.lit(2).alias("v"), "src", path.alias("path"), text(F.when(src % 5 == 1, dst + 1).otherwise(dst), F.when(src % 5 == 2, (src + 1) % 3).otherwise(src % 3)).alias("text"), (src % 5 == 0).alias("deleted"))
    return old.unionByName(new)


def session(edges):
    """The first version in full, a snapshot of it restored, the second in two batches."""
    spark, files = edges.sparkSession, versions(edges)
    folder = new_path(spark, "snapshot")
    S.Session.start(spark).ingest(files.where("v = 1").select("path", "text", "deleted")).snapshot(folder)
    head = files.where("v = 2")
    after = S.Session.restore(spark, folder).ingest(head.where("src % 2 = 0").select("path", "text", "deleted"))
    return after.ingest(head.where("src % 2 = 1").select("path", "text", "deleted"))


_ID = "kind, source, relation, target, path, imported, local, specifier, related"


@query("udf02_session", _MODEL + f""", d AS (SELECT {_ID} FROM facts WHERE v = 1 EXCEPT SELECT {_ID} FROM facts WHERE v = 2), a AS (SELECT {_ID} FROM facts WHERE v = 2 EXCEPT SELECT {_ID} FROM facts WHERE v = 1),
changed AS (SELECT DISTINCT 'pkg/m' || src || '.py' AS path FROM edges WHERE src % 5 < 3)
SELECT 'current' AS state, kind, source, relation, target, path, line, imported, local, specifier, related FROM facts WHERE v = 2
UNION ALL SELECT 'removed', kind, source, relation, target, path, line, imported, local, specifier, related FROM facts JOIN d USING ({_ID}) WHERE v = 1 AND path IN (SELECT path FROM changed)
UNION ALL SELECT 'added', kind, source, relation, target, path, line, imported, local, specifier, related FROM facts JOIN a USING ({_ID}) WHERE v = 2 AND path IN (SELECT path FROM changed)""", "edges")  # fmt: skip
def _(edges):
    return session(edges).finish()


@query("grf06_packets", _MODEL + ", p AS (SELECT path, path AS p FROM facts WHERE v = 2 UNION SELECT path, related FROM facts WHERE v = 2) SELECT path, list_sort(list(p)) AS paths, (SELECT count(*) FROM facts WHERE v = 2 AND facts.path = p.path) AS n_facts FROM p GROUP BY path", "edges")
def _(edges):
    return S.packets(session(edges).state["facts"])


@query("grf06_origins", _MODEL.replace("WITH v", "WITH RECURSIVE v") + """, h AS (SELECT path, local, related, imported FROM b WHERE v = 2 AND imported <> ''),
w AS (SELECT path, local, related AS p, imported AS n, 1 AS hops FROM h UNION ALL SELECT w.path, w.local, h.related, h.imported, hops + 1 FROM w JOIN h ON h.path = w.p AND h.local = w.n WHERE hops < 200)
SELECT path, local, CASE WHEN max(hops) < 200 THEN max_by(p, hops) END AS origin_path, CASE WHEN max(hops) < 200 THEN max_by(n, hops) END AS origin_name, CAST(CASE WHEN max(hops) < 200 THEN max(hops) END AS BIGINT) AS hops FROM w GROUP BY path, local""", "edges")  # fmt: skip
def _(edges):
    return S.origins(session(edges).state)
