"""Queries of the inspector's graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inspector as I
from .registry import query

_KINDS = "CASE id % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'function' WHEN 3 THEN 'interface' WHEN 4 THEN 'constructor' ELSE 'chunk' END"


def nodes(chunks):
    s = lambda head, of: F.concat(F.lit(head), of.cast("string"))
    i = F.col("id")
    relation = lambda field, *values: F.struct(F.lit(field).alias("field"), F.array(*values).alias("values"))
    return chunks.select(
        i.alias("seq"), s("c", i).alias("id"), "branch", "path", F.col("namespace"), F.expr(_KINDS).alias("kind"), s("Title", i % 50).alias("title"), s("Name", i % 700).alias("name"),
        F.when(i % 4 == 0, F.array(s("pkg.Class", i % 90), s("Name", i % 700))).alias("names"), F.when(i % 3 == 0, F.array(s("run", i % 211))).alias("members"), F.col("parent_class").alias("parent"),
        F.when(i % 5 > 0, F.col("start_line")).alias("start_line"), F.lit(0).alias("chunk"),
        F.array(relation("imports", s("pkg.Class", i * 7 % 120), s("lib/Name", i * 11 % 900)), relation("calls", s("run", i * 5 % 300), s("this.run", i * 5 % 300), s("Name", i * 3 % 800)), relation("extends", s("Class", i * 13 % 100))).alias("relations"),
    )


# the whole graph, step by step; the caps are given
_GRAPH = """
WITH n AS (SELECT id AS seq, 'c' || id AS id, branch, path, namespace, @KINDS AS kind, 'Title' || id % 50 AS title, 'Name' || id % 700 AS name, CASE WHEN id % 4 = 0 THEN ['pkg.Class' || id % 90, 'Name' || id % 700] ELSE [] END AS names,
  CASE WHEN id % 3 = 0 THEN ['run' || id % 211] ELSE [] END AS members, parent_class AS parent, CASE WHEN id % 5 > 0 THEN start_line END AS start_line FROM chunks),
files AS (SELECT *, 'file::' || branch || '::' || path AS v, min(seq) OVER (PARTITION BY branch, path) AS f0, count(*) OVER (PARTITION BY branch, path) AS size,
  row_number() OVER (PARTITION BY branch, path ORDER BY coalesce(start_line, 1000000000), id) AS i, lead(id) OVER (PARTITION BY branch, path ORDER BY coalesce(start_line, 1000000000), id) AS nxt FROM n),
named AS (SELECT seq, id, unnest(list_concat([name], names)) AS full_name, unnest(range(1 + len(names))) AS pos FROM n),
syms AS (SELECT *, 'symbol::' || symbol AS v FROM (SELECT seq, pos, id, symbol, count(*) OVER w AS size, first(seq) OVER o AS f0, first(pos) OVER o AS f1, row_number() OVER o AS i FROM (SELECT seq, id, pos, string_split(full_name, '.')[-1] AS symbol FROM named)
  WINDOW w AS (PARTITION BY symbol), o AS (PARTITION BY symbol ORDER BY seq, pos)) WHERE size BETWEEN 2 AND 80 AND i <= 40),
pars AS (SELECT *, 'parent::' || branch || '::' || parent AS v FROM (SELECT seq, branch, parent, id, count(*) OVER (PARTITION BY branch, parent) AS size, min(seq) OVER (PARTITION BY branch, parent) AS f0, row_number() OVER (PARTITION BY branch, parent ORDER BY seq) AS i FROM n WHERE parent IS NOT NULL) WHERE size BETWEEN 2 AND 100 AND i <= 55),
tv AS (SELECT seq, unnest(list_concat([name, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), namespace || '.' || name], names)) AS v FROM n),
idx AS (SELECT DISTINCT 'type' AS ix, seq, t FROM (SELECT seq, unnest([lower(v), lower(string_split(v, '.')[-1])]) AS t FROM tv) UNION SELECT 'member', seq, lower(unnest(members)) FROM n),
vals AS (SELECT seq, id, branch, path, 0 AS field, unnest([0, 1, 2]) AS vat, unnest(['run' || seq * 5 % 300, 'this.run' || seq * 5 % 300, 'Name' || seq * 3 % 800]) AS value FROM n
  UNION ALL SELECT seq, id, branch, path, 1, 0, 'Class' || seq * 13 % 100 FROM n UNION ALL SELECT seq, id, branch, path, 4, unnest([0, 1]), unnest(['pkg.Class' || seq * 7 % 120, 'lib/Name' || seq * 11 % 900]) FROM n),
toks AS (SELECT *, 0 AS tok, replace(lower(value), '/', '.') AS t FROM vals UNION ALL SELECT *, 1, lower(regexp_extract(value, '[^./]*$')) FROM vals WHERE value LIKE '%.%' OR value LIKE '%/%'),
few AS (SELECT CASE WHEN g = 'call' THEN 0 ELSE 1 END AS type_only, t FROM (SELECT 'call' AS g, seq, t FROM idx UNION SELECT 'other', seq, t FROM idx WHERE ix = 'type') GROUP BY g, t HAVING count(*) < 30),
seen AS (SELECT DISTINCT 0 AS type_only, seq, t FROM idx UNION SELECT 1, seq, t FROM idx WHERE ix = 'type'),
met AS (SELECT k.*, m.seq AS tseq, m.id AS target, m.branch AS tb, m.path AS tp, m.kind AS tk, coalesce(m.start_line, 1000000000) AS tl, m.title AS tt, max(CASE WHEN m.branch = k.branch THEN 1 ELSE 0 END) OVER (PARTITION BY k.seq, field, vat, tok) AS own
  FROM toks k JOIN few f ON f.t = k.t AND f.type_only = CASE field WHEN 0 THEN 0 ELSE 1 END JOIN seen s ON s.t = k.t AND s.type_only = f.type_only JOIN n m ON m.seq = s.seq),
ranked AS (SELECT *, CASE WHEN field = 4 AND path = tp THEN 1 ELSE 0 END AS same, CASE WHEN field = 0 THEN CASE tk WHEN 'method' THEN 0 WHEN 'function' THEN 0 WHEN 'constructor' THEN 1 WHEN 'class' THEN 2 WHEN 'interface' THEN 3 ELSE 8 END ELSE CASE tk WHEN 'class' THEN 0 WHEN 'interface' THEN 0 WHEN 'constructor' THEN 1 WHEN 'function' THEN 2 WHEN 'method' THEN 3 ELSE 8 END END AS kr
  FROM met WHERE (own = 0 OR tb = branch) AND id <> target),
once AS (SELECT *, row_number() OVER (PARTITION BY seq, field, vat, target ORDER BY tok) AS one FROM ranked),
best AS (SELECT *, row_number() OVER (PARTITION BY seq, field, vat ORDER BY tok, same, kr, tl, length(tt), tt, tseq) AS i FROM once WHERE one = 1),
hits AS (SELECT * FROM best WHERE i <= CASE field WHEN 0 THEN 5 ELSE 1 END),
outs AS (SELECT v.*, CASE field WHEN 1 THEN 'external_type' ELSE 'import' END || '::' || branch || '::' || replace(lower(value), '/', '.') AS v, regexp_extract(value, '[^./]*$') AS title FROM vals v WHERE field <> 0 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.seq = v.seq AND h.field = v.field AND h.vat = v.vat)),
virt AS (SELECT v AS id, string_split(path, '/')[-1] AS title, 'file' AS kind, size, [1, f0, 0, 0, 0] AS o FROM files UNION ALL SELECT v, symbol, 'symbol', size, [2, f0, f1, 0, 0] FROM syms UNION ALL SELECT v, parent, 'parent_class', size, [3, f0, 0, 0, 0] FROM pars
  UNION ALL SELECT v, title, CASE field WHEN 1 THEN 'external_type' ELSE 'import' END, 0, [4, seq, field, vat, 0] FROM outs),
kept AS (SELECT id, min_by(title, o) AS title, min_by(kind, o) AS kind, CAST(max(size) AS BIGINT) AS size, min(o) AS o FROM virt GROUP BY id ORDER BY o LIMIT @VIRTUAL),
adds AS (SELECT v AS source, id AS target, 'file_contains' AS kind, 1.35 AS w, NULL AS token, [1, f0, 0, i, 0] AS o FROM files WHERE i <= 80 AND v IN (SELECT id FROM kept)
  UNION ALL SELECT least(id, nxt), greatest(id, nxt), 'file_sequence', 0.35, NULL, [1, f0, 1, i, 0] FROM files WHERE nxt IS NOT NULL
  UNION ALL SELECT least(v, id), greatest(v, id), 'same_symbol', 1.1, NULL, [2, f0, f1, i, 0] FROM syms WHERE v IN (SELECT id FROM kept)
  UNION ALL SELECT least(v, id), greatest(v, id), 'same_parent', 0.95, NULL, [3, f0, 0, i, 0] FROM pars WHERE v IN (SELECT id FROM kept)
  UNION ALL SELECT id, target, CASE field WHEN 0 THEN 'calls' WHEN 1 THEN 'extends' ELSE 'imports' END, CASE field WHEN 0 THEN 1.85 WHEN 1 THEN 2.35 ELSE 1.35 END, value, [4, seq, field, vat, i] FROM hits
  UNION ALL SELECT id, v, CASE field WHEN 1 THEN 'extends' ELSE 'imports' END, 0.72 * CASE field WHEN 1 THEN 2.35 ELSE 1.35 END, value, [4, seq, field, vat, 0] FROM outs WHERE v IN (SELECT id FROM kept)),
firsts AS (SELECT source, target, kind, min(o) AS o FROM adds WHERE source <> target GROUP BY 1, 2, 3 ORDER BY o LIMIT @EDGES),
inside AS (SELECT a.* FROM adds a JOIN firsts USING (source, target, kind) WHERE (SELECT count(*) FROM firsts) < @EDGES OR a.o <= (SELECT max(o) FROM firsts)),
said AS (SELECT source, target, kind, list(token ORDER BY o)[1:8] AS tokens FROM (SELECT source, target, kind, token, min(o) AS o FROM inside WHERE token IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
edges_out AS (SELECT source, target, kind, round(CAST(least(8.0, min_by(w, o) + 0.2 * (sum(w) - min_by(w, o))) AS DOUBLE), 6) AS weight, coalesce(any_value(tokens), []) AS tokens FROM inside LEFT JOIN said USING (source, target, kind) GROUP BY 1, 2, 3)
"""


def _sql(edges: int, virtual: int, tail: str) -> str:
    return _GRAPH.replace("@KINDS", _KINDS).replace("@VIRTUAL", str(virtual)).replace("@EDGES", str(edges)) + tail


_ROUND = lambda e: e.withColumn("weight", F.round("weight", 6))


@query("grf05_inspector", _sql(1200, 240, "SELECT * FROM edges_out"), "chunks")
def _(chunks):
    return _ROUND(I.build(nodes(chunks))[1])


@query("grf05_inspector_whole", _sql(10**9, 10**9, "SELECT * FROM edges_out"), "chunks")
def _(chunks):
    return _ROUND(I.build(nodes(chunks), None, None)[1])


@query("grf05_inspector_nodes", _sql(1200, 700, "SELECT id, title, kind, size FROM kept"), "chunks")
def _(chunks):
    return I.build(nodes(chunks), max_virtual=700)[0]
