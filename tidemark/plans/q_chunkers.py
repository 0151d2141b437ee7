"""Queries of chunkers: code made of the documents' ids, read by lateral joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunkers as K
from .registry import query

# even ids: Java, a class with two methods and a class in it; odd ids: Python, a class with a method and a function; fields by id
JAVA = "concat('package p', id, ';\\n// class No {\\n@A(x = \"{\")\\npublic class C', id, '<T> extends D {\\n', repeat('  int a = 1;\\n', cast(id % 4 AS int)), '  C', id, '(int a) {\\n    if (a > 0) { run(); }\\n  }\\n  static List<T> get', id % 7, '(Map<K, V> m) throws E {\\n    return x(\"}\");\\n  }\\n  enum E', id % 3, ' { A, B }\\n}\\n')"
PYTHON = "concat('import os\\n\\n@dec\\nclass P', id, '(Base):\\n    \"\"\"def no():\\n    \"\"\"\\n', repeat('    x = 1\\n', cast(id % 4 AS int)), '\\n    async def m', id % 7, '(self,\\n  a):\\n        return \"class X:\"\\n\\n\\ndef f', id % 3, '(a):\\n    # end\\n    return a\\n')"


def code(chunks):
    return chunks.select("id", F.expr(f"CASE WHEN id % 2 = 0 THEN {JAVA} ELSE {PYTHON} END").alias("code"), F.expr("CASE WHEN id % 2 = 0 THEN 'java' ELSE 'python' END").alias("language"))


@query("txt11_definitions", """WITH c AS (SELECT id, id % 4 AS k FROM chunks)
SELECT id, 'class' AS kind, 'C' || id AS name, '' AS parent, 3 AS start_line, CAST(12 + k AS INTEGER) AS end_line, '@A(x = "") public class C' || id || '<T> extends D' AS signature FROM c WHERE id % 2 = 0
UNION ALL SELECT id, 'method', 'C' || id, 'C' || id, CAST(5 + k AS INTEGER), CAST(7 + k AS INTEGER), 'C' || id || '(int a)' FROM c WHERE id % 2 = 0
UNION ALL SELECT id, 'method', 'get' || id % 7, 'C' || id, CAST(8 + k AS INTEGER), CAST(10 + k AS INTEGER), 'static List<T> get' || id % 7 || '(Map<K, V> m) throws E' FROM c WHERE id % 2 = 0
UNION ALL SELECT id, 'enum', 'E' || id % 3, 'C' || id, CAST(11 + k AS INTEGER), CAST(11 + k AS INTEGER), 'enum E' || id % 3 FROM c WHERE id % 2 = 0
UNION ALL SELECT id, 'class', 'P' || id, '', 3, CAST(10 + k AS INTEGER), 'class P' || id || '(Base):' FROM c WHERE id % 2 = 1
UNION ALL SELECT id, 'method', 'm' || id % 7, 'P' || id, CAST(8 + k AS INTEGER), CAST(10 + k AS INTEGER), 'async def m' || id % 7 || '(self,' FROM c WHERE id % 2 = 1
UNION ALL SELECT id, 'function', 'f' || id % 3, '', CAST(13 + k AS INTEGER), CAST(15 + k AS INTEGER), 'def f' || id % 3 || '(a):' FROM c WHERE id % 2 = 1""", "chunks")  # fmt: skip
def _(chunks):
    rows = code(chunks)
    return rows.lateralJoin(K.Definitions(F.col("code").outer(), F.col("language").outer())).drop("code", "language")


@query("udf05_code_chunks", None, "chunks")
def _(chunks):
    K.register(chunks.sparkSession)
    return chunks.sparkSession.sql("SELECT id, c.* FROM {code}, LATERAL code_chunks(code, language, 120, true) AS c", code=code(chunks))


@query("udf05_document_chunks", "SELECT doc_id, md5(text) AS whole, true AS bounded FROM documents WHERE text <> ''", "t:documents")
def _(documents):
    """Chunks of prose, put together again: nothing is lost, and none is longer than the size but for single lines."""
    K.register(documents.sparkSession)
    each = documents.sparkSession.sql("SELECT doc_id, c.* FROM {docs}, LATERAL code_chunks(text, 'text', 800) AS c", docs=documents)
    whole = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "content"))), lambda x: x["content"]), "\n"))
    return each.groupBy("doc_id").agg(whole.alias("whole"), F.bool_and((F.length("content") < 800) | (F.col("start_line") == F.col("end_line"))).alias("bounded"))
