"""Chunkers: golden rows for two languages, every line once, arguments checked before a query runs."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions import chunkers as K

TYPESCRIPT = """import { a } from "b";
export class Cart<T> extends Base {
  private items = { "}": 1 };
  constructor(private x: T) { super(); }
  async total(rate: number): Promise<number> {
    for (const i of this.items) { this.add(() => { return i; }); }
    if (rate > 1) { return `{${rate}}`; }
    return 0;
  }
}
/* class Not { */
function helper(a, b = {}) {
  return a;
}
export const arrow = async (x) => {
  return x;
};
interface Shape { area(): number; }
"""
PYTHON = '''"""module { """
import os
class A(Base):
    """class B:
def no(): """
    x = {"def f(": [
1, 2]}

    @prop
    @other(1)
    def go(self,
           a=(1,
2)):
        def inner(): return 1
        return inner
    # comment
async def top(x): return x
class C: pass
'''


def plain(text, language):
    return [(d.kind, d.name, ".".join(d.parents), d.start, d.end) for d in K.definitions(text, language)]


def test_brackets():
    assert plain(TYPESCRIPT, "typescript") == [
        ("class", "Cart", "", 2, 10), ("method", "constructor", "Cart", 4, 4), ("method", "total", "Cart", 5, 9), ("function", "helper", "", 12, 14), ("function", "arrow", "", 15, 17), ("interface", "Shape", "", 18, 18),
    ]
    go = "package x\ntype T struct {\n  a int\n}\nfunc (t *T) Get(i int) (int, error) {\n  switch i { case 1: return 1, nil }\n}\nfunc New() *T { return &T{1} }\n"
    assert plain(go, "go") == [("function", "Get", "", 5, 7), ("function", "New", "", 8, 8)]
    assert plain("class A { void f() {", "java") == [("class", "A", "", 1, 1), ("method", "f", "A", 1, 1)]
    assert plain("} } class A", "java") == plain("", "java") == plain(None, None) == []


def test_indentation():
    assert plain(PYTHON, "python") == [("class", "A", "", 3, 15), ("method", "go", "A", 9, 15), ("function", "inner", "A.go", 14, 14), ("function", "top", "", 17, 17), ("class", "C", "", 18, 18)]


@pytest.mark.parametrize("seed", range(6))
def test_every_line_once(seed):
    rng = random.Random(seed)
    pieces = ["class A {", "void f(int a) {", "}", "x = 1;", "", "  def g(a):", "class B:", "    return 2", '"""', "'", "// {", "if (x) {", "y" * 90, "}}", "{"]
    text = "\n".join(rng.choice(pieces) for _ in range(120)) + rng.choice(["", "\n"])
    for language in ("java", "python", None):
        for most in (1, 40, 400, 10**6):
            got = list(K.chunks(text, language, most))
            assert "\n".join(r[-1] for r in got) == text and [r[0] for r in got] == list(range(len(got)))
            assert all(len(r[-1]) <= most or r[4] == r[5] for r in got) and [r[4] for r in got] == [1] + [r[5] + 1 for r in got[:-1]]


def test_lateral_joins_and_arguments(spark):
    K.register(spark)
    rows = spark.createDataFrame([(1, TYPESCRIPT, "ts"), (2, PYTHON, "python"), (3, None, None), (4, "", "x")], "id long, code string, language string")
    got = rows.lateralJoin(K.Definitions(F.col("code").outer(), F.col("language").outer())).select("id", "name").collect()
    assert sorted(map(tuple, got)) == [(1, "Cart"), (1, "Shape"), (1, "arrow"), (1, "constructor"), (1, "helper"), (1, "total"), (2, "A"), (2, "C"), (2, "go"), (2, "inner"), (2, "top")]
    sized = spark.sql("SELECT id, c.* FROM {rows}, LATERAL code_chunks(code, language, 100) c", rows=rows)
    assert sized.columns == ["id", "chunk", "kind", "name", "parent", "start_line", "end_line", "content"]
    assert {(r["kind"], r["name"]) for r in sized.where("id = 1").collect()} >= {("method", "constructor"), ("function", "arrow"), ("module", "")}
    assert "first_line" in spark.sql("SELECT c.* FROM {rows}, LATERAL code_chunks(code, language, 100, true) c", rows=rows).columns
    for bad in ("0", "id", "'x'"):
        with pytest.raises(AnalysisException, match="size must be a constant"):
            spark.sql(f"SELECT c.* FROM {{rows}}, LATERAL code_chunks(code, language, {bad}) c", rows=rows).collect()
