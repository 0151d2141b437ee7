"""Repository sessions: batches in any order against everything resolved anew, parsing, origins."""

import random

from tidemark.operators import sessions as S

FILES = "path string, text string, deleted boolean"


def facts_of(table):
    return sorted(tuple(r) for r in table.collect())


def random_text(rng):
    lines = [f"def f{rng.randrange(4)}():", "    pass"]
    for _ in range(rng.randint(0, 4)):
        to = rng.choice(["a", "b", "p", "p.c", "p.d", "q.e", ".c", ".d", "..a", "missing"])
        lines.append(rng.choice([f"from {to} import f{rng.randrange(4)}", f"from {to} import f{rng.randrange(4)} as f{rng.randrange(4)}, g", f"import {to} as h", f"import {to}", f"from {to} import *", f"    from {to} import (g, f1 as k)"]))
    lines += [rng.choice(["f1()", "h.run(f2())", "k(1)", "p.c.go()", "g.x.y()"]) for _ in range(3)]
    return "\n".join(lines)


def test_batches_equal_a_full_rebuild(spark, tmp_path):
    rng = random.Random(11)
    paths = ["a.py", "a/__init__.py", "b.py", "p/__init__.py", "p/c.py", "p/d.py", "q/e.py"]
    now = {p: random_text(rng) for p in paths if p != "a/__init__.py"}
    base = S.Session.start(spark).ingest(spark.createDataFrame([(p, t, False) for p, t in now.items()], FILES))
    base.snapshot(str(tmp_path / "snapshot"))
    session, old, changed = S.Session.restore(spark, str(tmp_path / "snapshot")), facts_of(base.state["facts"]), set()
    for _ in range(3):
        batch = []
        for p in rng.sample(paths, 2):
            gone = rng.random() < 0.3
            batch.append((p, random_text(rng), gone))
            now.pop(p, None)
            if not gone:
                now[p] = batch[-1][1]
            changed.add(p)
        session = session.ingest(spark.createDataFrame(batch, FILES))
        whole = S.Session.start(spark).ingest(spark.createDataFrame([(p, t, False) for p, t in now.items()], FILES))
        new = facts_of(session.state["facts"])
        assert new == facts_of(whole.state["facts"])
    same = lambda f: f[:5] + f[6:]  # noqa: E731  all but the line
    kept_old, kept_new = {same(f) for f in old}, {same(f) for f in new}
    want = [("added", *f) for f in new if f[4] in changed and same(f) not in kept_old] + [("removed", *f) for f in old if f[4] in changed and same(f) not in kept_new]
    assert sorted(map(tuple, session.differences().collect())) == sorted(want) and want


def test_parsing_and_resolution(spark):
    files = [
        ("p/__init__.py", "", False), ("p/c.py", "def make():\n    pass\nclass Thing:\n", False), ("b.py", None, False),
        ("p/d.py", "from .c import make as m, Thing\nimport p.c as pc, b\nm()\npc.go(Thing())\nb.run()\nother()", False), ("x.py", "from p.c import nothing\nfrom p.c import *\nimport x", False),
    ]
    facts = S.Session.start(spark).ingest(spark.createDataFrame(files, FILES)).state["facts"]
    got = {(f["kind"], f["source"], f["target"], f["line"]) for f in facts.collect()}
    assert got == {
        ("module-resolution", "p.d", "p.c", 1), ("module-resolution", "p.d", "p.c", 2), ("module-resolution", "p.d", "b", 2), ("module-resolution", "x", "p.c", 2),
        ("import-binding", "p.d::m", "p.c::make", 1), ("import-binding", "p.d::Thing", "p.c::Thing", 1), ("import-binding", "p.d::pc", "p.c", 2), ("import-binding", "p.d::b", "b", 2), ("import-binding", "x::*", "p.c", 2),
        ("call-resolution", "p.d::m", "p.c::make", 3), ("call-resolution", "p.d::pc", "p.c::go", 4), ("call-resolution", "p.d::Thing", "p.c::Thing", 4), ("call-resolution", "p.d::b", "b::run", 5),
    }


def test_origins_follow_chains_and_stop_at_circles(spark):
    chain = [(f"m{i}.py", f"from m{i + 1} import n{i + 1} as n{i}", False) for i in range(40)] + [("m40.py", "def n40():\n    pass", False)]
    circle = [("u.py", "from v import z", False), ("v.py", "from u import z", False), ("w.py", "from u import z as y", False)]
    state = S.Session.start(spark).ingest(spark.createDataFrame(chain + circle, FILES)).state
    got = {(r["path"], r["local"]): (r["origin_path"], r["origin_name"], r["hops"]) for r in S.origins(state).collect()}
    assert {k: v for k, v in got.items() if k[0] in ("u.py", "v.py", "w.py")} == {("u.py", "z"): (None, None, None), ("v.py", "z"): (None, None, None), ("w.py", "y"): (None, None, None)}
    assert all(got[f"m{i}.py", f"n{i}"] == ("m40.py", "n40", 40 - i) for i in range(40))


def test_empty_batches(spark):
    none = spark.createDataFrame([], FILES)
    session = S.Session.start(spark).ingest(none)
    assert session.finish().collect() == [] and S.origins(session.state).collect() == []


def test_files_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(S, "FILES_A_TASK", 2)
    files = spark.createDataFrame([(f"m{i}.py", "") for i in range(5)], "path string, text string").coalesce(1)
    got = S.dealt(files)
    assert got.rdd.getNumPartitions() == 3 and sorted(r["path"] for r in got.collect()) == [f"m{i}.py" for i in range(5)]
