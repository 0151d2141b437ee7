"""Data contracts: nested, cyclic and dangling references, odd texts, a scan by hand."""

from tidemark.operators import contracts as C

FILES = "path string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_json_of_any_depth_and_references(spark):
    deep = '{"a": ' * 12 + '{"$ref": "#"}' + "}" * 12
    files = spark.createDataFrame(
        [
            ("x/one.json", '{"properties": {"self": {"$ref": "#/properties/self"}, "two": {"$ref": "two.json#/defs/0"}, "lost": {"$ref": "two.json#/defs/9"}, "away": {"$ref": "../../z.json"}, "none": {"$ref": "../y/none.json"}, "n": {"$ref": 5}, "e": {"$ref": " "}}}'),
            ("x/two.json", '{"defs": [{"$ref": "./../x/one.json"}, {"properties": {"p": {"type": "string"}, "q": {"type": ["a"]}}}]}'), ("bad.json", "{"), ("null.json", None), ("list.json", "[1, [2]]"), ("leaf.json", "3"), ("deep.json", deep),
        ],
        FILES,
    )
    nodes = C.json_nodes(files)
    assert rows(C.json_references(nodes, files)) == sorted([
        ("deep.json", "#" + "/a" * 12, "#", "deep.json", "#", True), ("x/one.json", "#/properties/self", "#/properties/self", "x/one.json", "#/properties/self", True), ("x/one.json", "#/properties/two", "two.json#/defs/0", "x/two.json", "#/defs/0", True),
        ("x/one.json", "#/properties/lost", "two.json#/defs/9", "x/two.json", "#/defs/9", False), ("x/two.json", "#/defs/0", "./../x/one.json", "x/one.json", "", True),
    ], key=str)
    fields = rows(C.json_fields(nodes))
    assert ("x/two.json", "#/defs/1", "p", "string") in fields and ("x/two.json", "#/defs/1", "q", None) in fields
    assert {f[2] for f in fields if f[0] == "x/one.json"} == {"self", "two", "lost", "away", "none", "n", "e"}


def test_graphql_scan():
    text = '# c\ntype A implements B & C @d(x: "}") {\n  """doc { """\n  f(x: [Int!] = [1], y: In = {z: 1}): [B!]! @old\n  g: String\n}\ninterface B { h: A }\nenum E { X }\nunion U = A | B\nextend schema @l { query: Q }\n{ a b: c(x: {y: 1}) @skip(if: true) { d ... on A { e } ... @include(if: true) { f } ...G h { i } } }\nmutation M { j }\nfragment G on A { k }\nsubscription { l'
    got = [(what, owner, name, target, segments, line) for what, owner, name, target, segments, line in C._Scan(text).all()]
    assert got == [
        ("field", "A", "f", "B", None, 4), ("field", "A", "g", "String", None, 5), ("field", "B", "h", "A", None, 7), ("root", "", "query", "Q", None, 10),
        ("reference", "query", "a", None, ["a"], 11), ("reference", "query", "c", None, ["c"], 11), ("reference", "query", "d", None, ["c", "d"], 11), ("reference", "query", "h", None, ["c", "h"], 11), ("reference", "query", "i", None, ["c", "h", "i"], 11),
        ("reference", "mutation", "j", None, ["j"], 12), ("reference", "subscription", "l", None, ["l"], 14),
    ]
    for broken in ("", "type", "type A {", "query (", "}", "{ a {", 'type A { f(: "', "... on"):
        C._Scan(broken).all()


def test_graphql_types_in_a_circle_and_ambiguous_fields(spark):
    files = spark.createDataFrame([("a", "type Query { u: User, twice: User }\ntype User { boss: User name: String }"), ("b", "extend type Query { twice: User }"), ("c", "query { u { boss { boss { name } nothing { name } } } twice { name } }"), ("d", None)], FILES)
    got = {(r["source"], ".".join(r["segments"])): (r["contract"], r["owner"], r["type"]) for r in C.graphql_references(C.graphql_scan(files)).collect()}
    assert got == {("c", "u"): ("a", "Query", "User"), ("c", "u.boss"): ("a", "User", "User"), ("c", "u.boss.boss"): ("a", "User", "User"), ("c", "u.boss.boss.name"): ("a", "User", "String")}
    none = spark.createDataFrame([], FILES)
    assert C.graphql_references(C.graphql_scan(none)).collect() == [] and C.json_references(C.json_nodes(none), none).collect() == []
