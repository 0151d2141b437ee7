"""Predicates, and operators that keep or label rows by them (built-in expressions only)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """``*``: within a segment, ``**``: across segments, ``?``: one character of a segment; a whole match."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def contract_glob(path: Column, pattern: str) -> Column:
    """Whether a whole path matches a plug-in's glob: ``**`` crosses segments, but the slashes beside it must be there."""
    marks = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return path.rlike("^" + "".join(marks.get(x) or re.escape(x) for x in re.findall(r"\*\*|.", pattern)) + "$")


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches some glob; ``dir/`` stands for all below it, and the path without its first segment counts too."""
    if not patterns:
        return F.lit(False)
    rules = [glob_regex(p + "**" if p.endswith("/") else p) for p in patterns]
    tail = F.regexp_replace(path, "^[^/]*/", "")
    return reduce(lambda a, b: a | b, [path.rlike(r) | tail.rlike(r) for r in rules])


def select_paths(df: DataFrame, include: list[str], exclude: list[str], col: str = "path") -> DataFrame:
    """An empty include list takes all."""
    keep = matches_any(F.col(col), include) if include else F.lit(True)
    return df.where(keep & ~matches_any(F.col(col), exclude))


def branch_matches(branch: Column, patterns: list[str]) -> Column:
    """An empty list allows all; a pattern without wild cards is compared as it is."""
    if not patterns:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [branch.rlike(glob_regex(p)) if re.search(r"[*?]", p) else branch == p for p in patterns])


def tree(must: list[Column] = (), should: list[Column] = (), must_not: list[Column] = ()) -> Column:
    """A boolean filter tree: all of must, one of should (if there are any), none of must_not; unknown is false."""
    out = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in must], F.lit(True))
    if should:
        out = out & reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in should])
    return reduce(lambda a, b: a & ~b, [F.coalesce(c, F.lit(False)) for c in must_not], out)


def contains_text(needle: str, *columns: Column) -> Column:
    """Case-insensitive substring of the columns joined by blanks (nulls left out)."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower()))


def like_any(needle: str, *columns: str) -> Column:
    """LOWER(c) LIKE '%needle%' for some column, wild cards in the needle taken literally."""
    safe = re.sub(r"([\\%_])", r"\\\1", needle)
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{safe}%"), F.lit(False)) for c in columns])


def optional(**equals) -> Column:
    """``p is null or column = p`` for each; parameters that are None don't constrain."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equals.items() if v is not None], F.lit(True))


def severity_of(name: Column) -> Column:
    """``critical`` is HIGH; unknown names give null, which stands for no filter."""
    up = F.upper(F.trim(name))
    return F.when(up == "CRITICAL", "HIGH").when(up.isin("HIGH", "MEDIUM", "LOW", "INFO"), up)


def path_matches(a: Column, b: Column) -> Column:
    """Equal, or the shorter is a suffix of several whole segments; a bare file name never matches a longer path."""
    ends = lambda long, short: F.contains(short, F.lit("/")) & F.endswith(long, F.concat(F.lit("/"), short))
    return (a == b) | ends(a, b) | ends(b, a)


def generated_asset(path: Column) -> Column:
    """Script or style whose name ends in a separated run of seven or more alphanumerics with both letters and digits."""
    run = F.regexp_extract(path, r"[-._]([A-Za-z0-9]{7,})\.(?:js|css|mjs|map)$", 1)
    return (run != "") & run.rlike("[A-Za-z]") & run.rlike("[0-9]")


def decodable(raw: Column) -> Column:
    """Bytes that are valid UTF-8 and hold no NUL."""
    return F.coalesce(F.is_valid_utf8(raw.cast("string")) & ~F.contains(raw, F.lit(b"\x00")), F.lit(False))


CONFIG_NAMES = ["package.json", "pom.xml", "build.gradle", "pyproject.toml", "setup.py", "composer.json", "go.mod", "cargo.toml", "makefile", "dockerfile"]
CONFIG_EXTENSIONS = ["json", "yaml", "yml", "toml", "ini", "xml", "cfg", "conf", "properties"]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_config(path: Column) -> Column:
    return F.lower(base_name(path)).isin(CONFIG_NAMES) | extension(path).isin(CONFIG_EXTENSIONS)


def skip_reason(change: Column, path: Column, size: Column, binary: Column, max_bytes: int = 25 * 1024) -> Column:
    """The first rule that holds, in this order; null: the file is looked at."""
    return (
        F.when(change == "deleted", "deleted").when(change == "gitlink", "gitlink").when(binary, "binary")
        .when(generated_asset(path) | path.rlike(r"(^|/)(dist|build|vendor|node_modules)/"), "generated").when(size > max_bytes, "oversize")
    )


def violations(df: DataFrame, key: str, **checks: Column) -> DataFrame:
    """(key, check) for every check that a row fails; an unknown outcome passes, as in SQL CHECK."""
    each = [F.when(~c, F.lit(name)) for name, c in checks.items()]
    return df.select(key, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("check"))


def first_reject(**rules: Column) -> Column:
    """The name of the first rule that holds, in order."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules.items()])


def non_semantic(*flags: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
