"""Text, hash and diff functions as column expressions (JVM-side), with a few pandas functions where the semantics need a program."""

from __future__ import annotations

import difflib
import json
import re
import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that tell nothing about the root of a finding (token sets and overlaps).
ROOT_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "because", "by", "can", "could", "for", "from", "has", "have", "if", "in", "into", "is", "it", "may", "of", "on", "or",
    "that", "the", "their", "this", "to", "was", "were", "will", "with", "would",
]
#: Words that tell nothing about a task (task terms).
TASK_STOP_WORDS = [
    "about", "acceptance", "add", "added", "adding", "after", "against", "also", "another", "before", "being", "branch", "change", "changes", "code", "context", "could",
    "create", "criteria", "description", "does", "enable", "ensure", "from", "have", "implement", "implementation", "into", "issue", "must", "new", "only", "pull", "request",
    "requested", "return", "review", "should", "support", "task", "that", "their", "then", "there", "these", "they", "this", "through", "update", "using", "when", "where",
    "which", "with", "without",
]
#: File extensions of languages.
LANGUAGES = {"py": "python", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "cpp": "cpp", "c": "c", "kt": "kotlin", "scala": "scala", "swift": "swift", "md": "markdown", "sql": "sql"}
#: Patterns, whatever the case, of texts that try to turn a prompt.
INJECTIONS = [
    r"\b(ignore|disregard|forget)\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?|rules?)",
    r"\b(new|different|change)\s+(system\s+)?(prompt|instructions?|rules?)",
    r"\byou\s+are\s+(now|a)\b",
    r"\b(act|behave|pretend)\s+(as|like)\s+",
    r"\brole\s*[:=]",
    r"\b(output|print|write|return)\s+(only|just|exactly)",
    r"\bformat\s*[:=]\s*(json|xml|raw)",
    r"###\s*(system|assistant|user)",
    r"<\|?(system|assistant|user|endof)\|?>",
    r"\[\s*(INST|SYS)\s*\]",
    r"\b(reveal|show|display|tell)\s+(me\s+)?(your|the)\s+(system|initial|original)\s+(prompt|instructions?)",
    r"\bwhat\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?|rules?)",
    r"\bexec(ute)?\s*\(",
    r"\beval\s*\(",
    r"\bos\s*\.\s*(system|popen|exec)",
    r"\bsubprocess\s*\.",
    r"\bimport\s+(os|sys|subprocess)",
]


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def line_hash(line: Column) -> Column:
    return F.md5(normal_line(line))


def lines_of(text: Column) -> Column:
    """Lines by LF or CRLF; one empty line at the end doesn't count."""
    parts = F.split(text, r"\r?\n", -1)
    return F.when(F.size(parts) > 0, F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def normal_title(title: Column) -> Column:
    """Lower case, without line references and numbers that stand alone."""
    low = F.lower(title)
    bare = F.regexp_replace(low, r"\b(at |on |in )?lines? \d+([-–]\d+)?\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(^|\s)\d+(?=\s|$)", " "), r"\s+", " "))


def fingerprint(category: Column, hash_: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(F.upper(category), F.lit("UNKNOWN")), F.coalesce(hash_, F.lit("no_hash")), normal_title(title)), 256)


def content_fingerprint(hash_: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(hash_, F.lit("no_hash")), normal_title(title)), 256)


def anchored_identity(fp: Column, hash_: Column, scope: Column, line: Column, snippet: Column) -> Column:
    """By line hash, else by snippet; null without either, and null is no identity."""
    return F.when(fp.isNotNull() & hash_.isNotNull(), F.concat_ws(":", fp, F.lit("line-hash"), hash_)).when(fp.isNotNull() & (F.length(F.trim(snippet)) > 0), F.concat_ws(":", fp, F.lit("snippet"), F.coalesce(scope, F.lit("")), F.coalesce(line.cast("string"), F.lit("")), normal_line(snippet)))


def diff_fingerprint(diff: Column) -> Column:
    """Of a diff whatever the order of its files: sections are sorted, each framed by its length."""
    text = F.regexp_replace(diff, "\r\n?", "\n")
    parts = F.filter(F.split(text, "(?m)(?=^diff --git )"), lambda x: F.length(x) > 0)
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ""), 256)


def chunk_id(path: Column, index: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, index.cast("string"), F.substring(content, 1, 500)), 256), 1, 32)


def embedding_header(**parts: Column) -> Column:
    """``Name: value`` of the parts that there are, joined by `` | ``."""
    return F.concat_ws(" | ", *[F.when(F.length(v) > 0, F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()])


def clean_archive_path(path: Column) -> Column:
    """Without a first segment that is an archive's root (name-hash)."""
    return F.regexp_replace(path, r"^[^/]+-[0-9a-f]{7,40}/", "")


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext], F.lit("text"))


def slug(name: Column) -> Column:
    return F.translate(F.lower(name), "/.", "__")


def identifiers(text: Column, least: int = 3, most: int = 50) -> Column:
    """Distinct identifiers in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]{%d,})" % (least - 1)), F.lit(1))), 1, most)


def task_terms(text: Column, most: int = 80) -> Column:
    """Names of three characters or more in lower case, whole (with digits, dots, underscores and slashes) and by their camel-case parts, without stop words and bare numbers; longest first, then by name."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_.:$\\/-]{2,})"), F.lit(1))
    each = F.flatten(F.transform(names, lambda t: F.concat(F.array(t), F.split(t, "(?<=[a-z0-9])(?=[A-Z])"))))
    bare = F.array_distinct(F.transform(each, lambda w: F.regexp_replace(F.lower(w), r"^[./\\_:-]+|[./\\_:-]+$", "")))
    keep = F.array_except(F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$")), F.array(*[F.lit(w) for w in TASK_STOP_WORDS]))
    ordered = F.array_sort(F.transform(keep, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(ordered, lambda x: x["w"]), 1, most)


def relation_token(token: Column) -> Column:
    """Without quotes, separators as dots; null for what is too short."""
    bare = F.regexp_replace(F.translate(F.lower(F.trim(token)), "'\"`<>", ""), r"(::|->|/|\\)+", ".")
    return F.when(F.length(bare) > 1, bare)


def root_reason(text: Column) -> Column:
    """A description without its lines that list further places."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: ~F.lower(F.trim(x)).startswith("also affects:"))
    return F.trim(F.array_join(lines, "\n"))


def narrative(text: Column) -> Column:
    """The words ``[A-Za-z0-9_$]+`` of a text in lower case, joined by one space, without lines that list further places; empty for null."""
    return F.lower(F.array_join(F.regexp_extract_all(root_reason(F.coalesce(text, F.lit(""))), F.lit(r"([A-Za-z0-9_$]+)"), F.lit(1)), " "))


def token_set(text: Column) -> Column:
    """Distinct words of narrative() of more than one character that aren't stop words."""
    return F.array_except(F.array_distinct(F.filter(F.split(narrative(text), " "), lambda w: F.length(w) > 1)), F.array(*[F.lit(w) for w in ROOT_STOP_WORDS]))


def overlap(a: Column, b: Column) -> Column:
    """(common, containment in the smaller, Jaccard) of two token sets."""
    n = F.size(F.array_intersect(a, b))
    least, union = F.least(F.size(a), F.size(b)), F.size(F.array_union(a, b))
    return F.struct(n.alias("common"), F.coalesce(F.try_divide(n, least), F.lit(0.0)).alias("containment"), F.coalesce(F.try_divide(n, union), F.lit(0.0)).alias("jaccard"))


def split_also_affects(text: Column) -> Column:
    """Body and list of further places of a description."""
    parts = F.split(text, r"(?i)\n?\s*also affects:\s*", 2)
    places = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"[\n,]"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*]\s*", ""))), lambda x: x != "")
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("body"), places.alias("places"))


def blocked(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTIONS)), F.lit(False))


def sanitised(text: Column, most: int = 2000) -> Column:
    """A text with long blanks cut, markers of delimiters set apart and control characters taken out.  Null if it is empty, too long, or blocked."""
    bare = F.trim(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    clean = F.regexp_replace(bare, r"\s{3,}", "  ")
    for mark, apart in (("###", "# # #"), ("<|", "< |"), ("|>", "| >")):
        clean = F.replace(clean, F.lit(mark), F.lit(apart))
    clean = F.regexp_replace(clean, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when((F.length(bare) > 0) & (F.length(bare) <= most) & ~blocked(bare), F.trim(clean))


def snippets(added: Column, group: int = 8, most: int = 10) -> Column:
    """Added lines in groups of eight."""
    n = F.ceil(F.size(added) / group)
    take = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(most)).cast("int") - 1), lambda i: F.array_join(F.slice(added, i * group + 1, group), "\n"))
    return F.when(F.size(added) > 0, take).otherwise(F.array().cast("array<string>"))


def query_snippets(snippet: Column) -> Column:
    """A diff snippet without its markers, its first ten lines, if there is something left to search for."""
    bare = F.transform(F.split(snippet, "\n"), lambda x: F.regexp_replace(x, r"^[+\- ]", ""))
    text = F.trim(F.array_join(F.slice(F.filter(bare, lambda x: F.trim(x) != ""), 1, 10), "\n"))
    return F.when(F.length(text) > 15, text)


def budget(lines: Column, most: int) -> Column:
    """The longest prefix of lines within a number of characters, and how many lines it leaves out."""
    step = lambda acc, x: F.struct((acc["used"] + F.length(x) + 1).alias("used"), (acc["n"] + F.when(acc["used"] + F.length(x) + 1 <= most, 1).otherwise(0)).alias("n"))
    n = F.aggregate(lines, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), step)["n"]
    return F.struct(F.slice(lines, 1, n).alias("kept"), (F.size(lines) - n).alias("omitted"))


# --- documents by line


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos from 1, line, hash)."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(lines_of(F.col(text_col))).alias("p", "line"))
    return rows.select("doc", (F.col("p") + 1).alias("pos"), "line", line_hash(F.col("line")).alias("hash"))


def context_hash(lines: DataFrame, radius: int, block: int = 4096) -> DataFrame:
    """lines with the hash of the hashes within so many lines.

    Windows run over blocks of lines, each with the few of its neighbours that it needs, so a
    long document isn't one task's.
    """
    if radius >= block:
        raise ValueError("the radius must be less than a block")
    of = lambda shift: F.floor((F.col("pos") + shift) / block)
    spread = lines.withColumn("_block", F.explode(F.array_distinct(F.array(of(-radius), of(0), of(radius)))))
    w = Window.partitionBy("doc", "_block").orderBy("pos").rowsBetween(-radius, radius)
    hashed = spread.withColumn("context", F.md5(F.array_join(F.collect_list("hash").over(w), "")))
    return hashed.where(F.col("_block") == of(0)).drop("_block")


def at_places(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """ranges (doc, first, last, …) with one row for each pos inside that the document has."""
    ends = lines.groupBy("doc").agg(F.max("pos").alias("_end"))
    cut = ranges.join(ends, "doc").withColumn("_last", F.least("last", "_end")).where("first <= _last")
    return cut.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("first"), F.lit(1)).cast("int"), F.col("_last").cast("int")))).drop("_last", "_end")


def range_hash(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """ranges (id, doc, first, last) with the hash of the line hashes inside, cut to the document."""
    hit = at_places(ranges, lines).join(lines.select("doc", "pos", "hash"), ["doc", "pos"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]), "")
    return hit.groupBy("id").agg(F.md5(ordered).alias("range_hash"))


def locate(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """wanted (id, doc, snippet): line and strategy of a snippet: an equal line (1.0), several lines in a row (0.85), a line that holds it or that it holds (0.75, eight characters and half the length at least), or none."""
    first = F.get(lines_of(F.col("snippet")), F.lit(0))
    several = F.size(lines_of(F.col("snippet"))) > 1
    w = wanted.withColumn("hash", line_hash(first)).withColumn("many", several)
    exact = w.where(~F.col("many")).join(lines, ["doc", "hash"]).groupBy("id").agg(F.min("pos").alias("pos")).select("id", "pos", F.lit("HASH_EXACT").alias("how"), F.lit(1.0).alias("confidence"))
    size = F.size(lines_of(F.col("snippet")))
    spans = w.where("many").join(lines, ["doc", "hash"]).select("id", "doc", F.col("pos").alias("first"), (F.col("pos") + size - 1).alias("last"), F.transform(lines_of(F.col("snippet")), line_hash).alias("want"))
    got = at_places(spans, lines).join(lines.select("doc", "pos", F.col("hash").alias("h")), ["doc", "pos"])
    multi = got.groupBy("id", "first").agg(F.first("want").alias("want"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]).alias("have")).where("want = have")
    multi = multi.groupBy("id").agg(F.min("first").alias("pos")).select("id", "pos", F.lit("MULTI_LINE").alias("how"), F.lit(0.85).alias("confidence"))
    a, b = normal_line(F.col("snippet")), normal_line(F.col("line"))
    near = (F.least(F.length(a), F.length(b)) >= 8) & (F.least(F.length(a), F.length(b)) >= 0.5 * F.greatest(F.length(a), F.length(b))) & (F.contains(a, b) | F.contains(b, a))
    # only what no equal line was found for is held against the other lines of its document
    left = w.where(~F.col("many")).drop("hash").join(exact.select("id"), "id", "left_anti")
    part = left.join(lines.select("doc", "pos", "line"), "doc").where(near).groupBy("id").agg(F.min("pos").alias("pos")).select("id", "pos", F.lit("TRIMMED_CONTAINS").alias("how"), F.lit(0.75).alias("confidence"))
    best = exact.unionByName(multi).unionByName(part).groupBy("id").agg(F.max_by(F.struct("pos", "how", "confidence"), "confidence").alias("best"))
    return wanted.select("id").join(best, "id", "left").select("id", F.coalesce("best.pos", F.lit(-1)).alias("pos"), F.coalesce("best.how", F.lit("NOT_FOUND")).alias("how"), F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"))


# --- diffs


def parse_diff(diffs: DataFrame) -> DataFrame:
    """diffs (id, diff): one row a hunk: id, path, change, hunk number, old and new start and count, body lines.

    Sections and hunks are split by look-ahead patterns, so a diff never becomes one row a line.
    """
    sections = diffs.select("id", F.explode(F.filter(F.split(F.regexp_replace("diff", "\r\n?", "\n"), "(?m)(?=^diff --git )"), lambda x: F.startswith(x, F.lit("diff --git ")))).alias("section"))
    s = F.col("section")
    head = F.regexp_extract(s, r"(?s)^(.*?)(?=\n@@ |\z)", 1)
    path = F.coalesce(F.nullif(F.regexp_extract(head, r"(?m)^\+\+\+ b/(.*)$", 1), F.lit("")), F.regexp_extract(head, r"^diff --git a/.* b/(.*)", 1))
    change = (
        F.when(head.rlike("(?m)^deleted file mode"), "deleted").when(head.rlike("(?m)^(new file |index .* )?(mode )?160000"), "gitlink").when(head.rlike("(?m)^new file mode"), "added")
        .when(head.rlike("(?m)^rename from "), "renamed").when(head.rlike("(?m)^(Binary files |GIT binary patch)"), "binary").otherwise("modified")
    )
    hunks = F.filter(F.split(s, "(?m)(?=^@@ )"), lambda x: x.rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"))
    rows = sections.select("id", path.alias("path"), change.alias("change"), F.posexplode_outer(hunks).alias("hunk", "body"))
    pat = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    number = lambda g, default: F.when(F.col("body").isNotNull(), F.coalesce(F.nullif(F.regexp_extract("body", pat, g), F.lit("")).cast("int"), F.lit(default)))
    body = F.filter(F.slice(F.split("body", "\n"), 2, 1_000_000_000), lambda x: x.rlike(r"^[-+ ]"))
    return rows.select("id", "path", "change", "hunk", number(1, 0).alias("old_start"), number(2, 1).alias("old_count"), number(3, 0).alias("new_start"), number(4, 1).alias("new_count"), body.alias("lines"))


def hunk_id(path: Column, header: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", path, header, content), 256)


def diff_summary(lines: Column, headers: int = 20, sample: int = 80) -> Column:
    """Of a diff's lines: how many are added and deleted (file headers are neither), the first distinct hunk headers, and the distinct ones of the first changed lines."""
    one = lambda sign: F.filter(lines, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(3 * sign)))
    changed = F.filter(lines, lambda x: x.rlike(r"^(\+(?!\+\+)|-(?!--))"))
    regions = F.array_distinct(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("@@"))), lambda x: F.trim(x)))
    return F.struct(F.size(one("+")).alias("added"), F.size(one("-")).alias("deleted"), F.slice(regions, 1, headers).alias("headers"), F.array_distinct(F.slice(changed, 1, sample)).alias("sample"))


def _packed(pieces: Column, head: Column, most: int) -> Column:
    """Pieces joined in order, each group within so many characters with the head before it (a larger piece alone)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, x):
        full = (acc["now"] != "") & (F.length(head) + F.length(acc["now"]) + F.length(x) > most)
        done = F.when(full, F.concat(acc["done"], F.array(F.concat(head, acc["now"])))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, x).otherwise(F.concat(acc["now"], x)).alias("now"))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(F.concat(head, acc["now"])))).otherwise(acc["done"]))


def _bound(value: Column, f) -> Column:
    """f(value), with value evaluated once for a row; what a lambda names is else evaluated at each of its steps."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chunk_diff(diff: Column, most: int) -> Column:
    """A diff in chunks of at most so many characters, whole hunks each, with what stands before the first hunk at the head of each; one without hunks in groups of lines."""

    def cut(parts: Column) -> Column:
        bare = F.startswith(F.get(parts, F.lit(0)), F.lit("@@"))
        return F.struct(F.when(bare, "").otherwise(F.get(parts, F.lit(0))).alias("head"), F.when(bare, parts).otherwise(F.slice(parts, 2, F.size(parts))).alias("hunks"))

    def chunks(diff: Column) -> Column:
        parted = _bound(F.split(diff, r"(?=@@ -\d+,?\d* \+\d+,?\d* @@)"), cut)
        lines = F.filter(_packed(F.transform(F.split(diff, "\n", -1), lambda x: F.concat(x, F.lit("\n"))), F.lit(""), most), lambda x: F.trim(F.translate(x, "\n\t", "  ")) != "")
        by_hunk = _bound(parted, lambda p: F.when(F.size(p["hunks"]) > 0, _packed(p["hunks"], p["head"], most)).otherwise(lines))
        return F.when(F.length(diff) <= most, F.array(diff)).otherwise(by_hunk)

    return _bound(diff, chunks)


# --- what needs a program: small functions over one value, in Arrow batches


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity (not an edit distance, and not symmetric)."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)])

    return F.pandas_udf(run, "double")(a, b)


def _pieces(text: str, size: int, overlap_: int, separators: list[str]) -> list[str]:
    """Recursive split by the first separator that occurs, pieces packed up to size, each begun with the end of the one before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next((s for s in separators if s and s in text), "")
    if not mark:
        return [text[i : i + size] for i in range(0, len(text), max(1, size - overlap_))]
    parts = text.split(mark)
    parts = [p + mark for p in parts[:-1]] + parts[-1:]
    out, now = [], ""
    for part in parts:
        if len(part) > size:
            out += ([now] if now.strip() else []) + _pieces(part, size, overlap_, separators[separators.index(mark) + 1 :])
            now = ""
        elif len(now) + len(part) > size:
            out.append(now)
            tail = now[-overlap_:] if overlap_ else ""
            now = tail + part if len(tail) + len(part) <= size else part
        else:
            now += part
    return out + ([now] if now.strip() else [])


def split_text(size: int, overlap_: int = 200, separators=("\n\n", "\n", " ")):
    """A column function: text to chunks of at most size characters."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else _pieces(t, size, overlap_, list(separators)) for t in texts])

    return run


def metadata(text: Column) -> Column:
    """Names, base types, signature and first comment of code, by patterns."""
    names = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:class|interface|def|func|function|struct|trait)\s+([A-Za-z_]\w*)"), F.lit(1))), 1, 30)
    bases = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:extends|implements)\s+([A-Za-z_][\w.]*)"), F.lit(1)))
    return F.struct(names.alias("names"), bases.alias("bases"), F.trim(F.regexp_extract(text, r"(?m)^\s*((?:public|private|protected|static|async|def|func|function|class)[^\n{:]*)", 1)).alias("signature"), F.trim(F.regexp_extract(text, r'(?s)(?:"""|/\*\*)(.*?)(?:"""|\*/)', 1)).alias("docstring"))


def duplication_queries(text: Column) -> Column:
    """Search texts of what a piece of code may repeat: definitions, calls, routes, statements, each with its weight."""
    found = lambda pattern, kind, w: F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("query"), F.lit(w).alias("weight")))
    return F.concat(found(r"(?:def|func|function)\s+([A-Za-z_]\w{2,})", "definition", 1.0), found(r"(?:class|interface)\s+([A-Za-z_]\w{2,})", "type", 0.9), found(r"\b([A-Za-z_]\w{3,})\(", "call", 0.6), found(r"(?i)\b((?:select|insert|update|delete)\s[^;\"]{10,80})", "statement", 0.8), found(r"[\"'](/[a-z0-9_/{}-]{3,})[\"']", "route", 0.7))


# Keys whose values are secrets, and ends of keys (without signs) that make them so; what takes their place.
SECRET_KEYS = {
    "access_token", "accesstoken", "api_key", "apikey", "authorization", "credential", "credentials", "oauth_client", "oauth_secret",
    "oauthclient", "oauthsecret", "password", "private_key", "privatekey", "secret", "token", "x-api-key",
}
SECRET_ENDS = ("apikey", "accesstoken", "oauthsecret", "privatekey")
URL_KEY_ENDS = ("baseurl", "base_url")
MASK, MASKED_URL = "[REDACTED]", "[REDACTED_INVALID_URL]"


def is_secret_key(key: str) -> bool:
    plain = key.strip().casefold()
    bare = re.sub("[^a-z0-9]", "", plain)
    return not SECRET_KEYS.isdisjoint((plain, bare)) or bare.endswith(SECRET_ENDS)


def _bare_url(url: str) -> str:
    """Scheme, host, port and path; what has no host loses query and fragment alone."""
    try:
        parts = urllib.parse.urlsplit(url)
        port = parts.port
    except ValueError:
        return MASKED_URL
    if parts.scheme and parts.netloc:
        return f"{parts.scheme}://{parts.hostname or ''}{f':{port}' if port else ''}{parts.path}"
    return re.split("[?#]", url, maxsplit=1)[0]


def _without_secrets(document: str) -> str:
    def clean(members: list[tuple[str, object]]) -> dict:
        # called for the innermost objects first; what stands under a secret key goes as a whole
        out = {}
        for key, value in members:
            if is_secret_key(key):
                value = value if value in (None, "", {}, []) else MASK
            elif isinstance(value, str) and key.casefold().endswith(URL_KEY_ENDS):
                value = _bare_url(value)
            out[key] = value
        return out

    try:
        found = json.loads(document, object_pairs_hook=clean, parse_constant=lambda _: None)
        return json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode(errors="replace").decode()
    except (ValueError, RecursionError):
        return json.dumps(MASK)


def redacted(documents: Column | str) -> Column:
    """JSON with what stands under secret keys masked at any depth, and URLs under base-URL keys without user, query and fragment.

    Null and empty values of secret keys stay, so they can be told from masked ones.  The result
    is JSON for every row: keys in order, no blanks, the last of repeated keys; NaN is null.
    Text that isn't JSON is masked as a whole, null stays null.
    """

    def run(values: pd.Series) -> pd.Series:
        return values.map(_without_secrets, na_action="ignore")

    return F.pandas_udf(run, "string")(documents)
