"""Sets and duplicates of findings and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import saved
from .aggregates import severity_rank
from .components import connected_components
from .folds import fold
from .ranking import first_rows

#: Reasons shorter than this don't identify a finding by themselves.
NARRATIVE = 40


def ordered_distinct(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """by, seen: the distinct values of a group in order of their first appearance; repeated ones are combined before they meet."""
    first = rows.groupBy(by, value).agg(F.min(order).alias("_at"))
    return first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_all")).select(by, F.transform("_all", lambda x: x[value]).alias("seen"))


def keep_best(rows: DataFrame, path: str = "path", text: str = "text", score: str = "score", tie: str = "id") -> DataFrame:
    """Of equal texts of a file the one with the best score."""
    return first_rows(rows.withColumn("_h", F.sha2(text, 256)), [F.col(path), F.col("_h")], [F.desc(score), F.col(tie)]).drop("_h")


def branch_priority(rows: DataFrame, target: str) -> DataFrame:
    """Rows of the target branch win for their paths; then the first of each path, branch and beginning of text."""
    owned = rows.where(F.col("branch") == target).select("path").distinct().withColumn("_owned", F.lit(True))
    out = rows.join(owned, "path", "left").where(F.col("_owned").isNull() | (F.col("branch") == target)).drop("_owned")
    return first_rows(out, [F.col("path"), F.col("branch"), F.sha2(F.substring("text", 1, 100), 256)], [F.desc("score"), F.col("id")])


def layer_priority(rows: DataFrame, priority: Column) -> DataFrame:
    """For each path only its rows of the best layer."""
    best = rows.withColumn("_p", priority)
    top = best.groupBy("path").agg(F.max("_p").alias("_p"))
    return best.join(top, ["path", "_p"], "left_semi").drop("_p")


def absorb(rows: DataFrame, key: Column, rank: Column) -> DataFrame:
    """Rows that agree in key become one: the best by rank (then the first), with the worst severity, the longest diff, the first description and all other places.

    Rows with a null key, and resolved rows, stay as they are.
    """
    # written once: two branches read it, and each pass would else run all passes before it twice
    named = saved(rows.withColumn("_k", F.when(~F.col("resolved"), F.md5(key))).withColumn("_rank", rank), "absorb")
    # the row that stands for a group comes out of the one aggregation as a whole
    grouped = named.where("_k is not null").groupBy("_k").agg(
        F.max_by(F.struct(*rows.columns), F.struct("_rank", -F.col("seq"))).alias("_best"),
        F.min_by("severity", F.struct(severity_rank(F.col("severity")), F.col("seq"))).alias("severity"), F.max_by("diff", F.struct(F.length("diff"), -F.col("seq"))).alias("diff"),
        F.sort_array(F.collect_set("line")).alias("_lines"),
    )
    columns = [F.col(c) if c in ("severity", "diff") else F.col(f"_best.{c}").alias(c) for c in rows.columns]
    merged = grouped.select(*columns, F.array_except("_lines", F.array("_best.line")).alias("places"))
    return merged.unionByName(named.where("_k is null").select(*rows.columns, F.array().cast(merged.schema["places"].dataType).alias("places")))


def representation_rank(snippet: Column, line: Column, diff: Column, reason: Column) -> Column:
    """How well a finding stands for its duplicates: by a snippet, then a line (the first line counts little), then the lengths of diff and reason."""
    at = F.when(line > 1, 100_000_000).when(line > 0, 10_000_000).otherwise(0)
    size = lambda c, most: F.least(F.coalesce(F.length(c), F.lit(0)), F.lit(most))
    return F.when(F.length(F.trim(snippet)) > 0, 1_000_000_000).otherwise(0) + at + size(diff, 1_000_000) + size(reason, 100_000)


def ingest(findings: DataFrame) -> DataFrame:
    """findings (seq, file, title, reason, severity, category, line, snippet, line_hash, resolved, diff): three passes, by narrative, by fingerprint, by content.

    The first takes equal titles and complete reasons (NARRATIVE characters at least, lines of
    further places apart) of a file; the other two only merge anchored findings.  Resolved
    findings, and those without an identity, stay.  One row a group, with ``places``.
    """
    rank = representation_rank(F.col("snippet"), F.col("line"), F.col("diff"), F.col("reason"))
    title, reason = T.normal_line(F.lower("title")), T.normal_line(F.lower(T.root_reason(F.col("reason"))))
    narrative = F.when((F.length(title) > 0) & (F.length(reason) >= NARRATIVE), F.concat_ws("\u0001", "file", title, reason))

    def anchored(fp: Column) -> Column:
        identity = T.anchored_identity(fp, F.col("line_hash"), F.lit("line"), F.col("line"), F.col("snippet"))
        return F.when(identity.isNotNull(), F.concat_ws("\u0001", "file", identity))

    keys = (narrative, anchored(T.fingerprint(F.col("category"), F.col("line_hash"), F.col("title"))), anchored(T.content_fingerprint(F.col("line_hash"), F.col("title"))))
    out = findings
    for i, key in enumerate(keys):
        # the column of an earlier pass belongs to the row that stands for its group
        out = absorb(out, key, rank).withColumnRenamed("places", f"_p{i}")
    places = [f"_p{i}" for i in range(len(keys))]
    return out.withColumn("places", F.sort_array(F.array_distinct(F.concat(*places)))).drop(*places)


def prompt_fingerprint(path: Column, line: Column, severity: Column, reason: Column) -> Column:
    return F.concat_ws("::", path, F.coalesce(F.floor(line / 3), F.lit(0)).cast("string"), severity, F.substring(F.lower(reason), 1, 50))


#: Share of the smaller reason's words that brings two narratives of a file together, wherever they stand and whatever their titles.
WORDS = 1 / 3
_PLACE = ["file", "title_n", "reason_n", "anchor", "at"]


def prepared(rows: DataFrame) -> DataFrame:
    """rows (seq, file, line, snippet, title, reason) with their narratives, token sets, anchor (snippet without blanks, or null) and place (line, or null)."""
    anchor = T.normal_line(F.col("snippet"))
    return rows.select(
        "seq", "file", T.narrative(F.col("title")).alias("title_n"), T.narrative(F.col("reason")).alias("reason_n"), F.when(anchor != "", anchor).alias("anchor"), F.when(F.col("line") > 0, F.col("line")).alias("at")
    ).where("file <> ''")


def _stars(rows: DataFrame, *by: str) -> DataFrame:
    """(a, b): each row beside the first of those that agree with it."""
    return rows.join(rows.groupBy(*by).agg(F.min("seq").alias("a")), list(by)).where("a < seq").select("a", F.col("seq").alias("b"))


def overlapping(sets: DataFrame, by: list[str], least: int, share: float, of: str | None = None) -> DataFrame:
    """sets (*by, seq, words): pairs (x, y), x < y, of a group that have ``least`` words in common and ``share`` of the smaller set; with a column ``of``, those of which it marks one set at least.

    The smaller set's words are ordered by how many sets of the group have them, the rarest
    first; of n words, of which t must be common, one of the first n - t + 1 is.  Only these look
    for partners, so a word that most sets have joins none of them, unless nothing rarer is left.
    """
    size = F.size("words")
    need = F.greatest(F.lit(least), F.ceil(size * share - 1e-9).cast("int"))
    marked = F.col(of) if of else F.lit(True)
    words = sets.where(size >= least).select(*by, "seq", size.alias("n"), need.alias("need"), marked.alias("marked"), F.explode("words").alias("word"))
    words = saved(words, "words")
    ranked = words.join(words.groupBy(*by, "word").agg(F.count("*").alias("k")).where("k > 1"), [*by, "word"])
    order = Window.partitionBy(*by, "seq").orderBy("k", "word")  # the words of one set
    lone = F.col("n") - F.count("*").over(Window.partitionBy(*by, "seq"))  # the rarest words, which no other set has
    first = ranked.withColumn("_at", F.row_number().over(order) + lone).where("_at <= n - need + 1")
    probe = first.select(*by, "word", F.col("seq").alias("p"), F.col("n").alias("np"), "need", "marked")
    held = words.select(*by, "word", F.col("seq").alias("q"), "n", "marked")
    meet = lambda p, q: p.drop("marked").join(q.drop("marked"), [*by, "word"]).where("p <> q and np <= n").select("p", "q", "need")
    met = meet(probe.where("marked"), held)
    met = (met.unionByName(meet(probe.where("not marked"), held.where("marked"))) if of else met).distinct()
    both = sets.select("seq", "words")
    met = met.join(both.select(F.col("seq").alias("p"), F.col("words").alias("_a")), "p").join(both.select(F.col("seq").alias("q"), F.col("words").alias("_b")), "q")
    return met.where(F.size(F.array_intersect("_a", "_b")) >= F.col("need")).select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()


def _pairs_of(found: DataFrame, reps: DataFrame) -> DataFrame:
    """(x, y) of seqs as structs a and b."""
    whole = F.struct(*reps.columns)
    return found.join(reps.select(F.col("seq").alias("x"), whole.alias("a")), "x").join(reps.select(F.col("seq").alias("y"), whole.alias("b")), "y").select("a", "b")


def _linked(rows: DataFrame, on: list[str], holds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs of rows that agree in ``on`` and fulfil ``holds`` (a filter of pairs a and b, by seq), such that the pairs' components are those of all such pairs.

    Each row is held against the first of its group; only those that this leaves apart are held against all of them.
    """
    whole = F.struct(*rows.columns)
    first = rows.groupBy(*on).agg(F.min_by(whole, "seq").alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    met = saved(holds(rows.select(*on, whole.alias("b")).join(first, on).where("a.seq < b.seq").select("a", "b")).select("a", "b"), "linked")
    joined = met.select(F.col("b.seq").alias("seq"), *(F.col(f"b.{c}").alias(c) for c in on)).unionByName(first.select(F.col("a.seq").alias("seq"), *on))
    strays = saved(rows.join(first.select(*on), on, "left_semi").join(joined, [*on, "seq"], "left_anti").select(rows.columns), "strays")
    side = rows.join(first.select(*on, F.col("a.seq").alias("_first")), on).where("seq <> _first").join(strays.select(*on, "seq", F.lit(True).alias("_stray")), [*on, "seq"], "left")
    pairs = strays.select(*on, whole.alias("s")).join(side.select(*on, whole.alias("o"), F.coalesce("_stray", F.lit(False)).alias("_stray")), on).where("(s.seq < o.seq) or (s.seq > o.seq and not _stray)")
    swap = F.col("s.seq") < F.col("o.seq")
    return met.unionByName(holds(pairs.select(F.when(swap, F.col("s")).otherwise(F.col("o")).alias("a"), F.when(swap, F.col("o")).otherwise(F.col("s")).alias("b"))).select("a", "b"))


def _measured(pairs: DataFrame) -> DataFrame:
    """pairs with title_s and reason_s (sequence similarity, each pair of texts compared once), and title_o and reason_o (token overlap)."""
    pairs = saved(pairs.select("a", "b").dropDuplicates(["a", "b"]), "pairs")
    texts = pairs.select(F.inline(F.array(*(F.struct(F.col(f"a.{c}").alias("x"), F.col(f"b.{c}").alias("y")) for c in ("title_n", "reason_n"))))).where("x <> '' and y <> ''").distinct()
    # what both texts of a pair share is told by the row of the pair, not once a finding
    ratios = texts.withColumn("ratio", F.when(F.col("x") == F.col("y"), 1.0).otherwise(T.sequence_ratio(F.col("x"), F.col("y")))).withColumn("o", T.overlap(T.token_set(F.col("x")), T.token_set(F.col("y"))))
    ratios = saved(ratios, "ratios")
    none = F.struct(F.lit(0).alias("common"), F.lit(0.0).alias("containment"), F.lit(0.0).alias("jaccard"))
    for c in ("title", "reason"):
        r = ratios.select(F.col("x").alias(f"_x{c}"), F.col("y").alias(f"_y{c}"), F.col("ratio").alias(f"{c}_s"), F.col("o").alias(f"{c}_o"))
        pairs = pairs.join(r, (F.col(f"a.{c}_n") == F.col(f"_x{c}")) & (F.col(f"b.{c}_n") == F.col(f"_y{c}")), "left").withColumn(f"{c}_s", F.coalesce(f"{c}_s", F.lit(0.0))).withColumn(f"{c}_o", F.coalesce(f"{c}_o", none))
    return pairs


def _same_anchor() -> Column:
    both = F.col("a.anchor").isNotNull() & F.col("b.anchor").isNotNull()
    return F.when(both, F.col("a.anchor") == F.col("b.anchor")).otherwise(F.coalesce(F.col("a.at") == F.col("b.at"), F.lit(False)))


def _same(c: str) -> Column:
    return (F.col(f"a.{c}") == F.col(f"b.{c}")) & (F.col(f"a.{c}") != "")


def _conservative() -> Column:
    """Same narrative, or same anchor and reasons that are equal or nearly so (nearer still under another title)."""
    reason = _same("reason_n") | (F.col("reason_s") >= 0.88) | (_same("title_n") & (F.col("reason_s") >= 0.94))
    return (_same("title_n") & _same("reason_n")) | (_same_anchor() & reason)


def _candidate() -> Column:
    """A pair of a file that may be one finding in other words."""
    title, reason = (lambda k: F.col(f"title_o.{k}")), (lambda k: F.col(f"reason_o.{k}"))
    near = F.coalesce(F.abs(F.col("a.at") - F.col("b.at")) <= 3, F.lit(False))
    by_title = _same("title_n") & ((F.col("reason_s") >= 0.50) | ((reason("common") >= 3) & (reason("containment") >= 0.45)))
    title_like = (F.col("title_s") >= 0.48) | ((title("common") >= 3) & (title("containment") >= 0.55)) | (title("jaccard") >= 0.42)
    reason_like = (F.col("reason_s") >= 0.46) | ((reason("common") >= 4) & (reason("containment") >= 0.50)) | (reason("jaccard") >= 0.36)
    strong = (F.col("reason_s") >= 0.70) | ((reason("common") >= 5) & (reason("containment") >= 0.65))
    return _conservative() | by_title | (title_like & strong) | ((_same_anchor() | near) & title_like & reason_like)


def duplicates(rows: DataFrame) -> DataFrame:
    """(a, b): findings (seq, file, line, snippet, title, reason) that are one without doubt.

    Findings of one file with the same title and reason, or at one anchor (equal snippets; equal
    lines where one has no snippet) with the same reason or reasons of a similarity of .88.  Equal
    ones are linked with the first of them, and distinct ones of an anchor as far as components need it, so
    the pairs' components are the duplicates; pairs are those of representatives.  Nulls are
    empty texts, which equal nothing; findings without a file stay alone.
    """
    p = saved(prepared(rows), "findings")
    reps = p.groupBy(*_PLACE).agg(F.min("seq").alias("seq"))
    sure = lambda pairs: _measured(pairs).where(_conservative())
    # equal lines count where one of two has no snippet, which the filter looks at
    anchored = _linked(reps.where("anchor is not null"), ["file", "anchor"], sure).unionByName(_linked(reps.where("at is not null"), ["file", "at"], sure))
    close = anchored.select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))
    told = p.where("title_n <> '' and reason_n <> ''")
    known = p.where("reason_n <> '' and (anchor is not null or at is not null)")
    return _stars(told, "file", "title_n", "reason_n").unionByName(_stars(known, *_PLACE)).unionByName(close).distinct()


def similar_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): findings that may be one, for a judgement by meaning; the pairs' components are the groups to judge.

    Beside the duplicates, pairs of a file with equal titles, at one anchor, on lines three apart
    or less, or with WORDS of the smaller one's words in common, if their titles and reasons are
    like enough; and findings of different files with an equal title of four words and like
    reasons.  Only distinct narratives are compared; equal ones hang on the first.

    Each narrative is first held against the first of its file.  Those that this joins are one
    group already, so only pairs with one that it leaves open are looked for further: equal titles
    and anchors such that the components are right (_linked), words in common by their rarest
    (overlapping).  The one pair that is not brought up has other titles, stands on distant lines,
    and has reasons alike by letters with few words in common.
    """
    p = saved(prepared(rows), "findings")
    every = saved(p.groupBy(*_PLACE).agg(F.min("seq").alias("seq")), "representatives")
    like = lambda pairs: _measured(pairs).where(_candidate())
    # places don't matter to titles and words: one row a narrative, to which its places hang
    names = ["file", "title_n", "reason_n"]
    told = saved(every.groupBy(*names).agg(F.min_by(F.struct("anchor", "at", "seq"), "seq").alias("r")).select(*names, "r.*").select(*_PLACE, "seq"), "narratives")
    hung = every.join(told.select(*names, F.col("seq").alias("a")), names).where("a < seq and title_n <> ''").where("reason_n <> ''").select("a", F.col("seq").alias("b"))
    whole = F.struct(*told.columns)
    hub = told.where("title_n <> '' and reason_n <> ''").groupBy("file").agg(F.min_by(whole, "seq").alias("a"))
    met = saved(like(told.select("file", whole.alias("b")).join(hub, "file").where("a.seq < b.seq and b.title_n <> '' and b.reason_n <> ''").select("a", "b")).select("a", "b"), "met")
    joined = met.select(*(F.col(f"b.{c}").alias(c) for c in names)).unionByName(hub.select(*(F.col(f"a.{c}").alias(c) for c in names)))
    left = saved(every.join(joined, names, "left_anti").select(*_PLACE, "seq"), "open")
    # a file without an open one is done
    flagged = every.join(left.select("file").distinct(), "file", "left_semi").join(left.select("seq", F.lit(True).alias("open")), "seq", "left")
    reps = saved(flagged.select(*_PLACE, "seq", F.coalesce("open", F.lit(False)).alias("open")), "representatives")
    told = told.join(reps.select("seq", "open"), "seq").select(*_PLACE, "seq", "open")
    by_word = overlapping(told.where("title_n <> ''").select("file", "seq", T.token_set(F.col("reason_n")).alias("words"), "open"), ["file"], 1, WORDS, "open")
    bucket = F.floor(F.col("at") / 4)
    placed = reps.where("at is not null")
    side = lambda n, b: placed.select("file", b.alias("_b"), F.struct(*every.columns).alias(n), F.col("open").alias(f"{n}_open"))
    near = side("a", F.explode(F.array(bucket - 1, bucket, bucket + 1))).join(side("b", bucket), ["file", "_b"]).where("(a_open or b_open) and a.seq < b.seq and a.at <> b.at and abs(a.at - b.at) <= 3").select("a", "b")
    pairs = met.unionByName(like(near.unionByName(_pairs_of(by_word, told.drop("open")))).select("a", "b"))
    for source, on in ((reps, ["file", "anchor"]), (reps, ["file", "at"]), (told.where("title_n <> ''"), ["file", "title_n"])):
        some = source.where(F.col(on[1]).isNotNull())
        pairs = pairs.unionByName(_linked(some.join(some.where("open").select(*on).distinct(), on, "left_semi").select(every.columns), on, like))
    found = pairs.select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))
    return duplicates(rows).unionByName(hung).unionByName(found).unionByName(_across(p)).distinct()


def _across(p: DataFrame) -> DataFrame:
    """(a, b) of findings in different files with an equal title of four words and like reasons."""
    words = T.token_set(F.col("reason_n"))
    signed = p.where((F.size(T.token_set(F.col("title_n"))) >= 4) & (F.size(words) >= 4))
    first = saved(signed.groupBy("title_n", "reason_n").agg(F.min("seq").alias("seq"), F.min("file").alias("f0"), F.max("file").alias("f1")), "titles")
    many = first.where("f0 < f1").select("title_n", "reason_n")
    pairs = _pairs_of(overlapping(first.select("title_n", "seq", words.alias("words")), ["title_n"], 4, 0.50), first)
    o = T.overlap(T.token_set(F.col("a.reason_n")), T.token_set(F.col("b.reason_n")))
    apart = (F.col("a.f0") != F.col("a.f1")) | (F.col("b.f0") != F.col("b.f1")) | (F.col("a.f0") != F.col("b.f0"))
    other = pairs.where(apart & (o["jaccard"] >= 0.25)).select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))
    return _stars(signed.join(many, ["title_n", "reason_n"], "left_semi"), "title_n", "reason_n").unionByName(other)


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, component) of duplicates that hang together."""
    return connected_components(pairs, "a", "b")


def greedy(rows: DataFrame, by: str, ratio: float = 0.88) -> DataFrame:
    """In order of seq, a finding is absorbed by the first kept one of its file with the same title and reason, or at the same anchor with a like reason.

    rows (by, seq, line, reason, and title and snippet, if there are such columns).  Texts are
    compared as narratives; nulls are empty and equal nothing.  Anchors are equal snippets, or
    equal lines where one of two has no snippet.  Order decides, so the findings of a file are
    one fold; only distinct reasons of an anchor are compared, once each.
    """
    import difflib

    texts = [F.coalesce(T.narrative(F.col(c)) if c in rows.columns else F.lit(""), F.lit("")).alias(c) for c in ("title", "reason")]
    anchor = F.coalesce(T.normal_line(F.col("snippet")), F.lit("")) if "snippet" in rows.columns else F.lit("")
    plain = rows.select(by, "seq", F.coalesce(F.when(F.col("line") > 0, F.col("line")), F.lit(0)).cast("long").alias("line"), *texts, anchor.alias("snippet"))

    def run(group: list) -> list[tuple]:
        narratives, anchors, into = {}, {}, []  # the place and seq of the first kept finding of each
        for at, r in enumerate(group):
            near = [anchors.get(("snippet", r.snippet), {})] if r.snippet else []
            if r.line:
                # by line only those of whom one has no snippet
                near += [anchors.get(("line", r.line, False), {})] + ([] if r.snippet else [anchors.get(("line", r.line, True), {})])
            found = [x for x in [narratives.get((r.title, r.reason))] if x]
            for reasons in near if r.reason else ():
                if r.reason in reasons:
                    found.append(reasons[r.reason])
                for other, kept in reasons.items():
                    if other != r.reason and (not found or kept < min(found)) and difflib.SequenceMatcher(None, r.reason, other).ratio() >= ratio:
                        found.append(kept)
                        break
            if not found:
                if r.title and r.reason:
                    narratives[r.title, r.reason] = (at, r.seq)
                for key in [("snippet", r.snippet)] * bool(r.snippet) + [("line", r.line, bool(r.snippet))] * bool(r.line):
                    if r.reason:
                        anchors.setdefault(key, {}).setdefault(r.reason, (at, r.seq))
            into.append((r.seq, min(found)[1] if found else r.seq))
        return into

    return fold(plain, [by], ["seq"], run, "seq long, kept_seq long")


def flatten_groups(rows: DataFrame) -> DataFrame:
    """rows (grp, seq, path, text): groups in order, each text of a path once."""
    return first_rows(rows.withColumn("_h", F.sha2("text", 256)), [F.col("path"), F.col("_h")], [F.col("grp"), F.col("seq")]).drop("_h")


def replace_stale(branch: DataFrame, overlay: DataFrame, changed: DataFrame) -> DataFrame:
    """Branch chunks of changed paths give way to overlay chunks where there are some; those left are flagged stale."""
    fresh = overlay.select("path").distinct().withColumn("_fresh", F.lit(True))
    mark = changed.select("path").distinct().withColumn("_changed", F.lit(True))
    old = branch.join(mark, "path", "left").join(fresh, "path", "left").where(F.col("_changed").isNull() | F.col("_fresh").isNull())
    old = old.withColumn("stale", F.coalesce("_changed", F.lit(False))).drop("_changed", "_fresh")
    return old.unionByName(overlay.join(changed.select("path").distinct(), "path", "left_semi").withColumn("stale", F.lit(False)))


def promotion(commits: DataFrame, receipts: DataFrame) -> DataFrame:
    """commits (request, commit, patch), receipts (patch, target): how far a request's review can be reused."""
    known = receipts.select("patch").distinct().withColumn("_k", F.lit(True))
    each = commits.join(known, "patch", "left").groupBy("request").agg(F.count("*").alias("n"), F.count("_k").alias("k"))
    return each.select("request", F.when(F.col("k") == F.col("n"), "EXACT").when(F.col("k") > 0, "PARTIAL").otherwise("NONE").alias("reuse"), (F.col("k") < F.col("n")).alias("needs_context"))
