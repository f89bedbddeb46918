"""Secret scans with multipart credential linking, on DataFrame functions only.

Base spans: all leftmost matches of three patterns. A pattern's gaps (split) and matches (extract all) alternate, so
running sums of their lengths give the places, in code points, without leaving the JVM. Lengths are exploded and summed by a
window, and redaction cuts from blocks of a text, so a text's cost is in proportion to its length however many secrets it has.

Linking: an access key, a secret and an endpoint are harmless alone and a credential together. Weak parts (a loose
identifier, a loose secret-like run of any length, a URL of any scheme, an assigned value too short for the base) are
found likewise and reported only if complementary parts lie in one scope, that is at most ``scope`` code points apart: an interval join of parts of one text, on overlapping blocks of
``scope`` code points. Spans don't overlap within a kind, so a block holds a bounded number of parts and the join
can't grow with the square of a text or a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinade.llm.common import store

# The base patterns; letters of the assign keywords stand in either case.
KEYWORD = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
BASE = {
    "assign": KEYWORD + r"([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{14,}",  # a run too short has no longer one inside, so the least length may be asked at once
    "hex": r"[0-9a-f]{16,}",
}
ASSIGN_LEAST = 12
# The weak parts.
WEAK = {
    "weak_id": r"""([cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT](_?[iI][dD])?|[uU][sS][eE][rR]([nN][aA][mM][eE])?|[lL][oO][gG][iI][nN])["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""",
    "weak_secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])",
    "weak_endpoint": r"""(?<![A-Za-z0-9])[0-9]*[A-Za-z][A-Za-z0-9]*(?:\+[A-Za-z0-9]+)?://[^\s"'<>]{4,}""",  # from a run's start, so that long runs cost no square
    "weak_assign": KEYWORD + r"""(?![A-Za-z0-9+/_.=-]{12})[^\s"'<>,;&]+""",  # what the base's least length leaves out
}
# What a cheap look must find before a costly pattern runs; each is part of every match.
NEEDS = {
    "assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}",
    "weak_id": r"[:=]\x20*[\"']?[A-Za-z0-9_.@+-]{3}",
    "weak_secret": r"[A-Za-z0-9+/_-]{32}",
    "weak_endpoint": r"://",
}
RANK = {kind: i for i, kind in enumerate([*BASE, *WEAK])}
ID, SECRET, ENDPOINT = "id", "secret", "endpoint"
PART = {"assign": SECRET, "access": ID, "hex": SECRET, "weak_id": ID, "weak_secret": SECRET, "weak_endpoint": ENDPOINT, "weak_assign": SECRET}
LENGTHS = "array<struct<gap:int,hit:int,ok:boolean>>"
PIECE = 1000  # code points of a block that redaction cuts from


def lengths(text: Column, kind: str) -> Column:
    """Per leftmost match: the length before it, its own, and whether it counts (for assign: its group 2 is long enough)."""
    pattern = (BASE | WEAK)[kind]
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else hits
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), counts.alias("own"))
    least = ASSIGN_LEAST if kind == "assign" else 0
    found = F.transform(parts, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["own"]) >= least).alias("ok")))
    return F.when(text.rlike(NEEDS.get(kind, pattern)), found).otherwise(F.array().cast(LENGTHS))


def of_rank(rank: Column, values: dict) -> Column:
    """The kind's value in ``values`` (by kind) for a kind's rank."""
    return F.element_at(F.array(*(F.lit(values[k]) for k in RANK)), rank + 1)


def places(rows: DataFrame) -> DataFrame:
    """_row, rank, start, end, kind, part of every span, from the rows' columns of lengths."""

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda x, i: F.struct(F.lit(RANK[kind]).alias("rank"), i.alias("no"), x["gap"].alias("gap"), x["hit"].alias("hit"), x["ok"].alias("ok")))

    some = reduce(lambda a, b: a | b, (F.size(k) > 0 for k in RANK))
    each = rows.where(some).select("_row", F.explode(F.concat(*map(tagged, RANK))).alias("s")).select("_row", "s.*")
    line = Window.partitionBy("_row", "rank").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.col("hit")).cast("long")).over(line)
    found = each.withColumn("end", end).where("ok").withColumn("start", F.col("end") - F.col("hit"))
    return found.select("_row", "rank", "start", "end", of_rank(F.col("rank"), {k: k for k in RANK}).alias("kind"), of_rank(F.col("rank"), PART).alias("part"))


def joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame, key: str, scope: int) -> DataFrame:
    """Weak parts of ``parts`` (key, start, end, kind, part) whose complementary parts lie in one scope.

    An identifier needs a secret, a secret an identifier, an endpoint both.
    """
    block = lambda c: F.floor(F.col(c) / scope)
    near = F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope)))
    weak = parts.where(F.col("kind").startswith("weak_")).withColumn("block", near)
    other = parts.select(key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("part").alias("o_part"), F.explode(F.sequence(block("start"), block("end"))).alias("block"))
    close = (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope) & (F.col("part") != F.col("o_part"))
    seen = weak.join(other, [key, "block"]).where(close).groupBy(key, "start", "end", "kind", "part").agg(F.bool_or(F.col("o_part") == ID).alias("with_id"), F.bool_or(F.col("o_part") == SECRET).alias("with_secret"))
    complete = F.when(F.col("part") == ID, F.col("with_secret")).when(F.col("part") == SECRET, F.col("with_id")).otherwise(F.col("with_id") & F.col("with_secret"))
    return seen.where(complete).select(key, "start", "end", "kind")


def scan(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's id and ``spans``: an array of (start, rank, end, kind, ended), in order of start, then kind as listed; ``ended`` is how far the spans before reach.

    Null and empty texts have none; repeated rows each have theirs; null ids are kept; texts of any length and number of spans take time in
    proportion; an empty table gives an empty result; other columns aren't read. ``keep`` names further columns to
    carry along (none of this function's own names).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [c for c in keep if c not in ("doc_id",)]
    rows = docs.select(F.col(id_col).alias("doc_id"), *names, *(lengths(text, k).alias(k) for k in RANK))
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()), "secrets")  # the row numbers stay
    alls = store(places(rows), "secret-spans")
    base = alls.where(F.col("rank") < len(BASE)).select("_row", "start", "rank", "end", "kind")
    weak = linked(alls, "_row", scope).select("_row", "start", of_rank_by_kind().alias("rank"), "end", "kind")
    line = Window.partitionBy("_row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = base.union(weak).withColumn("ended", F.coalesce(F.max("end").over(line), F.lit(0).cast("bigint")))
    spans = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "ended"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,ended:bigint>>")
    return rows.drop(*RANK).join(spans, "_row", "left").withColumn("spans", F.coalesce("spans", none)).drop("_row")


def of_rank_by_kind() -> Column:
    return reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(RANK[k])), RANK, F)


def digest(rows: DataFrame) -> DataFrame:
    """The query's columns from scan()'s rows."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def between(blocks: Column, begin: Column, end: Column) -> Column:
    """The text from code point ``begin`` to ``end``, put together from its blocks."""
    first, last = F.floor(begin / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    of = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    inside = F.substring(of(first), (begin % PIECE + 1).cast("int"), (end - begin).cast("int"))
    head, tail = F.substring(of(first), (begin % PIECE + 1).cast("int"), F.lit(PIECE)), F.substring(of(last), F.lit(1), (end % PIECE).cast("int"))
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(end <= begin, F.lit("")).when(first == last, inside).otherwise(F.concat(head, middle, tail))


def redact(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """The same columns with every span's text replaced by ``mark`` (overlapping spans by one), n_chars brought up to date.

    Every row stays, repeated ones, null ids, null and empty texts included; texts of any length and number of spans take
    time in proportion; an empty table gives an empty result; columns may have any names.
    """
    columns = docs.columns
    own = {c: f"_own{i}" for i, c in enumerate(columns)}  # their names may be those of this module's columns
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    rows = scan(renamed, scope, own["doc_id"], own["text"], tuple(own.values()))
    text, some = F.col(own["text"]), F.size("spans") > 0
    cut = rows.withColumn("blocks", F.when(some, F.regexp_extract_all(own["text"], F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def piece(s: Column) -> Column:
        return F.when(s["start"] >= s["ended"], F.concat(between(F.col("blocks"), s["ended"], s["start"]), F.lit(mark))).otherwise(F.lit(""))

    rest = between(F.col("blocks"), F.array_max(F.transform("spans", lambda s: s["end"])), F.length(text).cast("bigint"))
    clean = F.when(some, F.concat(F.array_join(F.transform("spans", piece), ""), rest)).otherwise(text)
    fresh = {"text": clean}
    if "n_chars" in columns:
        fresh["n_chars"] = F.when(some, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return cut.select(*(fresh.get(c, F.col(n)).alias(c) for c, n in own.items()))
