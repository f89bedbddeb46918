"""Prefix trie of conversations: the Cartesian tree over the LCP array of the sorted conversations.

Conversations are sorted by their turns and each is compared with the one before: lcp, the turns they share. A node that branches or ends is an
interval of rows with a depth, found for every row by its nearest smaller values on both sides; rows of one interval
and depth are one node. These are found within blocks of the order first, what leaves a block by the blocks' minima. The depths between a node
and its parent are filled in at the end, and sums over subtrees are differences of running sums over the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinade.llm.common import globally_ordered, in_small_batches, lookup, partition_offsets, store

BLOCK_ROWS = 4096  # conversations of a block
TIE_LETTERS = 32  # of a text that order turns of one number and role
WORD = r"[\x20\x09-\x0D]+"
GROUP = 20  # conversations that share a head, and
HEADS = 4  # one more than the turns it has at most
INT64_MAX = np.iinfo(np.int64).max


def digested(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``: an array of (digest, words) in order, of every conversation with an id.

    Turns go by number, null first; those of one number by role, then the text's first letters, then its digest. Texts are read whole where they are; a digest is half a
    SHA-256 of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.size(F.filter(F.split(text, WORD), lambda w: w != "")).cast("bigint")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, TIE_LETTERS).alias("start"), digest.alias("digest"), words.alias("words"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "start", "digest", "words"))).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turns``: the group's first h turns, then the conversation's own after its first h; h by the id's CRC."""
    own = digested(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    own = own.select("conv_id", "turns", h.alias("h"), base.alias("base"))
    heads = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, HEADS - 1).alias("head"))
    head, rest = F.coalesce("head", F.filter("turns", lambda x: F.lit(False))), F.when(F.col("h") < F.size("turns"), F.slice("turns", F.col("h") + 1, F.size("turns")))
    joined = own.join(heads, "base", "left")
    turns = F.concat(F.slice(head, F.lit(1), F.col("h")), F.coalesce(rest, F.filter("turns", lambda x: F.lit(False))))
    return joined.select("conv_id", turns.alias("turns"))


def shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("bigint")


def lcp_table(sequences: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``conv_id``, ``turns`` in sorted order: ``_pid``, ``g`` (place), conv_id, ``len``, ``lcp`` and ``nxt`` (turns shared with the row before and after), ``sums`` (words
    of the first d turns, d from 0); and a row for each block.

    A block's first and last row are compared with copies of its neighbours' last and first.
    """
    digests = F.transform("turns", lambda x: x["digest"])
    ordered = globally_ordered(store(sequences.select(digests.alias("s"), "conv_id", F.transform("turns", lambda x: x["words"]).alias("words")), "sequences"), ["s", "conv_id"], "sorted-sequences", rows)
    offsets = partition_offsets(ordered, F.count(F.lit(1)))
    ends = ordered.groupBy("_pid").agg(F.min_by("s", "_pos").alias("first"), F.max_by("s", "_pos").alias("last"))
    by_block = Window.orderBy("_pid")  # a row for each block
    ends = store(ends.select("_pid", F.lag("last").over(by_block).alias("before"), F.lead("first").over(by_block).alias("after")), "block-ends")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("conv_id", "bigint"), ("words", "array<bigint>"))]
    copies = [ends.where(F.col(c).isNotNull()).select("_pid", F.lit(at).cast("bigint").alias("_pos"), F.col(c).alias("s"), *none) for c, at in (("before", -1), ("after", INT64_MAX))]
    both = ordered.select("_pid", "_pos", "s", "conv_id", "words").union(copies[0]).union(copies[1])
    w = Window.partitionBy("_pid").orderBy("_pos")
    near = both.withColumns({"lag": F.lag("s").over(w), "lead": F.lead("s").over(w)}).where("conv_id IS NOT NULL")
    g = lookup(offsets, F.col("_pid")) + F.col("_pos")
    zero = F.lit(0).cast("bigint")
    out = near.select("_pid", g.alias("g"), "conv_id", F.size("s").cast("bigint").alias("len"), F.coalesce(shared(F.col("lag"), F.col("s")), zero).alias("lcp"), F.coalesce(shared(F.col("s"), F.col("lead")), zero).alias("nxt"), "words")
    out = store(out, "lcp")
    return out, out.groupBy("_pid").agg(F.min("lcp").alias("lcp"), F.min("conv_id").alias("conv"))


def smaller_before(v: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, -1 without any."""
    found, stack = np.full(len(v), -1), []
    for i, x in enumerate(v.tolist()):
        while stack and v[stack[-1]] >= x:
            stack.pop()
        if stack:
            found[i] = stack[-1]
        stack.append(i)
    return found


class RangeMinimum:
    """Minima of any ranges of a fixed array, by powers of two."""

    def __init__(self, v: np.ndarray):
        self.levels = [np.asarray(v, np.int64)]
        while len(self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of v[lo:hi] for each pair; the largest number where a range is empty."""
        out = np.full(len(lo), INT64_MAX)
        for k, level in enumerate(self.levels):
            rows = (hi - lo >= 1 << k) & (hi - lo < 2 << k)
            if rows.any():
                out[rows] = np.minimum(level[lo[rows]], level[hi[rows] - (1 << k)])
        return out


def block_values(block: pd.DataFrame) -> pd.DataFrame:
    """A block's nearest smaller values (null: outside it), and minima of conv_id: within the interval, from the row on, before the row."""
    block = block.sort_values("g")
    lcp, conv, start = block["lcp"].to_numpy(), block["conv_id"].to_numpy(), int(block["g"].iloc[0])
    before = smaller_before(lcp)
    after = len(lcp) - 1 - smaller_before(lcp[::-1])[::-1]  # len(lcp): none
    inside = (before >= 0) & (after < len(lcp))
    least = np.where(inside, RangeMinimum(conv).of(np.where(inside, before, 0), np.where(inside, after, 0)), -1)
    known = lambda x, ok: pd.array(np.where(ok, x, 0), "Int64").copy() if ok.all() else pd.array([int(a) if b else None for a, b in zip(x, ok, strict=True)], "Int64")
    upto = np.minimum.accumulate(conv)
    return pd.DataFrame({
        "_pid": block["_pid"].to_numpy(), "g": block["g"].to_numpy(), "conv_id": conv, "len": block["len"].to_numpy(), "lcp": lcp, "nxt": block["nxt"].to_numpy(),
        "ps": known(before + start, before >= 0), "ns": known(after + start, after < len(lcp)), "least": known(least, inside),
        "tail": np.minimum.accumulate(conv[::-1])[::-1], "head": known(np.concatenate([[0], upto[:-1]]), np.arange(len(conv)) > 0),
        "sums": [np.concatenate([[0], np.cumsum(w)]).astype(np.int64) for w in block["words"]],
    })


VALUES = "_pid int, g long, conv_id long, len long, lcp long, nxt long, ps long, ns long, least long, tail long, head long, sums array<bigint>"


def nearest_blocks(minima: np.ndarray, forward: bool):
    """A mapInPandas function: rows of ``_pid``, ``lcp`` get ``at``, the nearest block on one side whose minimum is smaller than lcp."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = np.full(len(rows), -1)
            for pid, own in rows.groupby("_pid").indices.items():
                line = minima[pid + 1 :] if forward else minima[:pid][::-1]
                low = np.minimum.accumulate(line) if len(line) else line
                k = np.searchsorted(-low, -rows["lcp"].to_numpy()[own], side="right")
                at[own] = np.where(k < len(low), pid + 1 + k if forward else pid - 1 - k, -1)
            yield rows.assign(at=at)

    return find


def outside(rows: DataFrame, minima: np.ndarray, forward: bool) -> DataFrame:
    """``_pid``, ``lcp``, ``found``: for the values of a block that have no smaller one in it on one side, the place of that.

    The block where it lies is found by minima; in that it is a row which has itself nothing smaller on the other side. Such rows are
    few (one for each value of a block), and meet as one array for each block.
    """
    mine, other, edge = ("ns", "ps", F.min) if forward else ("ps", "ns", F.max)
    asked = rows.where(F.col(mine).isNull() & (F.col("lcp") > 0)).select("_pid", "lcp").distinct()
    asked = asked.mapInPandas(nearest_blocks(minima, forward), "_pid int, lcp long, at int").where("at >= 0")
    ends = rows.where(F.col(other).isNull()).groupBy("_pid", "lcp").agg(edge("g").alias("g"))
    ends = ends.groupBy(F.col("_pid").alias("at")).agg(F.collect_list(F.struct("lcp", "g")).alias("ends"))
    places = F.transform(F.filter("ends", lambda x: x["lcp"] < F.col("lcp")), lambda x: x["g"])
    return asked.join(ends, "at").select("_pid", "lcp", (F.array_min if forward else F.array_max)(places).alias("found"))


def nearest_smaller(rows: DataFrame, minima: np.ndarray, n: int) -> DataFrame:
    """block_values()'s rows with ``ps`` and ``ns`` of every row whose lcp isn't 0; n where nothing smaller follows."""
    before, after = (outside(rows, minima, forward).withColumnRenamed("found", name) for forward, name in ((False, "_before"), (True, "_after")))
    out = rows.join(before, ["_pid", "lcp"], "left").join(after, ["_pid", "lcp"], "left")
    out = out.withColumns({"ps": F.coalesce("ps", "_before"), "ns": F.coalesce("ns", "_after", F.lit(n).cast("bigint"))}).drop("_before", "_after")
    return store(out, "nearest-smaller")


NODE = ["v", "lo", "hi", "u", "plo", "conv", "cuts", "_pid", "sums"]


def merged_nodes(rows: DataFrame, conv_minima: np.ndarray, n: int) -> DataFrame:
    """The nodes that branch or end: depth ``v``, rows ``lo`` to before ``hi``, parent's depth ``u`` and first row ``plo``, smallest id
    ``conv``, ``cuts`` (places where its rows part), ``sums`` (of words, along its first row).

    Rows of one depth and interval are one node. The smallest id of an interval within a block is known; of others it is put together
    from what the first and last block have and the minima of the blocks between.
    """
    inner = rows.where("lcp > 0").groupBy(F.col("lcp").alias("v"), F.col("ps").alias("lo")).agg(F.max("ns").alias("hi"), F.min("least").alias("least"), F.count(F.lit(1)).alias("cuts"))
    first = rows.select(F.col("g").alias("lo"), "_pid", F.col("lcp").alias("lv"), F.col("ps").alias("lps"), "tail", "sums")
    last = rows.select(F.col("g").alias("hi"), F.col("_pid").alias("hi_pid"), F.col("lcp").alias("hv"), "head")
    inner = inner.join(first, "lo").join(last, "hi", "left")
    inner = inner.withColumns({"hi_pid": F.coalesce("hi_pid", F.lit(len(conv_minima))), "hv": F.coalesce("hv", F.lit(0)), "u": F.greatest("lv", F.coalesce("hv", F.lit(0)))})
    between = RangeMinimum(conv_minima)

    @F.pandas_udf("bigint")
    def of_blocks(lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series(between.of(lo.to_numpy(np.int64), hi.to_numpy(np.int64)))

    inner = store(inner, "inner-nodes")
    within = inner.where("least IS NOT NULL").withColumn("conv", F.col("least"))
    across = inner.where("least IS NULL").withColumn("conv", F.least("tail", of_blocks(F.col("_pid") + 1, F.col("hi_pid")), "head"))
    plo = F.when(F.col("u") == 0, F.lit(0)).when(F.col("lv") < F.col("u"), F.col("lo")).otherwise(F.col("lps")).cast("bigint")
    inner = within.unionByName(across).withColumn("plo", plo).select(*NODE)
    u = F.greatest("lcp", "nxt")
    plo = F.when(u == 0, F.lit(0)).when(F.col("lcp") < u, F.col("g")).otherwise(F.col("ps")).cast("bigint")
    none, zero = F.lit(None).cast("array<bigint>"), F.lit(0).cast("bigint")
    single = rows.where(F.col("len") > u).select(F.col("len").alias("v"), F.col("g").alias("lo"), (F.col("g") + 1).alias("hi"), u.alias("u"), plo.alias("plo"), F.col("conv_id").alias("conv"), zero.alias("cuts"), "_pid", none.alias("sums"))
    root = rows.groupBy().agg(F.count_if((F.col("lcp") == 0) & (F.col("g") > 0)).alias("cuts"), F.min("_pid").alias("_pid"))
    fixed = {"v": 0, "lo": 0, "hi": n, "u": -1, "plo": None, "conv": int(conv_minima.min())}
    root = root.select("cuts", "_pid", *(F.lit(x).cast("bigint").alias(c) for c, x in fixed.items()), none.alias("sums")).select(*NODE)
    return inner.union(single).union(root)


def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's texts, which come in order, one after the other; only a hash's state is kept."""
    node, state = None, None
    for rows in batches:
        out = []
        for v, lo, text in zip(rows["v"], rows["lo"], rows["ids"], strict=True):
            if (v, lo) != node:
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (v, lo), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pd.DataFrame(out, columns=["v", "lo", "ends"])
    if state is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["v", "lo", "ends"])


def ending(rows: DataFrame) -> DataFrame:
    """``v``, ``lo``, ``k`` (conversations that end in the node) and ``ends`` (SHA-256 of their ids).

    Alike conversations stand in order of their ids, so a block joins its own ids, and only nodes over several blocks are hashed piece by piece: as a hash is
    sequential by its nature, such a node's pieces (one for each block) pass one task, never held together.
    """
    lo = F.when(F.col("len") == 0, F.lit(0).cast("bigint")).when(F.col("lcp") < F.col("len"), F.col("g")).otherwise(F.col("ps"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "conv_id"))), lambda x: x["conv_id"].cast("string")), ",")
    pieces = rows.select("_pid", "g", "conv_id", F.col("len").alias("v"), lo.alias("lo")).groupBy("_pid", "v", "lo").agg(F.count(F.lit(1)).alias("k"), ids.alias("ids"))
    pieces = store(pieces, "ends")
    nodes = pieces.groupBy("v", "lo").agg(F.count(F.lit(1)).alias("pieces"), F.sum("k").alias("k"), F.min("ids").alias("ids"))
    one = nodes.where("pieces = 1").select("v", "lo", "k", F.sha2("ids", 256).alias("ends"))
    long = nodes.where("pieces > 1").select("v", "lo", "k")
    apart = in_small_batches(pieces).select("v", "lo", "_pid", "ids").join(long.select("v", "lo"), ["v", "lo"], "left_semi")
    apart = apart.repartition("v", "lo").sortWithinPartitions("v", "lo", "_pid").mapInPandas(hashed, "v long, lo long, ends string")
    return one.union(long.join(apart, ["v", "lo"]).select("v", "lo", "k", "ends"))


def with_totals(nodes: DataFrame) -> DataFrame:
    """``leaves`` and ``saved`` of each merged node's subtree: its nodes are those from it on, in order of first row and depth, whose
    first row is before its end; so both are differences of running sums."""
    along = lambda d: F.element_at("sums", (d + 1).cast("int"))
    saved = F.when(F.col("sums").isNotNull(), (F.col("hi") - F.col("lo") - 1) * (along(F.col("v")) - along(F.col("u")))).otherwise(0)
    nodes = store(nodes.withColumns({"t": saved.cast("bigint"), "leaf": (F.col("children") == 0).cast("bigint")}), "merged-nodes")
    w = Window.partitionBy("_pid").orderBy("lo", "v").rowsBetween(Window.unboundedPreceding, -1)
    whole = nodes.agg(F.sum("t").alias("t"), F.sum("leaf").alias("leaf")).first()
    so_far = {f"{c}_before": lookup(partition_offsets(nodes, F.sum(c)), F.col("_pid")) + F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("t", "leaf")}
    placed = store(nodes.withColumns(so_far), "placed-nodes")
    starts = placed.groupBy(F.col("lo").alias("hi")).agg(F.min("t_before").alias("t_end"), F.min("leaf_before").alias("leaf_end"))
    ended = placed.join(starts, "hi", "left")
    return ended.withColumns({name: F.coalesce(f"{c}_end", F.lit(whole[c])) - F.col(f"{c}_before") for name, c in (("saved", "t"), ("leaves", "leaf"))})


def with_parents(nodes: DataFrame, least: int) -> DataFrame:
    """``parent``: the parent's smallest id; ``least`` below the root. Each block asks once for a parent, so one with very many children meets none of them in one task."""
    asked = nodes.where("u > 0").select("_pid", "u", "plo").distinct()
    known = asked.join(nodes.select(F.col("v").alias("u"), F.col("lo").alias("plo"), F.col("conv").alias("parent")), ["u", "plo"])
    deep = nodes.where("u > 0").join(known, ["_pid", "u", "plo"])
    top = nodes.where("u <= 0").withColumn("parent", F.when(F.col("u") == 0, F.lit(least).cast("bigint")))
    return deep.unionByName(top)


TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(sequences: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each distinct beginning of the sequences (``conv_id``, ``turns`` of digest and words): smallest member, depth, parent's smallest member, members,
    children, childless nodes below, words saved by keeping it once, SHA-256 of the ids that end there.

    ``conv_id`` must be unique and not null. Sequences without turns end in the root; no sequences give no rows, not even a root. A sequence is one row, as
    long as it may be; everything else is bounded by a block's ``rows``.
    """
    lcp, blocks = lcp_table(sequences, rows)
    found = sorted(blocks.collect())  # a row for each block
    if not found:
        return sequences.sparkSession.createDataFrame([], TRIE)
    minima, convs = (np.full(found[-1]["_pid"] + 1, INT64_MAX) for _ in range(2))
    for r in found:
        minima[r["_pid"]], convs[r["_pid"]] = r["lcp"], r["conv"]
    n = lcp.count()
    values = store(lcp.groupBy("_pid").applyInPandas(block_values, VALUES), "block-values")
    near = nearest_smaller(values, minima, n)
    nodes = merged_nodes(near, convs, n).join(ending(near), ["v", "lo"], "left")
    nodes = with_totals(nodes.withColumn("children", F.col("cuts") + 1 - F.coalesce("k", F.lit(0))))
    nodes = with_parents(nodes, int(convs.min()))
    deepest, top = F.col("depth") == F.col("v"), F.col("depth") == F.col("u") + 1
    words = F.when(F.col("sums").isNotNull(), F.element_at("sums", F.greatest(F.col("u"), F.lit(0)).cast("int") + 1))
    depths = F.transform(F.sequence(F.col("u") + 1, F.col("v")), lambda d: F.struct(d.alias("depth"), F.when(F.col("sums").isNotNull(), F.element_at("sums", F.greatest(d, F.lit(1)).cast("int")) - words).otherwise(0).alias("above")))
    each = nodes.withColumn("at", F.explode(depths)).select("*", "at.depth", "at.above")
    members = F.col("hi") - F.col("lo")
    return each.select(
        F.col("conv").alias("conv_id"), "depth", F.when(top, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), members.alias("n_convs"),
        F.when(deepest, F.col("children")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (members - 1) * F.col("above")).alias("saved_tokens"), F.when(deepest & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """trie() of the rebuilt conversations.

    Nulls: rows without a conv_id take no part; a null turn goes first, null roles and texts are empty. Repeated rows are turns each;
    turns of one number are ordered by role, the text's first letters and its digest. Long texts are read whole, as digests and word counts; the digests and
    word counts of one conversation are one row, whatever its length. Other columns may have any names. An empty table gives no rows.
    """
    return trie(rebuilt(conversations), rows)
