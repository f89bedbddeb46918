"""N-gram Jaccard join: a MinHash LSH forest proposes, exact set comparison decides.

1. Texts become sets of hashed word n-grams; equal sets are one node from here on (exact copies never make pairs).
2. A node's signature is a label of DEEPEST MinHash values (a byte each) for every tree. A tree's labels are sorted within their
   shortest prefix that will ever be asked for; neighbours' common prefixes say how deep each label is matched, and
   labels matched nowhere leave.
3. From the deepest level up, the prefixes asked for get shorter. At a level, the labels with equal prefixes are a trie node; only
   trie nodes whose members don't all hang together already are looked at, so a large group of near copies is found deep
   down and skipped further up. In such a trie node all pairs of signatures are compared in tiles, in blocks where it is large, and the members
   whose estimated similarity may reach the threshold are tied together. The level at which a pair just at the threshold is met by some
   tree with the target probability is the last one.
4. Tied members form candidate groups. Their texts meet in blocks of bounded size, each pair of blocks is one task's work, and in it
   all pairs are compared exactly, as products of 0/1 matrices over the n-grams that at least two members share. A task gives
   back sums per node (how many links) and who hangs together, never the pairs.
5. Components of the verified links are the classes.

N-grams are 64-bit hashes with a random factor per place, so two different ones are taken for one with a probability of some 2**-60.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.llm.common import among, in_small_batches, ranges, store
from affinade.llm.components import components
from affinade.llm.hashing import WIDE, mix, of_runs
from affinade.llm.word_codec import slices

WORDS = 5
TREES, DEEPEST, STEP, TARGET = 40, 10, 2, 0.99999
DEVIATIONS = 6  # standard deviations that a pair's estimate may lie under the threshold
LABELS = 2_000_000  # in a range of the sorted tries
MEMBERS = 4096  # of a block of a trie node
BLOCK = 1_000_000  # n-grams in a block of a candidate group at most
FINER = 200  # a group of up to BLOCK / FINER n-grams is one block; larger ones make about FINER / 2 tasks
TILE, COLUMNS = 512, 8192  # of the matrix products


def shortest(threshold: float, trees: int = TREES, deepest: int = DEEPEST, target: float = TARGET) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target probability."""
    for depth in range(deepest, max(1, deepest - 7), -1):  # what is left of a label then fits a long
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    return max(1, deepest - 7)


def least_estimate(threshold: float, values: int) -> int:
    """Equal bytes that two signatures need at least for a pair to be looked at exactly; chance equality is in it."""
    p = threshold + (1 - threshold) / 256
    return int(values * p - DEVIATIONS * (values * p * (1 - p)) ** 0.5)


@functools.cache
def constants() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte (0 for the space) and odd multipliers for the words of an n-gram, by rule."""
    rng = np.random.default_rng(11)
    of_byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * WIDE(2) + WIDE(1)
    of_byte[32] = 0
    return of_byte, rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * WIDE(2) + WIDE(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's sorted set of 64-bit hashes of WORDS consecutive words, lower case, split at white space.

    A text of fewer words, but not none, has one: all its words; a text without words has the empty set.
    """
    norm = [" ".join((t or "").lower().split()) for t in texts]
    out = [np.zeros(0, np.uint64)] * len(texts)
    rows = [i for i, t in enumerate(norm) if t]
    if not rows:
        return out
    raw = np.frombuffer("".join(f"{norm[i]} " for i in rows).encode(), np.uint8)
    of_byte, of_word = constants()
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = of_runs(raw, of_byte, starts, ends)
    n_words = np.array([norm[i].count(" ") + 1 for i in rows])
    first = np.concatenate([[0], np.cumsum(n_words)])
    n = max(0, len(h) - WORDS + 1)
    g = np.zeros(n, np.uint64)
    for k in range(WORDS):
        g += h[k : k + n] * of_word[k]
    g = mix(g)
    for j, i in enumerate(rows):
        a, b = first[j], first[j + 1]
        if b - a >= WORDS:
            s = np.sort(g[a : b - WORDS + 1])
            out[i] = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            out[i] = mix((h[a:b] * of_word[: b - a]).sum(dtype=np.uint64, keepdims=True) + WIDE(b - a))
    return out


@functools.cache
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures_of(sets: list[np.ndarray], trees: int) -> np.ndarray:
    """For each non-empty set its labels, tree after tree: a byte of each MinHash value."""
    a, b = permutations(trees * DEEPEST)
    x = (np.concatenate(sets) >> WIDE(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), trees * DEEPEST), np.uint8)
    for v in range(trees * DEEPEST):
        least = np.minimum.reduceat(x * a[v] + b[v], starts)
        out[:, v] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def signatures(rows: DataFrame, trees: int) -> DataFrame:
    """``_row``, doc_id, s0 and s1 (the set's digest), ``n`` (its size), ``sig`` (its labels; null for an empty set)."""
    kind = rows.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            digests, sizes, sigs = [], [], []
            for a, b in slices([len(t or "") for t in texts]):
                sets = shingle_sets(texts[a:b])
                full = [s for s in sets if len(s)]
                made = iter(signatures_of(full, trees)) if full else iter(())
                for s in sets:
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sigs.append(next(made).tobytes() if len(s) else None)
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["_row", "doc_id", "s0", "s1", "n", "sig"])

    return in_small_batches(rows).select("_row", "doc_id", "text").mapInArrow(run, f"_row long, doc_id {kind.simpleString()}, s0 long, s1 long, n long, sig binary")


def tries(nodes: DataFrame, trees: int, last: int) -> DataFrame:
    """The sorted tries' labels that any other one matches: node, trunk (tree and shortest prefix), rest (of the label), depth (matched).

    Labels are range-sorted, so a trunk that very many share is cut; what lies at a range's border counts as matched.
    """
    more = DEEPEST - last

    def labels(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, trees, DEEPEST).astype(np.uint64)
            join = lambda part: sum((part[:, :, k] << WIDE(8 * (part.shape[2] - 1 - k)) for k in range(part.shape[2])), np.zeros(x.shape[:2], np.uint64))
            trunk = mix(mix(join(x[:, :, :last])) + np.arange(trees, dtype=np.uint64))
            node = np.repeat(batch.column(0).to_numpy(), trees)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(trunk.ravel().view(np.int64)), pa.array(join(x[:, :, last:]).ravel().view(np.int64))], ["node", "trunk", "rest"])

    def depths(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            node, trunk, rest = (batch.column(i).to_numpy() for i in range(3))
            if held is not None:
                node, trunk, rest = (np.concatenate([h, c]) for h, c in zip(held[:3], (node, trunk, rest)))
            same, shared = trunk[1:] == trunk[:-1], np.full(len(node) - 1, last)
            for k in range(1, more + 1):
                shared += (rest[1:] >> 8 * (more - k)) == (rest[:-1] >> 8 * (more - k))
            shared = np.where(same, shared, 0)
            deep = np.maximum(np.concatenate([[DEEPEST if held is None else held[3]], shared]), np.concatenate([shared, [0]]))
            held = node[-1:], trunk[-1:], rest[-1:], int(shared[-1]) if len(shared) else deep[-1]
            yield matched(node[:-1], trunk[:-1], rest[:-1], deep[:-1])
        if held is not None:
            yield matched(*held[:3], np.array([DEEPEST]))

    def matched(node, trunk, rest, deep):
        hit = deep > 0
        return pa.RecordBatch.from_arrays([pa.array(c[hit].astype(np.int64)) for c in (node, trunk, rest, deep)], ["node", "trunk", "rest", "depth"])

    narrow = store(nodes.mapInArrow(labels, "node long, trunk long, rest long"), "labels")
    ordered = narrow.repartitionByRange(ranges(narrow, LABELS), "trunk", "rest", "node").sortWithinPartitions("trunk", "rest", "node")
    return ordered.mapInArrow(depths, "node long, trunk long, rest long, depth long")


def ties(members: DataFrame, least: int) -> DataFrame:
    """Roots (a, b) of members of one trie node whose signatures have at least so many equal bytes, and which hang together by them.

    ``members``: key, i, j (a trie node and two of its blocks), block, root, sig. A task holds two blocks.
    """

    def finish(key, group):
        block, root, sig = (list(c) for c in zip(*group))
        block, root, x = np.array(block), np.array(root), np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
        forest, across, n = Forest(len(root)), key[1] != key[2], len(root)
        _, first = np.unique(root, return_index=True)
        for i, of in enumerate(first[np.searchsorted(root[first], root)].tolist()):
            forest.join(i, of)
        left = np.arange(n)
        while len(left) > 1:  # what is like the first one left needs no pairs of its own
            like = (x[left[1:]] == x[left[0]]).sum(1) >= least
            for i in left[1:][like].tolist():
                forest.join(int(left[0]), i)
            left = left[1:][~like]
        columns = np.ascontiguousarray(x.T)
        tiles = [(a, min(a + TILE, n)) for a in range(0, n, TILE)]
        for p, s in enumerate(tiles):
            for t in tiles[p:]:
                number = np.array([forest.root(i) for i in (*range(*s), *range(*t))])
                wanted = number[: s[1] - s[0], None] != number[None, s[1] - s[0] :]
                if across:
                    wanted &= block[s[0] : s[1], None] != block[None, t[0] : t[1]]
                if wanted.any():
                    equal = np.zeros(wanted.shape, np.uint16)
                    for v in columns:
                        equal += v[s[0] : s[1], None] == v[None, t[0] : t[1]]
                    tie((equal >= least) & wanted, s[0], t[0], forest)
        at, least_root = [forest.root(i) for i in range(len(root))], {}
        for i, r in zip(root.tolist(), at):
            least_root[r] = min(i, least_root.get(r, i))
        return {(i, least_root[r]) for i, r in zip(root.tolist(), at) if i != least_root[r]}

    def run(batches):
        key, group, done = None, [], []
        for batch in batches:
            for k, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, i, j) != key:
                    if len(group) > 1:
                        done += finish(key, group)
                    key, group = (k, i, j), []
                group.append(rest)
        if len(group) > 1:
            done += finish(key, group)
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(2)], ["a", "b"])

    tasks = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return tasks.select("key", "i", "j", "block", "root", "sig").mapInArrow(run, "a long, b long")


def candidates(nodes: DataFrame, threshold: float, trees: int) -> DataFrame:
    """``node``, ``root`` of all nodes (node, sig) in a candidate group that aren't its root, level by level up the tries."""
    last = shortest(threshold, trees)
    labels = store(tries(nodes, trees, last), "tries")
    edges, roots = None, None
    for depth in (*range(DEEPEST, last, -STEP), last):
        here = labels.where(F.col("depth") >= depth).select("node", F.xxhash64("trunk", F.shiftright("rest", 8 * (DEEPEST - depth))).alias("key"))
        here = here.withColumn("root", F.col("node")) if roots is None else here.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        here = store(here, "level")
        open_ = here.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("m")).where("a <> b")
        blocks = F.ceil(F.col("m") / MEMBERS).cast("int")
        asked = store(here.join(open_.select("key", blocks.alias("blocks")), "key").select("node", "key", "root", "blocks"), "asked")
        members = asked.join(among(nodes, "node", asked), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "sig")
        found = store(ties(members, least_estimate(threshold, trees * DEEPEST)).distinct(), "ties")
        edges = found if edges is None else edges.union(found)
        # members of one group mostly share their smallest neighbour: enough to know what needs no look further up
        roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return components(edges)


class Forest:
    """Union-find over places of a list; the root is the least place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def compare(sets: list[np.ndarray], block: list[int], copies: list[int], threshold: float, across: bool) -> tuple[np.ndarray, list[int]]:
    """All pairs of one task, exactly: each member's number of linked documents, and its root among linked ones.

    With ``across`` only pairs of members of different blocks count.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    kind, many = np.array(block)[order], np.array(copies)[order]
    every, column, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(order)), sizes)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    links, forest = np.zeros(len(order), np.int64), Forest(len(order))
    tiles = [(a, min(a + TILE, len(order))) for a in range(0, len(order), TILE)]
    cut = {t: slice(*np.searchsorted(row, t)) for t in tiles}
    for p, s in enumerate(tiles):
        for t in tiles[p:]:
            if sizes[t[0]] * threshold > sizes[s[1] - 1]:
                break  # larger sets only from here: too large for any link
            both = np.zeros((s[1] - s[0], t[1] - t[0]), np.float32)
            cs, ct = column[cut[s]], column[cut[t]]
            common = np.intersect1d(cs, ct) if s != t else np.unique(cs)
            for at in range(0, len(common), COLUMNS):
                part = common[at : at + COLUMNS]
                one, two = (spread(row[cut[x]] - x[0], column[cut[x]], part, x[1] - x[0]) for x in (s, t))
                both += one @ two.T
            union = sizes[s[0] : s[1], None] + sizes[None, t[0] : t[1]] - both
            link = both / np.maximum(union, 1).astype(np.float64) >= threshold
            if s == t:
                link &= ~np.eye(len(link), dtype=bool)
            if across:
                link &= kind[s[0] : s[1], None] != kind[None, t[0] : t[1]]
            if not link.any():
                continue
            links[s[0] : s[1]] += link @ many[t[0] : t[1]]
            if s != t:
                links[t[0] : t[1]] += link.T @ many[s[0] : s[1]]
            tie(link, s[0], t[0], forest)
    out_links, out_root = np.empty_like(links), [0] * len(order)
    for place, i in enumerate(order.tolist()):
        out_links[i] = links[place]
        out_root[i] = int(order[forest.root(place)])
    return out_links, out_root


def spread(row: np.ndarray, column: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """The 0/1 matrix of rows over the columns of ``part``."""
    at = np.minimum(np.searchsorted(part, column), len(part) - 1)
    hit = part[at] == column
    out = np.zeros((n, len(part)), np.float32)
    out[row[hit], at[hit]] = 1
    return out


def tie(link: np.ndarray, a: int, b: int, forest: Forest) -> None:
    """Join what hangs together in a tile of links, by the least label around until nothing changes."""
    if not link.any():
        return
    rows, columns = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    link = link[np.ix_(rows, columns)]
    of_row, of_column = rows + a, columns + b
    while True:
        new_row = np.minimum(of_row, np.where(link, of_column, 1 << 60).min(1))
        new_column = np.minimum(of_column, np.where(link, new_row[:, None], 1 << 60).min(0))
        if (new_row == of_row).all() and (new_column == of_column).all():
            break
        of_row, of_column = new_row, new_column
    for place, label in zip([*(rows + a), *(columns + b)], [*of_row, *of_column]):
        if place != label:
            forest.join(int(place), int(label))


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """Per member and task: node, links (documents it is linked with there), lead (a node it hangs together with).

    ``members``: root, i, j (a task's component and two blocks), node, block, copies, text.
    """

    def finish(key, group):
        node, block, copies, text = (list(c) for c in zip(*group))
        links, root = compare(shingle_sets(text), block, copies, threshold, key[1] != key[2])
        lead = {}
        for n, r in zip(node, root):
            lead[r] = min(n, lead.get(r, n))
        return [(n, int(k), lead[r]) for n, k, r in zip(node, links, root) if k]

    def run(batches):
        key, group, done = None, [], []
        for batch in batches:
            for root, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != key:
                    if len(group) > 1:
                        done += finish(key, group)
                    key, group = (root, i, j), []
                group.append(rest)
            if len(done) > 10_000:
                yield made(done)
                done = []
        if len(group) > 1:
            done += finish(key, group)
        yield made(done)

    def made(done):
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(3)], ["node", "links", "lead"])

    tasks = members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return tasks.select("root", "i", "j", "node", "block", "copies", "text").mapInArrow(run, "node long, links long, lead long")


def classes(docs: DataFrame, threshold: float = 0.8, trees: int = TREES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The input with ``_row``, and per row: _row, doc_id, class_row, n_links.

    Rows are linked when their n-gram sets are not empty and have a Jaccard similarity of ``threshold`` or more; classes are
    the components of links; ``n_links`` counts the other documents linked with one, copies included. Null, empty and blank
    texts have no links; very long texts are compared whole; repeated rows and null ids are rows like any other; other
    columns may have any name but ``_row``; an empty table gives an empty result.
    """
    rows = store(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    sigs = store(signatures(rows, trees), "signatures")
    nodes = store(sigs.where("n > 0").groupBy("s0", "s1").agg(F.min("_row").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    found = candidates(among(sigs.where("n > 0").select(F.col("_row").alias("node"), "sig"), "node", nodes), threshold, trees)
    inside = store(found.union(found.select("root", "root").distinct()).join(sigs.select(F.col("_row").alias("node"), "n"), "node"), "members")

    sizes = inside.groupBy("root").agg(F.sum("n").alias("total"))
    # at most ``block`` n-grams each; smaller ones while a group has few, so that its pairs of blocks fill many tasks
    number = F.greatest(F.ceil(F.col("total") / block), F.ceil(F.sqrt(F.col("total") * FINER / block)))
    blocks = sizes.select("root", number.cast("int").alias("blocks"))
    dealt = inside.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = among(rows.select(F.col("_row").alias("node"), "text"), "node", inside)
    members = pairs.select("root", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    members = members.join(nodes.select("node", "copies"), "node").join(texts, "node")
    parts = store(verify(members, threshold), "links")

    roots = components(parts.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = nodes.join(links, "node", "left").join(roots, "node", "left").select("s0", "s1", F.coalesce("root", "node").alias("class_row"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sigs.select("_row", "doc_id", "s0", "s1", "n").join(of_node, ["s0", "s1"], "left")
    linked = F.col("n") > 0
    out = out.select("_row", "doc_id", F.when(linked, F.col("class_row")).otherwise(F.col("_row")).alias("class_row"), F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
    return rows, store(out, "classes")


def firsts(found: DataFrame) -> DataFrame:
    """Per class its first row, by doc_id (nulls last) and place: class_row, class_id, first_row."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    out = found.groupBy("class_row").agg(first.alias("f")).select("class_row", F.col("f.doc_id").alias("class_id"), F.col("f._row").alias("first_row"))
    return store(out, "firsts")  # a join with a stored table can be split where one class is very large


def join_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, class_id (the class's least doc_id), n_links, stays (it is its class's first)."""
    _, found = classes(docs.select("doc_id", "text"), threshold)
    return found.join(firsts(found), "class_row").select("doc_id", "class_id", "n_links", (F.col("_row") == F.col("first_row")).alias("stays"))


def deduplicate(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The input's rows and columns, of each class only the first.

    Null, empty and blank texts are classes of their own and stay, as do all columns, whatever their names; of repeated rows one
    stays; texts of any length are compared whole; an empty table gives an empty result.
    """
    own = {c: c if c in ("doc_id", "text") else f"_own{i}" for i, c in enumerate(docs.columns)}
    rows, found = classes(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())), threshold)
    stay = among(rows, "_row", firsts(found).select(F.col("first_row").alias("_row")))
    return stay.select(*(F.col(n).alias(c) for c, n in own.items()))
