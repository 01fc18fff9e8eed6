"""N-gram Jaccard join over prefix trees.

Each text becomes the set of its distinct n-word shingles, as 64-bit hashes in
one global order (ascending). Texts with equal sets form a class, and all later
work is on classes. Links are found in two steps, neither of which loses one:

1. Grouping by leading paths. For a similarity of t percent the sets differ in
   at most e = floor((100 - t) / (100 + t) * (|x| + |y|)) elements. The hash
   range is cut into more than e equal parts, each a run of the global order,
   and a prefix tree is thought of for each part, with that part's run first.
   By the pigeonhole principle two similar sets agree on a whole run, so they
   share the leading path of that tree; and they do so among the e + 1 longest
   runs of either, so the short ones, on which unlike sets agree by chance, are
   not used. Only the hashes of paths are dealt out. Since e depends on the
   sizes, sizes fall into classes (``GROWTH`` apart) and a small set also takes
   the cut of the class below, if a partner can be there.
   Classes that share a path are joined to the path's smallest member, and the
   components of that graph are the blocks: no link leaves a block.
2. A prefix tree per block. Sets are inserted in the global order, each after
   it has probed the tree: the walk shares partial overlaps along common paths
   and leaves a subtree as soon as the remaining lengths cannot reach the
   threshold. A subtree whose sets are all in the probe's component already is
   left too, so a group of many copies costs no square of its size.

A passage that many unlike texts quote makes them agree on some run, so blocks
chain up as a table grows. A block of more than ``BLOCK`` bytes of text is
therefore parted anew: its sets are ordered by how common their shingles are in
the large blocks, rarest first, and since similar sets share an element among
their first |x| - ceil(t |x|) + 1 in any one order, only the classes that do
stay together. Common passages stand last there and connect nothing. The counts
are of hash slots, and a poor order would cost time, never a link.

A block that is still larger is cut by set size into ranges whose
ends are as far apart as similar sets can be, so only a range and the next one
meet; a range that is still larger is cut into sub-blocks. Each pair of
sub-blocks is one group, dealt by a key of its own, and holds two sub-blocks (or
two documents) at most. Duplicate paths inside a task are dropped before they
are dealt.

Defined results: a null text, or one without words, has an empty set and is
linked with nothing, not even its like; fewer than n words are one shingle; a
null id links but is never a component's id; repeated rows keep a row each.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import wordhash
from quillgraph.llm.common import release, table, written
from quillgraph.llm.components import components
from quillgraph.operators.cut import marked

#: Size classes are this factor apart; text bytes of a sub-block; rows of paths that a task holds for dropping duplicates.
GROWTH, BLOCK, HELD = 1.5, 1_000_000, 500_000
#: Parts of a cut over the elements in which sets can differ; elements of a long run that a probe compares first.
SPARE, STRETCH = 1.3, 32
#: Bits of a slot in which shingles of large blocks are counted.
SLOT = 18


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for first, end in wordhash.chunked(raw):
        hashes, counts, _, _ = wordhash.words(raw[first:end], lower=True)
        made = wordhash.runs(hashes, n, salt=n)
        at = 0
        for c in counts.tolist():
            if c >= n:
                yield np.unique(made[at : at + c - n + 1])
            else:
                yield wordhash.runs(hashes[at : at + c], c, salt=c) if c else np.zeros(0, np.uint64)
            at += c


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def size_class(size: int) -> int:
    """Number of the class of a set size: class k holds bounds(k) to bounds(k + 1)."""
    k = 0
    while bound(k + 1) <= size:
        k += 1
    return k


def bound(k: int) -> int:
    return int(np.ceil(GROWTH**k))


def differing(size: int, percent: int) -> int:
    """Elements in which a set of this size and any similar one differ at most."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


def cuts(size: int, percent: int) -> list[tuple[int, int]]:
    """(class, parts) of the cuts that a set of this size takes part in: its own, and the one below if it can have a partner there.

    The cut of class k serves pairs whose smaller set is in class k.
    """
    own = size_class(size)
    classes = [own, own - 1] if own and size * percent <= 100 * (bound(own) - 1) else [own]
    return [(k, int(SPARE * differing(bound(k + 1) - 1, percent)) + 1) for k in classes]


def paths(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the leading paths of a set: per cut, of as many of its longest runs as a similar set could differ in, and one more.

    Runs on which two sets agree are as long in both and stand in the same
    order, and before the first of them stand at most the runs in which the
    sets differ; so that one is among the chosen runs of both.
    """
    out = []
    mixed = np.concatenate([[np.uint64(0)], np.cumsum(wordhash.mix(s, 7), dtype=np.uint64)])
    take = differing(len(s), percent) + 1
    for k, parts in cuts(len(s), percent):
        edges = np.searchsorted(s, _edges(parts))
        sizes = np.diff(np.append(edges, len(s)))
        longest = np.argsort(-sizes, kind="stable")[:take]
        run = mixed[edges[longest] + sizes[longest]] - mixed[edges[longest]]
        out.append(wordhash.mix(run + wordhash.mix(longest.astype(np.uint64) + np.uint64(k << 32), 11), 13))
    return np.concatenate(out)


_edge_cache: dict[int, np.ndarray] = {}


def _edges(parts: int) -> np.ndarray:
    """Where each part of the hash range begins."""
    if parts not in _edge_cache:
        _edge_cache[parts] = np.array([i * (1 << 64) // parts for i in range(parts)], dtype=np.uint64)
    return _edge_cache[parts]


class Node:
    __slots__ = ("children", "depth", "end", "high", "low", "one", "run")

    def __init__(self, run: list[int], depth: int, low: int, high: int):
        self.run, self.depth, self.low, self.high = run, depth, low, high  # depth: elements down to the end of the run
        self.children: dict[int, Node] = {}
        self.end = -1  # the set that ends here
        self.one = -1  # a set below, if all sets below are in one component; -2: in several


class PrefixTree:
    """Sets in a path-compressed trie; probing links a set to the components it is similar to, or (``every``) to each set, which ``pairs`` lists."""

    def __init__(self, percent: int, every: bool = False):
        self.percent, self.every = percent, every
        self.pairs: list[tuple[int, int]] = []
        self.parent: list[int] = []
        self.root = Node([], 0, 1 << 60, 0)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def add(self, elements: np.ndarray) -> int:
        """Of sorted distinct elements; returns the number of the set."""
        me, x = len(self.parent), elements.tolist()
        self.parent.append(me)
        self._probe(x, me)
        self._insert(x, me)
        return me

    def _probe(self, x: list[int], me: int) -> None:
        size, find, percent = len(x), self.find, self.percent
        own = set(x)
        stack: list[tuple[Node, int, bool]] = [(self.root, 0, False)]
        while stack:
            node, shared, done = stack.pop()
            if done:
                self._settle(node)
                continue
            if not self.every and node.one >= 0 and find(node.one) == find(me):
                continue
            run, at, beyond, step = node.run, 0, 0, STRETCH
            depth = node.depth - len(run)
            possible = True
            while at < len(run) and possible:
                some = run[at : at + step] if at or len(run) > step else run
                shared += len(own.intersection(some))
                at, step, depth = at + len(some), step * 2, depth + len(some)
                beyond = bisect_right(x, some[-1])
                # can a set below reach the threshold, this far down? At best its length is what makes the most of what is left of both.
                left = size - beyond
                best = min(max(depth + left, node.low), node.high)
                possible = (100 + percent) * (shared + min(left, best - depth)) >= percent * (size + best)
            if not possible:
                continue
            if node.end >= 0 and 100 * shared >= percent * (size + node.depth - shared):
                self._join(me, node.end)
                self.pairs.append((node.end, me))
            if node.one == -2 and not self.every:
                stack.append((node, 0, True))
            if node.children:
                mine = find(me)
                # the child on the probe's own path is walked first
                first = node.children.get(x[beyond]) if beyond < size else None
                stack += [(c, shared, False) for c in node.children.values() if c is not first and (self.every or c.one < 0 or find(c.one) != mine)]
                if first is not None:
                    stack.append((first, shared, False))

    def _settle(self, node: Node) -> None:
        """Has everything below come into one component?"""
        below = [c.one for c in node.children.values()] + [node.end] * (node.end >= 0)
        if -2 not in below and len({self.find(i) for i in below}) == 1:
            node.one = below[0]

    def _insert(self, x: list[int], me: int) -> None:
        node, at = self.root, 0
        while True:
            node.low, node.high = min(node.low, len(x)), max(node.high, len(x))
            if node.one == -1:
                node.one = me
            elif node.one >= 0 and self.find(node.one) != self.find(me):
                node.one = -2
            if at == len(x):
                node.end = me
                return
            key = x[at]
            child = node.children.get(key)
            if child is None:
                leaf = Node(x[at:], len(x), len(x), len(x))
                leaf.end = leaf.one = me
                node.children[key] = leaf
                return
            m, same = min(len(child.run), len(x) - at), 1
            while same < m and child.run[same] == x[at + same]:
                same += 1
            if same < len(child.run):
                upper = Node(child.run[:same], child.depth - len(child.run) + same, child.low, child.high)
                upper.one = child.one
                upper.children[child.run[same]] = child
                child.run = child.run[same:]
                node.children[key] = upper
                child = upper
            node, at = child, at + same


def classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, size, n_shingles, cid) per row of ``docs`` (doc_id, text): ``size`` in bytes; ``cid`` names the set and is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            sizes, ids = [], []
            for s in shingle_sets(b.column(3).to_pylist(), n):
                sizes.append(len(s))
                ids.append(set_digest(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "th", "size", "n_shingles", "cid"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, size long, n_shingles long, cid binary")


def leading_paths(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(path, cid): what each class is dealt by, once per class and stretch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[bytes] = set()
        for b in batches:
            for s in shingle_sets(b.column(0).to_pylist(), n):
                if not len(s) or (cid := set_digest(s)) in seen:
                    continue
                if len(seen) >= HELD:
                    seen.clear()
                seen.add(cid)
                p = np.unique(paths(s, percent)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array([cid], pa.binary()).take(pa.array(np.zeros(len(p), np.int32)))], ["path", "cid"])

    return docs.select("text").mapInArrow(_batched(run), "path long, cid binary")


def _batched(run, rows: int = 50_000):
    """Joins small output batches."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return whole


def blocks(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(v, label): the classes that share a path with another, and their block."""
    group = Window.partitionBy("path")
    edges = leading_paths(docs, n, percent).withColumn("head", F.min("cid").over(group)).where("head <> cid")
    return components(edges.select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct())


def links(docs: DataFrame, known: DataFrame, n: int, percent: int, every: bool = False) -> DataFrame:
    """(a, b): classes that are linked, enough of them to connect each component, or ``every`` pair (some several times). ``known`` is ``classes(docs)``."""
    member = blocks(docs, n, percent).select(F.col("v").alias("cid"), F.col("label").alias("block"))
    heads = known.where("cid IS NOT NULL").groupBy("cid").agg(F.min(F.struct("doc_id", "th", "size", "n_shingles")).alias("head"))
    chosen = written(member.join(heads, "cid").select("cid", "block", "head.*", _range("head.n_shingles", percent).alias("c")), "members")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    key = F.xxhash64("doc_id", "th")
    rows = rows.where(marked(chosen.select(key.alias("hash")), key))  # texts of others need not be dealt
    # always by a shuffle, so that the plan is the same at every size
    large = large_blocks(chosen)
    of = chosen.join(large, chosen["block"] == large["large"], "left").select("cid", F.col("doc_id").alias("head_id"), F.col("th").alias("head_th"), F.when(F.col("large").isNotNull(), F.xxhash64("block")).alias("salt"))
    texts = written(rows.join(of.hint("merge"), rows["doc_id"].eqNullSafe(of["head_id"]) & (rows["th"] == of["head_th"])).select("cid", "salt", "text"), "member-texts")
    dealt = written(_dealt(refined(texts, chosen, large, n, percent)).withColumnRenamed("cid", "of"), "dealt")
    texts = texts.join(dealt.hint("merge"), texts["cid"] == dealt["of"]).select("block", "low", "high", "cid", "text")

    def join(group: pa.Table) -> pa.Table:
        tree = PrefixTree(percent, every)
        ids = group.column("cid").to_pylist()
        first: dict[bytes, int] = {}
        keep = [i for i, c in enumerate(ids) if first.setdefault(c, i) == i]
        texts = group.column("text")
        for s in shingle_sets([texts[i].as_py() for i in keep], n):
            tree.add(s)
        linked = tree.pairs if every else [(tree.find(i), i) for i in range(len(keep)) if tree.find(i) != i]
        found = [(ids[keep[i]], ids[keep[j]]) for i, j in linked]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return texts.groupBy("block", "low", "high").applyInArrow(join, "a binary, b binary")


def _slots(s: np.ndarray) -> np.ndarray:
    return wordhash.mix(s, 23) >> np.uint64(64 - SLOT)


def prefix(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first elements of a set, rarest first by the counts of their slots: any similar set has one of them among its own."""
    by = np.lexsort((s, common[_slots(s)]))
    return s[by[: len(s) + 1 - -(-len(s) * percent // 100)]]


def large_blocks(chosen: DataFrame) -> DataFrame:
    """(large): blocks of more than ``BLOCK`` bytes of text."""
    return written(chosen.groupBy("block").agg(F.sum("size").alias("whole")).where(F.col("whole") > BLOCK).select(F.col("block").alias("large")), "large-blocks")


def refined(texts: DataFrame, chosen: DataFrame, large: DataFrame, n: int, percent: int) -> DataFrame:
    """``chosen`` (cid, block, size, ...) with large blocks parted by shared rare shingles; a class that shares none there is linked with nothing and goes.

    ``texts`` is (cid, salt, text), with a salt by block where the block is large: texts are neither shuffled nor written again for this.
    """
    if large.isEmpty():
        return chosen
    inner = written(chosen.join(large, chosen["block"] == large["large"], "left_semi"), "large-members")
    texts = texts.where("salt IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(1 << SLOT, np.int64)
        for b in batches:
            for s in shingle_sets(b.column(0).to_pylist(), n):
                np.add.at(total, _slots(s), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    counted = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row per slot
    common = np.zeros(1 << SLOT, np.int64)
    common[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shipped = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            of, salts = b.column(0), b.column(1).to_numpy().view(np.uint64)
            for i, s in enumerate(shingle_sets(b.column(2).to_pylist(), n)):
                p = wordhash.mix(prefix(s, shipped.value, percent) ^ salts[i], 29).view(np.int64)  # no path is shared by two blocks
                yield pa.RecordBatch.from_arrays([pa.array(p), of.take(pa.array(np.full(len(p), i, np.int32)))], ["path", "cid"])

    rows = written(texts.mapInArrow(_batched(run), "path long, cid binary"), "prefixes")
    # by partial aggregates and a join, which can be split, where one path has many rows
    first = rows.groupBy(F.col("path").alias("at")).agg(F.min("cid").alias("head"), F.max("cid").alias("last")).where("head <> last").select("at", "head")
    edges = rows.join(first.hint("merge"), rows["path"] == first["at"]).where("head <> cid").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    parted = components(edges).select(F.col("v").alias("cid"), F.col("label").alias("block"))
    again = inner.drop("block").join(parted, "cid").select(*chosen.columns)
    return written(chosen.join(large, chosen["block"] == large["large"], "left_anti").unionByName(again), "members")


def _range(size: str, percent: int) -> Column:
    """Number of the range of set sizes; sets two ranges apart are too unequal to be similar."""
    return F.floor(F.ln(F.col(size)) / (math.log(100 / percent) * 1.001)).cast("int")


def _dealt(chosen: DataFrame) -> DataFrame:
    """``chosen`` (block, c, cid, size, ...) x the pairs (low, high) of sub-blocks that its classes take part in.

    A sub-block is named by its range and its number there. A pair also finds
    the links inside both, so a sub-block is paired with itself only where it
    has no other partner.
    """
    ranges = chosen.groupBy("block", "c").agg(F.sum("size").alias("size"))
    cut = ranges.groupBy("block").agg(F.sum("size").alias("whole"), F.map_from_entries(F.collect_list(F.struct("c", F.ceil(F.col("size") / BLOCK).cast("int").alias("k")))).alias("parts"))
    cut = written(cut.where(F.col("whole") > BLOCK).select(F.col("block").alias("large"), "parts"), "large-blocks")  # a row has a range per factor of 100 / percent in the set sizes
    rows = chosen.join(cut, chosen["block"] == cut["large"], "left")
    parts = lambda c: F.greatest(F.coalesce(F.try_element_at("parts", c), F.lit(0)), F.lit(0))
    rows = rows.withColumns({"k": parts(F.col("c")), "above": parts(F.col("c") + 1), "below": parts(F.col("c") - 1)}).withColumn("i", F.pmod(F.xxhash64("cid"), F.greatest("k", F.lit(1))).cast("int"))
    name = lambda c, i: F.struct(c.alias("c"), i.alias("i"))
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda j: j < n)
    me = name(F.col("c"), F.col("i"))
    own = F.transform(F.filter(upto(F.col("k")), lambda j: (j != F.col("i")) | ((F.col("k") == 1) & (F.col("above") + F.col("below") == 0))), lambda j: pair(name(F.col("c"), F.least("i", j)), name(F.col("c"), F.greatest("i", j))))
    up = F.transform(upto(F.col("above")), lambda j: pair(me, name(F.col("c") + 1, j)))
    down = F.transform(upto(F.col("below")), lambda j: pair(name(F.col("c") - 1, j), me))
    whole = F.array(pair(name(F.lit(-1), F.lit(0)), name(F.lit(-1), F.lit(0))))
    return rows.withColumn("p", F.explode(F.when(F.col("large").isNull(), whole).otherwise(F.concat(own, up, down)))).select("block", "cid", "p.low", "p.high")


def similar_groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, th, n_shingles, group, component_id (smallest id of the linked documents, itself included).

    ``th`` is the hash of the text; ``group`` names the component and is null for an empty set.
    """
    docs = docs.select("doc_id", "text")
    known = written(classes(docs, n), "classes")
    labels = components(links(docs, known, n, percent)).select(F.col("v").alias("cid"), "label")
    # by class, not by row; written, so that a large class or component is split by the joins that follow
    least = known.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("least"))
    least = written(least.join(labels, "cid", "left").select("cid", F.coalesce("label", "cid").alias("group"), "least"), "groups")
    smallest = written(least.groupBy("group").agg(F.min("least").alias("component")), "smallest")
    named = written(least.join(smallest, "group").select(F.col("cid").alias("of"), "group", "component"), "named")
    out = known.join(named, known["cid"] == named["of"], "left")
    return out.select("doc_id", "th", "n_shingles", "group", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def link_counts(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, n_shingles, n_links (other rows whose sets are similar, those with equal sets among them).

    Every pair of similar classes is made for this, so unlike the components a
    group of m different near-copies costs m squared; copies of one set cost nothing.
    """
    docs = docs.select("doc_id", "text")
    known = written(classes(docs, n), "classes")
    sizes = written(known.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("rows")), "sizes")
    pairs = written(links(docs, known, n, percent, every=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, both["b"] == sizes["cid"]).groupBy("a").agg(F.sum("rows").alias("others"))
    per = written(sizes.join(others, sizes["cid"] == others["a"], "left").select(F.col("cid").alias("of"), (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links")), "link-counts")
    out = known.join(per, known["cid"] == per["of"], "left")
    return out.select("doc_id", "th", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest id (then text hash) stays, once; texts without words all stay."""
    rows = written(similar_groups(docs, n, percent).where("group IS NOT NULL").select("doc_id", "th", "group"), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")
    best = rows.groupBy("group").agg(F.min(rank).alias("best"))
    best = best.select(F.col("best.doc_id").alias("__id"), F.col("best.th").alias("__th"))
    best = written(best, "kept")
    # most texts stay where they are: only those that go, or are there twice, and what has a bit of theirs, are looked up
    per = rows.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    open_ = per.join(best.hint("merge"), per["doc_id"].eqNullSafe(best["__id"]) & (per["th"] == best["__th"]), "left").where("n > 1 OR __th IS NULL")
    open_ = written(open_.select(F.xxhash64("doc_id", "th").alias("hash")), "open")
    keyed = docs.withColumns({"__text": F.xxhash64("text"), "__none": ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")})
    keyed = keyed.withColumn("__open", marked(open_, F.xxhash64(F.col("doc_id").cast("long"), "__text")))
    asked = keyed.where("NOT __none AND __open")
    chosen = asked.join(best.hint("merge"), asked["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__th")))
    chosen = chosen.dropDuplicates(["__id", "__th"]).select(*(asked[c] for c in docs.columns))
    return chosen.unionByName(keyed.where("__none OR NOT __open").select(*docs.columns))


def op9_jaccard(spark, sf_dir) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)"""
