"""Substring deduplication by relative Lempel-Ziv parsing.

A window is ``WINDOW`` consecutive words. Every document is parsed into factors
relative to all documents with smaller ids: a factor is a run of its words
with the reference document that has the same run and the place there. Factors
of a window or more are the duplicate spans.

* Phrases. In each window the run of ``ANCHOR`` words with the least hash is
  its anchor (the leftmost of several). Consecutive windows with one anchor are
  a phrase. Equal windows have equal anchors wherever they stand, so a window
  can only be found under its own anchor.
* Reference blocks. No task holds all references; the index is dealt by
  anchor. A block has, for its share of the anchors, every phrase of every
  document with the place at which the smallest id has it. A phrase that a
  smaller id has is copied from there whole.
* Factors. A document's phrases overlap, so the copies of neighbouring ones are
  one factor as long as they go on at the next place of the same reference. A
  factor is extended greedily, and the next one begins where it ends.
* Boundaries. Where a repeat ends, a phrase differs from all earlier ones, yet
  single windows of it may still be repeats. If its anchor is known with other
  phrases, its windows and theirs (one copy of each phrase) are looked up one by
  one in the same way, which extends factors to their true ends.

Tasks first reduce what they deal: of equal phrases only the one with the
smallest id goes to the index, the others have their reference already. So a
passage that a third of all documents share is a row per task, not per
document. Tasks of the index read their rows in order and keep one of them.

Phrases are compared by two 64-bit hashes, of anchor and phrase, which combine
the 64-bit hashes of their words in different ways.

Defined results: a null text has no words; words are kept byte for byte; a null
id is neither a reference nor deduplicated; rows that share an id are one
document, so they never remove each other's words; fewer words than a window
are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import wordhash
from quillgraph.llm.common import partitions, table, written

WINDOW, ANCHOR = 13, 5
#: Rows that a task reduces together before it deals them out.
HELD = 2_000_000


def _leftmost_least(values: np.ndarray, wide: int) -> np.ndarray:
    """Where the least of each ``wide`` neighbours stands, the leftmost of equal ones."""
    least, at, step = values, np.arange(len(values)), 1
    while step < wide:
        by = min(step, wide - step)
        right = least[by:] < least[:-by]
        least, at, step = np.where(right, least[by:], least[:-by]), np.where(right, at[by:], at[:-by]), step + by
    return at


class Parsed:
    """The windows and phrases of some texts, all in word numbers of ``hashes``."""

    def __init__(self, raw: list[bytes]):
        hashes, self.counts, _, _ = wordhash.words(raw, lower=False)
        n = len(hashes)
        self.first = np.cumsum(self.counts) - self.counts
        doc = np.repeat(np.arange(len(raw)), self.counts)
        up, down = wordhash._power(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:n], dtype=np.uint64)])
        self._span = lambda a, b: wordhash.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64), 3)
        starts = np.arange(max(n - WINDOW + 1, 0))
        starts = starts[doc[starts] == doc[starts + WINDOW - 1]] if len(starts) else starts
        self.starts, self.doc = starts, doc[starts] if n else starts
        if not len(starts):
            self.lo = self.hi = self.anchor = self.phrase = self.owner = np.zeros(0, np.int64)
            self.of = starts
            return
        grams = wordhash.runs(hashes, ANCHOR, salt=5)
        at = _leftmost_least(grams, WINDOW - ANCHOR + 1)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        self.of = np.cumsum(new) - 1  # window -> phrase
        self.lo = starts[new]
        self.hi = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
        self.anchor = grams[at[new]].view(np.int64)
        self.phrase = self._span(self.lo, self.hi + WINDOW).view(np.int64)
        self.owner = self.doc[new]

    def windows(self, some: np.ndarray) -> np.ndarray:
        """Hashes of the windows at ``some`` positions of ``starts``."""
        return self._span(self.starts[some], self.starts[some] + WINDOW).view(np.int64)


def _reduced(keys: list[tuple]) -> tuple[np.ndarray, ...]:
    """Distinct (a, s, doc) rows in order, each with its reference (the place of the smallest doc with an equal (a, s)), and whether that is another document."""
    a, s, doc, pos = (np.concatenate(k) for k in zip(*keys, strict=True))
    by = np.lexsort((pos, doc, s, a))
    a, s, doc, pos = a[by], s[by], doc[by], pos[by]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    keep = first.copy()
    keep[1:] |= doc[1:] != doc[:-1]
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(a) else np.zeros(0, np.int64)
    found = doc[head] < doc
    at, place = np.where(found, doc[head], doc), np.where(found, pos[head], pos)
    return tuple(x[keep] for x in (a, s, doc, at, place, found))


def _dealt(make, by_anchor: bool):
    """Rows of ``_DEALT`` from a function that yields (a, s, doc, pos) arrays; ``deal`` is the anchor or the key, and spreads what needs no look-up."""

    def out(keys: list) -> pa.RecordBatch:
        a, s, doc, at, place, found = _reduced(keys)
        deal = np.where(found, wordhash.mix(doc.view(np.uint64) + s.view(np.uint64)).view(np.int64), a if by_anchor else s)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, a, s, doc, at, place, found)], ["deal", "a", "s", "doc", "ref", "place", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for keys in make(batches):
            held.append(keys)
            n += len(keys[0])
            if n >= HELD:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, s, ref, place, found) of rows sorted by (a, s, doc): keys that a smaller id has, with their reference, and the first of each key whose anchor has several (not found, to be asked for).

    Rows stream by: what is kept is the last row and the head of its key, so a
    common anchor needs no more memory than any other.
    """
    names = ["doc", "s", "ref", "place", "found"]
    last: tuple[int, int, int] | None = None  # a, s, doc
    head = (0, 0)  # the smallest id of the last row's key, and the place there
    pending: tuple[int, int] | None = None  # doc, s of a head whose anchor has had no other key so far
    for b in batches:
        known = b.column("found").to_numpy(zero_copy_only=False)
        columns = {n: np.asarray(b.column(n)) for n in ("a", "s", "doc", "ref", "place")}
        hits = [[columns[n][known] for n in names[:4]]]
        a, s, doc, _, place = (columns[n][~known] for n in columns)
        asks: list[tuple] = []
        if len(a):
            before = [np.append(x[:1] if last is None else last[i], x[:-1]) for i, x in enumerate((a, s, doc))]
            other_a, other_s, other_doc = (x != y for x, y in zip((a, s, doc), before, strict=True))
            if last is None:
                other_a[0] = True
            heads = other_a | other_s
            at = np.maximum.accumulate(np.where(heads, np.arange(len(a)), -1))
            least, there = np.where(at < 0, head[0], doc[at]), np.where(at < 0, head[1], place[at])
            hit = ~heads & other_doc & (doc > least)
            hits.append([doc[hit], s[hit], least[hit], there[hit]])
            where = np.flatnonzero(heads)
            if len(where):
                same = np.zeros(len(where) + 1, bool)  # has the anchor of the head before
                same[1:-1] = a[where[1:]] == a[where[:-1]]
                same[0] = last is not None and a[where[0]] == last[0]
                if same[0] and pending:
                    asks.append(tuple(np.array([x], np.int64) for x in pending))
                several = same[:-1] | same[1:]
                asks.append((doc[where[several]], s[where[several]]))
                pending = None if several[-1] else (int(doc[where[-1]]), int(s[where[-1]]))
            head = int(least[-1]), int(there[-1])
            last = int(a[-1]), int(s[-1]), int(doc[-1])
        n = sum(len(x[0]) for x in hits)
        rows = [np.concatenate([x[i] for x in (*hits, *asks)]) for i in range(2)]
        m = len(rows[0]) - n
        rows += [np.concatenate([*(x[i] for x in hits), np.zeros(m, np.int64)]) for i in (2, 3)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows), pa.array(np.arange(n + m) < n)], names)


_DEALT = "deal long, a long, s long, doc long, ref long, place long, found boolean"


def _index(rows: DataFrame, make, by_anchor: bool) -> DataFrame:
    made = rows.mapInArrow(_dealt(make, by_anchor), _DEALT)
    return made.repartition(partitions(rows), "deal").sortWithinPartitions("a", "s", "doc").mapInArrow(_looked_up, "doc long, s long, ref long, place long, found boolean")


def _parsed(ids, texts) -> Iterator[tuple[int, Parsed, np.ndarray]]:
    """(index of the first, parse, ids) of slices of a batch."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for first, end in wordhash.chunked(raw):
        yield first, Parsed(raw[first:end]), np.array(ids[first:end], np.int64)


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for _, p, ids in _parsed(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield p.anchor, p.phrase, ids[p.owner] if len(p.owner) else ids[:0], p.lo - p.first[p.owner] if len(p.owner) else ids[:0]


class Lists:
    """A column of lists of (s, ref, place), or of s alone, without an object per entry."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        kind = pa.types.is_struct(flat.type)
        self.fields = [np.asarray(f, np.int64) for f in (flat.flatten() if kind else [flat])]
        sizes = np.nan_to_num(np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), float)).astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])

    def found(self, row: int, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]] | None:
        """Which of ``keys`` are in the row's list, and the other fields there; None for an empty list."""
        a, b = self.ends[row], self.ends[row + 1]
        if a == b:
            return None
        own = [f[a:b] for f in self.fields]
        by = np.argsort(own[0], kind="stable")
        at = np.minimum(np.searchsorted(own[0][by], keys), b - a - 1)
        return own[0][by][at] == keys, [f[by][at] for f in own[1:]]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        asks = Lists(b.column(2))
        for first, p, ids in _parsed(b.column(0).to_pylist(), b.column(1).to_pylist()):
            wanted = np.zeros(len(p.phrase), bool)
            ends = np.searchsorted(p.owner, np.arange(len(ids) + 1))
            for d in range(len(ids)):
                if got := asks.found(first + d, p.phrase[ends[d] : ends[d + 1]]):
                    wanted[ends[d] : ends[d + 1]] = got[0]
            some = np.flatnonzero(wanted[p.of]) if len(p.of) else p.of
            yield p.anchor[p.of[some]], p.windows(some), ids[p.doc[some]], p.starts[some] - p.first[p.doc[some]]


def _factors(p: Parsed, n: int, row: int, hits: Lists, windows: Lists) -> list[tuple[np.ndarray, ...]]:
    """Per document (start, end, ref, place) of its factors in word numbers, one after another without overlap."""
    ref, place = np.zeros(len(p.starts), np.int64), np.zeros(len(p.starts), np.int64)
    dup = np.zeros(len(p.starts), bool)
    of_doc, of_owner = np.searchsorted(p.doc, np.arange(n + 1)), np.searchsorted(p.owner, np.arange(n + 1))
    out = []
    for d in range(n):
        here, own = slice(of_doc[d], of_doc[d + 1]), slice(of_owner[d], of_owner[d + 1])
        if got := hits.found(row + d, p.phrase[own]):
            of = p.of[here] - of_owner[d]
            dup[here], ref[here] = got[0][of], got[1][0][of]
            place[here] = got[1][1][of] + p.starts[here] - p.lo[own][of]
        if got := windows.found(row + d, p.windows(np.arange(of_doc[d], of_doc[d + 1]))):
            new = got[0] & ~dup[here]
            dup[here] |= new
            ref[here], place[here] = np.where(new, got[1][0], ref[here]), np.where(new, got[1][1], place[here])
        w = np.flatnonzero(dup[here]) + of_doc[d]
        at, r, q = p.starts[w] - p.first[d], ref[w], place[w]
        # a factor goes on while the next window is at the next place of the same reference
        new = np.ones(len(w), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (r[1:] != r[:-1]) | (q[1:] != q[:-1] + 1)
        begin = np.flatnonzero(new)
        ends = at[np.append(begin[1:], len(w)) - 1] + WINDOW if len(w) else at
        late = np.maximum(np.concatenate([[0], ends[:-1]]) - at[begin], 0) if len(w) else at  # a factor begins where the one before ends
        out.append((at[begin] + late, ends, r[begin], q[begin] + late))
    return out


def marks(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``hits`` (phrases) and ``windows`` (single ones) that earlier documents have, each with its reference."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where(F.col("doc_id").isNotNull())
    seen = _index(known, _phrases, by_anchor=True)
    copied = F.struct("s", "ref", "place")
    lists = seen.groupBy("doc").agg(F.collect_list(F.when(F.col("found"), copied)).alias("hits"), F.collect_list(F.when(~F.col("found"), F.col("s"))).alias("asks"))
    lists = written(lists, "factors")
    asked = known.join(lists.where(F.size("asks") > 0).select("doc", "asks"), known["doc_id"] == F.col("doc")).select("doc_id", "text", "asks")
    singles = _index(asked, _asked, by_anchor=False).where("found").groupBy("doc").agg(F.collect_list(copied).alias("windows"))
    singles = written(singles, "boundaries").withColumnRenamed("doc", "sdoc")
    both = lists.select("doc", "hits").join(singles, F.col("doc") == F.col("sdoc"), "left").select("doc", "hits", "windows")
    return docs.join(both, docs["doc_id"] == both["doc"], "left").select("doc_id", "text", "hits", "windows")


def _parsed_factors(b: pa.RecordBatch) -> Iterator[tuple[int, Parsed, list[tuple[np.ndarray, ...]]]]:
    hits, windows = Lists(b.column(2)), Lists(b.column(3))
    for first, p, ids in _parsed([0] * b.num_rows, b.column(1).to_pylist()):
        yield first, p, _factors(p, len(ids), first, hits, windows)


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans): the factors of each document, as word numbers (ends exclusive), the reference document and the word number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "ref", "place")]))
        for b in batches:
            counts, spans = [], []
            for _, p, factors in _parsed_factors(b):
                counts += p.counts.tolist()
                spans += [[dict(zip(("start", "end", "ref", "place"), f, strict=True)) for f in zip(*(x.tolist() for x in fs), strict=True)] for fs in factors]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind)], ["doc_id", "n_words", "spans"])

    return marks(docs).mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:long,end:long,ref:long,place:long>>")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that are left, joined by a space, in UTF-8."""
    return _kept(docs, "kept binary", pa.binary(), lambda kept: kept)


def _kept(docs: DataFrame, column: str, kind: pa.DataType, shape) -> DataFrame:
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            counts, removed, kept = [], [], []
            for first, _, factors in _parsed_factors(b):
                for t, (start, end, *_) in zip(texts[first:], factors, strict=False):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    counts.append(len(words))
                    removed.append(int((end - start).sum()))
                    left, at = [], 0
                    for x, y in zip(start.tolist(), end.tolist(), strict=True):
                        left += words[at:x]
                        at = y
                    kept.append(shape(b" ".join(left + words[at:])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, kind)], ["doc_id", "n_words", "n_removed", name])

    return marks(docs).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {column}")


def op6_substrings(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _kept(docs, "kept_sha256 string", pa.string(), lambda kept: hashlib.sha256(kept).hexdigest())


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS t FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT t, min(doc_id) AS d FROM p GROUP BY t),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS at_word FROM p JOIN f USING (t) WHERE d < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS at_word FROM w),
k AS (SELECT x.doc_id, count(*) - count(h.doc_id) AS n_kept, count(h.doc_id) AS n_removed,
  string_agg(word, ' ' ORDER BY at_word) FILTER (h.doc_id IS NULL) AS kept FROM x LEFT JOIN hit h USING (doc_id, at_word) GROUP BY x.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""
