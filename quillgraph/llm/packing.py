"""Token ids in fixed-width bit packing.

Every id takes the least number of bits that the vocabulary needs. A block is
one row of the written table and holds whole documents in order:

* ``part``, ``block``  its place: parts are ranges of document ids, blocks count inside a part,
* ``before``           ids of the part before this block,
* ``bits``, ``n_ids``  width and count of its ids,
* ``doc_ids``, ``ends`` little-endian 64-bit: the documents and where each ends in the block,
* ``payload``          the ids, lowest bits first, the last byte filled with zeros.

A block closes at ``BLOCK`` ids; a longer document has a block of its own. Ids
are unpacked by numpy for a whole block, or for any slice of it: id ``i`` begins
at bit ``i * bits``. The table is written by Spark's committer, so a lost
executor only repeats its own part, and read by Spark, whatever store it is in.

Order: by document id (null first), then by the checksum of the text. The
global start of a block needs the ids of all parts before it; that sum runs
over one row per part.

Defined results: a null or empty text has the end id alone; repeated rows are
documents of their own; an empty table gives no blocks.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.bpe import Encoder, WordBpe, public_tokenizer
from quillgraph.llm.common import ranges_for, resident, table, written

#: Ids after which a block closes.
BLOCK = 1 << 18

FILE_SCHEMA = "part int, block int, before long, bits int, n_ids long, doc_ids binary, ends binary, payload binary"


def width(n_values: int) -> int:
    """Bits for ids 0 to n_values - 1."""
    return max(1, (n_values - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.asarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (exclusive) of a block, without reading the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-stop * bits // 8)
    raw = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    raw = raw[start * bits - first * 8 :][: (stop - start) * bits].reshape(-1, bits)
    return raw.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class LibraryEncoder(Encoder):
    """The tokenizers library, asked once for each word while that is in the cache."""

    def __init__(self, tokenizer: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(WordBpe(tokenizer), self._from_library)
        self.lib = Tokenizer.from_str(tokenizer.decode())
        self.lib.no_truncation()
        self.lib.no_padding()
        self.size = self.lib.get_vocab_size()

    def _from_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the model alone: a word is normalised already, and must not be again
        split, letters = self.lib.model.tokenize, self.bpe.letters
        found = [split(w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()])) for w in words]
        ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), np.uint32)
        return ids, np.fromiter(map(len, found), np.int64, len(found))


def encoder(tokenizer: bytes) -> LibraryEncoder:
    """One per worker process."""
    return resident(("library", hash(tokenizer)), lambda: LibraryEncoder(tokenizer))


def id_ranges(docs: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending bounds that cut the ids into ranges of about as many rows."""
    cuts = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(F.col(key), cuts, 10_000).alias("b")).first()["b"] if cuts else []
    return sorted(set(found or []))


def range_of(key, bounds: list[int]):
    """Number of bounds that are at or below the key: 0 to len(bounds). Looked up in two steps, so a row costs the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    group = F.greatest(below(F.array(*(F.lit(g[0]) for g in groups))) - 1, F.lit(0))
    return F.coalesce(group * step + below(F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group)), F.lit(0))


def _blocks(bits: int, between: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = None, 0, 0
        docs: list[int] = []
        sizes: list[int] = []
        kept: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal docs, sizes, kept, held, block, before
            payload = b"".join(kept)
            if between != bits:
                payload = pack(np.frombuffer(payload, f"<u{between // 8}"), bits)
            row = [part, block, before, bits, held, np.array(docs, "<i8").tobytes(), np.cumsum(sizes).astype("<i8").tobytes(), payload]
            block, before = block + 1, before + held
            docs, sizes, kept, held = [], [], [], 0
            names = ["part", "block", "before", "bits", "n_ids", "doc_ids", "ends", "payload"]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for p, key, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(packed) * 8 // between
                if docs and (p != part or held + n > BLOCK):
                    yield closed()
                if p != part:
                    part, block, before = p, 0, 0
                docs.append(NULL_ID if key is None else key)
                sizes.append(n)
                kept.append(packed)
                held += n
        if docs:
            yield closed()

    return run


#: Stands for a null document id in ``doc_ids``.
NULL_ID = -(1 << 63)


def write_ids(docs: DataFrame, tokenizer: bytes, end_id: int, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Encode, append ``end_id`` to each document, write the blocks; returns the written table."""
    parts = parts or ranges_for(docs)
    raw = docs.sparkSession.sparkContext.broadcast(tokenizer)
    bits = width(max(encoder(tokenizer).size, end_id + 1))
    between = bits if bits in (8, 16) else 32  # between tasks an id takes whole bytes

    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(np.append(i, np.uint32(end_id)), between) for i in encoder(raw.value).encode(texts)], dtype=object)

    bounds = id_ranges(docs, key, parts)
    rows = docs.select(
        range_of(F.col(key), bounds).cast("int").alias("part"),
        F.col(key).cast("long").alias("key"),
        F.crc32(text).alias("tie"),
        F.pandas_udf(encoded, "binary")(F.col(text)).alias("ids"),
    )
    rows = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("key"), "tie")
    return written(rows.select("part", "key", "ids").mapInArrow(_blocks(bits, between), FILE_SCHEMA), "packed-ids")


def block_starts(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``start``: ids of all blocks before. The running sum is over one row per part."""
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(sums), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the blocks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                docs, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=docs == NULL_ID), pa.array(starts + row["start"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return block_starts(blocks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_packing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(write_ids(docs, public_tokenizer(), end_id=1))
