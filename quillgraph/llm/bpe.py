"""BPE encoding and decoding over a minimal acyclic transducer.

The frequent words of the corpus (all documents are counted) are encoded once
on the driver and compiled into a minimal acyclic automaton: words with the
same endings share states, every arc carries how many words sort before it, and
the sum along a path is the number of the word, which leads to its ids. The
file is broadcast (its size is bounded by ``LEXICON``), memory-mapped by each
worker, and walked for all new words of a batch at once. Words that it does not
have go through the merge list exactly, so the lexicon changes speed only.

The tokenizer file is one of the word-end kind: NFC, lower case, words by one
pattern, bytes as letters, ``</w>`` at a word's end, no decoder. Special tokens
are found in the raw text.

Defined results: a null or empty text has no ids and decodes to the empty
text; rows are kept one for one (repeated rows, null ids); texts are encoded
whole whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import release, resident, table, written

#: Words in the transducer at most, and their length in bytes.
LEXICON, LONGEST = 250_000, 64
#: Words that a worker's cache keeps, and that a task counts before it adds up the like.
CACHED, COUNTED = 200_000, 800_000
#: Code points whose words are looked up together.
TOGETHER = 1_000_000

# White space as the tokenizer's patterns have it, which leaves out U+001C to U+001F.
SPACE = r"[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SEPARATORS = regex.compile(SPACE + "+")
_WIDE_SPACES = [chr(c) for c in range(0x80, 0x3001) if _SEPARATORS.match(chr(c))]
#: The pattern that ``split`` stands for, and its endings after an apostrophe by length, as code points.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = {1: [ord(c) for c in "stmd"], 2: [tuple(map(ord, e)) for e in ("re", "ve", "ll")]}
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Per code point: white space, letter, number or anything else."""
    if not _kinds:
        codes = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
        every, out = codes.tobytes().decode("utf-32-le"), np.full(0x110000, _OTHER, np.uint8)
        for value, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, SPACE + "+")):
            for m in regex.finditer(pattern, every):
                out[codes[m.start() : m.end()]] = value
        _kinds.append(out)
    return _kinds[0]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordBpe:
    """The exact merge procedure of a tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {self.vocab[a] << 32 | self.vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self._one = [self.vocab.get(self.letters[b]) for b in range(256)]
        self._last = [self.vocab.get(self.letters[b] + self.end) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("the tokenizer splits words by another pattern")
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, piece) in order."""
        if self._special is None or not any(s in text for s in self.special):
            yield False, text
            return
        for i, piece in enumerate(self._special.split(text)):
            if piece:
                yield i % 2 == 1, piece

    @staticmethod
    def normalised(text: str) -> str:
        """The text as the pattern sees it, with a space for each run of white space beyond ASCII; no word crosses white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter, sigma has one lower case
            if any(x in text for x in _WIDE_SPACES):
                text = _SEPARATORS.sub(" ", text)
        return text.lower()

    @staticmethod
    def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of normalised texts, one after another, and how many each text has.

        Words are runs of letters, single numbers and runs of anything else; an
        apostrophe that begins a word takes the ending of a contraction with it.
        """
        joined = " ".join(texts) + " "
        raw = np.frombuffer(joined.encode(), np.uint8)
        plain = len(raw) == len(joined)
        codes = raw if plain else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = kinds()[codes]
        first = kind != _SPACE
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        if "'" in joined:
            at = np.flatnonzero((codes == 39) & first)
            one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
            short, long = np.isin(one, _ENDINGS[1]), np.zeros(len(at), bool)
            for a, b in _ENDINGS[2]:
                long |= (one == a) & (two == b)
            first[at[short | long] + 1] = False
            for size, those in ((2, at[short]), (3, at[long & ~short])):
                first[those + size] = kind[those + size] != _SPACE
        starts = np.flatnonzero(first)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
        keep = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
        begins = starts if plain else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
        offsets = np.append(kept[begins], kept[-1]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])
        return words.cast(pa.string()) if kept[-1] < 1 << 31 else words, counts

    def merge(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self._one[b] for b in raw[:-1]]
        ids.append(self._last[raw[-1]])
        if None in ids:  # a letter that the vocabulary lacks is left out, and nothing merges across it
            ids = [-1 if i is None else i for i in ids]
        rank, made, never = self.rank.get, self.made, 1 << 60
        ranks = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)  # the leftmost of the lowest rank
            ids[i] = new = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, never)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], never)
        return [i for i in ids if i >= 0] if -1 in ids else ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


class Transducer:
    """Minimal acyclic automaton over bytes; a word's number leads to its ids."""

    _PARTS = ("keys", "target", "before", "final", "offsets", "ids")
    _TYPES = (np.int64, np.int32, np.int32, np.uint8, np.int32, np.uint32)

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compiled(cls, entries: Iterable[tuple[bytes, list[int]]]) -> Transducer:
        """Of distinct words; built in sorted order, a state is shared as soon as nothing can be added to it."""
        entries = sorted(entries)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # parent, label, child: of the last word

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, label, child = path.pop()
                key = (final[child], *arcs[child].items())
                arcs[parent][label] = register.setdefault(key, child)

        last = b""
        for word, _ in entries:
            same = len(os.path.commonprefix([word, last]))
            settle(same)
            state = path[-1][2] if path else 0
            for label in word[same:]:
                arcs.append({})
                final.append(False)
                arcs[state][label] = len(arcs) - 1
                path.append((state, label, len(arcs) - 1))
                state = len(arcs) - 1
            final[state] = True
            last = word
        settle(0)
        # number the states that are left; count the words below each
        below: dict[int, int] = {}
        stack = [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                below[state] = final[state] + sum(below[c] for c in arcs[state].values())
            elif state not in below:
                stack.append((state, True))
                stack += [(c, False) for c in arcs[state].values() if c not in below]
        number = {s: i for i, s in enumerate(sorted(below))}
        keys, target, before = [], [], []
        for s in sorted(below):
            passed = int(final[s])
            for label, child in sorted(arcs[s].items()):
                keys.append(number[s] << 8 | label)
                target.append(number[child])
                before.append(passed)
                passed += below[child]
        sizes = [len(ids) for _, ids in entries]
        values = (keys, target, before, [final[s] for s in sorted(below)], np.cumsum([0, *sizes]), [i for _, ids in entries for i in ids])
        return cls({k: np.array(v, dtype=t) for k, v, t in zip(cls._PARTS, values, cls._TYPES, strict=True)})

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, k), dtype=t).tobytes() for k, t in zip(self._PARTS, self._TYPES, strict=True)]
        parts = [p + bytes(-len(p) % 8) for p in parts]
        sizes = np.array([len(getattr(self, k)) for k in self._PARTS], dtype=np.int64).tobytes()
        return sizes + b"".join(parts)

    @classmethod
    def mapped(cls, raw: bytes) -> Transducer:
        """Over a memory map of its own, without a file in a machine-local folder."""
        m = mmap.mmap(-1, len(raw))
        m.write(raw)
        sizes, at, out = np.frombuffer(m, np.int64, len(cls._PARTS)), 8 * len(cls._PARTS), {}
        for k, t, n in zip(cls._PARTS, cls._TYPES, sizes, strict=True):
            out[k] = np.frombuffer(m, t, n, at)
            at += -(-int(n) * np.dtype(t).itemsize // 8) * 8
        return cls(out)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it. All words take a step together."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not words or not len(self.keys):
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        live = np.flatnonzero((sizes <= LONGEST) & (sizes > 0))
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            key = state << 8 | text[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc, total = live[ok], arc[ok], total[ok] + self.before[arc[ok]]
            state, depth = self.target[arc].astype(np.int64), depth + 1
            ended = sizes[live] == depth
            hit = ended & (self.final[state] == 1)
            out[live[hit]] = total[hit]
            live, state, total = live[~ended], state[~ended], total[~ended]
        return out


def _stretches(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """About TOGETHER code points at a time, null as empty."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` from ``starts`` on, one after another."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Encodes texts over a cache of words; ``unseen`` gives the ids (one after another, and how many of each) of words that it lacks.

    A stretch of texts is split into words and dictionary-encoded at once, so
    Python handles distinct words only; the ids are gathered by numpy. Of a
    full cache the words asked for in most stretches stay, a half at most.
    """

    def __init__(self, bpe: WordBpe, unseen: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cached: int = CACHED):
        self.bpe, self.unseen, self.cached = bpe, unseen, cached
        self._rows: dict[str, int] = {}
        self._starts, self._sizes, self._asked = (np.zeros(0, np.int64) for _ in range(3))
        self._ids = np.zeros(0, np.uint32)

    def _shrink(self) -> None:
        order = np.argsort(-self._asked, kind="stable")[: self.cached // 2]
        order = np.sort(order[self._asked[order] > 1])
        place = np.full(len(self._asked), -1, np.int64)
        place[order] = np.arange(len(order))
        self._rows = {w: j for w, i in self._rows.items() if (j := int(place[i])) >= 0}
        self._ids = _gathered(self._ids, self._starts[order], self._sizes[order])
        self._sizes, self._asked = self._sizes[order], np.ones(len(order), np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes

    def _known(self, words: list[str]) -> np.ndarray:
        """The cache's row of each of some distinct words."""
        if len(self._rows) > self.cached:
            self._shrink()
        found = list(map(self._rows.get, words))
        new = [w for w, row in zip(words, found, strict=True) if row is None]
        if new:
            ids, sizes = self.unseen(new)
            n = len(self._sizes)
            self._rows.update(zip(new, range(n, n + len(new)), strict=True))
            self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(sizes) - sizes])
            self._sizes = np.concatenate([self._sizes, sizes])
            self._ids = np.concatenate([self._ids, ids])
            self._asked = np.concatenate([self._asked, np.zeros(len(new), np.int64)])
            found = list(map(self._rows.__getitem__, words))
        rows = np.array(found, np.int64)
        self._asked[rows] += 1
        return rows

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for some in _stretches(texts):
            yield from self._encode(some)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        pieces = [list(self.bpe.pieces(t)) for t in texts]
        words, counts = self.bpe.split([self.bpe.normalised(p) for ps in pieces for special, p in ps if not special])
        coded = words.dictionary_encode()
        at = self._known(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        n = self._sizes[at]
        ids = _gathered(self._ids, self._starts[at], n)
        edges = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        k = 0
        for ps in pieces:
            parts = []
            for special, p in ps:
                if special:
                    parts.append(np.array([self.bpe.special[p]], np.uint32))
                else:
                    parts.append(ids[edges[k] : edges[k + 1]])
                    k += 1
            yield parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])


class Codec(Encoder):
    """Encodes texts: transducer first, exact merges for what it lacks."""

    def __init__(self, tokenizer: bytes, lexicon: bytes):
        super().__init__(WordBpe(tokenizer), self._from_lexicon)
        self.lexicon = Transducer.mapped(lexicon)

    def _from_lexicon(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers = self.lexicon.numbers([w.encode() for w in words])
        merged = [self.bpe.merge(words[i]) for i in np.flatnonzero(numbers < 0).tolist()]
        own = np.fromiter(chain.from_iterable(merged), np.uint32)
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        hit, ends = numbers >= 0, self.lexicon.offsets
        sizes[hit], starts[hit] = ends[numbers[hit] + 1] - ends[numbers[hit]], ends[numbers[hit]]
        sizes[~hit] = np.fromiter(map(len, merged), np.int64, len(merged))
        out = np.zeros(int(sizes.sum()), np.uint32)
        of_word = np.repeat(hit, sizes)
        out[of_word] = _gathered(self.lexicon.ids, starts[hit], sizes[hit])
        out[~of_word] = own
        return out, sizes


def packed(ids: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return ids.astype("<u4", copy=False).tobytes()


def codec(tokenizer: bytes, lexicon: bytes) -> Codec:
    """One per worker process."""
    return resident(("codec", hash(tokenizer), hash(lexicon)), lambda: Codec(tokenizer, lexicon))


def word_counts(docs: DataFrame, text: str, tokenizer: bytes) -> DataFrame:
    """(word, n) over all documents; counted in the tasks first."""
    raw = docs.sparkSession.sparkContext.broadcast(tokenizer)
    names = ["word", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bpe, held, rows = WordBpe(raw.value), [], 0
        for batch in batches:
            for texts in _stretches(batch.column(0).to_pylist()):
                words, _ = bpe.split([bpe.normalised(p) for t in texts for special, p in bpe.pieces(t) if not special])
                counts = pc.value_counts(words)
                held.append(pa.table([counts.field("values"), counts.field("counts")], names))
                rows += len(counts)
                if rows > COUNTED:
                    held = [_added(held)]
                    rows = len(held[0])
                    if rows > COUNTED // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from _added(held).to_batches()

    def _added(tables: list[pa.Table]) -> pa.Table:
        total = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(names)
        return total.filter(pc.less_equal(pc.binary_length(total["word"]), LONGEST)).combine_chunks()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, text: str, tokenizer: bytes, size: int = LEXICON) -> bytes:
    """The transducer of the words that are frequent in all documents: at most ``size``, seen twice at least."""
    counted = written(word_counts(docs, text, tokenizer).where("n >= 2"), "words")
    histogram = counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect()  # at most 10,000 rows
    least, room = 10_001, size
    for n, words in sorted(((r["n"], r["count"]) for r in histogram), reverse=True):
        if words > room:
            break
        least, room = n, room - words
    bpe = WordBpe(tokenizer)
    frequent = counted.where(F.col("n") >= least).select("word").toPandas()["word"] if least <= 10_000 else []
    return Transducer.compiled((w.encode(), bpe.merge(w)) for w in frequent if len(w.encode()) <= LONGEST).to_bytes()


def encode(docs: DataFrame, tokenizer: bytes, lexicon: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit) and ``decoded``; input columns of these names are replaced."""
    sc = docs.sparkSession.sparkContext
    raw, lex = sc.broadcast(tokenizer), sc.broadcast(lexicon)

    def run(texts: pd.Series) -> pd.DataFrame:
        c = codec(raw.value, lex.value)
        ids = list(c.encode(texts))
        return pd.DataFrame({"n_tokens": list(map(len, ids)), "ids": [packed(i) for i in ids], "decoded": [c.bpe.decode(i).decode() for i in ids]})

    made = docs.withColumn("__bpe", F.pandas_udf(run, "n_tokens long, ids binary, decoded string")(F.col(text)))
    return made.withColumns({c: F.col("__bpe")[c] for c in ("n_tokens", "ids", "decoded")}).drop("__bpe")


def digests(docs: DataFrame, tokenizer: bytes, lexicon: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as ``encode`` makes them, hashed where they are made."""
    sc = docs.sparkSession.sparkContext
    raw, lex = sc.broadcast(tokenizer), sc.broadcast(lexicon)

    def run(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(raw.value, lex.value), []
        for ids in c.encode(texts):
            rows.append((len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(c.bpe.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = docs.select("doc_id", F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")("text").alias("d"))
    return made.select("doc_id", "d.*")


def tokenized(docs: DataFrame, tokenizer: bytes, lexicon: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and the digests of the ids and of the decoded text, which does not leave the worker."""
    sc = docs.sparkSession.sparkContext
    raw, lex = sc.broadcast(tokenizer), sc.broadcast(lexicon)

    def run(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(raw.value, lex.value), []
        for ids in c.encode(texts):
            raw_ids = packed(ids)
            rows.append((len(ids), raw_ids, hashlib.sha256(raw_ids).hexdigest(), hashlib.sha256(c.bpe.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    made = docs.withColumn("__bpe", F.pandas_udf(run, "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")(F.col(text)))
    return made.withColumns({c: F.col("__bpe")[c] for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")}).drop("__bpe")


def public_tokenizer(name: str = "word_bpe_49k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op3_bpe(spark, sf_dir) -> DataFrame:
    docs, tokenizer = table(spark, sf_dir, "documents"), public_tokenizer()
    return digests(docs, tokenizer, compile_lexicon(docs, "text", tokenizer))
