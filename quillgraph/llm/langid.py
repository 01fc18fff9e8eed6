"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language. A character is a 16-bit symbol: letters (as
lower case), marks, punctuation and signs stand for themselves, all numbers are
one symbol, and so are all white space and controls; only code points beyond
the first 65,536 share symbols, those of the private use area. Four symbols
make a 64-bit code, so no two 4-grams of the first plane are confused. All
labelled texts are counted, in the tasks first; the distinct 4-grams reach the
driver one language at a time, and a model keeps all of them, so discounts,
continuation counts and context sums are those of the whole training text.

A model is stored as sorted hash arrays: for every order the hashes of its
n-grams with their discounted shares, and the hashes of its contexts with their
interpolation weights. Workers look up 4-grams in the arrays of all languages
and keep the scores of recent ones in a table of fixed size; a text's
cross-entropy is their mean over all of its positions. The language with the
lowest one wins.

Rejection is calibrated on texts that the calibrated models have not seen: a
tenth of the labelled texts (by the hash of the text) is scored by models of
the other nine. Per language, with m the median of their cross-entropies h, the
limit for a text of n code points is ``m + MARGIN * (a + b / sqrt(n))``, where a
is the 99th percentile of h - m over texts of ``LONG`` code points or more and b
that of (h - m) * sqrt(n) over all. The final models are of all ten tenths. A
text beyond its language's limit, or with no letter, is rejected.

Defined results: a null text, or one with no letter (Unicode category L), is
``und`` with score 0, and so is every text where nothing is labelled; ties go
to the first language in alphabetical order; a language without texts in the
tenth rejects nothing; a null document id is neither training nor held out;
repeated rows each keep a row; a text is scored whole, a stretch at a time.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import release, resident, table, written

ORDER, BITS = 4, 16
#: What the limit of the cross-entropy allows beyond what unseen texts have shown, and the code points of a long text.
MARGIN, LONG = 3.0, 400
#: a and b at least, for languages of which the tenth has few texts.
LEAST = (0.1, 2.0)
#: One in so many labelled texts calibrates the rejection.
UNSEEN = 10
#: Code points handled at once.
CHUNK = 200_000
#: Counts of 4-grams that a task holds before it adds up the like (and twice the distinct ones, where these are more).
MERGED = 400_000
#: Scores that a worker keeps.
KEPT = 1 << 21
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LEAD = "   "


def _symbols() -> np.ndarray:
    out = np.full(0x110000, 0x20, np.uint16)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LMPSN":
            low = ord("0") if kind == "N" else ord(chr(c).lower()[0]) if kind == "L" else c
            out[c] = low if low < 0x10000 else 0xE000 + low % 6400
    return out


_table: list[np.ndarray] = []


def symbols() -> np.ndarray:
    if not _table:
        _table.append(_symbols())
    return _table[0]


def stretches(texts: Iterable[str], size: int = CHUNK) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(which text, stretch of it), about ``size`` code points together; a stretch has the three code points before it (blanks at a text's start) in front."""
    of, held, total = [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), size):
            held.append((t[a - 3 : a] if a else _LEAD) + t[a : a + size])
            of.append(i)
            total += len(held[-1])
            if total >= size:
                yield np.array(of), held
                of, held, total = [], [], 0
    if held:
        yield np.array(of), held


def grams(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram code that ends at each code point of stretches, and where each begins."""
    s = symbols()[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    codes = s.copy()
    for k in range(1, ORDER):
        codes[k:] |= s[:-k] << np.uint64(BITS * k)
    sizes = np.fromiter(map(len, some), np.int64, len(some)) - 3
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(codes), bool)
    for k in range(3):
        keep[starts + 3 * np.arange(len(some)) + k] = False
    return codes[keep], starts


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, unseen, gram, n) over all rows (text, lang, unseen)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[tuple, list] = {}

        def merge(name: tuple) -> None:
            codes, where = np.unique(np.concatenate([c for c, _ in held[name]]), return_inverse=True)
            held[name] = [(codes, np.bincount(where, np.concatenate([n for _, n in held[name]])).astype(np.int64))]

        for batch in batches:
            texts: dict[tuple, list[str]] = {}
            for t, lang, unseen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts.setdefault((lang, unseen), []).append(t)
            for name in sorted(texts):
                for _, some in stretches(texts[name]):
                    held.setdefault(name, []).append(np.unique(grams(some)[0], return_counts=True))
                    if sum(len(c) for c, _ in held[name]) > max(MERGED, 2 * len(held[name][0][0])):
                        merge(name)
        for name in held:
            merge(name)
            codes, n = held[name][0]
            yield pa.RecordBatch.from_arrays([pa.array([name[0]] * len(codes), pa.string()), pa.array([name[1]] * len(codes), pa.bool_()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "unseen", "gram", "n"])

    return rows.mapInArrow(count, "lang string, unseen boolean, gram long, n long").groupBy("lang", "unseen", "gram").agg(F.sum("n").alias("n"))


def _hashed(codes: np.ndarray, order: int) -> np.ndarray:
    x = codes + np.uint64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ending(codes: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols."""
    return codes & np.uint64((1 << BITS * order) - 1)


class KneserNey:
    """One language's model in sorted hash arrays."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.grams: dict[int, tuple] = {}
        self.contexts: dict[int, tuple] = {}
        for order in range(ORDER, 0, -1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = float(ones / (ones + 2 * twos)) if ones and twos else 0.5
            contexts, where = np.unique(codes >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(where, n, len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            share = np.maximum(n - discount, 0) / np.maximum(total[where], 1)
            self.grams[order] = self._sorted(codes, share, order)
            self.contexts[order] = self._sorted(contexts, discount * kinds / np.maximum(total, 1), order)
            if order > 1:  # below, an n-gram counts once for each symbol that it follows
                codes, n = np.unique(_ending(codes, order - 1), return_counts=True)

    @staticmethod
    def _sorted(codes, values, order) -> tuple:
        h = _hashed(codes, order)
        by = np.argsort(h)
        return h[by], values[by]

    @staticmethod
    def _find(stored: tuple, codes: np.ndarray, order: int, missing: float) -> np.ndarray:
        keys, values = stored
        h = _hashed(codes, order)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], missing)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(last symbol | the three before) of 4-gram codes."""
        p = np.full(len(codes), 1.0 / (1 << BITS))
        for order in range(1, ORDER + 1):
            part = _ending(codes, order)
            weight = self._find(self.contexts[order], part >> np.uint64(BITS), order, 1.0)  # an unseen context leaves all to the lower order
            p = self._find(self.grams[order], part, order, 0.0) + weight * p
        return np.log(np.maximum(p, 1e-12))


class Scorer:
    """Cross-entropies of texts under all languages; the scores of recent 4-grams stand in a table of fixed size."""

    def __init__(self, models: dict[str, KneserNey]):
        self.langs = sorted(models)
        self.models = models
        self.bits = max(10, (KEPT // max(1, len(self.langs))).bit_length() - 1)
        self.codes = np.zeros(1 << self.bits, np.uint64)  # no text has a symbol 0
        self.scores = np.zeros((1 << self.bits, len(self.langs)), np.float32)

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def _scored(self, codes: np.ndarray) -> np.ndarray:
        place = self._place(codes)
        lacking = self.codes[place] != codes
        out = self.scores[place]
        if lacking.any():
            new = np.unique(codes[lacking])
            own = np.stack([self.models[k].log_probability(new) for k in self.langs], axis=1).astype(np.float32)
            out[lacking] = own[np.searchsorted(new, codes[lacking])]
            to, one = np.unique(self._place(new), return_index=True)
            self.codes[to], self.scores[to] = new[one], own[one]
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Texts x languages; each text has a code point at least."""
        out = np.zeros((len(texts), len(self.langs)))
        for of, some in stretches(texts, min(CHUNK, KEPT // max(1, len(self.langs)))):
            codes, starts = grams(some)
            np.add.at(out, of, -np.add.reduceat(self._scored(codes), starts, axis=0, dtype=np.float64))
        return out / np.array([[len(t)] for t in texts])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> bytes:
    """A pickled (models, limits) of the labelled rows; ``docs`` holds training rows only."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumn("unseen", F.pmod(F.xxhash64("text"), F.lit(UNSEEN)) == 0)
    counted = written(gram_counts(rows), "grams")
    models, partial = {}, {}
    for (name,) in counted.select("lang").distinct().orderBy("lang").collect():  # a row per language
        one = counted.where(F.col("lang") == name).select("gram", "n", "unseen").toArrow()  # distinct 4-grams
        codes, n, seen = one["gram"].to_numpy().view(np.uint64), one["n"].to_numpy(), ~one["unseen"].to_numpy()
        every, where = np.unique(codes, return_inverse=True)
        models[name] = KneserNey(every, np.bincount(where, n).astype(np.int64))
        if seen.any():
            by = np.argsort(codes[seen])
            partial[name] = KneserNey(codes[seen][by], n[seen][by])
    limits = _limits(rows.where("unseen").select("text", "lang"), partial) if partial else {}
    return pickle.dumps((models, limits))


def _limits(unseen: DataFrame, models: dict[str, KneserNey]) -> dict[str, tuple[float, float, float]]:
    """(m, a, b) of each language."""
    scored = unseen.select("lang", F.char_length("text").alias("n"), judged(unseen.sparkSession, pickle.dumps((models, {})), F.col("text")).alias("j"))
    # filtered once written: a filter here would be pushed below and judge each text again, in a second worker of the task
    scored = written(scored, "unseen").where("j.lang_pred = lang").select("lang", "n", F.col("j.cross_entropy").alias("h"))
    middle = scored.groupBy("lang").agg(F.percentile_approx("h", 0.5).alias("m"))  # a row per language
    beyond = scored.join(F.broadcast(middle), "lang").withColumn("x", F.col("h") - F.col("m"))
    found = beyond.groupBy("lang").agg(
        F.first("m").alias("m"),
        F.percentile_approx(F.when(F.col("n") >= LONG, F.col("x")), 0.99).alias("a"),
        F.percentile_approx(F.col("x") * F.sqrt("n"), 0.99).alias("b"),
    )
    return {r["lang"]: (r["m"], max(r["a"] or 0.0, LEAST[0]), max(r["b"] or 0.0, LEAST[1])) for r in found.collect()}


def _scorer(raw: bytes) -> tuple[Scorer, dict[str, tuple[float, float, float]]]:
    def make():
        models, limits = pickle.loads(raw)
        return Scorer(models), limits

    return resident(("languages", hash(raw)), make)


def judged(spark: SparkSession, model: bytes, text: Column) -> Column:
    """A struct of ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``."""
    shipped = spark.sparkContext.broadcast(model)

    def run(column: pd.Series) -> pd.DataFrame:
        scorer, limits = _scorer(shipped.value)
        lang, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        entropy, rejected = np.full(len(column), np.nan), np.ones(len(column), bool)
        at = [i for i, t in enumerate(column) if t and _LETTER.search(t)] if scorer.langs else []
        if at:
            h = scorer.entropies([column.iloc[i] for i in at])
            best = h.argmin(axis=1)
            share = np.exp(-4.0 * (h - h.min(axis=1, keepdims=True)))
            lang[at] = np.array(scorer.langs, object)[best]
            score[at] = 1.0 / share.sum(axis=1)
            entropy[at] = h.min(axis=1)
            m, a, b = np.array([limits.get(k, (np.inf, 0.0, 0.0)) for k in scorer.langs])[best].T
            rejected[at] = entropy[at] > m + MARGIN * (a + b / np.sqrt([len(column.iloc[i]) for i in at]))
        return pd.DataFrame({"lang_pred": lang, "score": score, "cross_entropy": entropy, "rejected": rejected})

    return F.pandas_udf(run, "lang_pred string, score double, cross_entropy double, rejected boolean")(text)


def predict(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``; input columns of these names are replaced."""
    made = docs.withColumn("__lid", judged(docs.sparkSession, model, F.col(text)))
    return made.withColumns({c: F.col("__lid")[c] for c in ("lang_pred", "score", "cross_entropy", "rejected")}).drop("__lid")


def fold(key: Column) -> Column:
    """0 to 3: crc32 of the id as text modulo 4; null for a null id."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(4))


def op8_langid(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold(F.col("doc_id")) != 2))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
