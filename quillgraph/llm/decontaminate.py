"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``size`` consecutive words of a benchmark item (an item of fewer
words is one window). To find every occurrence of every window:

1. Windows are broken into shingles of five words (all words of a shorter
   window). Document shingles that some window has are kept with their place;
   this is a pass over all words for each shingle size (one, unless items of
   fewer than five words add theirs), and needs the distinct shingle hashes of
   the benchmark on each task: they are broadcast up to ``SMALL`` of them, joined
   by a shuffle beyond.
2. Shingles are ordered by rarity among what was kept. A window occurs only
   with all of its shingles, so one prefix token, its rarest shingle, is joined;
   a window with a shingle that occurs nowhere is given up.
3. A match at ``pos`` of a shingle that stands at ``offset`` in its window
   begins at ``pos - offset``. The positional bound (not before the first word)
   and the length bound (not beyond the last) drop what cannot fit.
4. Each candidate is verified word for word: the shingles that tile the window
   must all stand at their places, compared as text.

Defined results: a null or empty text has no words and is clean; a null
``item_id`` is left out, as there is nothing to report; items and documents
that are repeated are reported once per document row; windows shared by items
are searched once and count for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import ascii_lower, table, written

SHINGLE = 5
#: Distinct benchmark shingles that may be broadcast (8 bytes each).
SMALL = 500_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """Lower-cased words: digits, letters and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _shingles(w: Column, size: int) -> Column:
    """Hash of the ``size`` words from each place on."""
    places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))


def _joined(w: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(w, start + 1, size), " ")


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, win, len, w): every window of every item; ``win`` is its words joined by a space."""
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    rows = rows.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    rows = rows.select("item_id", F.slice("w", F.col("at") + 1, size).alias("w"))
    return rows.select("item_id", F.array_join("w", " ").alias("win"), F.size("w").alias("len"), "w").distinct()


def occurrences(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(docs rows (doc_id, key, th) x start x window), (item_id, win). ``key`` is the id with a value for null, ``th`` the hash of the text."""
    wins = written(windows(items, size), "windows")
    pieces = wins.select("win", "len", "w", F.least("len", F.lit(SHINGLE)).alias("s")).distinct()
    sizes = [r["s"] for r in pieces.select("s").distinct().collect()]  # five values at most
    parts = [pieces.where(F.col("s") == s).select("win", "len", "s", "w", F.posexplode(_shingles(F.col("w"), s)).alias("off", "h")) for s in sizes]
    if not parts:
        parts = [pieces.select("win", "len", "s", "w", F.lit(0).alias("off"), F.lit(0).cast("long").alias("h"))]
    tokens = parts[0]
    for p in parts[1:]:
        tokens = tokens.unionByName(p)
    tokens = written(tokens.select("win", "len", "s", "off", "h", _joined(F.col("w"), F.col("off"), F.col("s")).alias("txt")), "tokens")
    known = tokens.select("s", "h").distinct()
    small = known.count() <= SMALL

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.xxhash64("text").alias("th"), words(F.col("text")).alias("dw"))
    found = None
    for s in sizes or [SHINGLE]:
        own = known.where(F.col("s") == s).select("h")
        each = rows.select("key", "th", "dw", F.posexplode(_shingles(F.col("dw"), s)).alias("pos", "h"))
        cut = [F.col("key"), F.col("th"), F.size("dw").alias("n"), F.lit(s).alias("s"), F.col("pos"), F.col("h"), _joined(F.col("dw"), F.col("pos"), F.lit(s)).alias("txt")]
        # within one stage the words stay beside the shingles and only matches are cut out; across a shuffle each shingle takes its own text
        hit = each.join(F.broadcast(own), "h", "left_semi").select(*cut) if small else each.select(*cut).join(own, "h", "left_semi")
        hit = hit.select("key", "th", "n", "s", "pos", "h", "txt").distinct()
        found = hit if found is None else found.unionByName(hit)
    found = written(found, "matches")

    rarity = found.groupBy("s", "h").agg(F.count("*").alias("df"))
    ranked = tokens.join(rarity, ["s", "h"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("win").orderBy("df", "off")
    prefix = ranked.withColumn("rank", F.row_number().over(order)).where("rank = 1 AND df > 0").select("win", "len", "s", "off", "h")
    candidates = found.select("key", "th", "n", "s", "pos", "h").join(prefix, ["s", "h"]).withColumn("start", F.col("pos") - F.col("off"))
    candidates = candidates.where("start >= 0 AND start + len <= n").select("key", "th", "start", "win", "len", "s").distinct()
    # the shingles at 0, s, 2 s, ... and at the end tile a window
    tiles = tokens.where((F.col("off") % F.col("s") == 0) | (F.col("off") + F.col("s") == F.col("len"))).select("win", "off", "txt")
    needed = tiles.groupBy("win").agg(F.count("*").alias("needed"))
    asked = candidates.join(tiles, "win").select("key", "th", "start", "win", "len", (F.col("start") + F.col("off")).alias("pos"), "txt")
    there = asked.join(found.select("key", "th", "pos", "txt"), ["key", "th", "pos", "txt"]).groupBy("key", "th", "start", "win", "len").agg(F.count("*").alias("n_there"))
    verified = there.join(needed, "win").where("n_there = needed").select("key", "th", "start", "win", "len")
    return verified, wins.select("item_id", "win")


def contamination(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, key, th, n_words, n_hit, n_items, items_sha256, contaminated."""
    verified, owners = occurrences(docs.select("doc_id", "text"), items.select("item_id", "text"), size)
    verified = written(verified, "occurrences")
    hit = verified.select("key", "th", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("at")).distinct()
    hit = hit.groupBy("key", "th").agg(F.count("*").alias("n_hit"))
    who = verified.select("key", "th", "win").distinct().join(owners, "win").select("key", "th", "item_id").distinct()
    who = who.groupBy("key", "th").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    per = hit.join(who, ["key", "th"])
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(per, ["key", "th"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "key",
        "th",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op1_decontaminate(spark, sf_dir) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key", "th")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, i, n FROM place JOIN win USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)"""
