"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words, or all its words if it has fewer. A window is a
set of positioned shingles, and a text contains the window only if it contains every shingle, so
for containment of 1 the necessary prefix is a single token: the window's rarest shingle. A first
pass over the documents counts the benchmark's shingles in the corpus. Windows with an unseen
shingle occur nowhere and leave; the others join the documents on their rarest shingle alone. The
position of that shingle fixes where the window would have to start (positional bound) and end
(length bound), and there the words are compared one by one.

The benchmark's shingles are broadcast while they number at most ``broadcast_rows``, which is
counted first; beyond that Spark joins by shuffle.

Cases: null and empty texts have no words and no hits; an item without words has no window. A
document is an (id, text) pair, so repeated rows get the same answer. Items that repeat a window
all count; an item id that occurs twice counts once, and a null item id is listed as ``null``.
Empty tables give clean documents or an empty result. Columns other than ids and texts are neither
read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import ascii_lower, whole
from plumbline.session import materialize

#: Everything in ASCII that is no digit and no letter a to z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5


def words_of(text: str | Column) -> Column:
    """The words of a text, A to Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(whole(text)), SEPARATORS, -1), "")


def shingle_hashes(words: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words of the array column ``words``."""
    run = lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)])
    return F.when(F.size(words) >= size, F.transform(
        F.sequence(F.lit(0), F.size(words) - size), run)).otherwise(
            F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """One row per distinct window: its key, words and the ids of its items."""
    words = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                         words_of(text_col).alias("_w")).filter(F.size("_w") > 0)
    size = F.least(F.size("_w"), F.lit(window))
    parts = F.transform(F.sequence(F.lit(1), F.size("_w") - size + 1),
                        lambda i: F.slice("_w", i, size))
    return words.select("item", F.explode(parts).alias("words")).groupBy("words").agg(
        F.collect_set("item").alias("items")).withColumn(
            "window_key", F.sha2(F.array_join("words", " "), 256))


def _runs(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Documents with the hashes of all their shingles in ``_runs``, one size after another."""
    return docs.withColumn("_runs", F.concat(*[shingle_hashes("_words", n) for n in sizes]))


def _position(sizes: list[int]) -> Column:
    """The position of a shingle of size ``n`` from its place ``_at`` in ``_runs``."""
    passed, out = F.lit(0), None
    for n in sizes:
        here = F.col("_at") - passed
        out = F.when(F.col("n") == n, here) if out is None else out.when(F.col("n") == n, here)
        passed = passed + F.greatest(F.size("_words") - (n - 1), F.lit(0))
    return out


def _bounded(small: DataFrame, broadcast_rows: int) -> DataFrame:
    return F.broadcast(small) if small.count() <= broadcast_rows else small


def window_hits(docs: DataFrame, windows: DataFrame, *, shingle: int = SHINGLE,
                broadcast_rows: int = 1_000_000) -> DataFrame:
    """Every verified occurrence: ``_id``, ``_version``, ``window_key``, start and end.

    ``docs`` has ``_id``, ``_version`` and ``_words``; ``windows`` comes from `item_windows`.
    """
    spark = docs.sparkSession
    size = F.least(F.size("words"), F.lit(shingle))
    kinds = windows.select(size.alias("n"), F.size("words").alias("long")).groupBy("n").agg(
        F.max("long").alias("long")).collect()  # at most `shingle`
    sizes, longest = sorted(r["n"] for r in kinds), max((r["long"] for r in kinds), default=0)
    if not sizes:
        return docs.select("_id", "_version", F.lit("").alias("window_key"),
                           F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    tokens = None
    for n in sizes:
        own = windows.filter(size == n).select(
            "window_key", "words", F.lit(n).alias("n"),
            F.posexplode(shingle_hashes("words", n)).alias(
                "offset", "shingle"))
        tokens = own if tokens is None else tokens.unionByName(own)
    tokens = materialize(spark, tokens, "window-shingles")
    runs = _runs(docs, sizes)

    # one pass over the documents: every place of a benchmark shingle, and the words around it
    vocabulary = _bounded(tokens.select("shingle", "n").distinct(), broadcast_rows)
    # an outer generator: others would evaluate the runs in a filter too
    places = runs.select("_id", "_version", "_words", F.posexplode_outer("_runs").alias(
        "_at", "shingle")).join(vocabulary, "shingle").withColumn("_place", _position(sizes)).withColumn(
            "_from", F.greatest(F.col("_place") - longest, F.lit(0)))
    places = materialize(spark, places.select(
        "_id", "_version", "shingle", "_place", "_from", F.size("_words").alias("_size"),
        F.slice("_words", F.col("_from") + 1, F.lit(2 * longest)).alias("_near")), "shingle-places")
    seen = places.groupBy("shingle").agg(F.count("*").alias("count"))
    ranked = tokens.join(seen, "shingle", "left").withColumn(
        "count", F.coalesce("count", F.lit(0)))
    prefix = ranked.groupBy("window_key").agg(F.min(F.struct(
        "count", "offset", "shingle", "words")).alias("_rarest")).select(
            "window_key", "_rarest.*").filter("count > 0").drop("count")
    prefix = _bounded(materialize(spark, prefix, "window-prefix"), broadcast_rows)

    found = places.join(prefix, "shingle").withColumn("start", F.col("_place") - F.col("offset"))
    fits = (F.col("start") >= 0) & (F.col("start") + F.size("words") <= F.col("_size"))
    same = F.slice("_near", F.col("start") - F.col("_from") + 1, F.size("words")) == F.col("words")
    return found.filter(F.when(fits, same).otherwise(False)).select(
        "_id", "_version", "window_key", "start", (F.col("start") + F.size("words")).alias("end"))


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str,
          item_text_col: str, window: int, broadcast_rows: int) -> tuple[DataFrame, ...]:
    """The documents' words, the windows and the verified hits; the last two are stored."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).select(
        "_id", F.xxhash64("_text").alias("_version"), words_of("_text").alias("_words"))
    windows = materialize(spark, item_windows(items, item_col, item_text_col, window),
                          "item-windows")
    return read, windows, materialize(spark, window_hits(
        read, windows, broadcast_rows=broadcast_rows), "window-hits")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10,
               broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    _, _, hits = _hits(docs, items, id_col, text_col, item_col, item_text_col, window,
                       broadcast_rows)
    dirty = hits.select("_id", "_version").distinct()
    return docs.join(dirty, F.col(id_col).eqNullSafe(dirty["_id"])
                     & (F.xxhash64(whole(text_col)) == dirty["_version"]), "left_anti")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", *, window: int = 10,
                  broadcast_rows: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, ``item_ids`` (sorted strings) and ``hit_spans``."""
    read, windows, hits = _hits(docs, items, id_col, text_col, item_col, item_text_col, window,
                                broadcast_rows)
    spans = hits.groupBy("_id", "_version").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hit_spans"))
    owners = hits.select("_id", "_version", "window_key").distinct().join(
        windows.select("window_key", F.explode("items").alias("item")), "window_key").groupBy(
            "_id", "_version").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    found = spans.join(owners, [spans._id.eqNullSafe(owners._id),
                                spans._version == owners._version]).select(
        spans._id, spans._version, "hit_spans", "item_ids")
    covered = F.expr("""aggregate(hit_spans, named_struct('n', 0L, 'upto', 0),
      (a, s) -> named_struct('n', a.n + greatest(0, s.end - greatest(s.start, a.upto)),
                             'upto', greatest(a.upto, s.end)), a -> a.n)""")
    counted = read.select("_id", "_version", F.size("_words").cast("long").alias("n_words"))
    return counted.alias("d").join(
        found.alias("f"), F.col("d._id").eqNullSafe(F.col("f._id"))
        & (F.col("d._version") == F.col("f._version")), "left").select(
            F.col("d._id").alias(id_col), "n_words",
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("hit_spans", F.array().cast(
                "array<struct<start:int,end:int>>")).alias("hit_spans"))
