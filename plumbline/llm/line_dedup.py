"""Line deduplication that returns keep bitmaps, not text.

Lines become 128-bit hashes. The hashes are range-partitioned together with the document, so that a
line which fills a third of all rows lies in as many ranges as its share asks for, and are sorted
by document and position. Each range streams the first occurrence of a line in each document and
leaves one row per line key: its first place and its number of documents. Those rows add up to one
verdict per key. Verdicts go
back to the lines, and lines that go become 64-bit words of a bitmap.

Cases: null and empty texts are one empty line. A document is an (id, text) pair, so repeated rows
count once and get the same bitmap; different texts under one id are separate documents, and a null
id is an id. Of lines tied for first place there are none, as (id, text, position) is unique.
An empty table gives an empty result, and columns other than id and text are neither read nor
returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import BLANKS, ascii_lower, whole
from plumbline.session import materialize


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole(text_col)
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"),
                       F.xxhash64(text).alias("_version"))


def _lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that can go: its place and the two halves of its key's hash."""
    keys = F.transform(F.split(ascii_lower(F.col("_text")), "\n", -1),
                       lambda line: F.btrim(line, F.lit(BLANKS)))
    # an outer generator, as others would evaluate the keys in a filter too
    lines = documents.select("_id", "_version", F.posexplode_outer(keys).alias("_pos", "_key"))
    return lines.filter(F.char_length("_key") >= min_chars).select(
        F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second half"), "_key").alias("_h2"),
        "_id", "_version", "_pos")


def line_verdicts(lines: DataFrame, min_docs: int) -> DataFrame:
    """One row per line key found in at least ``min_docs`` documents, with its first place."""
    ranged = lines.repartitionByRange("_h1", "_h2", "_id", "_version").sortWithinPartitions(
        "_h1", "_h2", "_id", "_version", "_pos")
    # partitioning and order are those of the ranges, so first occurrences stream by
    nth = F.row_number().over(Window.partitionBy("_h1", "_h2", "_id", "_version").orderBy("_pos"))
    return ranged.withColumn("_nth", nth).filter("_nth = 1").groupBy("_h1", "_h2").agg(
        F.count("*").alias("_docs"), F.min(F.struct("_id", "_version", "_pos")).alias(
            "_first")).filter(F.col("_docs") >= min_docs)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """Per document that loses lines: ``_id``, ``_version`` and its ``keep_bitmap``.

    The bitmap is sparse: sorted (word, bits) pairs, where bit ``p % 64`` of word ``p // 64`` says
    whether line ``p`` stays. Words whose lines all stay are left out. With ``keep_first`` the
    first occurrence over the whole table stays, without it every occurrence goes.
    """
    lines = _lines(_documents(docs, id_col, text_col), min_chars)
    # stored, so that both sides of the join are plain and a hot key's rows can be split
    verdicts = materialize(docs.sparkSession, line_verdicts(lines, min_docs), "line-verdicts")
    gone = lines.join(verdicts, ["_h1", "_h2"])
    if keep_first:
        gone = gone.filter(~F.struct("_id", "_version", "_pos").eqNullSafe(F.col("_first")))
    words = gone.groupBy("_id", "_version", F.expr("_pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_pos % 64 as int))")).alias("_gone"))
    return words.groupBy("_id", "_version").agg(F.array_sort(F.collect_list(F.struct(
        "word", F.bitwise_not("_gone").alias("bits")))).alias("keep_bitmap"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                        min_docs: int = 2, min_chars: int = 1,
                        keep_first: bool = True) -> DataFrame:
    """Per row of ``docs``: id, n_lines, n_dropped, keep_bitmap and the kept text ``kept``."""
    documents = _documents(docs, id_col, text_col)
    bitmaps = line_bitmaps(docs, id_col, text_col, min_docs=min_docs, min_chars=min_chars,
                           keep_first=keep_first)
    same = (F.col("d._id").eqNullSafe(F.col("b._id"))
            & (F.col("d._version") == F.col("b._version")))
    both = documents.alias("d").join(bitmaps.alias("b"), same, "left").select(
        "d._id", "_text", "keep_bitmap")
    # one 64-bit word per 64 lines, so that a line finds its bit at once
    dense = F.expr("""transform(sequence(0, (n_lines - 1) div 64),
      w -> coalesce(element_at(map_from_entries(keep_bitmap), cast(w AS int)), -1L))""")
    stays = F.expr("""array_join(filter(split(_text, '\\n', -1), (line, p) ->
      shiftright(get(_bits, p div 64), cast(p % 64 AS int)) & 1 = 1), '\\n')""")
    breaks = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit("")))
    out = both.withColumn("n_lines", (breaks + 1).cast("long")).withColumn(
        "_bits", F.when(F.col("keep_bitmap").isNotNull(), dense))
    dropped = F.expr("aggregate(keep_bitmap, 0L, (n, w) -> n + bit_count(~w.bits))")
    return out.select(
        F.col("_id").alias(id_col), "n_lines",
        F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"), "keep_bitmap",
        F.when(F.col("_bits").isNull(), F.col("_text")).otherwise(stays).alias("kept"))
