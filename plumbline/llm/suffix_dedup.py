"""Repeated byte strings by blockwise suffix construction with cover-sample ranks.

A suffix counts as repeated if its first ``length`` bytes also start elsewhere. The suffixes are cut
into buckets that one task can sort one at a time: a suffix belongs to the bucket of its anchor, the
``gram`` bytes with the smallest hash among its first ``length`` bytes. Equal suffixes have equal
anchors at equal distance, so they meet in one bucket, and only anchors that occur more than once
can hold repeats; the others leave after a count.

Within a bucket suffixes are aligned at the anchor. A difference cover only has to cover the
distances (modulo the period) at which two suffixes can still be equal; aligned at their anchors
that is distance 0, so the cover is the single residue 0 and the sample is every ``_PERIOD``-th
column. Sample suffixes are ranked first, by doubling. A suffix is then the few bytes before its
next sample column, that column's rank, and the few bytes after the ranked part; long ties are
settled by the rank alone and no string is compared byte by byte. Memory follows the block.

Anchors with more than ``bucket_rows`` occurrences would outgrow a task. For those every suffix is
hashed (128 bits) and counted with map-side sums, which needs no group in one place.

Cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing. Every row is a
document: rows that repeat id and text repeat each other, and a null id is an id. Matches may overlap
and may lie in one text, and never cross texts. An empty table gives an empty result. Only id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import whole
from plumbline.session import materialize

_PERIOD = 40
_BUFFER = 1 << 20  # bytes hashed at once
_BLOCK = 4096  # contexts after which the whole buckets gathered so far are sorted
_PLACE = np.uint64((1 << 22) - 1)  # low bits that hold a place in the buffer
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` bytes."""
    rng = np.random.default_rng(seed)
    code = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    factors = rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power, out, done, step, bit = code[data], None, 0, 1, 0
    while True:
        if size & step:
            if out is None:
                out = power
            else:
                count = max(len(data) - done - step + 1, 0)
                out = out[:count] * factors[32 + bit] + power[done:done + count]
            done += step
        if done == size:
            break
        power = power[:-step] * factors[bit] + power[step:] if len(power) > step else power[:0]
        step, bit = step * 2, bit + 1
    out = out ^ (out >> np.uint64(29))
    out *= _ODD
    return out ^ (out >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        values = np.minimum(values[:have - width], values[width - have:])
    return values


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hash, place, and first and last suffix of every anchor in texts that stand end to end."""
    nothing = (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    if len(data) < length:
        return nothing
    hashes = gram_hashes(data, gram, 1)
    keyed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    place = (sliding_min(keyed, length - gram + 1) & _PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    suffix = np.flatnonzero(np.cumsum(edge)[:len(place)] > 0)
    if not len(suffix):
        return nothing
    own = place[suffix]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(suffix) != 1)]))
    last = np.append(first[1:], len(suffix)) - 1
    return hashes[own[first]], own[first], suffix[first], suffix[last]


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts end to end: bytes, ends, and the text's number and offset for each piece.

    A text beyond a buffer comes in pieces that overlap by ``length - 1`` bytes.
    """
    parts, ends, rows, offsets, size = [], [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), _BUFFER):
            piece = text[at:at + _BUFFER + length - 1]
            parts.append(piece)
            size += len(piece)
            ends.append(size)
            rows.append(row)
            offsets.append(at)
            if size >= _BUFFER:
                yield (np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(rows),
                       np.array(offsets))
                parts, ends, rows, offsets, size = [], [], [], [], 0
    if parts:
        yield (np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(rows),
               np.array(offsets))


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _find_anchors(length: int, gram: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, rows, offsets in _buffers(_bytes(batch["_text"]), length):
                key, place, first, last = anchors(data, ends, length, gram)
                piece = np.searchsorted(ends, place, side="right")
                shift = offsets[piece] - np.concatenate([[0], ends])[piece]
                take = pa.array(rows[piece])
                yield pa.record_batch({
                    "_id": batch["_id"].take(take), "_version": batch["_version"].take(take),
                    "key": pa.array(key.view(np.int64)), "place": pa.array(place + shift),
                    "first": pa.array(first + shift), "last": pa.array(last + shift)})
    return find


def _classes(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers of the distinct rows of integer columns."""
    out = np.unique(columns[0], return_inverse=True)[1]
    for c in columns[1:]:
        other = np.unique(c, return_inverse=True)[1]
        out = np.unique(out * (int(other.max(initial=0)) + 1) + other, return_inverse=True)[1]
    return out


def repeated_suffixes(contexts: list[bytes], left: np.ndarray, count: np.ndarray, length: int,
                      gram: int) -> np.ndarray:
    """Which suffixes of aligned contexts repeat: a row per context, a column per suffix.

    Context i starts ``left[i]`` bytes before its anchor, and its first ``count[i]`` suffixes are
    asked for. Column j of the result is the suffix at the j-th aligned column.
    """
    reach, period = length - gram, _PERIOD
    blocks = length // period  # a suffix is `blocks - 1` whole periods and `period` bytes around
    if length % period:
        raise ValueError(f"length must be a multiple of {period}")
    width = -(-(reach + length) // period) * period + period
    rows = np.zeros((len(contexts), width), np.uint8)
    for i, (text, at) in enumerate(zip(contexts, left.tolist())):
        rows[i, reach - at:reach - at + len(text)] = np.frombuffer(text, np.uint8)
    low, high = reach - left, reach - left + count - 1  # first and last column asked for
    words = rows.reshape(len(rows), width // period, period).copy().view(np.uint64)
    cells = np.ascontiguousarray(words).reshape(-1, period // 8)
    one = _classes(*cells.T).reshape(len(rows), -1)
    # ranks of the sample suffixes' whole periods, by doubling
    rank, have, power, step = None, 0, one, 1
    while True:
        if (blocks - 1) & step:
            if rank is None:
                rank = power
            else:
                n = power.shape[1] - have
                rank = _classes(rank[:, :n].ravel(), power[:, have:].ravel()).reshape(len(rows), n)
            have += step
        if have == blocks - 1:
            break
        power = _classes(power[:, :-step].ravel(), power[:, step:].ravel()).reshape(
            len(rows), -1)
        step *= 2
    # an entry is a context at a sample column; shift d stands for the suffix d bytes before it
    row, col = np.nonzero((np.arange(rank.shape[1])[None, :] * period >= low[:, None]) & (
        np.arange(rank.shape[1])[None, :] * period - period + 1 <= high[:, None]))
    at = col * period
    from_d, to_d = np.maximum(at - high[row], 0), np.minimum(at - low[row], period - 1)
    after = col + blocks - 1
    fits = from_d <= to_d
    row, col, at, from_d, to_d, after = (x[fits] for x in (row, col, at, from_d, to_d, after))
    core = rank[row, col]
    before_cell = np.where(col > 0, one[row, col - 1], -1) + 1
    after_cell = one[row, np.minimum(after, one.shape[1] - 1)]
    group = _classes(core, before_cell, after_cell)
    groups = int(group.max(initial=-1)) + 1
    change = np.zeros((groups, period + 1), np.int32)
    np.add.at(change, (group, from_d), 1)
    np.add.at(change, (group, to_d + 1), -1)
    present = np.cumsum(change, axis=1)[:, :period]
    repeated = present >= 2
    # suffixes of different groups can be equal where only part of the bytes around differs
    head = np.zeros(groups, np.int64)
    head[group] = np.arange(len(group))
    core_of = core[head]
    open_groups = np.flatnonzero(np.bincount(core_of)[core_of] > 1)
    if len(open_groups):
        h = head[open_groups]
        lines, before_at, after_at = row[h], at[h] - 1, at[h] + (blocks - 1) * period
        tails = [np.zeros(len(h), np.int64)]
        for m in range(period):
            tails.append(_classes(tails[-1] * 256 + rows[lines, np.minimum(after_at + m, width - 1)]))
        heads = np.zeros(len(h), np.int64)
        for d in range(period):
            if d:
                heads = _classes(heads * 256 + rows[lines, np.maximum(before_at - d + 1, 0)])
            here = np.flatnonzero(present[open_groups, d] > 0)
            if not len(here):
                continue
            same = _classes(core_of[open_groups][here], heads[here], tails[period - d][here])
            both = np.bincount(same)[same] > 1
            repeated[open_groups[here[both]], d] = True
    out = np.zeros((len(rows), reach + 1), bool)
    for d in range(period):
        hit = (from_d <= d) & (d <= to_d) & repeated[group, d]
        out[row[hit], at[hit] - d] = True
    return out


def _runs(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last column of every run of neighbours in sorted (row, column) pairs."""
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(columns) != 1)]))
    closes = np.append(opens[1:], len(rows)) - 1
    return rows[opens], columns[opens], columns[closes]


def _spans(batch: pa.RecordBatch, rows: np.ndarray, first: np.ndarray,
           last: np.ndarray, length: int) -> pa.RecordBatch:
    take = pa.array(rows)
    return pa.record_batch({"_id": batch["_id"].take(take),
                            "_version": batch["_version"].take(take),
                            "start": pa.array(first, pa.int64()),
                            "end": pa.array(last + length, pa.int64())})


def _sort_buckets(length: int, gram: int, block: int):
    """Streams rows sorted by key; whole buckets are gathered into blocks."""
    def solve(rows: pa.Table) -> pa.RecordBatch:
        batch = rows.combine_chunks().to_batches()[0]
        place, first, last = (batch[c].to_numpy() for c in ("place", "first", "last"))
        found = repeated_suffixes(batch["context"].to_pylist(), place - first, last - first + 1,
                                  length, gram)
        row, col = np.nonzero(found)
        if not len(row):
            return _spans(batch, row, row, row, length)
        row, begin, end = _runs(row, col)
        shift = place[row] - (length - gram)
        return _spans(batch, row, begin + shift, end + shift, length)

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= block:
                table = pa.Table.from_batches(held)
                keys = table["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = len(table) - cut
        if size:
            yield solve(pa.Table.from_batches(held))

    return sort


def _located(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[dict]]]:
    for i, (text, found) in enumerate(zip(_bytes(batch["_text"]), batch["anchors"].to_pylist())):
        yield i, text, found


def _cut_contexts(length: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, texts = [], [], []
            for i, text, own in _located(batch):
                for a in own:
                    rows.append(i)
                    found.append(a)
                    texts.append(text[a["first"]:a["last"] + length])
            take = pa.array(rows, pa.int64())
            yield pa.record_batch({
                "_id": batch["_id"].take(take), "_version": batch["_version"].take(take),
                **{c: pa.array([a[c] for a in found], pa.int64())
                   for c in ("key", "place", "first", "last")},
                "context": pa.array(texts, pa.binary())})
    return cut


def _hash_suffixes(length: int):
    """Every suffix of the anchors given, as a 128-bit hash."""
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, firsts, parts = [], [], []
            for i, text, own in _located(batch):
                for a in own:
                    rows.append(i)
                    firsts.append(a["first"])
                    parts.append(text[a["first"]:a["last"] + length])
            for data, ends, part, offset in _buffers(parts, length):
                starts = np.concatenate([[0], ends[:-1]])
                sizes = ends - starts - length + 1
                at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                owner = np.repeat(part, sizes)
                begin = np.array(firsts)[owner] + at - np.repeat(starts, sizes) + np.repeat(
                    offset, sizes)
                take = pa.array(np.array(rows)[owner])
                yield pa.record_batch({
                    "_id": batch["_id"].take(take), "_version": batch["_version"].take(take),
                    "start": pa.array(begin, pa.int64()),
                    "h1": pa.array(gram_hashes(data, length, 2)[at].view(np.int64)),
                    "h2": pa.array(gram_hashes(data, length, 3)[at].view(np.int64))})
    return hashed


def repeated_spans(docs: DataFrame, length: int = 400, *, gram: int = 64,
                   bucket_rows: int = 16_384) -> DataFrame:
    """``_id``, ``_version``, ``start``, ``end``: bytes under repeated strings, spans may overlap.

    ``docs`` has ``_id``, ``_version`` (a hash of the text) and ``_text``.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["_id"]
    ids = f"_id {kind}, _version long"
    found = materialize(spark, docs.mapInArrow(
        _find_anchors(length, gram), f"{ids}, key long, place long, first long, last long"),
        "anchors")
    counts = materialize(spark, found.groupBy("key").agg(F.count("*").alias("rows")).filter(
        "rows > 1"), "anchor-counts")

    def located(few: bool) -> DataFrame:
        """Texts with their anchors in buckets of few or many rows."""
        own = found.join(counts.filter((F.col("rows") <= bucket_rows) == few).select("key"), "key")
        by_text = own.groupBy("_id", "_version").agg(F.collect_set(F.struct(
            "key", "place", "first", "last")).alias("anchors"))
        return docs.alias("d").join(by_text.alias("a"), F.col("d._id").eqNullSafe(F.col("a._id"))
                                    & (F.col("d._version") == F.col("a._version"))).select(
            "d._id", "d._version", "d._text", "a.anchors")

    contexts = located(True).mapInArrow(
        _cut_contexts(length), f"{ids}, key long, place long, first long, last long, context binary")
    spans = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(
        _sort_buckets(length, gram, min(_BLOCK, bucket_rows)), f"{ids}, start long, end long")
    if counts.filter(F.col("rows") > bucket_rows).isEmpty():
        return spans
    hashes = located(False).mapInArrow(_hash_suffixes(length),
                                       f"{ids}, start long, h1 long, h2 long")
    twice = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # a third key makes the counts travel once more; then both sides of the join are plain and a
    # hot hash's rows can be split
    third = F.col("h1").bitwiseXOR(F.col("h2")).alias("h3")
    many = hashes.select("*", third).join(twice.select("*", third), ["h1", "h2", "h3"]).select(
        "_id", "_version", "start", (F.col("start") + length).alias("end"))
    return spans.unionByName(many)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge spans and cut them out."""
    for batch in batches:
        merged, kept = [], []
        for text, copies, spans in zip(_bytes(batch["_text"]), batch["copies"].to_pylist(),
                                       batch["spans"].to_pylist()):
            if copies > 1 and len(text) >= batch["length"][0].as_py():
                spans = [{"start": 0, "end": len(text)}]
            out: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans or []):
                if out and s[0] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], s[1])
                else:
                    out.append(list(s))
            edges = [0, *(e for s in out for e in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            merged.append([{"start": a, "end": b} for a, b in out])
        yield pa.record_batch({
            "_id": batch["_id"], "n_bytes": pa.array([len(t) for t in _bytes(batch["_text"])],
                                                     pa.int64()),
            "removed": pa.array(merged, pa.list_(pa.struct([("start", pa.int64()),
                                                            ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary())})


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                length: int = 400, gram: int = 64, bucket_rows: int = 16_384) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, ``removed`` spans and the ``kept`` bytes."""
    read = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).select(
        "_id", F.xxhash64("_text").alias("_version"), "_text")
    spans = repeated_spans(read, length, gram=gram, bucket_rows=bucket_rows)
    by_text = spans.groupBy("_id", "_version").agg(F.collect_set(F.struct("start", "end")).alias(
        "spans"))
    copies = read.groupBy("_id", "_version").agg(F.count("*").alias("copies")).filter("copies > 1")
    d, s, c = read.alias("d"), by_text.alias("s"), copies.alias("c")

    def same(a: str, b: str):
        return F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (
            F.col(f"{a}._version") == F.col(f"{b}._version"))

    told = s.join(c, same("s", "c"), "full").select(
        F.coalesce("s._id", "c._id").alias("_id"),
        F.coalesce("s._version", "c._version").alias("_version"), "spans", "copies").alias("t")
    joined = d.join(told, same("d", "t"), "left").select(
        "d._id", "_text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        "spans", F.lit(length).alias("length"))
    return joined.mapInArrow(_cut, f"_id {dict(read.dtypes)['_id']}, n_bytes long, removed "
                                   "array<struct<start:long,end:long>>, kept binary").withColumnRenamed(
        "_id", id_col)
