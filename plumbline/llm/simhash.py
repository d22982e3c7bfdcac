"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint bit is the majority of that bit over the hashes of all word shingles. Distinct
fingerprints within ``radius`` bits agree on all but ``radius`` of ``radius + 2`` equal parts of
their 64 bits, so each is filed once under every pair of parts and compared inside those bins only.
A bin that outgrows a block is filed again: its fingerprints must also agree on one of
``radius + 1`` parts of the bits still free, which loses no pair and ends because distinct
fingerprints run out of common bits. So no bin has to fit a task whole.

In a block, bit planes are stored vertically: plane j holds bit j of every fingerprint, one lane
each, in sorted bins. Shifting all planes by s lanes lines every fingerprint up with its s-th
neighbour. XOR marks differing lanes, and counters that carry bit by bit add them up for all lanes
at once. As soon as no lane of a bin is within the radius the shift is abandoned. A block gives a
spanning set of its links, from which components follow.

Cases: null and empty texts have no word and fingerprint zero, which links like any other. Rows
with equal texts have equal fingerprints and one component. A row with a null id gets a fingerprint
and a component but names none, unless all rows of the component lack an id. An empty table gives
an empty result. Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.text import whole
from plumbline.session import materialize

BITS = 64
_CHUNK = 1 << 15  # shingles whose bits are unpacked at once
_LOT = 1 << 21  # shingles of the documents that a task compares exactly


def fingerprint(text: str, shingle: int) -> int:
    """Bitwise majority of the shingles' XXH64; zero without words."""
    ones, count = np.zeros(BITS, np.int64), 0
    for hashes in _shingle_hashes(text, shingle):
        count += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    major = (ones * 2 > count).astype(np.uint8)
    return int.from_bytes(np.packbits(major, bitorder="little").tobytes(), "little")


def _shingle_hashes(text: str, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, in chunks; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    runs = [words[i:] for i in range(min(shingle, len(words)))]
    shingles, digest = map(b" ".join, zip(*runs)), xxhash.xxh64_intdigest
    while True:
        hashes = np.fromiter((digest(s, seed) for _, s in zip(range(_CHUNK), shingles)), np.uint64)
        if not len(hashes):
            return
        yield hashes


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``_id`` and ``fp``, the fingerprint as a signed long, of every row."""
    read = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch["_text"]], np.uint64)
            yield pa.record_batch({"_id": batch["_id"], "fp": pa.array(found.view(np.int64))})

    return read.mapInArrow(hashed, f"_id {dict(read.dtypes)['_id']}, fp long")


def _parts(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` in ``parts`` runs, each as a mask."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    cuts = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _bins(fps: DataFrame, radius: int) -> DataFrame:
    """Every fingerprint under each pair of parts: ``mask``, ``bin`` and ``fp``."""
    parts = _parts((1 << BITS) - 1, radius + 2)
    masks = [_signed(a | b) for a, b in combinations(parts, 2)]
    return fps.select(F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"), "fp").select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bin"), "fp")


def _finer(bins: DataFrame, radius: int) -> DataFrame:
    """The same fingerprints under their mask and one of ``radius + 1`` parts of the free bits."""
    masks = [r["mask"] for r in bins.select("mask").distinct().collect()]  # a few per round
    finer = F.create_map(*[F.lit(x) for m in masks for x in (
        m, [_signed((m % (1 << BITS)) | p) for p in _parts(~m % (1 << BITS), radius + 1)])])
    return bins.select(F.explode(finer[F.col("mask")]).alias("mask"), "fp").select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bin"), "fp").distinct()


def lanes_within(planes: list[int], shift: int, lanes: int, radius: int) -> int:
    """Which of ``lanes`` differ by at most ``radius`` bits from the lane ``shift`` further on.

    ``planes`` and ``lanes`` are bit vectors, lane i in bit i; so is the result.
    """
    counters = [0] * (radius + 1).bit_length()
    alive = lanes
    for j, plane in enumerate(planes):
        carry = (plane ^ (plane >> shift)) & alive
        for k, counter in enumerate(counters):
            counters[k], carry = counter ^ carry, counter & carry
            if not carry:
                break
        if j >= radius:
            over, equal = 0, alive  # compare the counters with the radius from the top bit down
            for k in reversed(range(len(counters))):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    over |= equal & counters[k]
                    equal &= ~counters[k]
            alive &= ~over  # lanes beyond the radius stop counting, so counters cannot overflow
            if not alive:
                return 0
    return alive


def _bit_vector(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def block_links(fps: np.ndarray, bins: np.ndarray, radius: int,
                confirm: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as pairs of rows) that span the near fingerprints of each bin.

    ``fps`` has a fingerprint's bytes per row; ``bins`` numbers the bins from 0 in sorted order.
    With ``confirm`` a near pair is a link only if that holds for its rows.
    """
    count = len(fps)
    bits = np.unpackbits(fps, axis=1, bitorder="little")
    root = np.arange(count)
    lefts, rights = [], []
    here, shift = np.arange(count), 0
    planes: list[int] = []
    while True:
        shift += 1
        here_next = here[(here + shift < count)]
        here_next = here_next[bins[here_next] == bins[here_next + shift]]
        if not len(here_next):
            break
        if shift == 1 or len(here_next) < len(here) // 2:  # leave out the lanes of small bins
            sizes = np.bincount(bins)
            kept = np.flatnonzero(sizes[bins] > shift)
            planes = [_bit_vector(bits[kept, j]) for j in range(bits.shape[1])]
            place = np.searchsorted(kept, here_next)
            lane_rows = kept
        else:
            place = np.searchsorted(lane_rows, here_next)
        here = here_next
        flags = np.zeros(len(lane_rows), np.uint8)
        flags[place] = root[here_next] != root[here_next + shift]  # linked lanes need no test
        near = lanes_within(planes, shift, _bit_vector(flags), radius)
        if not near:
            continue
        raw = np.frombuffer(near.to_bytes((len(lane_rows) + 7) // 8, "little"), np.uint8)
        found = lane_rows[np.flatnonzero(np.unpackbits(raw, bitorder="little")[:len(lane_rows)])]
        for i in found:
            a, b = root[i], root[i + shift]
            if a != b and (confirm is None or confirm(i, i + shift)):
                low, high = (a, b) if a < b else (b, a)
                start, end = np.searchsorted(bins, [bins[i], bins[i] + 1])
                own = root[start:end]
                own[own == high] = low
                lefts.append(i)
                rights.append(i + shift)
    return np.array(lefts, np.int64), np.array(rights, np.int64)


def _compare(keys: list[str], radius: int, block: int, kind: pa.DataType, name: str = "fp",
             similarity: float | None = None):
    """Streams rows sorted by ``keys`` and compares whole bins, as many as fill a block.

    The links are pairs of ``name``. With ``similarity`` the rows' ``shingles`` decide on them.
    """
    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(rows: pa.Table) -> np.ndarray:
            key = np.column_stack([rows[c].to_numpy() for c in keys])
            return np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1

        def emit(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            numbers = np.zeros(len(rows), np.int64)
            numbers[ends] = 1
            fps = rows["fp"].combine_chunks()
            if pa.types.is_binary(kind):
                raw = np.frombuffer(b"".join(fps.to_pylist()), np.uint8)
            else:
                raw = fps.to_numpy().view(np.uint8)
            confirm = None
            if similarity is not None:
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
                confirm = lambda i, j: similar(sets[i], sets[j], similarity)
            left, right = block_links(raw.reshape(len(rows), -1), np.cumsum(numbers), radius, confirm)
            names = rows[name].combine_chunks()
            return pa.record_batch({"a": names.take(pa.array(left)), "b": names.take(pa.array(right))})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= block or sum(b.nbytes for b in held) >= 16 * _LOT:
                rows = pa.Table.from_batches(held)
                ends = edges(rows)
                if len(ends):
                    yield emit(rows.slice(0, ends[-1]), ends[:-1])
                    rows = rows.slice(ends[-1])
                held = rows.to_batches()
        if held and sum(map(len, held)):
            rows = pa.Table.from_batches(held)
            yield emit(rows, edges(rows))

    return links


def fingerprint_links(fps: DataFrame, radius: int, *, block: int = 8192) -> DataFrame:
    """Links ``a``, ``b`` that span all distinct fingerprints within ``radius`` bits."""
    spark = fps.sparkSession
    bins = materialize(spark, _bins(fps.select("fp").distinct(), radius), "fingerprint-bins")
    found = None
    while True:
        sizes = materialize(spark, bins.groupBy("mask", "bin").agg(F.count("*").alias("size")).filter(
            "size > 1"), "bin-sizes")
        small = bins.join(sizes.filter(F.col("size") <= block).drop("size"), ["mask", "bin"])
        links = small.repartition("mask", "bin").sortWithinPartitions("mask", "bin", "fp").mapInArrow(
            _compare(["mask", "bin"], radius, block, pa.int64()), "a long, b long")
        found = links if found is None else found.unionByName(links)
        large = sizes.filter(F.col("size") > block)
        if large.isEmpty():
            return found
        bins = materialize(spark, _finer(bins.join(large.drop("size"), ["mask", "bin"]), radius),
                           "fingerprint-bins")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    shingle: int = 3, radius: int = 2) -> DataFrame:
    """Per row of ``docs``: id, ``fingerprint`` (hex) and ``component_id``, its smallest id."""
    spark = docs.sparkSession
    rows = materialize(spark, fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("_id").alias("least"))
    linked = components(fingerprint_links(rows, radius))
    rooted = first.join(linked, first.fp == linked.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another hash from a hash, by a multiply and shift mix."""
    out = (hashes + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(
        0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    found = list(_shingle_hashes(text, shingle))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def similar(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity at least."""
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if not len(small) or len(small) / len(large) < similarity:
        return len(small) == len(large)
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = np.count_nonzero(large[place] == small)
    return common / (len(small) + len(large) - common) >= similarity


def wide_sketch(shingles: np.ndarray, words: int, pairs: int) -> tuple[bytes, list[int]]:
    """A fingerprint of ``words`` 64-bit words and ``pairs`` bin keys of a shingle set.

    A bin key hashes two shingles with the smallest hashes, so documents meet in a bin with the
    square of their shingle sets' similarity, and in one of many bins almost surely.
    """
    ones = np.zeros(words * BITS, np.int64)
    least = np.full(2 * pairs, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(shingles), 4096):
        some = shingles[begin:begin + 4096]
        wide = np.column_stack([_mixed(some, k) for k in range(words)])
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        for k in range(2 * pairs):
            least[k] = min(least[k], _mixed(some, words + k).min())
    major = np.packbits((ones * 2 > len(shingles)).astype(np.uint8), bitorder="little").tobytes()
    keys = _mixed(least[::2] ^ (least[1::2] >> np.uint64(1)), 99)
    return major, keys.view(np.int64).tolist()


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits expected of two shingle sets with that Jaccard similarity, and six deviations.

    Sets of four and five shingles differ by 19 % of the bits in place of 15 %; the margin is for them
    too.
    """
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(cosine) / math.pi
    return round(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def _in_lots(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows by ``keys`` and a pair of lots: of ``parts`` lots, lot i meets j under (low, high)."""
    lot = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return rows.withColumn("lot", lot).select(*keys, *columns, F.explode(F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(F.least("lot", j).alias("low"), F.greatest("lot", j).alias("high")))
    ).alias("pair")).select(*keys, "pair.low", "pair.high", *columns).repartition(
        *keys, "low", "high").sortWithinPartitions(*keys, "low", "high", "node")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  shingle: int = 5, similarity: float = 0.8, words: int = 8, pairs: int = 12,
                  block: int = 8192) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the smallest id stays.

    Two documents are linked if the sets of their shingles' hashes have the similarity. Wide
    fingerprints only choose which documents are compared: those within a radius that similar sets
    exceed hardly ever are chained to clusters, and within a cluster sets are compared exactly, also
    of documents that shared no bin. Bins and clusters beyond a block are cut in lots, and each pair
    of lots is a bin of its own. Of rows that repeat id and text one stays; a null id is larger than
    any other. All columns are kept.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).withColumn(
        "_version", F.xxhash64("_text"))

    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch["_text"]:
                own = shingle_set(t.as_py(), shingle)
                found.append((xxhash.xxh3_128_digest(own.tobytes()), len(own),
                              *wide_sketch(own, words, pairs)))
            yield pa.record_batch({"_id": batch["_id"], "_version": batch["_version"],
                                   "node": pa.array([f[0] for f in found], pa.binary()),
                                   "size": pa.array([f[1] for f in found], pa.int64()),
                                   "fp": pa.array([f[2] for f in found], pa.binary()),
                                   "keys": pa.array([f[3] for f in found], pa.list_(pa.int64()))})

    rows = materialize(spark, read.mapInArrow(
        sketched, f"_id {dict(read.dtypes)['_id']}, _version long, node binary, size long, "
        "fp binary, keys array<long>"), "sketches")  # a node is a digest of the set
    bins = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("keys").alias("keys")).select(
        "node", "fp", F.posexplode("keys").alias("part", "key"))
    sizes = bins.groupBy("part", "key").agg(F.count("*").alias("rows")).filter("rows > 1").select(
        "part", "key", F.ceil(F.col("rows") / block).cast("int").alias("parts"))
    radius = radius_for(similarity, words * BITS)
    near = components(_in_lots(bins.join(sizes, ["part", "key"]), ["part", "key"], [
        "node", "fp"]).mapInArrow(_compare(["part", "key", "low", "high"], radius, block,
                                           pa.binary(), "node"), "a binary, b binary"))

    best = F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_version"))
    first = rows.groupBy("node").agg(best.alias("best"), F.min("fp").alias("fp"),
                                     F.min("size").alias("size"))
    members = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(spark, members.join(first, "node").select(
        F.xxhash64("root").alias("cluster"), "node", "fp", "size", F.col("best._id").alias("_own"),
        F.col("best._version").alias("_its")), "near-documents")
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / _LOT, F.lit(1))).cast("int")
    members = members.join(members.groupBy("cluster").agg(parts.alias("parts")), "cluster")
    texts = read.join(members, read["_id"].eqNullSafe(members["_own"])
                      & (read["_version"] == members["_its"])).select(
        "cluster", "node", "fp", "parts", "_text").dropDuplicates(["node"])

    def in_full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle).tobytes() for t in batch["_text"]]
            yield pa.record_batch({c: batch[c] for c in ("cluster", "node", "fp", "parts")} | {
                "shingles": pa.array(found, pa.binary())})

    sets = texts.mapInArrow(
        in_full, "cluster long, node binary, fp binary, parts int, shingles binary")
    linked = components(_in_lots(sets, ["cluster"], ["node", "fp", "shingles"]).mapInArrow(
        _compare(["cluster", "low", "high"], radius, block, pa.binary(), "node", similarity),
        "a binary, b binary"))
    staying = first.join(linked, "node", "left").groupBy(
        F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(
            "best._id", "best._version")
    staying = materialize(spark, staying, "staying")
    marked = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(
        whole(text_col)).alias("_its"))
    kept = marked.join(staying, marked["_own"].eqNullSafe(staying["_id"])
                       & (marked["_its"] == staying["_version"]), "left_semi")
    again = rows.groupBy("_id", "_version").count().filter("count > 1")
    if again.isEmpty():
        return kept.select("_row.*")
    again = materialize(spark, again, "repeated-rows")
    same = kept["_own"].eqNullSafe(again["_id"]) & (kept["_its"] == again["_version"])
    return kept.join(again, same, "left_anti").unionByName(kept.join(
        again, same, "left_semi").dropDuplicates(["_own", "_its"])).select("_row.*")
