"""Dataset manifests: counts, leakage, fingerprints, group splits and duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.maps import bind
from plumbline.session import materialize

SPLITS = ("train", "validation", "test")


def split_counts(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files per split and label, and how many have a mask."""
    def count(split: str, label: str) -> Column:
        return F.count_if((F.col("split") == split) & (F.col("label") == label))

    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("images_total"),
        count("train", "normal").alias("train_normal"),
        count("validation", "normal").alias("validation_normal"),
        count("validation", "anomaly").alias("validation_anomaly"),
        count("test", "normal").alias("test_normal"),
        count("test", "anomaly").alias("test_anomaly"),
        F.count("mask_path").alias("masks"))


def leakage_audit(files: DataFrame, dataset: str, sha: str, source: str, name: str,
                  split: str = "split") -> DataFrame:
    """Hashes, sources and normalized names that occur in more than one split.

    One shuffle for all three kinds; a set of splits has at most three entries, so a key with a
    third of all rows stays a three-entry set on every map task. A missing hash, source or name is
    shared by nobody.
    """
    kinds = F.array(
        F.struct(F.lit("content_hash").alias("kind"), F.col(sha).alias("key")),
        F.struct(F.lit("source_identity").alias("kind"), F.col(source).alias("key")),
        F.struct(F.lit("normalized_name").alias("kind"), F.col(name).alias("key")))
    return (
        files.select(dataset, split, F.explode(kinds).alias("_k"))
        .where(F.col("_k.key").isNotNull())
        .groupBy(dataset, F.col("_k.kind").alias("kind"), F.col("_k.key").alias("key"))
        .agg(F.sort_array(F.collect_set(split)).alias("splits"))
        .where(F.size("splits") > 1))


def leakage_status(files: DataFrame, audit: DataFrame, dataset: str) -> DataFrame:
    """PASS or FAIL per dataset; shared names alone do not fail a dataset."""
    found = audit.groupBy(dataset).agg(
        F.count_if(F.col("kind") == "content_hash").alias("hash_collisions"),
        F.count_if(F.col("kind") == "source_identity").alias("source_collisions"),
        F.count_if(F.col("kind") == "normalized_name").alias("name_collisions"))
    cols = ["hash_collisions", "source_collisions", "name_collisions"]
    out = files.select(dataset).distinct().join(found, dataset, "left").select(
        dataset, *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    bad = (F.col("hash_collisions") > 0) | (F.col("source_collisions") > 0)
    return out.withColumn("status", F.when(bad, "FAIL").otherwise("PASS"))


def require_no_leakage(audit: DataFrame) -> None:
    if audit.where(F.col("kind") != "normalized_name").limit(1).count():
        raise ValueError("the same content or source occurs in more than one split")


def shared_between_splits(files: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that two splits have in common, one row per pair of splits: one aggregation."""
    found = files.where(F.col(split).isin(*SPLITS)).groupBy(key).agg(
        F.collect_set(split).alias("_in"))  # three entries at most
    pairs = F.array(*[F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"))
                      for a, b in combinations(SPLITS, 2)])
    both = F.filter(pairs, lambda p: F.array_contains(F.col("_in"), p["split_a"])
                    & F.array_contains(F.col("_in"), p["split_b"]))
    return found.select(F.explode(both).alias("_p"), key).select("_p.split_a", "_p.split_b", key)


def set_fingerprint(rows: DataFrame, keys: Sequence[str], columns: Sequence[str],
                    header: Sequence[str] = ()) -> DataFrame:
    """Order-free SHA-256 fingerprint of a multiset of rows per key.

    Equal rows are counted first. Row hashes hang in a tree: those that share their first eight
    hex digits, sorted, are hashed together, then the groups that share four digits, then all. A
    node has 65,536 children at most and a leaf few rows, so no key gathers in one task and no sum
    can be forged. ``header`` columns describe the set and are hashed in at the end.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    group = list(dict.fromkeys([*keys, *header]))
    node = rows.select(*group, row.alias("_h")).groupBy(*group, "_h").agg(
        F.count(F.lit(1)).alias("_n"))
    node = node.select(*group, F.col("_h").alias("_at"), "_n", F.concat_ws(
        ":", "_h", F.col("_n").cast("string")).alias("_t"))
    for digits in (8, 4, 0):
        joined = F.array_join(F.array_sort(F.collect_list("_t")), ",")
        node = node.groupBy(*group, F.substring("_at", 1, digits).alias("_at")).agg(
            F.sum("_n").alias("_n"), F.sha2(joined, 256).alias("_t"))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in header],
                       F.col("_n").cast("string"), "_t")
    return node.select(*group, F.col("_n").alias("n_rows"), F.sha2(text, 256).alias("fingerprint"))


def config_hash(text: Column) -> Column:
    """SHA-256 of a JSON document in compact form with sorted keys, at every level."""
    # the variant encoding stores object fields in key order
    return F.sha2(F.to_json(F.parse_json(text)), 256)


def average_hash(pixels: Column, height: int, width: int, size: int = 8) -> Column:
    """Perceptual hash: one bit per block mean that reaches the overall mean, as hex digits.

    ``pixels`` is a row-major array whose sides are multiples of ``size``.
    """
    if height % size or width % size or (size * size) % 4:
        raise ValueError("image sides must be multiples of the hash size")
    bh, bw = height // size, width // size

    def block_mean(px: Column, b: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(bh * bw - 1)), F.lit(0.0),
            lambda acc, i: acc + F.get(px, (
                (F.floor(b / size) * bh + F.floor(i / bw)) * width
                + (b % size) * bw + i % bw).cast("int")).cast("double")) / (bh * bw)

    def block_means(px: Column) -> Column:
        if bh == bw == 1:
            return F.transform(px, lambda v: v.cast("double"))
        return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)),
                           lambda b: block_mean(px, b))

    def to_bits(blocks: Column) -> Column:
        mean = F.aggregate(blocks, F.lit(0.0), lambda a, v: a + v) / (size * size)
        return bind(mean, lambda m: F.array_join(F.transform(
            blocks, lambda v: F.when(v >= m, "1").otherwise("0")), ""))

    bits = bind(pixels, lambda px: bind(block_means(px), to_bits))
    return bind(bits, lambda text: F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(size * size // 4 - 1)),
        lambda i: F.lower(F.conv(F.substring(text, i * 4 + 1, F.lit(4)), 2, 16))), ""))


def hash_groups(df: DataFrame, item: str, digest: str) -> DataFrame:
    """One row per distinct hash: least item id and number of copies."""
    return df.groupBy(F.col(digest).alias("hash")).agg(
        F.min(item).alias("item"), F.count(F.lit(1)).alias("copies"))


def _filed(rows: DataFrame, segments: int, hot_rows: int) -> DataFrame:
    """Rows of (choice, key) bins, hot bins filed again under one more segment of their ``rest``.

    ``skipped`` collects the segments before the one that joined a key: a pair that shares one of those
    meets in that segment's bin.
    """
    def cut(name: str, i: str) -> str:
        start, end = f"int({i} * length({name}) div {segments})", f"int(({i} + 1) * length({name}) div {segments})"
        return f"substring({name}, {start} + 1, {end} - {start})"

    def outside(name: str, i: str) -> str:
        start, end = f"int({i} * length({name}) div {segments})", f"int(({i} + 1) * length({name}) div {segments})"
        return f"concat(substring({name}, 1, {start}), substring({name}, {end} + 1))"

    again = f"""inline(transform(sequence(0, {segments - 1}), i -> struct(
        concat(key, '/', i, ':', {cut("rest", "i")}) AS key, {outside("rest", "i")} AS rest,
        concat(skipped, transform(filter(sequence(0, {segments - 1}), j -> j < i), j -> {cut("rest", "j")}))
          AS skipped)))"""
    done = None
    while True:
        hot = rows.where(f"length(rest) >= {segments}").groupBy("choice", "key").agg(
            F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select("choice", "key")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        hot = materialize(rows.sparkSession, hot, "hot-keys")
        cold = rows.join(hot, ["choice", "key"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        rows = materialize(rows.sparkSession, rows.join(hot, ["choice", "key"], "left_semi").selectExpr(
            "hash", "item", "copies", "choice", again), "filed-again")


def near_duplicates(groups: DataFrame, max_distance: int = 3, blocks: int | None = None,
                    digits: int = 16, hot_rows: int = 10_000) -> DataFrame:
    """Pairs of distinct hashes at most ``max_distance`` bits apart.

    Equal hashes were folded by :func:`hash_groups`, so copies never pair with each other. A hash
    is cut into blocks; two hashes within d bits agree on at least blocks - d of them, so every
    choice of that many blocks is one join key (Manku et al. 2007). With 6 blocks and d = 3 a key
    has about 32 of the 64 bits.

    Hashes of a key that more than ``hot_rows`` share are filed again, as often as needed: the digits
    outside the key fall into d + 1 segments, of which a close pair shares at least one, so each
    segment in turn joins the key. That ends where fewer than d + 1 digits are left, when a key is
    shared by 16 ** d hashes at most. A pair that agrees in several ways is kept for the first way
    only, which needs no distinct afterwards. No pair is lost by any step.
    """
    d = max_distance
    blocks = blocks or min(digits, 2 * d)
    if not 0 < d < blocks <= digits:
        raise ValueError("need max_distance < blocks <= digits")
    edges = [round(i * digits / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - d))

    def cut(name: str, b: int) -> str:
        return f"substring({name}, {edges[b] + 1}, {edges[b + 1] - edges[b]})"

    def joined(parts: list[str]) -> str:
        return f"concat({', '.join(parts)})"

    keys = ", ".join(
        f"struct({i} AS choice, {joined([cut('hash', b) for b in choice])} AS key, "
        f"{joined([cut('hash', b) for b in range(blocks) if b not in choice])} AS rest)"
        for i, choice in enumerate(choices))
    keyed = groups.selectExpr("hash", "item", "copies", f"inline(array({keys}))",
                              "cast(array() AS array<string>) AS skipped")
    filed = _filed(keyed, d + 1, hot_rows)
    pairs = filed.alias("a").join(filed.alias("b"), F.expr(
        "a.choice = b.choice AND a.key = b.key AND a.hash < b.hash"))
    same = [f"{cut('a.hash', i)} = {cut('b.hash', i)}" for i in range(blocks)]
    first_choice = " ".join(f"WHEN {' AND '.join(same[i] for i in c)} THEN {j}"
                            for j, c in enumerate(choices))
    distance = " + ".join(
        f"bit_count(bigint(conv(substring(a.hash, {at + 1}, {min(8, digits - at)}), 16, 10)) ^ "
        f"bigint(conv(substring(b.hash, {at + 1}, {min(8, digits - at)}), 16, 10)))"
        for at in range(0, digits, 8))
    return (
        pairs.where(f"CASE {first_choice} END = a.choice")
        .where("forall(zip_with(a.skipped, b.skipped, (x, y) -> x <> y), t -> t)")
        .selectExpr("a.hash AS hash_a", "b.hash AS hash_b", "a.item AS item_a", "b.item AS item_b",
                    "a.copies AS copies_a", "b.copies AS copies_b",
                    f"int({distance}) AS distance")
        .where(F.col("distance") <= d))


def split_cutoff(groups: DataFrame, group: str, fraction: float, seed: int) -> Column:
    """The greatest validation hash, as a one-row scalar subquery.

    Groups are ordered by SHA-256 of "seed:group". The first three hex digits cut that order into
    4096 even slices, so only one slice is ever sorted.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie strictly between 0 and 1")
    hashed = groups.select(group).distinct().select(group_hash(F.col(group), seed).alias("_h")
                                                    ).withColumn("_p", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(1))  # at most 4096 rows
    total = F.sum("_n").over(everything)
    wanted = F.greatest(F.lit(1), F.bround(total * F.lit(float(fraction))).cast("long"))
    wanted = F.when(total > 1, F.least(wanted, total - 1)).otherwise(wanted)
    counts = counts.select(
        "_p", "_n", wanted.alias("_want"),
        (F.sum("_n").over(everything.orderBy("_p")) - F.col("_n")).alias("_below"))
    hit = counts.where((F.col("_want") > F.col("_below"))
                       & (F.col("_want") <= F.col("_below") + F.col("_n")))
    inside = Window.partitionBy("_p").orderBy("_h")
    return (hashed.join(hit, "_p").withColumn("_r", F.row_number().over(inside) + F.col("_below"))
            .where(F.col("_r") == F.col("_want")).agg(F.max("_h")).scalar())


def group_hash(group: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), group.cast("string")), 256)


def group_split(df: DataFrame, group: str, fraction: float, seed: int,
                name: str = "assigned_split") -> DataFrame:
    """Train or validation per row; whole groups move together and the choice is repeatable.

    Rows compare their own group hash with one cut-off, so no row is joined or shuffled.
    """
    cutoff = split_cutoff(df, group, fraction, seed)
    return df.withColumn(name, F.when(group_hash(F.col(group), seed) <= cutoff, "validation")
                         .otherwise("train"))


def dedupe_first(df: DataFrame, digest: str, path: str) -> DataFrame:
    """Mark all but the first path of every content hash as duplicates.

    ``path`` is unique. The first path comes from a minimum per hash and rows are matched on the
    path, so copies that make up a third of the table stay spread out. Rows without a hash are
    copies of nothing.
    """
    first = df.groupBy(digest).agg(F.min(path).alias(path)).select(path, F.lit(True).alias("_first"))
    copy = F.col("_first").isNull() & F.col(digest).isNotNull()
    return df.join(first, path, "left").withColumn(
        "error_code", F.when(copy, "DUPLICATE_INPUT")).drop("_first")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent, child[child_key] == parent[parent_key], "left_anti")


def pair_masks(items: DataFrame, masks: DataFrame, key: str, first: Column,
               second: Column) -> DataFrame:
    """Attach a mask by its first candidate name, else by the second; NULL where both miss."""
    m = masks.select(F.col(key).alias("_mask"))
    one = m.withColumnRenamed("_mask", "_m1")
    two = m.withColumnRenamed("_mask", "_m2")
    marked = items.withColumn("_c1", first).withColumn("_c2", second)
    return (marked.join(one, F.col("_c1") == F.col("_m1"), "left")
            .join(two, F.col("_c2") == F.col("_m2"), "left")
            .withColumn("mask_path", F.coalesce("_m1", "_m2")).drop("_c1", "_c2", "_m1", "_m2"))


def contract_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, counted in one pass; a NULL test counts as broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(test, F.lit(False))).alias(name)
                      for name, test in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, violations)")


def batch_result(results: DataFrame, failures: DataFrame) -> DataFrame:
    """Results and failures side by side; nothing is dropped."""
    return results.unionByName(failures, allowMissingColumns=True)


def batch_summary(batch: DataFrame, error_code: str = "error_code") -> DataFrame:
    """Items per error code; NULL means completed."""
    return batch.groupBy(F.coalesce(error_code, F.lit("COMPLETED")).alias("result")).agg(
        F.count(F.lit(1)).alias("n"))
