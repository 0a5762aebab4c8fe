"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks of documents."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, scratch, with_added

#: Words that a block holds on average.
BLOCK_WORDS = 20_000
#: No source is repeated more often.
REPEATS = 3.0
#: Rounds of the keyed permutation, and steps after which it must have come back into its range.
ROUNDS, WALK = 3, 40
#: Blocks whose words are summed first, so that the search for a source's last block meets few rows at a time.
RUN = 1024


def word_count(text):
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def default_weights(sources: list) -> dict:
    """1, 2, 3, 1, ... for the sources by code point, null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    return {s: float(i % 3 + 1) for i, s in enumerate(order)}


def targets(sizes: dict, weights: dict, total: float | None = None, repeats: float = REPEATS) -> dict:
    """Words for each source: total (default: all sizes) by weight, at most repeats times a source's size;
    the excess is dealt anew by weight among the others until none is above."""
    left = float(sum(sizes.values()) if total is None else total)
    out, free = {}, {s: weights[s] for s in sizes}
    while free:
        unit = left / sum(free.values()) if sum(free.values()) > 0 else 0.0
        full = [s for s, w in free.items() if w * unit > repeats * sizes[s]]
        if not full:
            return out | {s: w * unit for s, w in free.items()}
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
            del free[s]
    return out


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact quotas (sources, shards): each node deals its blocks to two halves by one hypergeometric draw.

    Leaves differ in size by one block at most. A node's random numbers depend on the seed and its place only.
    """
    out = np.zeros((len(counts), shards), np.int64)
    total = int(counts.sum())
    size = lambda a, b: total * b // shards - total * a // shards
    stack = [(0, shards, counts.astype(np.int64))]
    while stack:
        a, b, have = stack.pop()
        if b - a == 1:
            out[:, a] = have
            continue
        mid = (a + b) // 2
        take = _draw(have, size(a, mid), np.random.Generator(np.random.PCG64([seed, a, b])))
        stack += [(a, mid, take), (mid, b, have - take)]
    return out


def _draw(have: np.ndarray, n: int, rng) -> np.ndarray:
    """One multivariate hypergeometric draw as a chain of univariate ones."""
    out, rest = np.zeros_like(have), int(have.sum())
    for i, h in enumerate(have):
        rest -= int(h)
        out[i] = n - out[:i].sum() if not rest else _hypergeometric(int(h), rest, n - int(out[:i].sum()), rng) if n > out[:i].sum() and h else 0
    return out


def _hypergeometric(good: int, bad: int, n: int, rng) -> int:
    """One draw; beyond the range of the exact generator its normal limit, kept within the possible values."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    p = good / (good + bad)
    spread = math.sqrt(n * p * (1 - p) * (good + bad - n) / (good + bad - 1))
    return min(max(round(rng.normal(n * p, spread)), n - bad, 0), good, n)


def permuted(index: Column, count: Column, key: Column) -> Column:
    """A keyed permutation of 0 .. count - 1: a Feistel network over a grid of at least count cells, walked until it is inside."""
    a = F.greatest(F.ceil(F.sqrt(count)).cast("long"), F.lit(1))
    b = F.greatest(F.ceil(count / a).cast("long"), F.lit(1))

    def once(x: Column) -> Column:
        state = F.struct(F.pmod(x, a).alias("l"), F.call_function("div", x, a).alias("r"))
        for i in range(ROUNDS):
            half = F.transform(F.array(state), lambda s, i=i: F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(key, F.lit(2 * i), s["r"]), a), a).alias("l"), s["r"].alias("r")))
            state = F.transform(half, lambda s, i=i: F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(key, F.lit(2 * i + 1), s["l"]), b), b).alias("r")))[0]
        return F.transform(F.array(state), lambda s: s["r"] * a + s["l"])[0]

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), once(index), lambda x, _: F.when(x < count, x).otherwise(once(x)))
    return F.when(walked < count, walked).otherwise(F.raise_error(F.lit("the permutation left its range")))


def mix_plan(docs: DataFrame, weights: dict | None = None, total: float | None = None, shards: int | None = None, seed: int = 7, text: str = "text", key: str = "doc_id", source: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Which documents the mix takes, how often, and where each copy goes, without the texts.

    A source's documents are dealt to blocks by a hash. Its target is a number of whole
    passes plus part of one; the part is whole blocks, then documents of one more block
    that still fit, and the one other document whose size is nearest to what is lacking, a unit of its own. The splitting tree deals all block
    copies exactly among the shards (see split_tree); a source's block copies are permuted by a key and go
    to the shards in disjoint runs of the tree's quotas. Returns key, source, size, source_size, target, copies (array of
    (shard, rank, place): rank is the block copy's place in its source's permuted order, and place orders a shard's copies at random), taken =
    size times the number of copies, and _h (the document's hash).

    Null and empty texts have size 0 and are dealt like others. Null sources are a source of their own. Equal rows share a hash and are
    taken alike; null keys are keys; a very long text is one document of its size; an empty table gives an empty plan; further columns, whatever
    their names, are dropped. Sources and their block counts come to the
    driver, one row each: weights are given per source there. No window or group holds a whole source.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    rows = scratch(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"), hashed.alias("_h")), "mix")
    found = [(r["_source"], r["s"]) for r in rows.groupBy("_source").agg(F.sum("size").alias("s")).collect()]
    sizes = dict(found)
    given = weights if weights is not None else default_weights(list(sizes))
    goal = targets(sizes, {s: float(given.get(s, 0.0)) for s in sizes}, total)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    n = shards or partitions(spark)
    blocks = {s: max(1, -(-sizes[s] // block_words)) for s in order}
    facts = [(s, sizes[s], goal[s], blocks[s]) for s in order]
    table = spark.createDataFrame(facts, f"_source {docs.schema[source].dataType.simpleString()}, source_size long, target double, _blocks long")
    # the unsigned upper 32 bits of the hash choose the block
    place = (F.shiftrightunsigned("_h", 32) * F.col("_blocks") / F.lit(2.0**32)).cast("long")
    dealt = rows.join(F.broadcast(table), rows["_source"].eqNullSafe(table["_source"])).drop(table["_source"]).withColumn("_block", place)

    # where the part of a pass ends: first by blocks, then by the hashes within one block
    whole = {s: int(goal[s] // sizes[s]) if sizes[s] else 0 for s in order}
    rest = {s: goal[s] - whole[s] * sizes[s] for s in order}
    sums = dealt.groupBy("_source", "_block").agg(F.sum("size").alias("w"))
    cuts = _block_cuts(spark, sums, order, rest, docs.schema[source].dataType.simpleString())
    inside = dealt.join(F.broadcast(cuts), dealt["_source"].eqNullSafe(cuts["_source"]) & (dealt["_block"] == cuts["_cut"])).select(cuts["_source"], "_h", "size", "_need")
    found_ends = [(r["_source"], r["e"], r["d"]) for r in _hash_cuts(inside).collect()]
    ends = {s: e for s, e, _ in found_ends}
    cut = {r["_source"]: r["_cut"] for r in cuts.collect()}
    kind = docs.schema[source].dataType.simpleString()
    lacks = spark.createDataFrame([(s, cut[s], e, float(d)) for s, e, d in found_ends], f"_s {kind}, _last long, _end long, _lack double")
    left_out = dealt.join(F.broadcast(lacks), dealt["_source"].eqNullSafe(lacks["_s"])).where((F.col("_block") > F.col("_last")) | ((F.col("_block") == F.col("_last")) & (F.col("_end").isNull() | (F.col("_h") > F.col("_end")))))
    off = F.abs(F.col("size") - F.col("_lack"))
    fill = {r["_source"]: r["h"] for r in left_out.where(off < F.col("_lack")).groupBy("_source").agg(F.min_by("_h", F.struct(off, F.col("_h"))).alias("h")).collect()}

    counts = np.array([whole[s] * blocks[s] + (cut[s] + 1 if s in cut else 0) + (s in fill) for s in order], np.int64)
    quotas = split_tree(counts, n, seed) if len(order) else np.zeros((0, n), np.int64)
    extra = [(s, whole[s], cut.get(s, -1), ends.get(s), fill.get(s), int(c), i, [int(x) for x in np.cumsum(q)[:-1]]) for i, (s, c, q) in enumerate(zip(order, counts, quotas, strict=True))]
    more = spark.createDataFrame(extra, f"_s {kind}, _whole int, _last long, _end long, _fill long, _count long, _no int, _bounds array<long>")
    full = dealt.join(F.broadcast(more), dealt["_source"].eqNullSafe(more["_s"]))
    partial = (F.col("_block") < F.col("_last")) | ((F.col("_block") == F.col("_last")) & (F.col("_h") <= F.col("_end")))
    part = F.when(F.coalesce(partial, F.lit(False)), F.array(F.col("_whole") * F.col("_blocks") + F.col("_block")))
    last = F.when(F.coalesce(F.col("_h") == F.col("_fill"), F.lit(False)), F.array(F.col("_count") - 1))
    passes = F.transform(F.filter(F.sequence(F.lit(0), F.col("_whole")), lambda e: e < F.col("_whole")), lambda e: e * F.col("_blocks") + F.col("_block"))
    units = F.concat(passes, F.coalesce(part, last, F.array().cast("array<bigint>")))
    # each document of a block computes the same rank for it, so no table of blocks has to be joined
    ranked = F.transform(units, lambda u: permuted(u, F.col("_count"), F.xxhash64(F.lit(seed), F.col("_no"))))
    copies = F.transform(ranked, lambda r, i: F.struct(F.size(F.filter("_bounds", lambda b: b <= r)).alias("shard"), r.alias("rank"), F.xxhash64(F.lit(seed), i, F.col("_h")).alias("place")))
    return full.withColumn("copies", copies).select(F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size", "target", "copies", (F.col("size") * F.size("copies")).alias("taken"), F.col("_h"))


def _block_cuts(spark, sums: DataFrame, order: list, rest: dict, kind: str) -> DataFrame:
    """(source, _cut, _need): the block in which the running sum of a source reaches its rest, and the words still needed there.

    Found by runs of RUN * RUN blocks first, then runs of RUN in that one, then blocks: a source of 10^9 blocks has a thousand rows at each step.
    """
    from pyspark.sql import Window

    sums = scratch(sums, "mix-blocks")
    want = spark.createDataFrame([(s, float(rest[s])) for s in order if rest[s] > 0], f"_s {kind}, _rest double")
    inside = sums
    for width in (RUN * RUN, RUN, 1):
        runs = inside.groupBy("_source", F.floor(F.col("_block") / width).alias("_run_no")).agg(F.sum("w").alias("w"))
        at = runs.withColumn("_run", F.sum("w").over(Window.partitionBy("_source").orderBy("_run_no"))).join(F.broadcast(want), F.col("_source").eqNullSafe(F.col("_s")))
        last = at.where((F.col("_run") >= F.col("_rest")) & (F.col("_run") - F.col("w") < F.col("_rest")))
        found = last.select("_s", "_run_no", (F.col("_rest") - F.col("_run") + F.col("w")).alias("_need")).collect()  # a row a source
        want = spark.createDataFrame([(r["_s"], float(r["_need"])) for r in found], f"_s {kind}, _rest double")
        some = spark.createDataFrame([(r["_s"], r["_run_no"]) for r in found], f"_t {kind}, _no long")
        inside = sums.join(F.broadcast(some), F.col("_source").eqNullSafe(F.col("_t")) & (F.floor(F.col("_block") / width) == F.col("_no"))).select(*sums.columns)
    discard(sums)
    return spark.createDataFrame([(r["_s"], r["_run_no"], float(r["_need"])) for r in found], f"_source {kind}, _cut long, _need double")


def _hash_cuts(inside: DataFrame) -> DataFrame:
    """(source, e, d): the hash up to which documents of the cut block fit the need, and the words that it then lacks."""
    from pyspark.sql import Window

    by = inside.groupBy("_source", "_h", "_need").agg(F.sum("size").alias("w"))
    run = F.sum("w").over(Window.partitionBy("_source").orderBy("_h"))
    fits = F.col("_run") <= F.col("_need")
    ended = by.withColumn("_run", run).groupBy("_source", "_need").agg(F.max(F.when(fits, F.col("_h"))).alias("e"), F.max(F.when(fits, F.col("_run"))).alias("r"))
    return ended.select("_source", "e", (F.col("_need") - F.coalesce("r", F.lit(0))).alias("d"))


def mix(docs: DataFrame, seed: int = 7, text: str = "text", key: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The mixed documents: every copy is a row, with docs' columns and its _shard, in random order within the shard.

    See mix_plan for the rules and odd rows. Texts are moved once, to their shards. Columns of docs keep their names and values; one that is named
    _shard is left out.
    """
    plan = mix_plan(docs, seed=seed, text=text, key=key, source=source, **how)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    at = lambda c: F.col(inner[names.index(c)])
    keyed = rows.withColumn("_h", F.xxhash64(F.lit(seed), at(key), at(text))).withColumn("_s", at(source))
    # equal rows have equal plans; one of them is joined to all
    one = plan.select(F.col("_h").alias("_ph"), F.col(source).alias("_ps"), "copies").where(F.size("copies") > 0).dropDuplicates(["_ph", "_ps"])
    taken = keyed.join(one, (keyed["_h"] == one["_ph"]) & keyed["_s"].eqNullSafe(one["_ps"])).withColumn("_copy", F.explode("copies"))
    n = how.get("shards") or partitions(docs.sparkSession)
    dealt = taken.select(*inner, F.col("_copy.shard").alias("_shard"), F.col("_copy.place").alias("_place")).repartition(n, "_shard").sortWithinPartitions("_shard", "_place").drop("_place")
    return with_added(dealt, names, ["_shard"])
