"""N-gram Jaccard self-join with Bayesian pruning of candidates and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, U64, begin, grams, integer_key, lists, mix, partitions, ramp, scratch, slices, text_buffer
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values, and how many of them make a band. A pair at the threshold shares no band with probability 3e-6.
HASHES, BAND = 160, 5
#: Compared at a time before a pair's posterior is looked at.
STEP = 16
#: A pair is dropped when the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-9
#: Members of a candidate component that one task compares with as many others.
BLOCK = 256
#: Nodes of null keys lie below.
_LOWEST = -(2**62)
_ODD = mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def minhashes(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, HASHES) least 32-bit hashes of each row's shingles; rows without shingles get the largest value."""
    n = len(offsets) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    i = 0
    while i < len(full):  # runs of rows that fit the cache
        j = max(i + 1, int(np.searchsorted(offsets[full], offsets[full[i]] + (1 << 15), "right")))
        a, b = offsets[full[i]], offsets[full[j - 1] + 1]
        part, starts = shingles[a:b], offsets[full[i:j]] - a
        for k in range(HASHES):
            out[full[i:j], k] = np.minimum.reduceat((part * _ODD[k]) >> U64(32), starts)
        i = j
    return out


@cache
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For STEP, 2 STEP, ... compared values the least number of matches that keeps a pair.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), and its mass above t is the
    binomial sum of C(n + 1, j) t^j (1 - t)^(n + 1 - j) over j = 0 .. m.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    data, off = text_buffer(texts)
    _, _, words, bounds = FOLDED.split(data, off)
    hashes, at, _ = grams(words, bounds, SHINGLE, short=True)
    return [np.unique(hashes[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text identity (two hashes of its word sequence), number of words, and the keys of its bands."""
    begin("join")
    for whole in batches:
        for b in slices(whole, "_text"):
            data, off = text_buffer(b.column(1))
            _, _, words, bounds = FOLDED.split(data, off)
            count = np.diff(bounds)
            place = ramp(count).astype(U64)
            full = np.flatnonzero(count)
            ids = np.zeros((2, len(count)), U64)
            for i, odd in enumerate((U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))):
                if len(full):
                    ids[i, full] = np.add.reduceat(mix(words * odd + mix(place + odd)), bounds[full])
            hashes, at, _ = grams(words, bounds, SHINGLE, short=True)
            sig = minhashes(hashes, at)
            keys = np.zeros((len(count), HASHES // BAND), U64)
            for k in range(HASHES // BAND):
                h = np.full(len(count), k + 1, U64)
                for v in sig[:, k * BAND : (k + 1) * BAND].T:
                    h = mix(h * U64(31) + v.astype(U64))
                keys[:, k] = h
            off = np.arange(len(count) + 1) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids[0].view(np.int64)), pa.array(ids[1].view(np.int64)), pa.array(count.astype(np.int64)), lists(keys.ravel().view(np.int64), off)], names=["node", "h1", "h2", "n", "bands"])


class Verifier:
    """Compares the members of candidate components; rows arrive sorted by (comp, i, j)."""

    def __init__(self, threshold: float, tolerance: float):
        self.t = threshold
        self.least = least_matches(threshold, tolerance)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("join")
        group, held, out, weight = None, [], [], 0
        for whole in batches:
            for b in slices(whole, "_text", 1 << 20):
                keys = list(zip(*(b.column(i).to_pylist() for i in range(6)), strict=True))
                sets = shingle_sets(b.column(6))
                for (comp, i, j, mine, node, copies), s in zip(keys, sets, strict=True):
                    if (comp, i, j) != group:
                        if group is not None:
                            weight += self.compare(held, group[1] != group[2], out)
                        group, held = (comp, i, j), []
                        if weight > 50_000:
                            yield self.rows(out)
                            out, weight = [], 0
                    held.append((mine == i, node, copies, s))
        if group is not None:
            self.compare(held, group[1] != group[2], out)
        if out:
            yield self.rows(out)

    @staticmethod
    def rows(out):
        a, b, w = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(w)], names=["a", "b", "w"])

    def compare(self, held: list, across: bool, out: list) -> int:
        """Append each member's weight of links (a = b), and links that join the linked ones."""
        if len(held) < 2:
            return 0
        side = np.array([h[0] for h in held])
        nodes = np.array([h[1] for h in held], np.int64)
        copies = np.array([h[2] for h in held], np.int64)
        sets = [h[3] for h in held]
        size = np.array([len(s) for s in sets], np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        sig = minhashes(np.concatenate(sets), bounds)
        left = np.flatnonzero(side) if across else np.arange(len(held))
        right = np.flatnonzero(~side) if across else left
        # lengths: the smaller set has at least t times the larger one's shingles
        live = np.minimum.outer(size[left], size[right]) >= self.t * np.maximum.outer(size[left], size[right]) - 1e-9
        live &= (size[left] > 0)[:, None]
        if not across:
            live &= left[:, None] < right[None, :]
        x, y = np.nonzero(live)
        a, b = left[x], right[y]
        same = np.zeros(len(a), np.int64)
        for k, least in enumerate(self.least):  # the posterior after each step of comparisons
            for c in range(k * STEP, (k + 1) * STEP):
                same += sig[a, c] == sig[b, c]
            keep = same >= least
            a, b, same = a[keep], b[keep], same[keep]
        if not len(a):
            return 0
        common = self.common(sets, a, b)
        linked = common >= self.t * (size[a] + size[b] - common) - 1e-9
        a, b = a[linked], b[linked]
        links = np.bincount(a, copies[b], len(held)) + np.bincount(b, copies[a], len(held))
        has = np.flatnonzero(links)
        if not len(has):
            return 0
        root = np.arange(len(held))

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        # one vectorised pass of least neighbours, then union-find over what is left
        least = np.arange(len(held))
        np.minimum.at(least, b, a)
        np.minimum.at(least, a, b)
        for v in np.flatnonzero(least != np.arange(len(held))).tolist():
            root[find(v)] = find(int(least[v]))
        roots = np.array([find(v) for v in range(len(held))])
        for v, w in zip(*(x[roots[a] != roots[b]].tolist() for x in (a, b)), strict=True):
            root[find(v)] = find(w)
        roots = np.array([find(int(v)) for v in has])
        other = roots != has
        out.append((np.concatenate([nodes[has], nodes[has[other]]]), np.concatenate([nodes[has], nodes[roots[other]]]), np.concatenate([links[has].astype(np.int64), np.zeros(int(other.sum()), np.int64)])))
        return len(has)

    def common(self, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact sizes of the intersections: pair by pair, or for many pairs by products of 0/1 blocks."""
        if len(a) <= 4 * len(sets):
            return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        used = np.unique(np.concatenate([a, b]))
        owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
        _, word, n = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
        shared = n > 1
        column = np.cumsum(shared) - 1
        keep = shared[word]
        owner, word = owner[keep], column[word[keep]]
        total = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(word, kind="stable")
        owner, word = owner[order], word[order]
        for c in range(0, int(shared.sum()), 4096):
            p, q = np.searchsorted(word, [c, c + 4096])
            block = np.zeros((len(used), 4096), np.float32)
            block[owner[p:q], word[p:q] - c] = 1
            total += block @ block.T
        return total[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)


def _node(docs: DataFrame, text: str, key: str):
    """The key, or for a null key a number below all keys that the text's hash chooses."""
    own = integer_key(docs, key)
    hashed = F.lit(_LOWEST - 1) - F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 2)
    checked = F.when(own < _LOWEST, F.raise_error(F.lit("keys below -2^62 are not supported")).cast("long")).otherwise(own)
    return F.coalesce(checked, hashed)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Near-duplicates by the Jaccard similarity of sets of five-word shingles: (key, text_id, copies, n_links, class_id).

    Words are lower-cased runs of digits, letters and bytes beyond ASCII; a text of fewer than five words, but not none, has one
    shingle of all. Texts with the same words are one class of copies, named by its least key (text_id). n_links is
    the number of other documents at similarity of at least the threshold, copies included; class_id is
    the least key that links reach. Texts without words (null, empty) are copies of each other and have no other links.

    1. MinHash values in bands find candidates; copies are collapsed before. Bucket members link to the bucket's
       least member, and components of these links hold every pair that shares a band.
    2. Within a component all pairs are compared in blocks: values step by step, dropping a pair when
       the posterior probability of reaching the threshold is below the tolerance; what is left is verified exactly.
       Only counts and spanning links leave a task; no pairs are emitted.
    3. Components of the spanning links are the classes.

    The key must be an integer above -2 ** 62. Rows with equal keys and texts are copies; one key with several texts is a node that has all of their
    links. A null key becomes a node of its own below all keys, by the text's hash, and null in the result's key. A very long text is signed and
    compared whole, in one task; an empty table gives an empty result; further columns, whatever their names, are dropped.
    """
    spark = docs.sparkSession
    base = docs.select(_node(docs, text, key).alias("node"), F.col(text).alias("_text"))
    signed = scratch(base.mapInArrow(_sign, "node long, h1 long, h2 long, n long, bands array<long>"), "join-signed")
    reps = scratch(signed.groupBy("h1", "h2", "n").agg(F.min("node").alias("rep"), F.count("*").alias("copies"), F.min_by("bands", "node").alias("bands")), "join-reps")

    banded = reps.where("n > 0").select("rep", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("band", "lo")
    near = banded.join(least, "band").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    groups = scratch(components(near, "join-candidates"), "join-groups")

    # blocks of members of a component; a component within one block is compared at once
    salted = groups.withColumn("_h", F.xxhash64("node"))
    wide = salted.groupBy("component").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int"))
    blocked = salted.join(wide, "component").withColumn("mine", F.pmod("_h", F.col("blocks")).cast("int"))
    facts = reps.where("n > 0").groupBy("rep").agg(F.sum("copies").alias("copies"))
    members = blocked.join(facts, F.col("node") == F.col("rep")).select("component", "node", "blocks", "mine", "copies")
    texts = base.join(members, "node")
    paired = texts.select("component", "node", "mine", "copies", "_text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "copies", "_text")
    sorts = ["component", "i", "j"]
    grouped = paired.repartition(partitions(spark), *sorts).sortWithinPartitions(*sorts, "node", "_text")
    found = scratch(grouped.select(*sorts, "mine", "node", "copies", "_text").mapInArrow(Verifier(threshold, tolerance), "a long, b long, w long"), "join-found")

    links = found.where("a = b").groupBy("a").agg(F.sum("w").alias("links"))
    classes = components(found.where("a <> b").select("a", "b"), "join-classes")
    known = reps.join(links, F.col("rep") == F.col("a"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    result = known.select("h1", "h2", "n", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("class_id"))
    all_docs = signed.select("node", "h1", "h2", "n").join(result, ["h1", "h2", "n"])
    return all_docs.select(
        F.col("node").alias("_node"),
        F.when(F.col("node") >= _LOWEST, F.col("node")).alias(key),
        F.col("rep").alias("text_id"),
        "copies",
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
        "class_id",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without those that have an earlier near-duplicate: the least key of each class stays, with all of docs' columns.

    Texts without words are copies of each other, so one of them stays. Of repeated rows of a kept key all stay.
    """
    joined = jaccard_join(docs, key=key, **how)
    kept = joined.where("_node = class_id").select("_node").distinct()
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = docs.select(*names, _node(docs, how.get("text", "text"), key).alias("_node")).toDF(*inner, "_node")
    return rows.join(kept, "_node", "left_semi").select(*inner).toDF(*names)
