"""Substring deduplication by seed and extend on winnowed anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLAIN, U64, begin, grams, integer_key, mix, partitions, powers, ramp, scratch, slices, text_buffer, with_added

#: Words of a window; repeats of at least so many words are removed.
WINDOW = 20
#: Words of a seed. Winnowing over WINDOW - SEED + 1 seeds picks one in every window, the same one in equal windows.
SEED = 8


class Anchors:
    """The winnowed anchors of rows of words: for each its first word (pos) and the range lo .. hi of the windows it was picked in."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, window: int, seed: int):
        self.seeds, s_at, first = grams(words, bounds, seed)
        span = window - seed + 1
        count = np.maximum(np.diff(bounds) - window + 1, 0)
        start = np.repeat(bounds[:-1], count) + ramp(count)
        where = np.repeat(s_at[:-1], count) + ramp(count)  # the window's first seed
        # leftmost least seed in each window, by doubling: least of 2^k seeds, then two overlapping runs
        pick = np.arange(len(self.seeds))
        run = 1
        while 2 * run <= span:
            pick = self._least(pick[: len(pick) - run], pick[run:])
            run *= 2
        best = self._least(pick[where], pick[where + span - run]) if len(where) else where
        row = np.repeat(np.arange(len(count)), count)
        new = np.ones(len(best), bool)
        new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        self.row = row[at]
        self.seed = self.seeds[best[at]]
        self.pos = first[best[at]]
        self.lo = start[at]
        last = np.concatenate([at[1:], [len(best)]]) - 1
        self.hi = start[last] if len(at) else start

    def _least(self, a, b):
        return np.where(self.seeds[b] < self.seeds[a], b, a)


def _anchors(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            begin("repeats")
            for b in slices(whole, "_text"):
                data, off = text_buffer(b.column(2))
                _, _, words, bounds = PLAIN.split(data, off)
                a = Anchors(words, bounds, window, seed)
                # the extension both ways, as far as windows with this anchor reach
                chain = _chain(words)
                extent = mix(_span(chain, a.lo, a.hi + window) + (a.pos - a.lo).astype(U64) * U64(0x9E3779B97F4A7C15) + (a.hi - a.lo).astype(U64))
                base = bounds[:-1][a.row]
                doc, twin = np.asarray(b.column(0))[a.row], np.asarray(b.column(1))[a.row]
                lo, hi = (a.lo - base).astype(np.int32), (a.hi - base).astype(np.int32)
                late = _settled((a.seed, extent), doc, twin, lo)
                part = np.where(late, mix(doc.astype(np.int64).view(U64)), a.seed)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part.view(np.int64), late, a.seed.view(np.int64), extent.view(np.int64), doc, twin, lo, hi)], names=["part", "late", "seed", "extent", "doc", "twin", "lo", "hi"])

    return run


def _chain(words: np.ndarray) -> np.ndarray:
    """Prefix sums of words times powers of an odd number, from which _span hashes any run of words."""
    power, _ = powers(len(words) + 1)
    out = np.zeros(len(words) + 1, U64)
    np.cumsum(mix(words) * power[: len(words)], out=out[1:])
    return out


def _span(chain: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(chain))
    return mix((chain[b] - chain[a]) * inverse[a] + (b - a).astype(U64))


def _settled(key: tuple, doc: np.ndarray, twin: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which rows come after another one of their key among these rows already: the map-side part of keeping the first.

    Such rows are repeats whatever else there is; they skip the comparison and are dealt by document, so that a key with very
    many occurrences brings one row for each run of texts to its task.
    """
    order = np.lexsort((lo, twin, doc, *key))
    same = np.ones(len(order), bool)
    for k in key:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    head = np.maximum.accumulate(np.where(same, -1, np.arange(len(order)))) if len(order) else order
    own = [x[order] for x in (doc, twin, lo)]
    again = np.ones(len(order), bool)
    for x in own:
        again &= x == x[head]
    out = np.zeros(len(order), bool)
    out[order] = same & ~again
    return out


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (late, seed, extent, doc, twin, lo), the late ones first: kind 0 for these, kind 0 for occurrences whose whole extent occurs earlier; kind 1 for the
    first of an extent whose seed also occurs in another one, so that single windows must be compared.

    Memory is one batch and one row: a seed may have any number of occurrences.
    """
    held = None  # the latest first occurrence, not yet known to be alone
    names = ["kind", "seed", "doc", "twin", "lo", "hi"]
    for b in batches:
        late = np.asarray(b.column(0))
        if late.any():  # sorted before the others
            done = b.filter(pa.array(late))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(done.num_rows, np.int32)), done.column(1), *(done.column(i) for i in range(3, 7))], names=names)
            b = b.filter(pa.array(~late))
        if not b.num_rows:
            continue
        seed, extent, doc, twin, lo, hi = (np.asarray(b.column(i)) for i in range(1, 7))
        n = len(seed)
        prior = held if held is not None else (None,) * 8
        same_seed, same_extent = np.zeros(n, bool), np.zeros(n, bool)
        same_seed[1:] = seed[1:] == seed[:-1]
        same_extent[1:] = same_seed[1:] & (extent[1:] == extent[:-1])
        if held is not None:
            same_seed[0] = seed[0] == prior[0]
            same_extent[0] = same_seed[0] and extent[0] == prior[1]
        new = np.flatnonzero(~same_extent)
        # a repeated row of the first occurrence is that occurrence
        head = np.full(n, -1)
        head[new] = new
        head = np.maximum.accumulate(head)
        hd, ht, hl = (np.where(head >= 0, x[np.maximum(head, 0)], prior[k] if held is not None else 0) for x, k in ((doc, 2), (twin, 3), (lo, 4)))
        full = same_extent & ~((doc == hd) & (twin == ht) & (lo == hl))
        # firsts of this batch and the held one: part of a seed with several extents?
        s = seed[new]
        after = np.zeros(len(new), bool)
        if len(new):
            after[:-1] = s[1:] == s[:-1]
        before = same_seed[new]
        several = after | before
        f = np.flatnonzero(full)
        cols = [[np.zeros(len(f), np.int32), seed[f], doc[f], twin[f], lo[f], hi[f]]]
        if len(new):
            if held is not None and (prior[6] or before[0]):
                cols.append([np.array([1], np.int32), *(np.array([prior[k]], x.dtype) for k, x in ((0, seed), (2, doc), (3, twin), (4, lo), (5, hi)))])
            e = new[:-1][several[:-1]]
            cols.append([np.ones(len(e), np.int32), seed[e], doc[e], twin[e], lo[e], hi[e]])
            k = new[-1]
            held = (seed[k], extent[k], doc[k], twin[k], lo[k], hi[k], bool(before[-1]), None)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols, strict=True)], names=names)
    if held is not None and held[6]:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([v], t)) for v, t in ((1, np.int32), (held[0], np.int64), (held[2], np.int64), (held[3], np.int64), (held[4], np.int32), (held[5], np.int32))], names=names)


def _windows(window: int):
    """For rows (doc, twin, text, seeds, los, his): the hash of each window in these ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                data, off = text_buffer(b.column(2))
                _, _, words, bounds = PLAIN.split(data, off)
                chain = _chain(words)
                los, his = b.column(3), b.column(4)
                n = np.diff(np.asarray(los.offsets))
                row = np.repeat(np.arange(b.num_rows), n)
                lo, hi = np.asarray(los.flatten()).astype(np.int64), np.asarray(his.flatten()).astype(np.int64)
                m = hi - lo + 1
                start = np.repeat(lo, m) + ramp(m)
                row = np.repeat(row, m)
                at = start + bounds[:-1][row]
                hashed, doc, twin, start = _span(chain, at, at + window), np.asarray(b.column(0))[row], np.asarray(b.column(1))[row], start.astype(np.int32)
                late = _settled((hashed,), doc, twin, start)
                part = np.where(late, mix(doc.astype(np.int64).view(U64)), hashed)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part.view(np.int64), late, hashed.view(np.int64), doc, twin, start)], names=["part", "late", "hash", "doc", "twin", "lo"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (late, hash, doc, twin, lo), the late ones first: these, and those that aren't the first of their hash."""
    last = None
    for b in batches:
        late = np.asarray(b.column(0))
        if late.any():
            done = b.filter(pa.array(late))
            yield pa.RecordBatch.from_arrays([done.column(i) for i in range(2, 5)], names=["doc", "twin", "lo"])
            b = b.filter(pa.array(~late))
        if not b.num_rows:
            continue
        h, doc, twin, lo = (np.asarray(b.column(i)) for i in range(1, 5))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[0] = last is None or h[0] != last[0]
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        same = [np.where(head >= 0, x[np.maximum(head, 0)], 0 if last is None else last[k]) == x for k, x in ((1, doc), (2, twin), (3, lo))]
        out = ~new & ~(same[0] & same[1] & same[2])
        k = head[-1]
        last = (h[-1], doc[k], twin[k], lo[k]) if k >= 0 else last
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (doc, twin, lo)], names=["doc", "twin", "lo"])


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ranges of words (doc, twin, lo, hi exclusive) that lie in windows whose word sequence also starts earlier.

    doc is the key (the least long for null) and twin the text's xxhash64; documents are ordered by both.

    Seeds: the least of the hashes of ``seed`` consecutive words in each window (winnowing), so equal windows have
    equal anchors at equal places. Extension: an anchor's extent is all words of the windows it was picked in. Where
    whole extents agree, all later ones are repeats; where seeds agree and extents don't (the ends of maximal
    repeats), one occurrence of each extent is kept and its windows are compared one by one. Neither step
    forms pairs: both sort occurrences and keep the first, once in each run of texts before the shuffle and once after it.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    base = _keyed(docs, text, key)
    found = base.mapInArrow(_anchors(window, seed), "part long, late boolean, seed long, extent long, doc long, twin long, lo int, hi int")
    sorts = [F.desc("late"), "seed", "extent", "doc", "twin", "lo"]
    resolved = scratch(found.repartition(n, "part").sortWithinPartitions(*sorts).drop("part").mapInArrow(_resolve, "kind int, seed long, doc long, twin long, lo int, hi int"), "repeats-resolved")

    open_ = resolved.where("kind = 1").groupBy("doc", "twin").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    ranged = base.join(open_, ["doc", "twin"]).select("doc", "twin", "_text", F.col("r.lo").alias("los"), F.col("r.hi").alias("his"))
    hashed = ranged.mapInArrow(_windows(window), "part long, late boolean, hash long, doc long, twin long, lo int").repartition(n, "part").sortWithinPartitions(F.desc("late"), "hash", "doc", "twin", "lo").drop("part")
    single = scratch(hashed.mapInArrow(_later, "doc long, twin long, lo int"), "repeats-windows")
    return resolved.where("kind = 0").select("doc", "twin", "lo", (F.col("hi") + window).alias("hi")).union(single.select("doc", "twin", "lo", (F.col("lo") + window).alias("hi")))


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(integer_key(docs, key), F.lit(-(2**63))).alias("doc"), F.xxhash64(whole).alias("twin"), whole.alias("_text"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Texts without words that windows repeat from earlier: docs' columns, n_words, n_removed and kept (words joined by a space).

    Words are runs of characters other than ASCII blanks, unchanged. A word goes if some window of ``window`` words of its
    document covers it and the same words start earlier (smaller key, or same document and earlier). Windows are judged on
    the input. The key must be an integer. Null texts have no words; shorter documents than a window lose nothing; a very long text is taken whole, in one
    task; rows that repeat a key and text are one document and share its result; null keys come first; an empty table gives an empty
    result. A column of docs named like an added one is replaced by it.
    """
    marks = repeats(docs, window, seed, text, key).groupBy("doc", "twin").agg(F.collect_list(F.struct("lo", "hi")).alias("_r"))
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    columns, at, kat = rows.columns, names.index(text), names.index(key)
    keyed = rows.withColumn("doc", F.coalesce(F.col(f"c{kat}").cast("long"), F.lit(-(2**63)))).withColumn("twin", F.xxhash64(F.coalesce(F.col(f"c{at}"), F.lit(""))))
    marked = keyed.join(marks, ["doc", "twin"], "left").select(*rows.columns, F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, lo, hi in zip(*(b.column(i).to_pylist() for i in (at, len(names), len(names) + 1)), strict=True):
                words = _split(t or "")
                gone = np.zeros(len(words) + 1, np.int64)
                if lo:
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, hi, -1)
                out = np.cumsum(gone)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(out.sum()))
                kept.append(" ".join(words if not lo else [w for w, g in zip(words, out.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "n", "r", "k"])

    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType()), T.StructField("r", T.LongType()), T.StructField("k", T.StringType())])
    return with_added(marked.mapInArrow(cut, schema), names, ["n_words", "n_removed", "kept"])


_BLANKS = dict.fromkeys(range(0x09, 0x0E), " ")


def _split(text: str) -> list[str]:
    return [w for w in text.translate(_BLANKS).split(" ") if w]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
