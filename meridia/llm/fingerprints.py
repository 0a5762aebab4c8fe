"""Document fingerprints by consistent weighted sampling of word pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, U64, begin, grams, mix, partitions, range_bounds, shard_of, slices, text_buffer, with_added

#: Samples of a fingerprint; the likeness of two has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 64
#: Words of a term. Its weight is the number of its occurrences.
TERM_WORDS = 2
#: Digest of a text without words.
_EMPTY = 0
#: Bytes of text that are signed at a time, and terms that are drawn at a time: larger arrays leave the processor's cache.
SLICE, BLOCK = 1 << 18, 1 << 14
_UNIT = np.float32(1 / (1 << 21))


def signatures(hashes: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """16-bit digests (rows, samples) of rows of word hashes; rows without words get _EMPTY throughout."""
    n = len(offsets) - 1
    out = np.full((n, samples), _EMPTY, np.uint16)
    terms, bounds, _ = grams(hashes, offsets, TERM_WORDS, short=True)
    if not len(terms):
        return out
    row = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((terms, row))
    terms, row = terms[order], row[order]
    new = np.concatenate([[True], (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(new)
    weight = np.diff(np.concatenate([at, [len(terms)]]))
    terms, row = terms[at], row[at]
    # terms that recur with the same weight are drawn once
    pairs, back = np.unique(mix(terms ^ mix(weight.astype(U64))), return_inverse=True)
    some = np.empty(len(pairs), np.int64)
    some[back] = np.arange(len(back))
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    rows = row[starts]
    ends = np.concatenate([starts[1:], [len(row)]])
    for k in range(0, samples, 8):
        keys, steps = _draws(terms[some], weight[some], k, min(k + 8, samples), samples)
        for j in range(keys.shape[1]):
            mine = keys[:, j][back]
            least = np.repeat(np.minimum.reduceat(mine, starts), ends - starts)
            hit = np.flatnonzero(mine == least)
            first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]
            digest = mix(terms[first] ^ mix(steps[:, j][back[first]].astype(np.int64).view(U64) + U64(k + j)))
            out[rows, k + j] = (digest & U64(0xFFFF)).astype(np.uint16)
    return out


def _draws(terms, weights, a, b, samples):
    """For each weighted term and the samples a to b: the logarithm of its gamma-based key, and its step.

    With r and c from Gamma(2, 1) and a uniform shift b: step t = floor(ln w / r + b), ln y = r (t - b), and the key's
    logarithm ln c - ln y - r. The term with the least key is the sample; two weighted sets agree in it with
    the probability of their generalised Jaccard similarity.
    """
    seeds = mix(np.arange(1, 2 * samples + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(2, samples)[:, a:b]
    low = U64((1 << 21) - 1)
    keys = np.empty((len(terms), b - a), np.float32, order="F")
    steps = np.empty((len(terms), b - a), np.int32, order="F")
    log_w = np.log(weights.astype(np.float32))
    for i, j in ((i, j) for i in range(0, len(terms), BLOCK) for j in range(b - a)):
        some = slice(i, i + BLOCK)
        one, two = mix(terms[some] ^ seeds[0, j]), mix(terms[some] ^ seeds[1, j])
        u = [(x.astype(np.float32) + np.float32(0.5)) * _UNIT for x in (one & low, (one >> U64(21)) & low, one >> U64(43), two & low, (two >> U64(21)) & low)]
        r = -np.log(u[0] * u[1])
        t = np.floor(log_w[some] / r + u[4])
        keys[some, j] = np.log(-np.log(u[2] * u[3])) - r * (t - u[4] + np.float32(1))
        steps[some, j] = t
    return keys, steps


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def _sign(texts: pa.Array, samples: int) -> np.ndarray:
    data, off = text_buffer(texts)
    _, _, hashes, bounds = FOLDED.split(data, off)
    return signatures(hashes, bounds, samples)


def _hex(sig: np.ndarray) -> pa.Array:
    return pa.array([bytes(r).hex() for r in np.ascontiguousarray(sig.astype(">u2")).view(np.uint8)], pa.string())


def fingerprints(docs: DataFrame, text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """docs with a column fingerprint: 4 hex digits for each sample.

    Terms are pairs of consecutive words (lower-cased runs of digits, letters and bytes beyond ASCII; a text of one word has
    that word as its term), weighted by their occurrences. Null counts as empty; texts without words share one fingerprint; a very long text is
    signed whole; repeated rows get equal fingerprints; an empty table stays empty; a column of docs named fingerprint is replaced.
    No shuffle.
    """
    from pyspark.sql import types as T

    at = docs.columns.index(text)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, f"c{at}", SLICE):
                yield pa.RecordBatch.from_arrays([*b.columns, _hex(_sign(b.column(at), samples))], names=[*b.schema.names, "f"])

    out = rows.mapInArrow(sign, T.StructType([*rows.schema.fields, T.StructField("f", T.StringType())]))
    return with_added(out, docs.columns, ["fingerprint"])


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, in ascending order of key.

    The edited text has the last floor(n / 4) of n code points replaced by the first as many (or all) of the next document;
    after the last comes the first. Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next; further columns, whatever their names, are dropped. Null counts as empty; null keys come first; rows of equal keys are ordered by text; a
    single document is its own next; an empty table gives an empty result; a very long text is one row of its task.

    One shuffle deals the texts to ranges of the key. The document that begins a range is also sent, as a
    look-ahead, to the range before it, so each task has all its documents' successors.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    base = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    bounds = range_bounds(base, "_key", n)
    low = base.agg(F.min("_key").alias("m"), F.count(F.when(F.col("_key").isNull(), 1)).alias("n")).first()
    first = None if low["n"] else low["m"]
    own = shard_of("_key", bounds)
    heads = F.col("_key").isin(bounds) if bounds else F.lit(False)
    lead = F.when(heads, F.array(own, own - 1)).otherwise(F.array(own))
    starts = F.col("_key").isNull() if first is None else F.col("_key").eqNullSafe(F.lit(first))
    lead = F.when(starts, F.concat(lead, F.array(F.lit(len(bounds))))).otherwise(lead)
    spread = base.withColumn("_own", own).select("_key", "_text", "_own", F.posexplode(lead).alias("_ahead", "_shard"))
    sorts = ["_shard", F.col("_ahead") > 0, F.col("_key").asc_nulls_first(), "_text"]
    rows = spread.select("_shard", "_ahead", "_key", "_text").repartition(len(bounds) + 1, "_shard").sortWithinPartitions(*sorts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("fingerprints")
        held: list = []  # (shard, ahead, key, text) not answered yet
        for whole in batches:
            for b in slices(whole, "_text", SLICE):
                held += list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
                out, held = _answer(held, samples)
                if out is not None:
                    yield out

    def _answer(rows: list, samples: int):
        """Rows whose successor is known give their result; the last one waits, unless it is a look-ahead itself."""
        done = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
        rest = rows[-1:]
        if not done:
            return None, rest
        texts, keys = [a[3] for a, _ in done], [a[2] for a, _ in done]
        tails = [len(t) // 4 for t in texts]
        edited = [t[: len(t) - k] + b[3][:k] for t, k, (_, b) in zip(texts, tails, done, strict=True)]
        # one call for the texts, the last one's successor and the edited texts
        sig = _sign(pa.array([*texts, done[-1][1][3], *edited], pa.large_string()), samples)
        m = len(done)
        mine, after, changed = sig[:m], sig[1 : m + 1].copy(), sig[m + 1 :]
        odd = [i for i in range(m - 1) if done[i][1] is not done[i + 1][0]]
        if odd:
            after[odd] = _sign(pa.array([done[i][1][3] for i in odd], pa.large_string()), samples)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        cols = [pa.array(keys, kind_arrow), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), _hex(mine), _hex(changed), pa.array(likeness(mine, changed)), pa.array(likeness(mine, after))]
        return pa.RecordBatch.from_arrays(cols, names=names), rest

    from pyspark.sql.pandas.types import to_arrow_type

    kind_arrow = to_arrow_type(docs.schema[key].dataType)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.mapInArrow(sign, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
