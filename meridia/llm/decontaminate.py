"""Benchmark decontamination by a prefix-filtered join on the rarest word of each benchmark window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, U64, begin, ramp, slices, text_buffer, with_added

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in one pass; larger benchmarks are joined in blocks of about this size. A word of text makes about 100 bytes
#: of index (its window's word ids, offset and owner, and the vocabulary), so the broadcast is about 70 MB at most.
BLOCK_BYTES = 4 << 20


class Index:
    """Windows of a block of benchmark items, ready for the join.

    A window is a sequence of words, so containment of its set at threshold one needs a prefix of one token only:
    its rarest word by the counts over all documents. ``rare`` maps such a word to the windows that it leads, each
    with the word's offset there and the window's length.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        texts = pa.array([t or "" for _, t in items], pa.string())
        data, off = text_buffer(texts)
        starts, ends, hashes, bounds = FOLDED.split(data, off)
        self.vocab, ids = np.unique(hashes, return_inverse=True)
        first = np.full(len(self.vocab), -1, np.int64)
        first[ids[::-1]] = np.arange(len(ids))[::-1]
        lower = bytes(data).lower()
        self.words = [lower[starts[i] : ends[i]] for i in first]
        ids = ids.astype(np.int32)
        count = np.diff(bounds)
        parts, owners = [], []  # the windows of each length, as rows of word ids, and the items that they come from
        for k in sorted({min(window, int(c)) for c in count.tolist()} - {0}):
            rows = np.flatnonzero(np.minimum(count, window) == k)
            m = count[rows] - k + 1
            start = np.repeat(bounds[rows], m) + ramp(m)
            win, back = np.unique(np.ascontiguousarray(ids[start[:, None] + np.arange(k)]), axis=0, return_inverse=True)
            parts.append(win)
            owners.append((back.ravel(), np.repeat(rows, m)))
        self.length = np.repeat([p.shape[1] for p in parts], [len(p) for p in parts]).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.tokens = np.concatenate([np.zeros(0, np.int32), *(p.ravel() for p in parts)])
        # items of each window, compressed: indices into names
        first = np.cumsum([0, *(len(p) for p in parts)])
        pair = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([back + f, row], axis=1) for (back, row), f in zip(owners, first, strict=False))]), axis=0)
        self.names = [None if i is None else str(i) for i, _ in items]
        self.owner = pair[:, 1].astype(np.int32)
        self.owned = np.searchsorted(pair[:, 0], np.arange(len(self.length) + 1))

    def items_of(self, w: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.owned[w] : self.owned[w + 1]].tolist() if self.names[i] is not None]

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each word of the vocabulary occurs in a partition's documents."""
        begin("decontamination")
        total = np.zeros(len(self.vocab), np.int64)
        for whole in batches:
            for b in slices(whole, "_text"):
                data, off = text_buffer(b.column(0))
                ids = self.lookup(FOLDED.split(data, off)[2])
                total += np.bincount(ids[ids >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word hash, -1 if none: a table by the upper bits leaves few words to search for."""
        if not len(self.vocab):
            return np.full(len(hashes), -1, np.int64)
        if not hasattr(self, "sieve"):
            self.sieve = np.zeros(1 << 20, bool)
            self.sieve[(self.vocab >> U64(44)).astype(np.int64)] = True
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.sieve[(hashes >> U64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, hashes[some]), len(self.vocab) - 1)
        out[some] = np.where(self.vocab[at] == hashes[some], at, -1)
        return out

    def lead(self, counts: np.ndarray) -> None:
        """Choose each window's rarest word (ties: by word hash) and sort the windows by it."""
        rank = np.empty(len(self.vocab), np.int64)
        rank[np.lexsort((self.vocab, counts))] = np.arange(len(self.vocab))
        offset = np.array([int(np.argmin(rank[self.tokens[a:b]])) for a, b in zip(self.at, self.at[1:], strict=False)], np.int64)
        head = self.tokens[self.at[:-1] + offset] if len(offset) else np.zeros(0, np.int64)
        order = np.argsort(head, kind="stable")
        self.order, self.offset = order, offset
        self.begin = np.searchsorted(head[order], np.arange(len(self.vocab) + 1))

    def match(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence in rows of word ids."""
        fan = np.diff(self.begin)
        hot = np.flatnonzero((ids >= 0) & (fan[np.maximum(ids, 0)] > 0)) if len(fan) else np.zeros(0, np.int64)
        at_all, win_all = [], []
        row_end = np.repeat(bounds[1:], np.diff(bounds))
        row_start = np.repeat(bounds[:-1], np.diff(bounds))
        i = 0
        reach = np.concatenate([[0], np.cumsum(fan[ids[hot]])]) if len(hot) else np.zeros(1, np.int64)
        while i < len(hot):  # a bounded number of candidates at a time
            j = max(i + 1, int(np.searchsorted(reach, reach[i] + (1 << 20), "right")) - 1)
            some = hot[i:j]
            n = fan[ids[some]]
            pos = np.repeat(some, n)
            win = self.order[np.repeat(self.begin[ids[some]], n) + ramp(n)]
            start = pos - self.offset[win]
            ok = (start >= row_start[pos]) & (start + self.length[win] <= row_end[pos])  # positions and lengths
            start, win = start[ok], win[ok]
            for k in range(int(self.length.max(initial=0))):  # all words in their places
                on = self.length[win] > k
                good = ~on
                good[on] = ids[start[on] + k] == self.tokens[self.at[win[on]] + k]
                start, win = start[good], win[good]
            at_all.append(start)
            win_all.append(win)
            i = j
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *at_all]), np.concatenate([empty, *win_all])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of docs inside occurrences of benchmark windows, with docs' other columns kept.

    Adds n_words, hits (array of [start, end) word ranges), n_hit, items (ids of items with occurring windows, sorted as
    strings) and contaminated. Words are lower-cased runs of digits, letters and bytes beyond ASCII. A window is ``window``
    consecutive words of an item; a shorter item is one window, one without words has none.

    Word counts over all documents choose the rarest word of each window. A broadcast holds at most block_bytes of benchmark
    text; a larger benchmark is joined block by block and the ranges are put together. One item longer than a block
    makes a block of its own. Null texts count as empty; a null item's windows hit, but it is not among the items; repeated rows
    get equal results; a very long text is taken whole, in one task; an empty benchmark leaves all documents clean, an empty table stays empty.
    A column of docs named like an added one is replaced by it.
    """
    spark = docs.sparkSession
    sized = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t"))
    weight = sized.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-weight // block_bytes))
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    at = inner[names.index(text)]
    texts = rows.select(F.col(at).alias("_text"))
    for k in range(blocks):
        part = [(r["i"], r["t"]) for r in sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()]
        index = Index(part, window)
        counts = np.zeros(len(index.vocab), np.int64)
        if len(counts):
            for r in texts.mapInArrow(index.count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
                counts[r["word"]] = r["n"]
        index.lead(counts)
        rows = _find(rows, spark.sparkContext.broadcast(index), at, k == blocks - 1)
    return with_added(rows, names, ["n_words", "hits", "n_hit", "items", "contaminated"])


def _find(rows: DataFrame, shared, text: str, last: bool) -> DataFrame:
    from pyspark.sql import types as T

    carried = "_hits" in rows.columns
    names = [c for c in rows.columns if c not in ("_hits", "_items")]
    kinds = [rows.schema[c] for c in names]
    pair = T.ArrayType(T.ArrayType(T.LongType()))
    added = [T.StructField("_hits", pair), T.StructField("_items", T.ArrayType(T.StringType()))]
    done = [T.StructField("n_words", T.LongType()), T.StructField("hits", pair), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())]
    columns, labels = rows.columns, [f.name for f in kinds + (done if last else added)]
    at = columns.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("decontamination")
        index = shared.value
        for whole in batches:
            whole = whole.rename_columns([f"c{i}" for i in range(whole.num_columns)])
            for b in slices(whole, f"c{at}"):
                data, off = text_buffer(b.column(at))
                starts, ends, hashes, bounds = FOLDED.split(data, off)
                ids = index.lookup(hashes)
                first, win = index.match(ids, bounds)
                row = np.searchsorted(bounds, first, "right") - 1
                n = b.num_rows
                hits: list[list] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                if carried:
                    hits = [list(x) for x in b.column(columns.index("_hits")).to_pylist()]
                    items = [set(x) for x in b.column(columns.index("_items")).to_pylist()]
                order = np.argsort(first, kind="stable")
                for r, s, w in zip(row[order].tolist(), first[order].tolist(), win[order].tolist(), strict=True):
                    if any(bytes(data[starts[i] : ends[i]]).lower() != index.words[int(ids[i])] for i in range(s, s + int(index.length[w]))):
                        continue  # another word with the same hash
                    hits[r].append([s - int(bounds[r]), s - int(bounds[r]) + int(index.length[w])])
                    items[r].update(index.items_of(w))
                merged = [_merge(x) for x in hits]
                out = [b.column(columns.index(c)) for c in names]
                if last:
                    total = [sum(e - s for s, e in x) for x in merged]
                    out += [pa.array(np.diff(bounds).astype(np.int64)), pa.array(merged, pa.list_(pa.list_(pa.int64()))), pa.array(total, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([x > 0 for x in total])]
                else:
                    out += [pa.array(merged, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(out, names=labels)

    return rows.mapInArrow(find, T.StructType(kinds + (done if last else added)))


def _merge(ranges: list) -> list:
    out: list = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
