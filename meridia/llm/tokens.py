"""Tokenising whole texts: overlapping chunks that are spliced where both agree, and a piece cache over the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, begin, ramp, slices, text_buffer

#: Characters of a chunk; every longer document is encoded in overlapping chunks.
CHUNK = 4096
#: Characters that neighbouring chunks share at first; doubled until a common boundary is proven.
OVERLAP = 64
#: Bytes of pieces and ids that a worker remembers, by estimate; beyond that it keeps those that recur, up to half as many.
REMEMBERED_BYTES = 40 << 20
#: What a remembered piece takes beside its characters and ids: its offsets, and its entry in the table that a call builds.
_ENTRY = 48
#: Words that are encoded as one text when they are learnt.
JOINED = 200


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _splits_by_blanks(tok) -> bool:
    """Whether pre-tokens can be proven: byte-level by the usual pattern, no normaliser, no blanks added
    or stripped, no special token with a blank."""
    conf = json.loads(tok.to_str())
    pre = conf.get("pre_tokenizer") or {}
    return bool(
        conf.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in conf["added_tokens"])
    )


# --- overlapping chunks -------------------------------------------------------------------------


class Chunks:
    """Encodes texts by the library in overlapping chunks, so that memory follows the chunk and not the text.

    At a common start p of pre-tokens of two neighbouring chunks, the left chunk's tokens before p are
    those of the text if p lies at least the longest special token plus one character before the
    left chunk's end: no pre-token looks further ahead. The right chunk's tokens from p on are those of the
    text too, since pre-tokens are found from left to right without looking back, and no special token
    spans p. Where a pair of chunks has no such p the left one is widened by twice the overlap, until there is one or
    the text ends. Tokenizers for which this can't be proven (see _splits_by_blanks) get whole texts.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import processors

        self.tok = load(path)
        self.proven = _splits_by_blanks(self.tok)
        self.margin = 1 + max([0, *(len(t.content) for t in self.tok.get_added_tokens_decoder().values())])
        self.chunk, self.overlap = chunk, max(overlap, self.margin + 1)
        if self.proven:  # offsets are those of the tokens themselves, blanks included
            self.tok.post_processor = processors.ByteLevel(trim_offsets=False)

    def encode(self, texts: list[str]):
        return self.tok.encode_batch(texts, add_special_tokens=False)

    def spans(self, text: str) -> list[tuple[int, int]]:
        n = len(text)
        if not self.proven or n <= self.chunk + self.overlap:
            return [(0, n)]
        return [(a, min(a + self.chunk + self.overlap, n)) for a in range(0, n - self.overlap, self.chunk)]

    def parts(self, texts: list[str]) -> list[list]:
        """For each text runs (encoding, first token, end) that put together are its tokens, in order."""
        spans = [self.spans(t) for t in texts]
        found = iter(self.encode([t[a:b] for t, s in zip(texts, spans, strict=True) for a, b in s]))
        return [self._splice(t, s, [next(found) for _ in s]) for t, s in zip(texts, spans, strict=True)]

    def _splice(self, text: str, spans: list, encodings: list) -> list:
        left, at, end, low = encodings[0], 0, spans[0][1], 0
        proven = 0  # where the left chunk's tokens from low on begin
        out = []
        for (start, stop), right in zip(spans[1:], encodings[1:], strict=True):
            width = self.overlap
            while not (cut := self._common(left, low, at, end, right, start)) and end < min(stop, len(text)):
                width *= 2
                end = min(start + width, len(text))
                left, at, low = self.encode([text[proven:end]])[0], proven, 0
            if not cut:
                continue  # the left chunk has grown over this one
            p, i, j = cut
            out.append((left, low, i))
            left, at, end, low, proven = right, start, stop, j, p
        return [*out, (left, low, len(left))]

    def _common(self, left, low: int, at: int, end: int, right, start: int) -> tuple[int, int, int] | None:
        """The last common start of pre-tokens that is proven, and the token that begins there in either chunk."""
        mine = {}
        for i in range(len(left) - 1, low, -1):
            p = left.token_to_chars(i)[0] + at
            if p <= start:
                break
            if p <= end - self.margin and left.token_to_word(i) != left.token_to_word(i - 1):
                mine[p] = i
        found = None
        for j in range(1, len(right)):  # its first token begins at a cut, which proves nothing
            p = right.token_to_chars(j)[0] + start
            if p > end - self.margin:
                break
            if p in mine and right.token_to_word(j) != right.token_to_word(j - 1):
                found = (p, mine[p], j)
        return found

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """Tokens and chunks of each text; equal texts are encoded once."""
        distinct = list(dict.fromkeys(texts))
        known = {t: (sum(b - a for _, a, b in p), len(p)) for t, p in zip(distinct, self.parts(distinct), strict=True)}
        return [known[t] for t in texts]

    def ids(self, text: str) -> list[int]:
        return [x for enc, a, b in self.parts([text])[0] for x in enc.ids[a:b]]


class Pieces:
    """Token counts by the sentencepiece library; texts are encoded whole, as its normaliser looks at blanks all over."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        return [(len(x), 1) for x in self.model.encode(texts, num_threads=1)]


# --- the piece cache ----------------------------------------------------------------------------


def safe_cuts(data: np.ndarray, offsets: np.ndarray, special: str = "") -> np.ndarray:
    """Bytes at which texts are cut into pieces: their ends, every space or line feed after a character that is no blank, and
    every ASCII sign after a letter (ASCII or Latin-1), but for the signs of ``special``.

    There a byte-level tokenizer of this family always begins a pre-token: blanks stand only before a word or among
    blanks, and signs are never in one pre-token with a letter before them. A character beyond ASCII before a blank is looked up among
    the blanks of Unicode.
    """
    kind = np.zeros(256, np.uint8)
    kind[[0x20, 0x0A]] = 1
    kind[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in special]] = 2
    after = kind[data[1:]]
    at = np.flatnonzero(after == 1) + 1
    before = data[at - 1]
    solid = (before > 0x20) & (before < 0x7F)
    high = np.flatnonzero(before >= 0x80)
    one, two, three = (data[np.maximum(at[high] - k, 0)] for k in (1, 2, 3))
    pair = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    triple = ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    solid[high] = ~(pair | triple)
    sign = np.flatnonzero(after == 2) + 1
    one, two = data[sign - 1], data[np.maximum(sign - 2, 0)]
    letter = ((one | 0x20) >= 0x61) & ((one | 0x20) <= 0x7A) | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    mask = np.zeros(len(data) + 1, bool)
    mask[at[solid]] = True
    mask[sign[letter]] = True
    mask[offsets] = True
    return np.flatnonzero(mask)


class Encoder:
    """Ids of texts by the library, piece by piece (see safe_cuts), remembering the pieces' ids.

    Texts are cut only where the tokenizer itself always cuts, so the pieces' tokens put together are those of the text.
    Tokenizers of other kinds get whole texts.
    """

    def __init__(self, path: str):
        self.tok = load(path)
        self.exact = _splits_by_blanks(self.tok)
        self.special = "".join(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.width = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        vocab = self.tok.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids whose token begins with the byte-level sign of a space
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.words = pa.array([], pa.large_string())
        self.flat = np.zeros(0, self.width)
        self.at = np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int64)  # calls in which a piece occurred

    @property
    def weight(self) -> int:
        return self.words.nbytes + self.flat.nbytes + len(self.words) * _ENTRY

    def _add(self, pieces: pa.Array, ids: list[np.ndarray], count: list[np.ndarray]) -> None:
        self.words = pa.concat_arrays([self.words, pieces])
        self.flat = np.concatenate([self.flat, *ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(count))])
        self.seen = np.concatenate([self.seen, np.zeros(len(pieces), np.int64)])

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Encode and remember new pieces; their places among the remembered ones.

        Words after a space are joined: a new one begins at each token that begins with the space. Other pieces are encoded one by one.
        """
        joins = np.array([p[0] == " " and p[1:].isalpha() for p in pieces])
        plain, other = ([pieces[i] for i in np.flatnonzero(m).tolist()] for m in (joins, ~joins))
        ids, count = [], []
        joined = ["".join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
        for enc in self.tok.encode_batch_fast(joined, add_special_tokens=False) if joined else ():
            x = np.array(enc.ids, self.width)
            at = np.flatnonzero(self.spaced[x])
            ids.append(x)
            count.append(np.diff(np.append(at, len(x))))
        if other:
            enc = self.tok.encode(other, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(enc.ids, self.width))
            count.append(np.bincount(np.array(enc.word_ids, np.int64), minlength=len(other)))
        place = np.empty(len(pieces), np.int64)
        place[joins], place[~joins] = np.arange(len(plain)), np.arange(len(plain), len(pieces))
        place += len(self.words)
        self._add(pa.array(plain + other, pa.large_string()), ids, count)
        return place

    def forget(self) -> None:
        """Keep the pieces that occurred in the most calls, more than one, up to half of the bytes."""
        n = np.diff(self.at)
        size = pc.binary_length(self.words).to_numpy() + 8 + _ENTRY + n * self.width.itemsize
        order = np.argsort(-self.seen, kind="stable")
        keep = np.sort(order[(np.cumsum(size[order]) <= REMEMBERED_BYTES // 2) & (self.seen[order] > 1)])
        ids, words, seen, n = self.flat[np.repeat(self.at[keep], n[keep]) + ramp(n[keep])], self.words.take(pa.array(keep)), self.seen[keep] // 2, n[keep]
        self.words, self.flat, self.at, self.seen = self.words[:0], self.flat[:0], self.at[:1], self.seen[:0]
        self._add(words, [ids], [n])
        self.seen = seen

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n + 1 offsets of the texts."""
        if not self.exact:
            got = [self.tok.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array([x for g in got for x in g], self.width), np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)
        data, offsets = text_buffer(texts)
        cuts = safe_cuts(data, offsets, self.special)
        if len(cuts) < 2:
            return np.zeros(0, self.width), np.zeros(len(offsets), np.int64)
        raw = pa.py_buffer(np.ascontiguousarray(data))
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), raw]).dictionary_encode()
        if self.weight > REMEMBERED_BYTES:
            self.forget()
        own = pc.index_in(pieces.dictionary, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(own < 0)
        if len(new):
            own[new] = self.learn(pieces.dictionary.take(pa.array(new)).to_pylist())
        self.seen[own] += 1
        place = own[np.asarray(pieces.indices)]
        start = self.at[place]
        n = self.at[place + 1] - start
        ends = np.cumsum(n)
        where = np.arange(ends[-1])
        where += np.repeat(start - (ends - n), n)
        return self.flat[where], np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]


_OPEN: dict = {}
CACHES.append(_OPEN)


def opened(kind, path: str):
    """One Encoder, Chunks or Pieces for each worker process."""
    if (kind, path) not in _OPEN:
        _OPEN[kind, path] = kind(path)
    return _OPEN[kind, path]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """Tokens of each whole text: (key, n_bytes, n_tokens, over_limit, n_chunks).

    Texts of more than CHUNK characters are encoded in overlapping chunks, which are spliced at proven common boundaries (see Chunks);
    n_chunks says how many were put together. A .model file is opened by sentencepiece, which gets whole texts.

    A null text counts as empty; an empty one has 0 bytes and tokens. Repeated rows and null keys stay as they
    are, one result each; an empty table gives an empty result; further columns of docs, whatever their names, are dropped. No
    shuffle: texts go through Arrow in batches, a very long one alone.
    """
    kind = Pieces if tokenizer.endswith(".model") else Chunks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("token counts")
        enc = opened(kind, tokenizer)
        for whole in batches:
            for b in slices(whole, "_text"):
                found = enc.counts([t or "" for t in b.column(1).to_pylist()])
                n, chunks = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit), pa.array(chunks)], names=[key, "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    named = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"))
    return rows.mapInArrow(count, f"`{key}` {named}, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")
