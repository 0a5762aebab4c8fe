"""Toxicity scores of deobfuscated text: a noisy-channel Viterbi decoder under a character model, then a linear model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, begin, scratch, slices, text_buffer, with_added

#: Labelled rows that are used for fitting at most: those with the least hashes of their ids.
TRAINING_ROWS = 20_000
#: Defaults of the classifier's size (see fit): least association of a feature with the label (log-likelihood ratio), number of features,
#: and training documents that a feature occurs in.
ASSOCIATION, FEATURES, LEAST_ROWS = 12.0, 4096, 3
#: Code points of a word that prefix features use.
PREFIXES = (4, 5, 6, 7)

# --- the channel ------------------------------------------------------------------------------

# What a written sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou", "_": "",
    "-": "", ".": "", "'": "", "~": "", "^": "",
}
#: Log-probabilities of the channel: a sign for a letter, a dropped sign, a sign that is meant as it stands, a letter repeated on purpose.
SIGN, DROP, LITERAL, REPEAT = -1.0, -0.5, -1.0, -0.7
_INNER = re.escape("".join(SIGNS))
#: Runs of letters of any script and signs, and what makes a run look disguised: a sign between letters, before or after a letter, or signs
#: next to signs beside a letter, or a letter three times.
_RUN = re.compile(rf"(?:[^\W\d_]|[{_INNER}])+")
_SUSPECT = re.compile(rf"[^\W\d_][{_INNER}]+[^\W\d_]|[0-9@$!|+(*#][^\W\d_]|[^\W\d_][0-9@$!|+]|([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_]|[0-9@$!|])(?:[ .\-_*]{1,2}(?:[^\W\d_]|[0-9@$!|])){3,}(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")
CLASSES = 28  # 0: no letter, 1-26: a-z, 27: characters beyond ASCII


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for i in range(26):
        table[97 + i] = table[65 + i] = i + 1
    table[128:] = 27
    return table


_TABLE = _class_table()


class CharacterModel:
    """Trigrams of letter classes, from counts over all documents, with bigram and unigram back-off by interpolation."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64) + 0.01
        two, one = c.sum(axis=0), c.sum(axis=(0, 1))
        p = 0.7 * c / c.sum(axis=2, keepdims=True) + 0.25 * (two / two.sum(axis=1, keepdims=True))[None] + 0.05 * (one / one.sum())[None, None]
        self.log = np.log(p).tolist()

    @staticmethod
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        total = np.zeros(CLASSES**3, np.int64)
        for whole in batches:
            for b in slices(whole, "_text"):
                data, off = text_buffer(b.column(0))
                c = _TABLE[data[(data & 0xC0) != 0x80]]  # the first byte of each character
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    def decode(self, token: str) -> str:
        """The likeliest word behind a token: Viterbi over the lattice of letters that its signs may stand for.

        A sign may stand for a letter, for nothing, or for itself, which ends a word. Runs of one letter may stand for one or two of
        it. The state is the last two letter classes; the cost is linear in the length of the token.
        """
        runs: list[tuple[str, int]] = []
        for ch in token:
            if runs and runs[-1][0] == ch:
                runs[-1] = (ch, runs[-1][1] + 1)
            else:
                runs.append((ch, 1))
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for ch, n in runs:
            options = [(ch, 0.0)] if ch.isalpha() else [(x, SIGN) for x in SIGNS.get(ch, "")] + [("", DROP * n), (ch, LITERAL)]
            step: dict = {}
            for (a, b), (score, path) in best.items():
                for x, cost in options:
                    if not x:
                        self._keep(step, (a, b), score + cost, path)
                        continue
                    if x is ch and not ch.isalpha():
                        self._keep(step, (b, 0), score + cost + self.log[a][b][0], (path, ch * n))
                        continue
                    c = _letter(x)
                    once = score + cost + self.log[a][b][c]
                    self._keep(step, (b, c), once + (REPEAT if n > 2 else 0.0 if n == 1 else REPEAT), (path, x))
                    if n > 1:
                        self._keep(step, (c, c), once + cost + self.log[b][c][c] + (0.0 if n == 2 else REPEAT), ((path, x), x))
            best = step
        score, path = max(((s + self.log[a][b][0], p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    @staticmethod
    def _keep(step, state, score, path):
        if state not in step or step[state][0] < score:
            step[state] = (score, path)


def _letter(x: str) -> int:
    o = ord(x)
    return o - 96 if 97 <= o <= 122 else 27


def character_model(docs: DataFrame, text: str = "text") -> CharacterModel:
    """Trigram counts over all documents; what comes to the driver is CLASSES ** 3 sums at most."""
    counts = np.zeros(CLASSES**3, np.int64)
    grams = docs.select(F.col(text).alias("_text")).mapInArrow(CharacterModel.count, "gram long, n long")
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return CharacterModel(counts)


def _runs(token: str) -> list[str]:
    """The runs of letters and signs of a token that look disguised."""
    return [m for m in _RUN.findall(token) if _SUSPECT.search(m)]


class Restorer:
    """Restores texts; decoded tokens are remembered, KNOWN of them at most."""

    KNOWN = 20_000

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def token(self, token: str) -> str:
        """The token with its disguised runs decoded."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.KNOWN:
                self.known.clear()
            got = self.known[token] = _RUN.sub(lambda m: self.model.decode(m.group()) if _SUSPECT.search(m.group()) else m.group(), token)
        return got

    def restored(self, text: str) -> str:
        """The text in lower case, with letters that stand apart put together and every disguised run replaced by its decoding."""
        text = _SPACED.sub(lambda m: self.token(re.sub(r"[ .\-_*]", "", m.group())), text.lower())
        odd = [p for p in set(text.split()) if (not p.isalpha() or _TRIPLE.search(p)) and _SUSPECT.search(p)]
        changed = {p: new for p in odd if (new := self.token(p)) != p}
        return re.sub(r"\S+", lambda m: changed.get(m.group(), m.group()), text) if changed else text


#: The worker's restorer, given back when another operator takes over the worker.
_RESTORERS: dict[str, Restorer] = {}
CACHES.append(_RESTORERS)
_TRIPLE = re.compile(r"(.)\1\1")


def words_of(restored: str) -> set[str]:
    """Distinct words of a restored text: runs of letters."""
    parts = set(restored.split())
    found = {p for p in parts if p.isalpha()}
    for p in parts - found:
        found.update(_WORD.findall(p))
    return found


# --- the classifier ---------------------------------------------------------------------------


def features(words: set[str]) -> set[str]:
    """Whole words, and beginnings of words marked by a star."""
    out = set(words)
    for n in PREFIXES:
        out |= {w[:n] + "*" for w in words if len(w) > n}
    return out


def held_out(key):
    """Column: whether crc32 of the id as text is divisible by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Scorer:
    def __init__(self, model: CharacterModel, weights: dict[str, float], bias: float):
        self.model, self.weights, self.bias = model, weights, bias
        self.names = frozenset(weights)
        self.stems = {n: frozenset(w[:-1] for w in weights if w.endswith("*") and len(w) == n + 1) for n in PREFIXES}
        self.whole = frozenset(w for w in weights if not w.endswith("*"))

    def score(self, text: str) -> float:
        if "" not in _RESTORERS or _RESTORERS[""].model is not self.model:
            _RESTORERS[""] = Restorer(self.model)
        words = words_of(_RESTORERS[""].restored(text))
        hit = [self.weights[w] for w in words & self.whole]
        for n, stems in self.stems.items():
            if stems:
                hit += [self.weights[s + "*"] for s in {w[:n] for w in words if len(w) > n} & stems]
        return float(1 / (1 + np.exp(-min(max(self.bias + sum(hit), -30.0), 30.0))))


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = TRAINING_ROWS, seed: int = 1,
    association: float = ASSOCIATION, most: int = FEATURES, least: int = LEAST_ROWS,
) -> Scorer:
    """Learn from labelled documents outside the held-out fifth: at most ``rows`` of them, those with the least id hashes.

    Executors restore the texts, turn them into feature sets and count in how many documents of each label a feature occurs. The model is over
    features that raise the rate of the label: in ``least`` training documents or more, with a log-likelihood ratio of ``association`` or more, and
    of these the ``most`` strongest; larger bounds give a larger model, in the driver too, which gets these features and each
    training document's indices of them. A ridge-penalised logistic regression weighs them. The character
    model is counted over all documents. Without labelled rows every text gets score 0.

    Null labels and keys are left out; a key with several labels has the greatest; a label without document and a document without label are
    not used; null and empty texts have no features; repeated rows count as often as they occur; further columns play no part.
    """
    spark = docs.sparkSession
    model = character_model(docs, text)
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    few = marked.orderBy(F.xxhash64(F.lit(seed), "_k"), "_k").limit(rows)
    sample = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(F.broadcast(few), "_k").select("_y", "_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        restorer = Restorer(model)
        for b in (x for whole in batches for x in slices(whole, "_text")):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(features(words_of(restorer.restored(t or "")))) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["y", "f"])

    bags = scratch(sample.mapInArrow(sets, "y int, f array<string>"), "toxicity")
    total = {r["y"]: r["n"] for r in bags.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        return Scorer(model, {}, -30.0 if not pos else 30.0)
    by = bags.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where(F.col("n") >= least)
    n, p = F.col("n"), F.lit(pos / (pos + neg))
    share = F.col("a") / n
    part = lambda x, q: F.when(x > 0, x * F.log(x / q)).otherwise(0.0)
    strength = 2 * n * (part(share, p) + part(1 - share, 1 - p))
    kept = [r["f"] for r in by.withColumn("g", strength).where((F.col("g") >= association) & (share > p)).orderBy(F.desc("g"), "f").limit(most).collect()]
    place = {f: i for i, f in enumerate(kept)}
    if not kept:
        rate = pos / (pos + neg)
        return Scorer(model, {}, float(np.log(rate / (1 - rate))))

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[place[x] for x in f if x in place] for f in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["y", "i"])

    data = sorted((r["y"], tuple(r["i"])) for r in bags.mapInArrow(indices, "y int, i array<int>").collect())
    y = np.array([d[0] for d in data], np.float64)
    row = np.repeat(np.arange(len(data)), [len(d[1]) for d in data])
    col = np.array([i for d in data for i in d[1]], np.int64)
    w, b = np.zeros(len(kept)), float(np.log(pos / neg))
    lr, m, v = 0.1, np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, 301):  # full-batch Adam: deterministic
        z = b + np.bincount(row, w[col], len(y))
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, err[row], len(kept)) / len(y) + 1e-4 * w, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Scorer(model, dict(zip(kept, w.tolist(), strict=True)), float(b))


def toxicity(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """docs with a column score: the probability that the restored text is toxic.

    Null and empty texts have no features and get the base score; a very long text is scored whole, in one task. Repeated rows get equal
    scores; an empty table stays empty; rows and columns stay as they are, but for one named score, which the result replaces; no
    shuffle. The scorer, of bounded size (fit's ``most`` weights and CLASSES ** 3 numbers), is broadcast.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        s = shared.value
        for whole in batches:
            for b in slices(whole, f"c{at}"):
                scores = pa.array([s.score(t or "") for t in b.column(at).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, "s"])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("s", T.DoubleType())]))
    return with_added(out, docs.columns, ["score"])


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
