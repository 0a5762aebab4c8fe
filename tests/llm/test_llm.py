"""The ten operators against brute force, on rows with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridia.llm import components, decontaminate, fingerprints, jaccard_join, lines, mixing, pii, substrings, tokenfile, tokens, toxicity
from meridia.llm.common import FOLDED, text_buffer

rng = np.random.default_rng(5)
VOCAB = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 6))) for _ in range(80)]
PASSAGE = " ".join(rng.choice(VOCAB, 30))


def prose(n):
    return " ".join(rng.choice(VOCAB, n))


BASE = prose(60)
TEXTS = [
    None, "", "  \n ", BASE, BASE, BASE.replace(BASE.split()[30], "changed", 1), prose(40) + " " + PASSAGE, PASSAGE + " " + prose(25), "one", "one two",
    "the the the " * 40, prose(20000), "Ünï çødé <|endoftext|> tail  double \n\n lines\n x", "mail a.b@c.example.org, _x@y.zz or 10.0.0.255 and 1.2.3.999; +1 (555) 123-4567 4539 1488 0343 6467 12345",
    prose(20), PASSAGE, "line one of text here\nshared line that is rather long indeed\nx", "shared line that is rather long indeed\nanother line\nshared line that is rather long indeeds",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", "clash", i) for i, t in enumerate(TEXTS)]
    rows += [(3, BASE, "s0", "clash", 9), (None, "null key text", "s1", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, n_words long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size string, n_words long")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokens.tokenizer_path())


def test_token_counts(docs, empty, tok):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, tokens.tokenizer_path()).collect())
    want = collections.Counter()
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 1024] += 1
    assert got == want
    assert tokens.token_counts(empty, tokens.tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", [TEXTS[11], "a" * 3000, "x  y\n\n z\t" * 400, "don't <|endoftext|>!! " * 300, "日本語テキスト" * 500, " <|endoftext|>" * 200])
def test_chunks_and_pieces_equal_the_whole(tok, text):
    want = tok.encode(text, add_special_tokens=False).ids
    for chunk, overlap in ((40, 16), (300, 32)):  # the least overlaps must be widened
        assert tokens.Chunks(tokens.tokenizer_path(), chunk, overlap).ids(text) == want
    ids, at = tokens.Encoder(tokens.tokenizer_path()).ids(pa.array([text, None, "", text]))
    assert ids.tolist() == want + want and at.tolist() == [0, len(want), len(want), len(want), 2 * len(want)]


SIGNS_AND_BLANKS = ["a" * 70, " ", "  ", "\n", "\n\n", "\t", "don't", "<|endoftext|>", "日本語", "\u00a0", "é", "word", "123", "!!!", "'s", " x", "\u3000", "\u0085", "\u200b", "😀", "ß,"]


def test_chunks_and_pieces_on_random_texts(tok):
    chunks, pieces = tokens.Chunks(tokens.tokenizer_path(), 40, 16), tokens.Encoder(tokens.tokenizer_path())
    for _ in range(200):
        text = "".join(rng.choice(SIGNS_AND_BLANKS, rng.integers(0, 120)))
        want = tok.encode(text, add_special_tokens=False).ids
        assert chunks.ids(text) == want and pieces.ids(pa.array([text]))[0].tolist() == want, text


def test_counts_come_from_spliced_chunks(spark):
    """A long document is put together from several chunks, and a splice that goes wrong would change its count."""
    got = tokens.token_counts(spark.createDataFrame([(1, prose(20000)), (2, "short")], "doc_id long, text string"), tokens.tokenizer_path())
    assert {r.doc_id: r.n_chunks > 5 for r in got.collect()} == {1: True, 2: False}


def test_the_piece_cache_stays_bounded(tok, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 10_000)
    enc = tokens.Encoder(tokens.tokenizer_path())
    for i in range(30):
        text = "the same words " + " ".join(f"w{i}x{j}" for j in range(40))
        assert enc.ids(pa.array([text]))[0].tolist() == tok.encode(text, add_special_tokens=False).ids
        assert enc.weight < 30_000
    assert " same" in enc.words.to_pylist()


def test_token_file_round_trip(spark, docs, empty, tok, tmp_path):
    path = f"file://{tmp_path}/t"
    tokenfile.write_tokens(docs, path, tokens.tokenizer_path(), 2)
    rows = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted([(-1 if r.doc_id is None else r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()])
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in rows) == want
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert [-1 if r.doc_id is None else r.doc_id for r in rows] == [w[0] for w in want]
    crc = {r.start: r.ids_crc32 for r in tokenfile.read_tokens(spark, path, digests_only=True).collect()}
    assert all(crc[r.start] == zlib.crc32(struct.pack(f"<{r.n_tokens}I", *r.ids)) for r in rows)
    assert list(tokenfile.read_document(spark, path, 8).first().ids) == tok.encode("one").ids + [2]
    blocks = spark.read.parquet(f"{path}/shards")
    broken = blocks.withColumn("frames", F.expr("overlay(frames PLACING cast('xxxx' AS binary) FROM 1)"))
    last = broken.where("size(doc_ids) > 1").orderBy("shard").collect()[-1].doc_ids[-1]  # each block's first frame is spoilt, others aren't expanded
    assert list(tokenfile._frames(spark, path, broken, wanted=last).first().ids) == tok.encode(TEXTS[last], add_special_tokens=False).ids + [2]
    tokenfile.write_tokens(empty, f"file://{tmp_path}/e", tokens.tokenizer_path(), 2)
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_mix(spark, docs, empty, monkeypatch):
    rows = mixing.mix_plan(docs, shards=3, block_words=50).collect()
    again = mixing.mix_plan(docs.repartition(5), shards=3, block_words=50).collect()
    key = lambda rs: sorted((str(r.doc_id), r["size"], str(r.copies)) for r in rs)
    assert key(rows) == key(again)
    assert len(rows) == docs.count() and all(r.taken == r["size"] * len(r.copies) <= 3 * r["size"] for r in rows)
    assert mixing.mix_plan(empty).count() == 0
    clashing = docs.withColumnsRenamed({"size": "copies", "n_words": "_shard"})
    out = mixing.mix(clashing, shards=3, block_words=50)
    assert out.columns == ["doc_id", "text", "source", "copies", "_shard"]
    assert out.count() == sum(len(r.copies) for r in rows) and {r.copies for r in out.collect()} == {"clash"} and {r._shard for r in out.collect()} <= {0, 1, 2}
    assert mixing.targets({"a": 10, "b": 100, None: 100}, {"a": 1, "b": 2, None: 3}) == {"a": 30, "b": 72, None: 108}


@pytest.mark.parametrize("run", [1024, 2])
def test_block_copies_follow_the_splitting_tree(spark, monkeypatch, run):
    """Blocks of each source and shard are the tree's quotas, ranks are a permutation, and sources come near their targets."""
    monkeypatch.setattr(mixing, "RUN", run)
    rows = [(i, prose(int(rng.integers(1, 40))), ["a", "b", "c", None][min(i % 7, 3)]) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    kept = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: seen.append(kept(*a)) or seen[-1])
    plan = mixing.mix_plan(df, shards=5, block_words=60).collect()
    (quotas,) = seen
    source = {i: s for i, _, s in rows}
    at, taken, goal = collections.defaultdict(dict), collections.Counter(), {}
    for r in plan:
        s = source[r.doc_id]
        taken[s] += r.taken
        goal[s] = r.target
        for c in r.copies:
            assert at[s].setdefault(c.rank, c.shard) == c.shard  # a block copy stays together
    for s, q in zip(["a", "b", "c", None], quotas, strict=True):
        per = collections.Counter(at[s].values())
        assert max(at[s]) < q.sum() and all(per[k] <= q[k] for k in range(5))
        assert len(at[s]) >= 0.8 * q.sum()  # a hashed block may hold no document
        bounds = np.cumsum(q)
        assert all(k == np.searchsorted(bounds, r, "right") for r, k in at[s].items())
        assert abs(taken[s] - goal[s]) <= 20
    assert [list(at["a"]) != sorted(at["a"])]


@pytest.mark.parametrize("count", [1, 2, 3, 7, 18, 33, 42, 1000])
def test_permuted_is_a_permutation_and_no_rotation(spark, count):
    got = [r.p for r in spark.range(count).select(mixing.permuted(F.col("id"), F.lit(count).cast("long"), F.lit(5)).alias("p")).collect()]
    assert sorted(got) == list(range(count))
    if count > 6:
        assert len({(b - a) % count for a, b in zip(got, got[1:], strict=False)}) > (3 if count > 10 else 1)


def test_split_tree():
    counts = np.array([7, 0, 23, 11])
    out = mixing.split_tree(counts, 5, 3)
    assert (out.sum(axis=1) == counts).all() and out.min() >= 0 and np.ptp(out.sum(axis=0)) <= 1
    assert (out == mixing.split_tree(counts, 5, 3)).all()


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def folded(t):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def brute_classes(rows):
    sets = {}
    for k, t in rows:
        w = folded(t)
        sets[k] = frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    root, links = {k: k for k in sets}, collections.Counter()

    def find(v):
        return v if root[v] == v else find(root[v])

    for a in sets:
        for b in sets:
            if a < b and (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 or a < b and not sets[a] and not sets[b]:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (find(k), links[k]) for k in sets}


def test_jaccard_join(spark, docs, empty):
    words = prose(400).split()
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(300):  # one large group of near copies, over several blocks
        w = list(words)
        w[i] = f"edit{i}"
        rows.append((100 + i, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert jaccard_join.jaccard_join(docs).count() == docs.count()
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_jaccard_join_keeps_negative_keys_apart_from_null_ones(spark):
    rows = [(-5, BASE), (None, BASE), (7, BASE), (-9, prose(50)), (None, prose(50))]
    got = {r.doc_id: (r.copies, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[-5] == got[7] == (3, 2) and got[-9] == (1, 0) and None in got
    with pytest.raises(TypeError):
        jaccard_join.jaccard_join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


ADDED = ["n_tokens", "n_removed", "kept", "n_lines", "n_hit", "hits", "items", "contaminated", "score", "fingerprint", "copies", "class_id", "_node", "doc", "twin", "_text", "_key", "_shard"]


def test_columns_named_like_outputs(spark, docs):
    """Every operator on a table that has columns named like its own: added columns replace them, others keep their values."""
    table = docs.select("doc_id", "text", "source", "n_words", *(F.lit("own").alias(c) for c in ADDED))
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    scorer = toxicity.Scorer(model_of(" x "), {"the": 1.0}, 0.0)
    n = table.count()
    for out, own in (
        (substrings.substring_dedup(table), ["n_words", "n_removed", "kept"]), (lines.line_dedup(table), ["n_lines", "n_removed", "kept"]),
        (decontaminate.contamination(table, bench), ["n_words", "hits", "n_hit", "items", "contaminated"]), (toxicity.toxicity(table, scorer), ["score"]),
        (fingerprints.fingerprints(table), ["fingerprint"]),
    ):
        assert out.columns == [c for c in table.columns if c not in own] + own
        rows = out.select(*ADDED).collect()
        assert len(rows) == n and all(r[c] == "own" for r in rows for c in ADDED if c not in own)
        assert all(r[c] != "own" for r in rows for c in ADDED if c in own)
    assert jaccard_join.keep_one(table).select(*ADDED).distinct().count() == 1
    for out in (jaccard_join.jaccard_join(table), tokens.token_counts(table, tokens.tokenizer_path()), pii.find_pii(table), fingerprints.edited_fingerprints(table), mixing.mix_plan(table)):
        assert out.count() == n
    assert mixing.mix(table).where("copies <> 'own'").count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (5, 4), (4, 2), (9, 8), (20, 9)], "a long, b long")
    assert {r.node: r.component for r in components.components(edges).collect()} == {1: 1, 2: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 8}


def brute_substrings(rows):
    seen, out = {}, {}
    for k, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if seen.setdefault(g, (k, i)) != (k, i):
                gone.update(range(i, i + 20))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substrings(spark, docs, empty):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50 + i, " ".join(rng.choice(VOCAB[:3], 60))) for i in range(30)] + [(90 + i, "same pair " * 60) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.substring_dedup(df).collect()} == brute_substrings(rows)
    twice = substrings.substring_dedup(spark.createDataFrame([(1, PASSAGE), (1, PASSAGE)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in twice] == [0, 0]
    assert substrings.substring_dedup(docs).count() == docs.count()
    assert substrings.substring_dedup(empty).count() == 0


def test_lines(spark, docs, empty):
    got = {r.doc_id: r for r in lines.line_dedup(docs).collect()}  # n_words is a column of docs
    # the x of 12, without blanks, comes before that of 16
    assert got[16].n_removed == 1 and got[17].kept == "another line" and got[17].n_removed == 2
    assert got[4].kept == "" and got[3].n_removed == 0 and got[0].n_lines == 0
    assert lines.line_dedup(empty).count() == 0
    rows = [(1, "\t\r\n same line \r\nlast"), (2, "same line\t"), (-3, "\x0b\n\n"), (4, "same line")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 0, rows[0][1]), 2: (1, 1, ""), -3: (0, 0, rows[2][1]), 4: (1, 1, "")}
    with pytest.raises(TypeError):
        lines.line_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_found_lines_and_shingles_equal_those_of_python():
    for _ in range(200):
        texts = ["".join(rng.choice(["a", "b ", " ", "\n", "\n\n", "\t", "\r\n", "é", "x y"], rng.integers(0, 12))) for _ in range(rng.integers(1, 6))]
        data, off = text_buffer(pa.array(texts))
        row, pos, first, last = lines.find_lines(data, off)
        got = [(int(r), int(p), bytes(data[a:b]).decode()) for r, p, a, b in zip(row, pos, first, last, strict=True)]
        strip = lambda x: x.strip(" \t\r\x0b\x0c")
        assert got == [(i, j, strip(x)) for i, t in enumerate(texts) for j, x in enumerate(t.split("\n")) if strip(x)]
        hashes, at = lines.shingles(data, lines.prefix_sums(data, 0), first, last)
        seen = {}
        for k, (_, _, x) in enumerate(got):
            own = [x[i : i + 8] for i in range(max(len(x) - 7, 1))]
            assert at[k + 1] - at[k] == len(own)
            assert all(seen.setdefault(s, h) == h for s, h in zip(own, hashes[at[k] : at[k + 1]].tolist(), strict=True))
        assert len(set(seen.values())) == len(seen)


def brute_pii(x):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0 if d else False
            if {"email": True, "ip": all(int(v) <= 255 for v in m.group().split(".")) if k == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), pii.KINDS.index(k), m.end()))
    return sorted(out)


def brute_line_classes(found, threshold=lines.THRESHOLD, k=lines.SHINGLE):
    """Sets of equal or nearly equal lines, over all pairs."""
    sets = [{x[i : i + k] for i in range(len(x) - k + 1)} or {x} for x in found]
    root = list(range(len(found)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(found)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(found)):
        out.setdefault(find(i), set()).add(found[i])
    return {frozenset(c) for c in out.values() if len(c) > 1}


def own_lines(kind):
    """Families of near lines about the threshold: edited words, swapped letters, added ends, common stems."""
    rnd = np.random.default_rng(11)
    own = lambda n: " ".join(rnd.choice(VOCAB, n))
    found = [own(20) for _ in range(40)]
    if kind == "stems":  # far from each other, but with a common passage
        stem = own(40)
        for _ in range(40):
            family = stem + " " + own(45)
            found += [family, family + " " + rnd.choice(list("abc")), family.replace(" ", "  ", 1)]
    else:
        for _ in range(150):
            base = own(int(rnd.integers(4, 60))).split()
            found.append(" ".join(base))
            for _ in range(3):
                w = list(base)
                for _ in range(int(rnd.integers(1, 2 + len(w) // 8))):
                    w[int(rnd.integers(len(w)))] = str(rnd.choice(VOCAB))
                found.append(" ".join(w))
    return sorted({x.strip() for x in found})


def found_classes(spark, found, **how):
    table = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    parts, classes = lines.line_classes(table, **how)
    named = parts.join(classes, "h1").groupBy("class").agg(F.collect_set("doc").alias("m")).collect()
    return {frozenset(found[i] for i in r.m) for r in named if len(r.m) > 1}


@pytest.mark.parametrize(("kind", "group"), [("stems", 20_000), ("stems", 20), ("edits", 20_000)])
def test_line_classes_equal_all_pairs(spark, kind, group):
    """With the real bands, and where large bands are dealt anew by pairs of bands."""
    found = own_lines(kind)
    got, want = found_classes(spark, found, group=group), brute_line_classes(found)
    linked = lambda classes: sum(len(c) - 1 for c in classes)
    # no false link: every class lies within one of all pairs; of the links hardly any is missed
    assert all(any(c <= w for w in want) for c in got)
    assert linked(got) >= (0.99 if group > 20 else 0.97) * linked(want)


@pytest.mark.parametrize(("kind", "least"), [("edits", lines.LEAST), ("edits", lines.HASHES + 1), ("stems", lines.HASHES + 1), ("chain", lines.HASHES + 1)])
def test_no_pair_of_a_group_is_dropped_by_its_values(monkeypatch, kind, least):
    """With a LEAST that no pair reaches, all links must come from the exact rest."""
    monkeypatch.setattr(lines, "LEAST", least)
    monkeypatch.setattr(lines, "PAIRS", 50)
    text = "".join(rng.choice(list("abcdefgh"), 400))
    found = [text[i : i + 200] for i in range(0, 200, 5)] if kind == "chain" else own_lines(kind)  # near their neighbours only
    data, off = text_buffer(pa.array(found))
    hashes, at = lines.shingles(data, lines.prefix_sums(data, 0), off[:-1], off[1:])
    sets = [np.unique(hashes[i:j]) for i, j in zip(at, at[1:], strict=False)]
    root = list(range(len(found)))
    edges = lines.Links(lines.THRESHOLD, 64).spanning(sets)
    for i, j in edges:
        root = [root[i] if r == root[j] else r for r in root]
    got = {frozenset(x for x, r in zip(found, root, strict=True) if r == c) for c in root}
    want = brute_line_classes(found)
    assert {c for c in got if len(c) > 1} == want and len(edges) == sum(len(c) - 1 for c in want)


def test_large_bands_lose_no_pair(spark):
    """Bands of more than 3 lines are dealt anew; the same classes come out as from whole bands."""
    found = own_lines("edits") + own_lines("stems")
    assert found_classes(spark, found, group=3) == found_classes(spark, found)


def test_recall_of_the_bands_and_of_the_filter():
    """Share of pairs at 0.8 to 0.85 that share a band and keep LEAST equal values: 0.99 at least."""
    rnd = np.random.default_rng(3)
    pairs = []
    while len(pairs) < 500:
        w = list(rnd.choice(VOCAB, int(rnd.integers(5, 80))))
        v = list(w)
        for _ in range(int(rnd.integers(1, 2 + len(w) // 10))):
            v[int(rnd.integers(len(w)))] = str(rnd.choice(VOCAB))
        x, y = " ".join(w), " ".join(v)
        a, b = ({t[i : i + 8] for i in range(max(len(t) - 7, 1))} for t in (x, y))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            pairs += [x, y]
    data, off = text_buffer(pa.array(pairs))
    sig = lines.signatures(*lines.shingles(data, lines.prefix_sums(data, 0), off[:-1], off[1:]))
    keys = lines.bands(sig)
    met = (keys[::2] == keys[1::2]).any(axis=1) & ((sig[:, ::2] == sig[:, 1::2]).sum(axis=0) >= lines.LEAST)
    assert met.mean() >= 0.99


def test_pii(spark, docs, empty):
    alphabet = ["1", "23", "4539148803436467", ".", "@", "a.b", "-", " ", "+", "_", "com", "é", "10.0.0.1", "(5) "]
    rows = [(i, "".join(rng.choice(alphabet, 25))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(2000, "a.b." * 20000 + "@"), (2001, "1 2 " * 20000), (2002, "call 555-123-4567 or joe (at) site (dot) com, ssn 123-45-6789")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        assert [(x.s, x.k, x.e) for x in got[k].base] == brute_pii(t or ""), t[:200]
        assert set(got[k].base) <= set(got[k].spans)
    assert any(x.k >= 4 for x in got[2002].spans)
    assert pii.find_pii(docs).count() == docs.count() and pii.find_pii(empty).count() == 0


@pytest.mark.parametrize("n", [1, pii.RUN - 1, pii.RUN, pii.RUN + 1, 3 * pii.RUN, 4000])
def test_pii_places_every_match_of_a_text(spark, n):
    text = " ".join(f"\u00fc{i} joe{i}@mail{i}.org, 10.0.{i % 300}.1" for i in range(n))
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.s, x.k, x.e) for x in got.base] == brute_pii(text)


def test_every_match_of_an_added_kind_has_the_hint():
    java = lambda p: re.sub(r"([+*?}])\+", r"\1", p)  # noqa: E731  possessive quantifiers, which older engines lack
    samples = ["account _DE44500105175407324931 end", "AB12CDEF3456GH", "x(55)123 4567", "(555) 12.3456", "123-45-6789", "joe(AT)site(dot)com", "call 555 123 4567"]
    samples += ["".join(rng.choice(["(", ")", "at", "[", "]", "12", "345", "DE44", "AB12", "-", " ", ".", "com", "_"], 12)) for _ in range(8000)]
    found = 0
    for x in samples:
        if any(re.search(java(p), x) for p in pii.ADDED.values()):
            found += 1
            assert re.search(pii._HINT, x), x
    assert found > 100


def test_reliabilities_of_labelers():
    """Labelers that agree get a high reliability, one that votes at random a low one; the classifier follows the reliable ones."""
    rnd = np.random.default_rng(2)
    counts = collections.Counter()
    for _ in range(4000):
        y = rnd.random() < 0.5
        vote = lambda right: str(2 * int(y == (rnd.random() < right)))  # noqa: E731, B023
        counts["".join([vote(0.95), vote(0.9), vote(0.9), vote(0.5), "1"])] += 1
    model = pii.SpanModel([(5, v, 1, n) for v, n in sorted(counts.items())])
    good, bad = [model.reliability[k] for k in ("pattern", "gazetteer", "context")], model.reliability["against"]
    assert min(good) > 0.85 and bad < 0.65
    assert model.accept(5, "22201", 1) and not model.accept(5, "00021", 1)
    assert not pii.SpanModel([]).weights


def test_decontamination(spark, docs, empty):
    items = [(1, PASSAGE), (2, "one two"), (3, None), (4, ""), (5, prose(50)), (10, PASSAGE.upper()), (None, "the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 60):  # one block, and several
        got = collections.Counter()
        for r in decontaminate.contamination(docs, bench, block_bytes=size).collect():
            got[r.doc_id, r.n_words, r.n_hit, tuple(r.items)] += 1
        want = collections.Counter()
        for r in docs.collect():
            w, hit, found = folded(r.text), set(), set()
            for item, t in items:
                b = folded(t)
                k = min(10, len(b))
                for g in {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else ():
                    for i in range(len(w) - k + 1):
                        if tuple(w[i : i + k]) == g:
                            hit.update(range(i, i + k))
                            if item is not None:
                                found.add(str(item))
            want[r.doc_id, len(w), len(hit), tuple(sorted(found))] += 1
        assert got == want
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_fingerprints(spark, docs, empty):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, t in rows:
        x, y = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(x) // 4
        edited = x[: len(x) - k] + y[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].near_next == 1) >= (x == y)
    assert got[3].fingerprint == got[4].fingerprint and got[3].near_next == 1
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1
    assert fingerprints.edited_fingerprints(docs).count() == docs.count() and fingerprints.edited_fingerprints(empty).count() == 0
    assert {r.text: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}[BASE] == got[3].fingerprint


def test_collision_rate_is_generalised_jaccard():
    a, b = ["x y " * 3 + "p q r s", "x y " * 5 + "p q t u"]
    count = lambda t: collections.Counter(zip(t.split(), t.split()[1:]))  # noqa: B905, E731
    ca, cb = count(a), count(b)
    want = sum(min(ca[k], cb[k]) for k in ca | cb) / sum(max(ca[k], cb[k]) for k in ca | cb)
    data, off = text_buffer(pa.array([a, b]))
    _, _, h, at = FOLDED.split(data, off)
    sig = fingerprints.signatures(h, at, 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_toxicity(spark, docs, empty):
    bad = ["scumbag", "moronic"]
    rows = [(i, " ".join([prose(30), *([bad[i % 2]] if i % 3 == 0 else [])])) for i in range(600)]
    rows += [(1000, "well sc0mb4g but s c u m b a g"), (1001, "you m0r0n1c thing"), (1002, "mooooronic"), (1003, prose(20)), (1004, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(df, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity(df, scorer).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(600))
    assert got[1000] > 0.5 and got[1001] > 0.5 and got[1002] > 0.5 and got[1003] < 0.5 and got[1004] < 0.5
    assert [r.h for r in df.select(toxicity.held_out("doc_id").alias("h")).collect()] == [toxicity.crc_held_out(i) for i, _ in rows]
    assert toxicity.toxicity(docs, scorer).count() == docs.count() and toxicity.toxicity(empty, scorer).count() == 0
    assert toxicity.toxicity(df, toxicity.fit(empty, labels)).count() == len(rows)


def model_of(seen):
    c = lambda x: toxicity._letter(x) if x.isalpha() else 0
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    for x, y, z in zip(seen, seen[1:], seen[2:], strict=False):
        counts[(c(x) * toxicity.CLASSES + c(y)) * toxicity.CLASSES + c(z)] += 1
    return toxicity.CharacterModel(counts)


def test_a_sign_at_the_end_of_a_token_is_decoded():
    restorer = toxicity.Restorer(model_of(" idiot " * 50))
    assert restorer.restored("An idio7, AN 1D10T and an i d i o t") == "an idiot, an idiot and an idiot"
    assert restorer.restored("12.50 or 3-4\n\tat 10.0.0.1") == "12.50 or 3-4\n\tat 10.0.0.1"


def test_letters_beyond_ascii_are_decoded_whole():
    restorer = toxicity.Restorer(model_of(" dümer кретин " * 50))
    assert restorer.restored("düm3r") == "dümer"
    assert toxicity._runs("düm3r кр@тин") == ["düm3r", "кр@тин"]


def test_the_score_is_that_of_the_restored_text():
    scorer = toxicity.Scorer(model_of(" idiot " * 50), {"idiot": 3.0, "idio": -3.0, "idi": 1.0}, 0.0)
    assert scorer.score("idio7!") == scorer.score("idiot!") == scorer.score("i d i o t") != scorer.score("idio 7")


def test_viterbi_finds_the_best_of_all_readings():
    """Short tokens against every path of the lattice, tried one by one."""
    model = model_of(" sad lad bad as lass " * 40)

    def readings(runs):
        if not runs:
            yield 0.0, ""
            return
        ch, n = runs[0]
        options = [(ch, 0.0)] if ch.isalpha() else [(x, toxicity.SIGN) for x in toxicity.SIGNS[ch]] + [(ch, toxicity.LITERAL), ("", toxicity.DROP * n)]
        for x, cost in options:
            for rest, tail in readings(runs[1:]):
                if not x or x == ch and not ch.isalpha():
                    yield cost + rest, x * n + tail
                else:
                    yield cost + (toxicity.REPEAT if n > 1 else 0.0) + rest, x + tail
                    if n > 1:
                        yield 2 * cost + (toxicity.REPEAT if n > 2 else 0.0) + rest, x + x + tail

    def total(cost, word):
        a = b = 0
        for x in word + " ":
            c = toxicity._letter(x) if x.isalpha() else 0
            cost += model.log[a][b][c]
            a, b = b, c
        return cost

    for token in ("b4d", "5ad", "l@55", "s_a-d", "l4sss", "8ad5", "a.b"):
        runs = [(m.group()[0], len(m.group())) for m in re.finditer(r"(.)\1*", token)]
        # a literal run is one step of class 0 for the model
        best = max(total(c, re.sub(r"([^a-z])\1+", r"\1", w)) for c, w in readings(runs))
        got = model.decode(token)
        assert abs(max(total(c, re.sub(r"([^a-z])\1+", r"\1", w)) for c, w in readings(runs) if w == got) - best) < 1e-9, token


def test_pipeline_stages(spark, tok, tmp_path):
    """Each stage against what it should do, on documents with further columns and odd rows, and the whole run."""
    import corpus_pipeline as cp

    rude = "you utter scumbag and moronic fool "
    rows = [(i, prose(120), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rude + prose(40), "s0") for i in range(40)]
    rows += [(200, rows[5][1], "s1"), (201, rows[6][1].replace(rows[6][1].split()[60], "changed", 1), None), (202, prose(50) + " " + PASSAGE + " " + prose(50), "s2"), (203, None, "s2"), (204, "", None), (None, prose(60), "s1")]
    table = spark.createDataFrame([(*r, "own", -1) for r in rows], "doc_id long, text string, source string, score string, _shard int")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(40)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    table.write.parquet(f"file://{tmp_path}/documents.parquet")
    sf, kept = f"file://{tmp_path}", {}
    docs = table
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == table.columns
        kept[name] = docs.collect()
        assert {(r.score, r._shard) for r in kept[name]} == {("own", -1)}
        docs = spark.createDataFrame(kept[name], table.schema)
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    everyone = {r[0] for r in rows}
    assert ids["toxicity"] == everyone - set(range(100, 140))
    assert ids["toxicity"] - ids["jaccard_join"] == {200, 201, 204} and len(kept["jaccard_join"]) == len(ids["jaccard_join"])
    assert ids["jaccard_join"] - ids["decontamination"] == {202}
    text = {r[0]: r[1] for r in rows}
    size = {k: len((text[k] or "").split()) for k in ids["decontamination"]}
    copies = collections.Counter(r.doc_id for r in kept["mixing"])
    assert set(copies) <= set(size) and max(copies.values()) <= 3 and abs(sum(n * size[k] for k, n in copies.items()) - sum(size.values())) < 400
    done = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in done) == sorted((str(k), len(tok.encode(text[k] or "").ids) + 1) for k in copies.elements())
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in cp.run(spark, sf).collect()) == sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in done)
    spark.createDataFrame([], table.schema).write.parquet(f"file://{tmp_path}/e/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/e/{name}.parquet")
    assert cp.run(spark, f"{sf}/e").count() == 0
