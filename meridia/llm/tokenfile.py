"""Token ids as a binary file format: documents compressed one by one under a shared dictionary, with an offset index.

A file set is a folder of three Parquet tables, so that any store that Spark writes to can hold it and Spark's
committer makes the writes safe against lost executors:

* ``dictionary``: one row; dict_hash (hex sha256), the zstandard dictionary's bytes, the width of an id in bytes.
* ``shards``: a row for each block of documents: shard, block, first_doc and last_doc, the index (doc_ids, n_tokens,
  starts within the shard, offsets into frames), frames (one zstandard frame a document) and dict_hash. Shards are
  ascending ranges of doc_id, blocks ascend within a shard. first_doc and last_doc let Parquet's statistics find the
  block of a document; its offset then gives its frame alone.
* ``manifest``: a row for each shard: n_docs, n_tokens, base (ids of all shards before it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import begin, integer_key, partitions, range_bounds, slices
from .tokens import Encoder, opened

#: The dictionary: its bytes, the documents of its training sample at most, and the characters of a passage of each, which
#: begins anywhere in the text. The bound keeps the sample at a few MB for any corpus; it changes no id, only frames' sizes.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 1 << 16, 1000, 4000
#: A block ends after so many documents or bytes of frames.
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
LEVEL = 3


def _train(docs: DataFrame, tokenizer: str, text: str, key: str) -> tuple[bytes, int]:
    """A zstandard dictionary from the id arrays of passages of a bounded sample: the documents with the SAMPLE_DOCS least
    hashes of their keys. A passage begins at a place that the hash chooses, so all parts of texts are met."""
    import zstandard

    hashed = docs.select(F.xxhash64(key).alias("_h"))
    low = hashed.orderBy("_h").limit(SAMPLE_DOCS).agg(F.max("_h")).first()[0]
    rows = []
    if low is not None:
        start = F.pmod(F.xxhash64(F.lit(1), key), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
        rows = docs.where(F.xxhash64(key) <= low).select(F.xxhash64(key).alias("_h"), F.substring(text, start, F.lit(SAMPLE_CHARS)).alias("t")).orderBy("_h", "t").limit(SAMPLE_DOCS).collect()
    enc = Encoder(tokenizer)
    ids, at = enc.ids(pa.array([r["t"] or "" for r in rows], pa.large_string()))
    samples = [s for s in (ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)) if s]
    try:
        data = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: raw content serves as a dictionary
        data = b"".join(samples)[:DICTIONARY_BYTES] or bytes(8)
    return data, enc.width.itemsize


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, text: str = "text", key: str = "doc_id", shards: int | None = None) -> None:
    """Encode each whole text (null: empty), append end_id, and write the file set in ascending order of key.

    Encoding and compression precede the one shuffle, so only frames are moved. Shards are ranges of about
    equal counts of documents. The key must be an integer. Rows of equal keys stay, ordered by their frames; null keys come first; an empty
    table gives a file set without blocks; a very long text is one frame; further columns, whatever their names, are not kept.
    """
    spark = docs.sparkSession
    rows = docs.select(integer_key(docs, key).alias("_key"), F.col(text).alias("_text"))
    dictionary, width = _train(rows, tokenizer, "_text", "_key")
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary), width)], "dict_hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    bounds = range_bounds(rows, "_key", shards or partitions(spark))
    edges = np.array(bounds, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        begin("token file")
        enc = opened(Encoder, tokenizer)
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        for whole in batches:
            for b in slices(whole, "_text", 3 << 20):
                ids, at = enc.ids(b.column(1))
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                raw = memoryview(ids).cast("B")
                ends = (at * width).tolist()
                frames = [press.compress(raw[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
                known = b.column(0).fill_null(0).to_numpy()
                shard = np.where(b.column(0).is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edges, known, "right")).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0), pa.array(np.diff(at)), pa.array(frames, pa.binary())], names=["shard", "_key", "n", "frame"])

    names = ["shard", "block", "first_doc", "last_doc", "doc_ids", "n_tokens", "starts", "offsets", "frames", "dict_hash"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows that arrive in the order of the file; a block is made of slices of batches."""
        begin("token file, pack")
        held, docs_held, weight = [], 0, 0
        shard, block, start = None, 0, 0

        def emit():
            nonlocal held, docs_held, weight, block, start
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys, n, frames = t.column(1), t.column(2).to_numpy(), t.column(3)
            known = keys.drop_null()
            lengths = pc.binary_length(frames).to_numpy().astype(np.int64)
            ends = [known[0].as_py(), known[-1].as_py()] if len(known) else [None, None]
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            lists = [keys, pa.array(n), pa.array(start + np.cumsum(n) - n), pa.array(np.concatenate([[0], np.cumsum(lengths)]))]
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), *(pa.array([e], pa.int64()) for e in ends), *map(one, lists), pa.array([b"".join(frames.to_pylist())], pa.binary()), pa.array([digest])]
            start, block = start + int(n.sum()), block + 1
            held, docs_held, weight = [], 0, 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            shards = b.column(0).to_numpy()
            bytes_to = np.cumsum(pc.binary_length(b.column(3)).to_numpy().astype(np.int64))
            i = 0
            while i < b.num_rows:
                if shards[i] != shard:
                    if held:
                        yield emit()
                    shard, block, start = int(shards[i]), 0, 0
                before = bytes_to[i - 1] if i else 0
                j = min(i + BLOCK_DOCS - docs_held, int(np.searchsorted(shards, shard, "right")), int(np.searchsorted(bytes_to, before + BLOCK_BYTES - weight)) + 1)
                held.append(b.slice(i, j - i))
                docs_held, weight, i = docs_held + j - i, weight + int(bytes_to[j - 1] - before), j
                if docs_held >= BLOCK_DOCS or weight >= BLOCK_BYTES:
                    yield emit()
        if held:
            yield emit()

    frames = rows.mapInArrow(encode, "shard int, _key long, n long, frame binary")
    ordered = frames.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("_key").asc_nulls_first(), "n", "frame")
    blocks = ordered.select("shard", "_key", "n", "frame").mapInArrow(pack, "shard int, block long, first_doc long, last_doc long, doc_ids array<long>, n_tokens array<long>, starts array<long>, offsets array<long>, frames binary, dict_hash string")
    blocks.write.parquet(f"{path}/shards")
    index = spark.read.parquet(f"{path}/shards").select("shard", F.size("doc_ids").cast("long").alias("d"), F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("t"), "first_doc", "last_doc")
    sums = index.groupBy("shard").agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")
    spark.sparkContext._jvm.System.gc()


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    r = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(data := bytes(r["dictionary"])).hexdigest() != r["dict_hash"]:
        raise ValueError("the dictionary doesn't match its hash")
    return r["dict_hash"], data, r["width"]


def _frames(spark: SparkSession, path: str, blocks: DataFrame, digests_only: bool = False, wanted: int | None = None) -> DataFrame:
    """Documents of blocks; with wanted only the frames of this document are cut out, by the offsets, and expanded."""
    digest, data, width = _dictionary(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("token file, read")
        from binascii import crc32

        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                at, raw = r["offsets"], memoryview(r["frames"])
                some = [i for i, d in enumerate(r["doc_ids"]) if wanted is None or d == wanted]
                ids = [np.frombuffer(expand.decompress(raw[at[i] : at[i + 1]]), f"<u{width}").astype("<u4") for i in some]
                if [len(x) for x in ids] != [r["n_tokens"][i] for i in some]:
                    raise ValueError("a frame doesn't hold as many ids as its index says")
                last = pa.array([crc32(x) for x in ids], pa.int64()) if digests_only else pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                index = [pa.array([r[c][i] for i in some], pa.int64()) for c in ("doc_ids", "starts", "n_tokens")]
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(ids), pa.int32()), *index, last], names=["shard", "doc_id", "_start", "n_tokens", what])

    what, kind = ("ids_crc32", "long") if digests_only else ("ids", "array<long>")
    rows = blocks.select("shard", "doc_ids", "n_tokens", "starts", "offsets", "frames", "dict_hash").mapInArrow(decode, f"shard int, doc_id long, _start long, n_tokens long, {what} {kind}")
    bases = spark.read.parquet(f"{path}/manifest").select("shard", "base")
    return rows.join(bases, "shard").select("doc_id", (F.col("_start") + F.col("base")).alias("start"), "n_tokens", what)


def read_tokens(spark: SparkSession, path: str, digests_only: bool = False) -> DataFrame:
    """All documents of a file set: doc_id, start, n_tokens, and ids or, with digests_only, ids_crc32."""
    return _frames(spark, path, spark.read.parquet(f"{path}/shards"), digests_only)


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document: Parquet's statistics leave the block that can hold it, the offset index its frame, which alone is expanded."""
    blocks = spark.read.parquet(f"{path}/shards").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return _frames(spark, path, blocks, wanted=doc_id)
