"""Token ids as documents compressed one by one under a shared zstandard dictionary.

A store is a folder of two tables.  ``dictionary``: the dictionary's SHA-256
and bytes.  ``shards``: one row per shard of about ``SHARD_BYTES``, holding
the frames of consecutive documents in ``payload``, and for each document its
id, the byte offset of its frame and its number of tokens, beside the hash
of the dictionary that the frames need.  Shards are in ascending order of
document id by (part, shard).  A single document is read by its offset,
without decompressing its neighbours.

Ids are serialised as little-endian unsigned integers, of 16 bits where the
vocabulary allows.  The dictionary is trained on the serialised ids of about
``SAMPLE_DOCS`` documents chosen by a hash of the id, of each at most
``SAMPLE_BYTES``; everything else covers every id of every document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark.llm.tokens import WordEncoder, load_tokenizer, word_bpe_path

END_ID = 2
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 32_768
DICTIONARY_BYTES = 65_536
SHARD_BYTES = 4 << 20
LEVEL = 3


def _encoded(encoder: WordEncoder, texts: list, end_id: int, dtype: str):
    end = np.array([end_id], dtype=dtype)
    for ids in encoder.encode_each(texts):
        yield np.concatenate([ids.astype(dtype), end])


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, dtype: str) -> bytes:
    """Dictionary bytes; none if the sample is too small to train one."""
    rows = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_DOCS / max(rows, 1)) * (1 << 30)))

    def run(batches):
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [
                x.tobytes()[:SAMPLE_BYTES] for x in _encoded(encoder, batch["text"].tolist(), end_id, dtype)]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    # SAMPLE_DOCS is what the hash gives on average; the limit bounds it for repeated ids too
    samples = [bytes(r.ids) for r in sample.mapInPandas(run, f"doc_id {kind}, ids binary").limit(2 * SAMPLE_DOCS).collect()]
    samples.sort()
    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 8:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # the trainer found nothing that repeats
        return b""


def write_store(docs: DataFrame, path: str, tokenizer_path: str | None = None, id_col: str = "doc_id",
                text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Write every row of ``docs`` as one document, in ascending id order (null ids first, equal ids by text).

    A null or empty text is a document of the end id alone; repeated rows are
    documents of their own; other columns are ignored; an empty table gives
    a store without shards.
    """
    tokenizer_path = tokenizer_path or word_bpe_path()
    dtype = "<u2" if max(load_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trained = train_dictionary(own, tokenizer_path, end_id, dtype)
    digest = hashlib.sha256(trained).hexdigest()
    docs.sparkSession.createDataFrame([(digest, bytearray(trained))], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    width = np.dtype(dtype).itemsize

    def run(batches):
        encoder, part, shard = WordEncoder(tokenizer_path), TaskContext.get().partitionId(), 0
        press = _compressor(trained)
        frames, ids_of, counts, size = [], [], [], 0

        def flush():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            return pd.DataFrame({"part": [part], "shard": [shard], "dict_hash": [digest], "width": [width],
                                 "payload": [b"".join(frames)], "doc_ids": [ids_of], "offsets": [offsets],
                                 "counts": [counts], "tokens": [sum(counts)]})

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None),
                                   _encoded(encoder, batch["text"].tolist(), end_id, dtype)):
                frames.append(press.compress(ids.tobytes()))
                ids_of.append(doc_id)
                counts.append(len(ids))
                size += len(frames[-1])
                if size >= shard_bytes:
                    yield flush()
                    shard += 1
                    frames, ids_of, counts, size = [], [], [], 0
        if frames:
            yield flush()

    kind = own.schema["doc_id"].dataType.simpleString()
    ordered = own.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInPandas(run, f"part int, shard int, dict_hash string, width int, payload binary, doc_ids array<{kind}>, "
                             "offsets array<long>, counts array<int>, tokens long").write.parquet(f"{path}/shards")


def _compressor(trained: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def _decompressor(trained: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.bytes)).hexdigest() != row.hash:
        raise ValueError(f"the dictionary in {path} doesn't have its hash")
    return row.hash, bytes(row.bytes)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the frames.

    ``start`` counts the ids of all documents before it in (part, shard) order;
    the crc is that of the ids as little-endian unsigned 32-bit integers.
    """
    digest, trained = _dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards")

    def run(batches):
        expand = _decompressor(trained)
        for batch in batches:
            rows = []
            for part, shard, used, width, payload, doc_ids, offsets in batch.itertuples(index=False):
                if used != digest:
                    raise ValueError(f"shard {part}/{shard} needs dictionary {used}, not {digest}")
                before = 0
                for i, doc_id in enumerate(doc_ids):
                    ids = np.frombuffer(expand.decompress(payload[offsets[i]:offsets[i + 1]]), dtype=f"<u{width}").astype("<u4")
                    rows.append((part, shard, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
            out = pd.DataFrame(rows, columns=["part", "shard", "doc_id", "before", "n_tokens", "ids_crc32"])
            yield out.assign(doc_id=out["doc_id"].astype(object).where(out["doc_id"].notna(), None)) if out["doc_id"].isna().any() else out

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    docs = shards.select("part", "shard", "dict_hash", "width", "payload", "doc_ids", "offsets").mapInPandas(
        run, f"part int, shard int, doc_id {kind}, before long, n_tokens long, ids_crc32 long")
    # one number for each task that wrote the store
    base, parts = 0, []
    for r in shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect():
        parts.append((r.part, base))
        base += r.tokens
    first = spark.createDataFrame(parts, "part int, base long")
    earlier = F.coalesce(F.sum("tokens").over(
        Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start_of = shards.select("part", "shard", earlier.alias("earlier")).join(first, "part").select(
        "part", "shard", (F.col("earlier") + F.col("base")).alias("base"))
    return docs.join(start_of, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents named in ``ids``: only their frames are cut out and decompressed.

    The offset index gives a row for each document with the two ends of its
    frame; those wanted are gathered by shard, so a shard's payload goes along
    once, and shards without a wanted document aren't read past the join.
    Null and unknown ids find nothing, an id named twice is found once, and
    every document stored under it gives a row.
    """
    digest, trained = _dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards").where(F.col("dict_hash") == digest)
    n = F.size("doc_ids")
    ends = F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.slice("offsets", F.lit(1), n).alias("a"), F.slice("offsets", F.lit(2), n).alias("b"))
    index = shards.select("part", "shard", F.inline(ends))
    wanted = index.join(ids.select(F.col(id_col).alias("doc_id")).dropna().distinct(), "doc_id").groupBy("part", "shard").agg(
        F.collect_list("doc_id").alias("doc_ids"), F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    frames = shards.select("part", "shard", "width", "payload").join(wanted, ["part", "shard"])

    def run(batches):
        expand = _decompressor(trained)
        for batch in batches:
            for width, payload, doc_ids, starts, ends_of in zip(batch["width"], batch["payload"], batch["doc_ids"], batch["a"], batch["b"]):
                yield pd.DataFrame({"doc_id": doc_ids, "ids": [
                    np.frombuffer(expand.decompress(payload[a:b]), dtype=f"<u{width}").astype(np.int32) for a, b in zip(starts, ends_of)]})

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    return frames.select("width", "payload", "doc_ids", "a", "b").mapInPandas(run, f"doc_id {kind}, ids array<int>")
