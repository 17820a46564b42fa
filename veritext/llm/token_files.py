"""Token-id files in a frequency-ranked, byte-aligned variable-length code (operator 5).

Ids are replaced by their rank in the corpus's own frequency order (ties: smaller id first). A
rank takes one, two, three or four bytes; its length less one is a two-bit code in a stream of
control bytes kept apart from the data bytes, four ranks to a control byte. The 256 most
frequent ids so take one byte each. A reader looks a control byte up in a table to get the four
lengths at once, and places all data bytes with array operations.

A data set is a folder of ``.ids`` shards in ascending order of doc id (a shard holds whole
documents, its name is its place in the order), and ``rank.tab`` with the id of every rank. Layout
of a shard, little-endian: magic ``VTI1``, u32 documents n, u64 ids t; n x i64 doc ids; n bytes
(1: the id is null); n x u32 ids of each document; ceil(t / 4) control bytes; data bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.llm.common import BROADCAST_IDS, materialise, new_dir, small_batches
from veritext.llm.tokens import END_ID, default_tokenizer, encoder, text_groups

MAGIC = b"VTI1"
#: For each control byte the four lengths it stands for, and their sum.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks below 2**32."""
    r = ranks.astype("<u4")
    size = 1 + (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    codes = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    codes[: len(r)] = size - 1
    q = codes.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The inverse: ``n`` ranks from control bytes and data bytes."""
    size = LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4, dtype=np.uint8)[None, :] < size[:, None]] = data
    return out.view("<u4").reshape(-1)


def pack_shard(doc_ids: list[int | None], lens: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    head = MAGIC + np.array([len(ids)], "<u4").tobytes() + np.array([len(ranks)], "<u8").tobytes()
    return b"".join([head, ids.tobytes(), null.tobytes(), lens.astype("<u4").tobytes(), control, data])


def unpack_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if raw[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    n, t = int(np.frombuffer(raw, "<u4", 1, 4)[0]), int(np.frombuffer(raw, "<u8", 1, 8)[0])
    at = 16
    ids = np.frombuffer(raw, "<i8", n, at)
    null = np.frombuffer(raw, np.uint8, n, at := at + 8 * n)
    lens = np.frombuffer(raw, "<u4", n, at := at + n)
    control = np.frombuffer(raw, np.uint8, -(-t // 4), at := at + 4 * n)
    ranks = unpack_ranks(control, np.frombuffer(raw, np.uint8, -1, at + len(control)), t)
    return [None if z else int(i) for i, z in zip(ids, null)], lens.astype(np.int64), ranks


def _tokenise(path: str):
    """Rows in order to (id, n, ids); ids holds the document's ids and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = "<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4"
        end = np.array([END_ID], dtype=kind).tobytes()
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in text_groups(texts):
                flat, at = enc(texts[lo:hi])
                flat = flat.astype(kind)
                blobs = [flat[at[i] : at[i + 1]].tobytes() + end for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array(np.diff(at) + 1, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["id", "n", "ids"],
                )

    return run


def _counts(width: int, vocab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, dtype=np.int64)
        for b in batches:
            raw = b"".join(b.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(raw, f"<u{width}"), minlength=vocab)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    return run


def _write(folder: str, width: int, rank: np.ndarray, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        docs, lens, parts, total, first, after = [], [], [], 0, 0, -1

        def close() -> pa.RecordBatch:
            name = f"{first:020d}.ids"
            ranks = rank[np.frombuffer(b"".join(parts), f"<u{width}")]
            # a second attempt writes the same bytes, and the last step is a rename: no half file is ever read
            with fs.open_output_stream(f"{root}/_{name}.{attempt}") as f:
                f.write(pack_shard(docs, np.array(lens), ranks))
            fs.move(f"{root}/_{name}.{attempt}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([total], pa.int64())], names=["shard", "docs", "ids"]
            )

        for b in batches:
            for at, d, n, blob in zip(*(b.column(c).to_pylist() for c in ("at", "id", "n", "ids"))):
                if docs and (at != after or total >= shard_ids):
                    yield close()
                    docs, lens, parts, total = [], [], [], 0
                if not docs:
                    first = at
                docs.append(d)
                lens.append(n)
                parts.append(blob)
                total += n
                after = at + 1
        if docs:
            yield close()

    return run


def write_token_files(
    docs: DataFrame,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    shard_ids: int = 4_000_000,
) -> tuple[str, DataFrame]:
    """Encode every whole text, append the end id, write shards; gives (folder, manifest).

    manifest: one row for each shard (shard, docs, ids, start), start counting all ids before it.
    A shard is closed at ``shard_ids`` ids, so memory is bounded by that and one document. Only
    the count of each id (as many rows as the vocabulary has) comes to the driver.

    Defined cases: a null or empty text is the end id alone; null doc ids sort first; rows that
    repeat a doc id follow one another in the order of their texts. An empty table makes no
    shard. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or default_tokenizer()
    folder = folder or new_dir(spark, "op5-files")
    vocab = encoder(path).tok.get_vocab_size()
    width = 2 if vocab <= 1 << 16 else 4
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    # ranges first: their borders are sampled from the ids alone, and texts are encoded once, in order
    dealt = base.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    coded = dealt.mapInArrow(_tokenise(path), "id long, n long, ids binary")
    # at: the row's place over all ranges; a shard is a run of following places, however the files are read
    ids = materialise(coded.withColumn("at", F.monotonically_increasing_id()), "op5-ids")
    freq = ids.select("ids").mapInArrow(_counts(width, vocab), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    count = np.zeros(vocab, dtype=np.int64)
    for row in freq.collect():  # one row for each id of the vocabulary at most
        count[row.token] = row.n
    by_rank = np.lexsort((np.arange(vocab), -count)).astype("<u4")
    rank = np.empty(vocab, dtype="<u4")
    rank[by_rank] = np.arange(vocab, dtype="<u4")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/rank.tab") as f:
        f.write(by_rank.tobytes())
    written = ids.mapInArrow(_write(folder, width, rank, shard_ids), "shard string, docs long, ids long")
    shards = materialise(written, "op5-shards")
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return folder, materialise(shards.withColumn("start", F.coalesce(F.sum("ids").over(over), F.lit(0))), "op5-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Each document of the shards: doc_id, start, n_tokens, ids_crc32, and ids (array) if asked for."""
    table = spark.read.format("binaryFile").load(f"{folder}/rank.tab").select("content").first().content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = np.frombuffer(table, "<u4")
        for b in batches:
            for raw, shard in zip(b.column("content"), b.column("shard").to_pylist()):
                ids, lens, ranks = unpack_shard(raw.as_buffer())
                tokens = token[ranks]
                at = np.concatenate([[0], np.cumsum(lens)])
                crc = [zlib.crc32(tokens[at[i] : at[i + 1]]) for i in range(len(ids))]
                cols = [pa.array([shard] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    rows = files.mapInArrow(run, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # where a shard starts joins its documents, so that what the files hold isn't moved
    starts = manifest.select("shard", F.col("start").alias("first"))
    starts = F.broadcast(starts) if manifest.count() <= BROADCAST_IDS else starts
    out = rows.join(starts, "shard").withColumn("start", F.col("first") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
