"""Training-order materialisation of token ids: fixed-stride binary shards in the order of a keyed permutation."""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.common import partitions, shared_dir, stored
from pageloom.llm.feistel import permute

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ends every document; the vocabulary leaves this id free. Ids fit 16 bits.
END_OF_TEXT = 50_256
LENGTH = 2_048
#: Sequences of one shard.
SHARD = 2_048
#: Each record: token count and checksum of its ids as two 32-bit integers, then LENGTH ids of 16 bits, little-endian, zeros after the last.
HEADER = 8
#: Compression of ids on their way to the shards, which are not compressed themselves.
LEVEL = 6
#: Tables of per-partition counts up to so many rows are broadcast.
BROADCAST_ROWS = 100_000


@lru_cache(maxsize=4)
def encoders(path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The tokenizer, and one whose pattern has no look-ahead: it gives the same ids, faster, for texts without two white-space characters in a row."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tuple(tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("own", PATTERN), ("plain", PATTERN.replace(r"\s+(?!\S)|", ""))))


_DOUBLE = re.compile(r"\s\s")


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    full, plain = encoders(path)
    return (full if _DOUBLE.search(text) else plain).encode_ordinary(text) if text else []


def stride(length: int) -> int:
    return HEADER + 2 * length


def write_shards(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard: int = SHARD, key: str = "order-1", vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the shards and a manifest under out and returns (slot, shard, position, n_tokens, doc_ids, crc): one row for each sequence, position is its byte in the shard.

    Documents are tokenised once, whole, each followed by END_OF_TEXT, and laid end to end within a scan partition; every length tokens are a sequence, the last of a partition may be short, so every token of every row is in the output once. Sequences are numbered from 0 by partition and place; a keyed Feistel permutation of these numbers gives each its slot, and slots shard * k .. are file k. Null and empty texts are an END_OF_TEXT alone; repeated rows are written as often; an empty table writes a manifest only; other columns are ignored.

    Range partitions of slots write the shards, each a run of neighbouring ones. Ids are numbers; what isn't one is null in doc_ids. The packed sequences are stored in the shared folder, so slots stay the same if a later task is run again; a shard is written under the name of its attempt and then renamed.
    """
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, size, ids = [], 0, []
        rows: list[tuple] = []

        def cut(tokens: np.ndarray, owners: list) -> None:
            nonlocal number
            rows.append((number, len(tokens), owners, tokens.tobytes()))
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            out_ = pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["part", "number", "n_tokens", "doc_ids", "tokens"])
            rows.clear()
            return out_

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array([*encode(text.as_py(), vocabulary), END_OF_TEXT], np.uint16)
                held.append(tokens)
                ids.append(doc_id)
                size += len(tokens)
                if size >= length:
                    stream = np.concatenate(held)
                    ends = np.cumsum([len(t) for t in held])
                    whole = size // length * length
                    for start in range(0, whole, length):
                        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length - 1, "right")
                        cut(stream[start : start + length], ids[first : last + 1])
                    rest = stream[whole:].copy()
                    held, ids, size = ([rest], [doc_id], len(rest)) if len(rest) else ([], [], 0)
                if len(rows) >= 512:
                    yield flush()
        if size:
            cut(np.concatenate(held), ids)
        if rows:
            yield flush()

    packed = stored(docs.select(F.col(id_col).try_cast("long"), F.col(text_col)).mapInArrow(pack, "part int, number long, n_tokens int, doc_ids array<long>, tokens binary"), "sequences")
    counts = packed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.select(F.col("part").alias("p"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "sequence-bases")
    total, n_parts = bases.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    n_shards = max(1, -(-total // shard))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        held: list[pa.RecordBatch] = []

        def send() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            slots = permute(rows["index"].to_numpy(), total, key)
            tokens, n, owners = rows["tokens"].to_pylist(), rows["n_tokens"].to_numpy(), rows["doc_ids"].to_pylist()
            order = np.argsort(slots, kind="stable")
            cuts = np.flatnonzero(np.diff(slots[order] // shard)) + 1
            for part in np.split(order, cuts):
                blob = squeeze.compress(b"".join(tokens[i] for i in part))
                arrays = [pa.array([int(slots[part[0]] // shard)], pa.int64()), pa.array([slots[part].tolist()], pa.list_(pa.int64())), pa.array([n[part].tolist()], pa.list_(pa.int32())), pa.array([[owners[i] for i in part]], pa.list_(pa.list_(pa.int64()))), pa.array([blob], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "slots", "sizes", "owners", "blob"])
            held.clear()

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 16_384:
                yield from send()
                size = 0
        if size:
            yield from send()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    yield one_shard(held)
                    held = []
                held.append(row)
        if held:
            yield one_shard(held)

    def one_shard(rows: list[dict]) -> pa.RecordBatch:
        number = rows[0]["shard"]
        first = number * shard
        records = np.zeros((min(shard, total - first), stride(length)), np.uint8)
        found = []
        for row in rows:
            blob, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), np.uint16), 0
            for slot, n, owners in zip(row["slots"], row["sizes"], row["owners"]):
                ids = blob[at : at + n]
                at += n
                crc = zlib.crc32(ids.tobytes())
                records[slot - first, :HEADER] = np.array([n, crc], np.uint32).view(np.uint8)
                records[slot - first, HEADER : HEADER + 2 * n] = ids.view(np.uint8)
                found.append((slot, number, (slot - first) * stride(length), n, owners, crc))
        found.sort()
        put(shard_path(out, number), records.tobytes())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["slot", "shard", "position", "n_tokens", "doc_ids", "crc"])

    small = F.broadcast(bases.drop("n")) if n_parts <= BROADCAST_ROWS else bases.drop("n")
    rows = packed.join(small, F.col("part") == F.col("p")).select((F.col("base") + F.col("number")).alias("index"), "n_tokens", "doc_ids", "tokens")
    dealt = rows.mapInArrow(deal, "shard long, slots array<long>, sizes array<int>, owners array<array<long>>, blob binary")
    n = min(n_shards, max(8 * partitions(spark), 200))
    dealt = dealt.repartitionById(n, F.expr(f"cast(shard * {n} div {n_shards} as int)")).sortWithinPartitions("shard")
    written = stored(dealt.mapInArrow(write, "slot long, shard long, position long, n_tokens int, doc_ids array<long>, crc long"), "sequence-index")
    put(f"{out}/manifest.json", json.dumps({"sequences": total, "length": length, "shard": shard, "shards": n_shards if total else 0, "header": HEADER, "dtype": "uint16", "key": key, "end_of_text": END_OF_TEXT}).encode())
    return written


def shard_path(out: str, number: int) -> str:
    return f"{out}/shard-{number:09d}.bin"


def put(uri: str, data: bytes) -> None:
    """Writes a file whole or not at all."""
    files, path = pa.fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as stream:
        stream.write(data)
    files.move(part, path)


def read_slots(out: str, start: int, n: int) -> Iterator[np.ndarray]:
    """Token ids of slots start .. start + n, read in order from any place on."""
    files, path = pa.fs.FileSystem.from_uri(out)
    with files.open_input_stream(f"{path}/manifest.json") as stream:
        about = json.loads(stream.read())
    step, end = stride(about["length"]), min(start + n, about["sequences"])
    while start < end:
        number, upto = start // about["shard"], min(end, (start // about["shard"] + 1) * about["shard"])
        with files.open_input_file(shard_path(path, number)) as file:
            file.seek((start - number * about["shard"]) * step)
            for _ in range(upto - start):
                record = file.read(step)
                size, crc = np.frombuffer(record[:HEADER], np.uint32)
                ids = np.frombuffer(record[HEADER : HEADER + 2 * int(size)], np.uint16)
                if zlib.crc32(ids.tobytes()) != crc:
                    raise ValueError(f"slot {start} of {out} is damaged")
                yield ids
        start = upto


def shards_of(spark: SparkSession, docs: DataFrame, **settings) -> DataFrame:
    """write_shards into a new folder of the shared one."""
    return write_shards(docs, f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}", **settings)
