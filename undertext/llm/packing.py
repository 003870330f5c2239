"""Documents packed into sequences of a fixed number of tokens, by best-two-fit.

Documents longer than a sequence are cut into whole ones, and what is over comes first; nothing else is cut. A bin is
filled greedily, always with the largest piece that fits. If room is left, its smallest piece gives way to those two
pieces not packed yet that fill the gap it leaves best, where they fill it better. Only the sizes of pieces matter, and
there are no more of them than tokens in a sequence: the sizes at hand are bits of a number, so the largest size that fits and
the two sizes with a given sum are found by a few operations on whole numbers.

Texts are encoded once, and pieces are written with their ids. Pieces are then dealt at random to shards of about
`A_SHARD` pieces, which have nearly the same mix of sizes; each is packed by itself, whatever documents and sources it
holds, so no document, source or copy makes a large group. Bins that stay loose (mainly the last ones of each shard)
are taken apart, and their pieces are dealt and packed once more together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertext.llm.common import shared_folder, stored, table

ROOM, END = 2048, 0
A_SHARD = 8192
#: Bins with at least this part of their room free are packed again.
LOOSE = 1 / 16
#: Texts that are encoded at once.
TEXTS = 2000
PIECES = "key bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, width int, ids binary"
PACKED = "key bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, free bigint"


def cutting(path: str, end_id: int, room: int):
    """Pieces of encoded texts; key tells all pieces of the table apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from undertext.llm.tokens import encoder

        encode, key = encoder(path), TaskContext.get().partitionId() << 40
        tail = np.array([end_id], dtype=encode.kind)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some, out = batch.slice(at, TEXTS), []
                for doc_id, own in zip(some["doc_id"].to_pylist(), encode(some["text"])):
                    ids = np.concatenate([own, tail])
                    start = 0
                    for n, end in enumerate(range(len(ids) % room or room, len(ids) + 1, room) if len(ids) > room else (len(ids),)):
                        part = ids[start:end]
                        out.append((key, doc_id, n, start, end - start, zlib.crc32(part.astype("<u4")), part.itemsize, part.tobytes()))
                        key, start = key + 1, end
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        encode.forget()

    return run


def best_two_fit(lengths: list[int], room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each piece, and the room that its bin has left. Lengths are from 1 to room; of equal ones, those listed first are packed first."""
    at_hand: list[list[int]] = [[] for _ in range(room + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        at_hand[lengths[i]].append(i)
    have = sum(1 << size for size, rows in enumerate(at_hand) if rows)
    mirror = sum(1 << (room - size) for size, rows in enumerate(at_hand) if rows)  # bit room - size
    bins = np.empty((3, len(lengths)), dtype=np.int64)
    number = 0
    while have:
        free, inside = room, []
        while fitting := have & ((2 << free) - 1):
            size = fitting.bit_length() - 1
            inside.append(at_hand[size].pop())
            free -= size
            if not at_hand[size]:
                have, mirror = have ^ 1 << size, mirror ^ 1 << (room - size)
        if free and len(inside) > 1:
            least = lengths[inside[-1]]
            for both in range(free + least, least, -1):
                sizes = have & (mirror >> (room - both))
                if both % 2 == 0 and sizes >> (both // 2) & 1 and len(at_hand[both // 2]) == 1:
                    sizes ^= 1 << (both // 2)  # one piece is not a pair
                if sizes:
                    back, size = inside.pop(), sizes.bit_length() - 1
                    for x in (size, both - size):
                        inside.append(at_hand[x].pop())
                        if not at_hand[x]:
                            have, mirror = have ^ 1 << x, mirror ^ 1 << (room - x)
                    at_hand[least].append(back)
                    have, mirror = have | 1 << least, mirror | 1 << (room - least)
                    free += least - both
                    break
        offset = 0
        for i in inside:
            bins[:, i] = number, offset, free
            offset += lengths[i]
        number += 1
    return bins[0], bins[1], bins[2]


def packing(shards: int, again: bool, room: int):
    """Packs the pieces of one shard. Numbers of sequences differ between shards and rounds."""

    def run(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32", "key")])
        bins, offset, free = best_two_fit(pieces["length"].to_pylist(), room)
        numbers = 2 * (bins * shards + pieces["shard"][0].as_py()) + again
        columns = [pieces[c] for c in ("key", "doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.Table.from_arrays([*columns, *map(pa.array, (numbers, offset, free))], names=[c.split()[0] for c in PACKED.split(", ")])

    return run


def packed_once(pieces: DataFrame, count: int, again: bool, room: int, a_shard: int) -> DataFrame:
    shards = max(1, -(-count // a_shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.lit(again), "key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(packing(shards, again, room), PACKED)


def write_pieces(docs: DataFrame, folder: str, path: str, end_id: int = END, room: int = ROOM) -> DataFrame:
    """Encodes every whole text of docs (doc_id, text), with the end id behind it, and writes its pieces with their ids to folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(cutting(path, end_id, room), PIECES), folder)


def packed(pieces: DataFrame, folder: str, room: int = ROOM, a_shard: int = A_SHARD) -> DataFrame:
    """pieces (of write_pieces, without ids) with sequence_id and offset: places in sequences of at most room tokens, without gaps from 0 on. Placements are written to folder."""
    slim = pieces.drop("width", "ids")
    first = stored(packed_once(slim, slim.count(), False, room, a_shard), f"{folder}/first")
    loose = first.where(F.col("free") >= room * LOOSE)
    again = stored(packed_once(loose.select(*slim.columns), loose.count(), True, room, a_shard), f"{folder}/again")
    return first.where(F.col("free") < room * LOOSE).union(again).drop("free")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, docs, offsets, widths, ids): each sequence's documents, their offsets in it, and its ids, piece by piece, as packed numbers of so many bytes."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "width", "ids")))  # a sequence holds no more pieces than tokens
    whole = places.select("key", "sequence_id", "offset").join(pieces.select("key", "doc_id", "width", "ids"), "key").groupBy("sequence_id").agg(held.alias("held"))
    return whole.select("sequence_id", F.col("held.doc_id").alias("docs"), F.col("held.offset").alias("offsets"), F.col("held.width").alias("widths"), F.col("held.ids").alias("ids"))


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, end_id: int = END, room: int = ROOM, a_shard: int = A_SHARD) -> tuple[DataFrame, DataFrame]:
    """The pieces of docs (doc_id, text) with their ids, and their places, both as written tables in a new shared folder.

    Null text is empty: its piece is the end id alone. Repeated rows and null doc_ids have pieces of their own, told
    apart by key; other columns are left out; an empty table gives empty tables. Texts of any length are cut by ids alone.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_folder(spark)
    pieces = write_pieces(docs, f"{folder}/pieces", path, end_id, room)
    return pieces, packed(pieces, folder, room, a_shard)


def op12_best_fit_packing(spark, sf_dir) -> DataFrame:
    """A row each piece of all documents, with its sequence and place; see pack for nulls, repeated rows and empty tables."""
    return pack(spark, table(spark, sf_dir, "documents"))[1].select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
