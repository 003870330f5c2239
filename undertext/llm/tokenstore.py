"""Token ids as a content-addressed store.

Each document's id stream is cut into chunks where a rolling hash of its last ids ends in zeros, so equal passages
give equal chunks wherever they stand. A chunk is stored once under the SHA-256 of its ids, packed in the narrowest
width and compressed. A recipe lists a document's chunks and holds the root of the Merkle tree over them; recipes
lie in ascending doc_id order, in parts, with the position of their first id in the part. The manifest has a row for
each part: its number of documents and ids, and the root of the Merkle tree over its recipes.

One pass encodes the texts. Its chunks and recipes go through one shuffle by content, where a chunk that many
documents share is merged before it travels. Reading back verifies all: a chunk against its name, a recipe's chunks
against its root, a part's recipes against the manifest. Each chunk is opened once, however many documents hold it: a
document's length and CRC-32 follow from those of its chunks.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertext.llm.common import shared_folder, small_batches, stored, table

WINDOW, MASK, LEAST, MOST = 4, 1023, 128, 8192
DOCS_A_PART = 20_000
#: Texts that are encoded at once, and chunks that are opened at once.
TEXTS, CHUNKS = 500, 1000
PIECES = "kind string, key binary, doc_id bigint, n_tokens bigint, root binary, chunks array<binary>, width int, body binary"

_gear = np.random.default_rng(20).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def cuts(ids: np.ndarray, ends: list[int]) -> list[list[int]]:
    """Ends of the chunks of non-empty id streams that lie end to end; ends: where each stream ends.

    The first sums of a stream hold ids of the one before it, but no chunk, unless it is the last, ends there: LEAST is above WINDOW.
    """
    mixed = _gear[ids & 0xFFFF]
    rolling = mixed.copy()
    for k in range(1, min(WINDOW, len(ids))):
        rolling[k:] += mixed[:-k] << np.uint32(k)
    marks = np.flatnonzero((rolling >> np.uint32(20)) & np.uint32(MASK) == 0) + 1
    until, marks = np.searchsorted(marks, ends, side="right").tolist(), marks.tolist()
    out, last, at = [], 0, 0
    for stop, upto in zip(ends, until):
        found = []
        for end in (*marks[at:upto], stop):
            while end - last > MOST:
                last += MOST
                found.append(last)
            if end - last >= LEAST or end == stop:
                if end > last:
                    found.append(end)
                last = end
        out.append(found)
        at = upto
    return out


def merkle(digests: list[bytes]) -> bytes:
    """The root of the binary hash tree over the digests; an odd one moves up as it is. Of none, the hash of nothing."""
    level = list(digests) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo CRC-32's, bits reflected."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
    return out


_powers = [0x00800000]  # x to the 8: one byte
for _ in range(63):
    _powers.append(_times(_powers[-1], _powers[-1]))


@functools.lru_cache(1 << 16)
def _power(length: int) -> int:
    """x to the 8 times length, modulo CRC-32's polynomial; chunks have few lengths."""
    out = 0x80000000
    for k in range(length.bit_length()):
        if length >> k & 1:
            out = _times(_powers[k], out)
    return out


def crc_of_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two joined byte strings; length: bytes of the second."""
    return _times(_power(length), first) ^ second


def encode_into_pieces(path: str, end_id: int, forget: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        from undertext.llm.tokens import encoder

        encode, press = encoder(path), zstandard.ZstdCompressor(level=1).compress
        part, row, met = TaskContext.get().partitionId(), 0, set()
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.binary()]
        tail = np.array([end_id], dtype=encode.kind)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(at, TEXTS)
                own = encode(piece["text"])
                ids = np.concatenate([x for ids in own for x in (ids, tail)])
                raw, width, begin, start, out = ids.tobytes(), encode.kind.itemsize, 0, 0, []
                ends = np.cumsum([len(x) + 1 for x in own]).tolist()
                for doc_id, stop, chunk_ends in zip(piece["doc_id"].to_pylist(), ends, cuts(ids, ends)):
                    digests = []
                    for end in chunk_ends:
                        body = raw[begin * width : end * width]
                        digests.append(digest := hashlib.sha256(body).digest())
                        begin = end
                        if digest not in met:
                            met.add(digest)
                            out.append(("C", digest, None, None, None, None, width, press(body)))
                    out.append(("R", struct.pack(">IQ", part, row), doc_id, stop - start, merkle(digests), digests, None, None))
                    row, start = row + 1, stop
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if forget:
            encode.forget()  # a worker goes on to other work with its memory free

    return run


def leaf(doc_id: int | None, n_tokens: int, root: bytes) -> bytes:
    """A recipe as a leaf of its part's tree."""
    return hashlib.sha256(struct.pack("<?qq", doc_id is None, doc_id or 0, n_tokens) + root).digest()


LAID = "kind string, part int, doc_id bigint, root binary, key binary, start bigint, n_tokens bigint, chunks array<binary>, docs bigint"


def numbering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of one part in their order, with their start in the part; at its end the part's row of the manifest."""
    from pyspark import TaskContext

    part, start, leaves = TaskContext.get().partitionId(), 0, []
    kinds = [("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("root", pa.binary()), ("key", pa.binary()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.list_(pa.binary())), ("docs", pa.int64())]
    of = lambda count, **given: pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(count, t) for k, t in kinds], names=[k for k, _ in kinds])
    for batch in batches:
        sizes = batch["n_tokens"].to_pylist()
        leaves += map(leaf, batch["doc_id"].to_pylist(), sizes, batch["root"].to_pylist())
        starts = [start := start + x for x in sizes]
        yield of(batch.num_rows, kind=["R"] * batch.num_rows, part=[part] * batch.num_rows, start=[a - x for a, x in zip(starts, sizes)], **{c: batch[c] for c in ("doc_id", "root", "key", "n_tokens", "chunks")})
    if leaves:
        yield of(1, kind=["M"], part=[part], root=[merkle(leaves)], n_tokens=[start], docs=[len(leaves)])


def write_store(docs: DataFrame, path: str, end_id: int, folder: str, forget: bool = False) -> None:
    """Encodes every whole text of docs (doc_id, text) and writes chunks, recipes and manifest below folder.

    Null text is empty: it has the end id only. Rows with a null doc_id come first. Repeated rows and equal doc_ids keep
    a recipe each, ordered by root. Other columns are left out. An empty table writes empty tables. forget: whether
    workers drop the encoder's pre-tokens after each task, as between stages of other kinds; else the next task has them.
    """
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode_into_pieces(path, end_id, forget), PIECES)
    rest = [c.split()[0] for c in PIECES.split(", ")][2:]
    merged = made.groupBy("kind", "key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest])
    with small_batches(docs.sparkSession):
        pieces = stored(merged, f"{folder}/pieces", "kind")
    recipes = pieces.where("kind = 'R'").select("doc_id", "root", "key", "n_tokens", "chunks")
    parts = max(1, -(-recipes.count() // DOCS_A_PART))
    order = ["doc_id", "root", "key"]
    laid = recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(numbering, LAID)
    stored(laid, f"{folder}/laid", "kind")


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, recipes and the manifest."""
    chunks = spark.read.schema(PIECES).parquet(f"{folder}/pieces").where("kind = 'C'").select("key", "width", "body")
    laid = spark.read.schema(LAID).parquet(f"{folder}/laid")
    return chunks, laid.where("kind = 'R'").drop("kind", "docs"), laid.where("kind = 'M'").select("part", "root", F.col("n_tokens").alias("ids"), "docs")


def rooting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's root, and its numbers of ids and recipes, from its recipes in their order."""
    for batch in batches:
        for part, recipes in zip(batch["part"].to_pylist(), batch["recipes"].to_pylist()):
            found = merkle([leaf(r["doc_id"], r["n_tokens"], r["root"]) for r in recipes])
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (found, pa.binary()), (sum(r["n_tokens"] for r in recipes), pa.int64()), (len(recipes), pa.int64()))], names=["part", "f_root", "f_ids", "f_docs"])


def verified_starts(recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(part, part_start); raises where a part's recipes are not those that the manifest was written from."""
    listed = recipes.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("start", "doc_id", "n_tokens", "root"))).alias("recipes"))
    both = manifest.join(listed.mapInArrow(rooting, "part int, f_root binary, f_ids bigint, f_docs bigint"), "part", "full")
    alike = F.col("root").eqNullSafe(F.col("f_root")) & F.col("ids").eqNullSafe(F.col("f_ids")) & F.col("docs").eqNullSafe(F.col("f_docs"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("part "), F.col("part").cast("string"), F.lit(" is not as the manifest has it"))).cast("long")
    return both.withColumn("before", before).select("part", F.when(alike, F.col("before")).otherwise(wrong).alias("part_start"))


def _opener():
    """Gives a chunk's bytes, from its body and its name."""
    import zstandard

    unpress = zstandard.ZstdDecompressor().decompress

    def opened(body: bytes, digest: bytes) -> bytes:
        raw = unpress(body)
        if hashlib.sha256(raw).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} does not have the content of its name")
        return raw

    return opened


def check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = _opener()
    for batch in (b.slice(at, CHUNKS) for b in batches for at in range(0, b.num_rows, CHUNKS)):
        crc, count = [], []
        for digest, width, body in zip(*[batch[c].to_pylist() for c in ("key", "width", "body")]):
            ids = np.frombuffer(opened(body, digest), dtype=f"<u{width}").astype("<u4")
            crc.append(zlib.crc32(ids))
            count.append(len(ids))
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(crc, pa.int64()), pa.array(count, pa.int64())], names=["digest", "crc", "size"])


def check_recipe(doc_id: int | None, root: bytes, n_tokens: int, digests: list[bytes], sizes: list[int | None]) -> None:
    if None in sizes or sum(sizes) != n_tokens or merkle(digests) != root:
        raise ValueError(f"the recipe of document {doc_id} does not hold")


def check_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, root, start, n_tokens, digests, crcs, sizes in zip(*[batch[c].to_pylist() for c in ("doc_id", "root", "start", "n_tokens", "digests", "crcs", "sizes")]):
            check_recipe(doc_id, root, n_tokens, digests, sizes)
            crc = crcs[0]
            for other, size in zip(crcs[1:], sizes[1:]):
                crc = crc_of_joined(crc, other, 4 * size)
            out.append((doc_id, start, n_tokens, crc))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def gathered(recipes: DataFrame, manifest: DataFrame, chunks: DataFrame, *facts: str) -> DataFrame:
    """A row each recipe, with its start among all ids, its chunks' digests and, as arrays in their order, facts of the chunks. A chunk that is missing has null facts."""
    listed = recipes.select("part", "doc_id", "root", "key", "start", "n_tokens", F.posexplode("chunks").alias("i", "digest"))
    met = listed.join(chunks, "digest", "left").groupBy("part", "doc_id", "root", "key", "start", "n_tokens")
    parts = met.agg(F.array_sort(F.collect_list(F.struct("i", "digest", *facts))).alias("parts"))
    starts = verified_starts(recipes, manifest)
    placed = parts.join(starts, "part", "full").withColumn("start", F.col("start") + F.col("part_start"))
    return placed.select("doc_id", "root", "start", "n_tokens", F.col("parts.digest").alias("digests"), *[F.col(f"parts.{c}").alias(f"{c}s") for c in facts])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files. A chunk, recipe or part that does not hold raises."""
    chunks, recipes, manifest = _tables(spark, folder)
    checked = chunks.mapInArrow(check_chunks, "digest binary, crc bigint, size bigint")
    return gathered(recipes, manifest, checked, "crc", "size").mapInArrow(check_recipes, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) with every document's whole stream, verified as read_digests does."""
    chunks, recipes, manifest = _tables(spark, folder)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opener()
        for batch in batches:
            out = []
            for doc_id, root, n_tokens, digests, widths, bodies in zip(*[batch[c].to_pylist() for c in ("doc_id", "root", "n_tokens", "digests", "widths", "bodys")]):
                ids = [None if b is None else np.frombuffer(opened(b, d), dtype=f"<u{w}").astype(np.int64) for b, d, w in zip(bodies, digests, widths)]
                check_recipe(doc_id, root, n_tokens, digests, [None if x is None else len(x) for x in ids])
                out.append(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    bodies = chunks.withColumnRenamed("key", "digest")
    return gathered(recipes, manifest, bodies, "width", "body").mapInArrow(unpack, "doc_id bigint, start bigint, ids array<bigint>")


def token_store(spark: SparkSession, docs: DataFrame, path: str | None = None, end_id: int = 2, forget: bool = False) -> DataFrame:
    """Writes docs (doc_id, text) with write_store into a new shared folder and gives read_digests of it: a row each row of docs."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_folder(spark)
    write_store(docs, path, end_id, folder, forget)
    return read_digests(spark, folder)


def op10_token_store(spark, sf_dir) -> DataFrame:
    """The whole documents table, as token_store gives it; see there for nulls, repeated rows and empty tables."""
    return token_store(spark, table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir) -> DataFrame:
    """The documents' ids in a store, as read back from it."""
    return token_store(spark, docs, forget=True)
