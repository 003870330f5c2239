import random
import shutil

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from undertext.llm import tokens, tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_agrees_with_the_library():
    rng = random.Random(1)
    alphabet = ["a", "bc", "'s", "'ll", "the", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "中文", "1", "23", ".", "!?", "<|endoftext|>", " ", "　", "\x1c", "\x85", "​", "é", "Ⅷ", "١", "🙂", "\0", "d", "'re", "_", "×"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(5000)] + [None, "", " ", "  "]
    library = tokens.library(PATH)
    for text, ids in zip(texts, tokens.encoder(PATH)(pa.array(texts))):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "AT_ONCE", 30)
    encode, library = tokens.ByteLevelEncoder(PATH), tokens.library(PATH)
    texts = [f"some word{i}, and one more." for i in range(50)] * 2
    assert [x.tolist() for x in encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def rewritten(folder, change):
    """Each parquet file below folder with its table changed."""
    for file in folder.rglob("*.parquet"):
        table = change(pq.read_table(file, partitioning=None))
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        pq.write_table(table, file)


def flipped(table, column, at=0):
    """The table with one bit of the column's first value changed."""
    values = table[column].to_pylist()
    if not values:
        return table
    first = values[0]
    if first is None or isinstance(first, int):
        values[0] = (first or 0) + 1
    elif isinstance(first, list):
        values[0] = [bytes([first[0][0] ^ 1]) + first[0][1:], *first[1:]]
    else:
        values[0] = first[:at] + bytes([first[at] ^ 1]) + first[at + 1 :]
    return table.set_column(table.column_names.index(column), column, pa.array(values, table.schema.field(column).type))


CHANGES = {
    "chunk content": ("pieces/kind=C", lambda t: flipped(t, "body", -1)),
    "chunk gone": ("pieces/kind=C", lambda t: t.slice(1)),
    "recipe chunks": ("laid/kind=R", lambda t: flipped(t, "chunks")),
    "recipe root": ("laid/kind=R", lambda t: flipped(t, "root")),
    "recipe id": ("laid/kind=R", lambda t: flipped(t, "doc_id")),
    "recipe gone": ("laid/kind=R", lambda t: t.slice(1)),
    "recipes gone": ("laid/kind=R", lambda t: t.slice(0, 0)),
    "manifest root": ("laid/kind=M", lambda t: flipped(t, "root")),
    "manifest ids": ("laid/kind=M", lambda t: flipped(t, "n_tokens")),
    "manifest gone": ("laid/kind=M", lambda t: t.slice(0, 0)),
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store") / "s"
    docs = spark.createDataFrame([(i, f"document {i} " + "of words and words " * (i * 40)) for i in range(30)] + [(None, None), (3, ""), (3, "")], "doc_id long, text string")
    tokenstore.write_store(docs, PATH, 2, f"file://{folder}")
    assert tokenstore.read_digests(spark, f"file://{folder}").count() == tokenstore.read_ids(spark, f"file://{folder}").count() == 33
    return folder


@pytest.mark.parametrize("what", CHANGES)
def test_a_change_anywhere_raises(spark, store, tmp_path, what):
    folder = shutil.copytree(store, tmp_path / "c")
    below, change = CHANGES[what]
    rewritten(folder / below, change)
    for read in (tokenstore.read_digests, tokenstore.read_ids):
        with pytest.raises(Exception, match="does not|is not as the manifest|zstd|content of its name|decompress"):
            read(spark, f"file://{folder}").collect()
