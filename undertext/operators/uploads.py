"""Files in the bodies of upload requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertext.operators.reports import sniffed

# Kinds of content that may be documents, the least bytes of a frame that may be a file, and the name of nameless bodies.
DOCUMENTS = r"(?i)pdf|officedocument|msword|ms-powerpoint|text/plain|text/markdown|octet-stream"
LEAST_BYTES = 512
NAMELESS = "upload.bin"


def may_be_document(mime: Column) -> Column:
    """Whether content of a MIME type is looked at. No type counts as a document's; null is no type."""
    return F.coalesce((mime == "") | mime.rlike(DOCUMENTS), F.lit(True))


def may_be_file(kind: Column, content: Column) -> Column:
    """Whether a frame is large enough for a file; text frames never are, and null content is none."""
    return F.coalesce((kind != "string") & (F.octet_length(content) >= LEAST_BYTES), F.lit(False))


def body_files(requests: DataFrame) -> DataFrame:
    """(request_id, seq, name, type, size) of the files in requests (request_id, channel, method, parts), in their order.

    parts: an array of (kind, name, type, size, content) with kind file, blob or string. Forms and single files give
    their files that are not empty; a nameless body counts when it is put and may be a document; a frame of a socket,
    channel or beacon counts by its size, and is named by its bytes. A request without parts has no files.
    """
    p = requests.select("request_id", "channel", F.upper(F.coalesce("method", F.lit("GET"))).alias("method"), F.posexplode("parts").alias("at", "p")).select("request_id", "channel", "method", "at", "p.*")
    form = F.col("channel").isin("form", "file") & (F.col("kind") == "file") & (F.col("size") > 0)
    put = (F.col("channel") == "blob") & (F.col("kind") == "blob") & (F.col("method") == "PUT") & (F.col("size") > 0) & may_be_document(F.col("type"))
    frame = F.col("channel").isin("socket", "peer", "beacon") & may_be_file(F.col("kind"), F.col("content"))
    name = F.when(form, F.col("name")).when(put, F.lit(NAMELESS)).when(frame, F.concat(F.lit("upload."), sniffed(F.col("content"))))
    kind = F.when(frame & (F.coalesce("type", F.lit("")) == ""), "application/octet-stream").otherwise(F.coalesce("type", F.lit("")))
    size = F.when(frame, F.octet_length("content").cast("long")).otherwise(F.col("size").cast("long"))
    return p.where(form | put | frame).select("request_id", (F.col("at") + 1).alias("seq"), name.alias("name"), kind.alias("type"), size.alias("size"))
