"""Incremental indexing: files that arrive in a folder are parsed, chunked and put into the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerloom.functions.text import clean_text
from ledgerloom.operators.chunking import chunk_documents
from ledgerloom.operators.vectors import VectorIndex
from ledgerloom.ports import PdfReader
from ledgerloom.sources.documents import parse_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def index_drop_folder(
    spark: SparkSession,
    folder: str,
    index: VectorIndex,
    checkpoint: str,
    pattern: str = "*",
    available_now: bool = True,
    pdf: PdfReader | None = None,
    rejects: str | None = None
) -> StreamingQuery:
    """Files of all known formats in ``folder`` as a stream; each batch is upserted, so a batch that is repeated changes
    nothing. Files that can't be read are added to the folder ``rejects`` (a batch's own subfolder), where given."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)

    def put(batch: DataFrame, number: int) -> None:
        found, refused = parse_files(batch, pdf)
        docs = found.select("doc_id", "ticker", "fiscal_period", clean_text(F.col("raw_text")).alias("cleaned_text"))
        index.upsert(chunk_documents(docs).drop("sec_ord").join(docs.select("doc_id", "ticker", "fiscal_period"), "doc_id"))
        if rejects:
            refused.write.mode("overwrite").json(f"{rejects}/batch={number}")

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
