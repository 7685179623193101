"""Markdown export in a bounded number of files, with an index from document to byte range.

Documents are dealt to packs by a hash of their id; a pack is written by one task as text files of a bounded number of bytes and
documents, its pieces, and all packs appear in one commit. The index gives every document's pack, piece, first byte in the piece
and number of bytes, so one document is read by one seek and many by one job that cuts each piece once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspan.functions.source import bind
from docspan.functions.text import slug
from docspan.operators.rows import inlined

#: Bytes of text that a pack is planned for. A document is never split, so a longer one makes a larger pack.
PACK_BYTES = 128 << 20
#: A piece ends after the document that brings its bytes, and so many for each document, to this.
PIECE_BYTES, ENTRY_BYTES = 16 << 20, 64
INDEX = "doc_id bigint, slug string, pack int, piece int, first_byte bigint, n_bytes bigint"
_AFTER = "\n"


def packs_for(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    return max(1, -(-total // pack_bytes))


def export_packed(docs: DataFrame, path: str, packs: int | None = None, piece_bytes: int = PIECE_BYTES) -> None:
    """Writes ``docs`` (doc_id, title, content) to ``path``/packs and ``path``/index.

    Null contents are empty files. Documents of one id all keep a range of their own, in the order of title and content. Places
    are sums of lengths over the documents before one in its pack, in the same order in which the pack is written."""
    packs = packs or packs_for(docs)
    order = ["doc_id", "title", "content"]
    size = F.octet_length("content").cast("bigint") + len(_AFTER)
    before = Window.partitionBy("pack").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    placed = (
        docs.select("doc_id", "title", F.coalesce("content", F.lit("")).alias("content"))
        .withColumn("pack", F.pmod(F.xxhash64("doc_id"), F.lit(packs)).cast("int")).repartition(packs, "pack")
        .withColumns({"place": sum_before(size).cast("bigint"), "piece": F.floor(sum_before(size + ENTRY_BYTES) / piece_bytes).cast("int")}))
    written = placed.sortWithinPartitions("pack", "piece", *order).select("pack", "piece", F.col("content").alias("value"))
    written.write.option("lineSep", _AFTER).partitionBy("pack", "piece").text(f"{path}/packs")
    start = F.min("place").over(Window.partitionBy("pack", "piece"))
    index = placed.select("doc_id", slug(F.col("title")).alias("slug"), "pack", "piece", "place", (size - len(_AFTER)).alias("n_bytes"))
    index.withColumn("first_byte", F.col("place") - start).select("doc_id", "slug", "pack", "piece", "first_byte", "n_bytes").write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_packed(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, slug and content of all documents, or of the ids in ``wanted`` (doc_id).

    The entries of a piece meet its bytes once, whatever their number: a row per document beside the bytes would copy a whole piece
    for every document."""
    index = read_index(spark, path)
    if wanted is not None:
        index = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    entries = index.groupBy("pack", "piece").agg(F.collect_list(F.struct("doc_id", "slug", "first_byte", "n_bytes")).alias("entries"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{path}/packs").select("pack", "piece", F.col("content").alias("bytes"))

    def cut(held: Column) -> Column:
        def one(e: Column) -> Column:
            own = F.substr(held, (e["first_byte"] + 1).cast("int"), e["n_bytes"].cast("int"))
            return F.struct(e["doc_id"].alias("doc_id"), e["slug"].alias("slug"), F.decode(own, "UTF-8").alias("content"))
        return F.transform("entries", one)

    return inlined(files.join(entries, ["pack", "piece"]).select(bind(F.col("bytes"), cut).alias("documents")), [], "documents")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[str]:
    """Contents of one id, by seeking to their ranges: nothing else of the pack is read."""
    files = spark._jvm.org.apache.hadoop.fs
    out = []
    for row in read_index(spark, path).filter(F.col("doc_id") == doc_id).orderBy("piece", "first_byte").collect():
        folder = files.Path(f"{path}/packs/pack={row.pack}/piece={row.piece}")
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        (part,) = [f.getPath() for f in system.globStatus(files.Path(folder, "part-*"))]
        stream = system.open(part)
        try:
            stream.seek(row.first_byte)
            out.append(bytes(stream.readNBytes(row.n_bytes)).decode())
        finally:
            stream.close()
    return out
