"""File formats: tolerant JSON lines, member splitting, blob classification, CSV and Parquet round trips."""

from __future__ import annotations

import hashlib
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def parse_lines(lines: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """Typed columns of JSON lines; a bad or torn line gives nulls and ``bad``, and never fails."""
    got = lines.withColumn("_row", F.from_json(column, schema, {"mode": "PERMISSIVE"})).withColumn("bad", F.expr(f"try_parse_json({column})").isNull())
    return got.select(*[c for c in lines.columns if c != column], "_row.*", "bad")


def split_members(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, n_chars) of the non-empty members of a text, which line ends part; pos counts from 1."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "body"))
    return each.where("length(body) > 0").select("doc_id", (F.col("i") + 1).cast("bigint").alias("pos"), F.length("body").cast("bigint").alias("n_chars"))


def classify_blobs(blobs: DataFrame) -> DataFrame:
    """(doc_id, format, n_bytes, utf8) of binary blobs, by their first bytes and strict decoding."""
    head = F.hex(F.substring("blob", 1, 4))
    kind = F.when(head.startswith("1F8B"), "gz").when(head == "25504446", "pdf").when(head.startswith("504B"), "zip").when(F.octet_length("blob") < 16, "stub").otherwise("text")
    return blobs.select("doc_id", kind.alias("format"), F.octet_length("blob").cast("bigint").alias("n_bytes"), F.expr("is_valid_utf8(cast(blob as string))").alias("utf8"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where a session on this machine alone has none, in a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/corpusweave/out-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: the plan starts anew, and a lost executor costs its tasks only."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """As ``staged``, in buckets of the column, one for each shuffle partition: joins and groups by it don't shuffle these rows again.

    The table's name is dropped at once; its files stay."""
    spark, name = df.sparkSession, f"corpusweave_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).sortBy(column)
    writer.option("path", scratch(spark)).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def write_and_read(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """``df`` written in a format and read again with its own schema; Spark's committer publishes whole files only."""
    path = scratch(df.sparkSession)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path)


def zipped_units(blobs: DataFrame) -> DataFrame:
    """(doc_id, pos, digest, n_chars): paragraphs of zipped documents (the body member of DOCX, the XHTML members of
    EPUB), each with a digest of its own text; a blob that is no zip gives no row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not blob or not zipfile.is_zipfile(io.BytesIO(blob)):
                    continue
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    names = [n for n in sorted(z.namelist()) if n == "word/document.xml" or n.endswith((".xhtml", ".html"))]
                    found = [x for n in names for x in re.findall(r"<(?:w:)?p[ >].*?</(?:w:)?p>", z.read(n).decode("utf-8", "replace"), re.S)]
                texts = [t for x in found if (t := " ".join(re.sub(r"<[^>]+>", "", x).split()))]
                rows += [(doc_id, i, hashlib.sha256(t.encode()).hexdigest()[:16], len(t)) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["doc_id", "pos", "digest", "n_chars"])

    return blobs.select("doc_id", "blob").mapInArrow(part, "doc_id long, pos long, digest string, n_chars long")


def as_docx(docs: DataFrame) -> DataFrame:
    """(doc_id, blob): each text as a minimal DOCX file with a paragraph for each line."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = []
            for text in b.column(1).to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", "".join(f"<w:p><w:t>{escape(x)}</w:t></w:p>" for x in (text or "").split("\n")))
                blobs.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    return docs.select("doc_id", "text").mapInArrow(part, "doc_id long, blob binary")


class PagedSource(DataSource):
    """A source that answers page by page with a cursor, as web interfaces do; here a counting one of ``total`` rows.

    Each page is a partition of its own, so pages are fetched in parallel and a lost one is fetched again."""

    @classmethod
    def name(cls) -> str:
        return "corpusweave_paged"

    def schema(self) -> str:
        return "id long, page int"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(int(self.options.get("total", "0")), int(self.options.get("size", "100")))


class _Pages(DataSourceReader):
    def __init__(self, total: int, size: int):
        self.total, self.size = total, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(-(-self.total // self.size))]

    def read(self, partition: InputPartition):
        page = partition.value
        for i in range(page * self.size, min(self.total, (page + 1) * self.size)):
            yield i, page
