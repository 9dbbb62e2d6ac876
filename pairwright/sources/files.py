"""Documents as files: policy, decoding, fail-soft ingest, landing, retention.

A *file relation* has the columns of Spark's ``binaryFile`` reader:
``path, modificationTime, length, content``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import lexicon as lx
from ..functions.columns import not_blank, strip
from ..functions.scores import human_size
from ..operators import documents as d

NOT_TEXT = "This format is not read as text."
UNREADABLE = "The text is not readable in its encoding."
EMPTY = "No readable text found. If this is a scanned document, it must be OCR'd before upload."


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), F.lit(-1))


def extension(path: Column, allowed: Sequence[str] = lx.UPLOAD_EXTENSIONS) -> Column:
    """Lower-case extension, empty when it is not allowed."""
    found = F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))
    return F.when(found.isin(*allowed), found).otherwise("")


def validate_files(
    files: DataFrame, max_bytes: int = lx.MAX_UPLOAD_BYTES,
    allowed: Sequence[str] = lx.UPLOAD_EXTENSIONS,
) -> DataFrame:
    """Add ``extension`` and ``rejection``; NULL means accepted.  Contents are not read."""
    ext = extension(F.col("path"), allowed)
    reason = (
        F.when(ext == "", f"Unsupported file type. Allowed: {', '.join(sorted(allowed))}")
        .when(F.col("length") == 0, "Uploaded file is empty")
        .when(
            F.col("length") > max_bytes,
            F.concat(
                F.lit("File is too large ("), human_size("length"),
                F.lit(f"). Maximum allowed is {max_bytes // (1024 * 1024)} MB."),
            ),
        )
    )
    return files.withColumns({"extension": ext, "rejection": reason})


def check_batch(files: DataFrame, max_files: int = lx.MAX_UPLOAD_FILES) -> None:
    """An interactive upload is one small batch; bulk ingest has no such limit."""
    if len(files.select("path").limit(max_files + 1).collect()) > max_files:
        raise ValueError(f"upload at most {max_files} files at a time")


def decode_text(content: Column) -> Column:
    """UTF-8, else UTF-16 with a byte-order mark, else Windows-1252; NULL for broken UTF-16."""
    head = F.hex(F.substring(content, 1, 2))
    utf16 = head.isin("FFFE", "FEFF")
    # one group of four digits per code unit, high byte first; what is no pair of surrogates must be none
    units = F.regexp_replace(
        F.hex(content), "(..)(..)", F.when(head == "FFFE", F.lit("$2$1 ")).otherwise(F.lit("$1$2 "))
    )
    alone = F.regexp_replace(units, "D[89AB].. D[CDEF].. ", "").rlike(r"(?:^| )D[89A-F]")
    whole = (F.octet_length(content) % 2 == 0) & ~alone
    # Windows-1252 is ISO-8859-1 but for 0x80 to 0x9F
    western = F.translate(F.decode(content, "ISO-8859-1"), lx.C1_CONTROLS, lx.C1_WINDOWS)
    return (
        F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .when(utf16 & whole, F.decode(F.when(utf16 & whole, content), "UTF-16"))
        .when(~utf16, western)
    )


def read_text_documents(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Add ``text``, ``lines``, ``status`` and ``error``; bad files stay as ``failed`` rows.

    Only plain text is read.  Bytes of other formats, by name or by their first bytes, never
    reach the parsers.
    """
    checked = files if "rejection" in files.columns else validate_files(files)
    binary = (F.col("extension") != ".txt") | F.hex(F.substring("content", 1, 4)).isin(*lx.BINARY_HEADS)
    checked = checked.withColumn(
        "rejection", F.coalesce("rejection", F.when(F.coalesce(binary, F.lit(False)), NOT_TEXT))
    )
    decoded = checked.withColumn(
        "text", F.when(F.col("rejection").isNull(), decode_text(F.col("content")))
    )
    decoded = decoded.withColumn(
        "rejection",
        F.coalesce("rejection", F.when(F.col("content").isNotNull() & F.col("text").isNull(), UNREADABLE)),
    )
    cleaned = d.clean_lines(decoded).withColumn("text", d.clean_text())
    if max_chars is not None:
        cleaned = cleaned.withColumn("text", F.left("text", F.lit(max_chars)))
    short = F.length(strip(F.col("text"))) < lx.MIN_DOCUMENT_CHARS
    error = F.when(F.col("rejection").isNotNull(), F.col("rejection")).when(
        F.coalesce(short, F.lit(True)), EMPTY
    )
    return cleaned.withColumns(
        {"error": error, "status": F.when(error.isNull(), "parsed").otherwise("failed")}
    ).drop("content", "rejection")


def ingest_documents(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good documents, quarantined files with their reason, and batch totals."""
    read = read_text_documents(files)
    good = read.where("status = 'parsed'").drop("error")
    bad = read.where("status = 'failed'").select("path", "length", "error")
    return good, bad, ingest_totals(read)


def ingest_totals(read: DataFrame) -> DataFrame:
    return read.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "parsed").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def storage_usage(files: DataFrame) -> DataFrame:
    """Number of files, bytes and a readable size."""
    return files.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
    ).withColumn("total_size", human_size("total_bytes"))


def land_by_month(files: DataFrame, path: str, when: str = "modificationTime") -> None:
    """Append under ``yyyymm=...`` folders; each month is spread over several writers."""
    month = F.date_format(when, "yyyyMM")
    (
        files.withColumn("yyyymm", month)
        .repartition("yyyymm", F.pmod(F.xxhash64("path"), F.lit(32)))
        .write.mode("append").partitionBy("yyyymm").parquet(path)
    )


# -- retention ----------------------------------------------------------------
def referenced_names(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Base names of every file a candidate or job row still points to."""
    columns = (
        (candidates, "resume_path"), (candidates, "original_filename"), (jobs, "source_file"),
    )
    out = None
    for df, column in columns:
        part = df.select(F.col(column).alias("name")).where(
            F.col("name").isNotNull() & not_blank(F.col("name"))
        )
        out = part if out is None else out.unionByName(part)
    return out.select(file_name(F.col("name")).alias("name")).distinct()


def expired_files(
    files: DataFrame, referenced: DataFrame, as_of: Column, retention_days: int = lx.RETENTION_DAYS
) -> DataFrame:
    """Files past the retention window that no row points to; the age filter comes first."""
    if retention_days <= 0:
        return files.limit(0)
    old = files.where(
        F.col("modificationTime") < as_of - F.make_dt_interval(F.lit(retention_days))
    )
    return old.withColumn("name", file_name(F.col("path"))).join(referenced, "name", "left_anti")
