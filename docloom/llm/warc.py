"""A content-addressed WARC archive (operator 4).

An archive is two tables in one folder. `payloads` holds the bytes of each distinct payload once,
named by SHA-256; `records` holds each record's exact header and the digest it names. Records are
rebuilt by joining the two: header, payload, and the two line ends of the format. A payload is
taken from the store only if its bytes again have the digest it is stored under.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id is a
response and the others are revisits of it, without payload; smaller ones are all responses.

Defined results: null html counts as empty bytes. A null url leaves the target out; a url with
white space, control characters or characters beyond ASCII is written percent-encoded, with a field that says so, and read back
as it was. Rows that repeat a page_id are one record each; of those with one payload exactly one is the
response, the one with the least url. Null page_ids come after all others and nulls among urls after
all others. Ids may be of any type that a string can be cast to. An empty table gives an empty
archive. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm._shared import new_folder, small_batches

MIN_REVISIT = 100
END = "\r\n"


def _bytes(html: Column) -> Column:
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:docloom:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(page_id.cast("string"))), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes the tables `payloads` and `records` under path."""
    spark = pages.sparkSession
    small_batches(spark)
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), _bytes(F.col("html")).alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    # partial aggregation drops copies before the shuffle
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("bare"), "url"))
    stored = keyed.groupBy("digest").agg(first.alias("first"), F.count("*").alias("records"), F.first("payload").alias("payload"), F.first("n").alias("n"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    owners = spark.read.parquet(f"{path}/payloads").where((F.col("n") >= MIN_REVISIT) & (F.col("records") > 1)).select("digest", "first")
    # rows that are the same in all are one row with a count until they have met their response
    rows = keyed.groupBy("page_id", "url", "digest", "n").agg(F.count("*").cast("int").alias("copies"))
    joined = rows.join(owners, "digest", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 1)
    revisit = F.col("first").isNotNull() & ~is_first
    odd = F.col("url").rlike(r"[^\x21-\x7e]")
    target = F.when(odd, F.concat(F.lit(f"{END}WARC-Target-URI: "), F.url_encode("url"), F.lit(f"{END}X-Target-Encoded: yes"))).otherwise(F.concat(F.lit(f"{END}WARC-Target-URI: "), F.col("url")))
    header = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{END}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"{END}WARC-Date: 1970-01-01T00:00:00Z"), F.coalesce(target, F.lit("")),
        F.lit(f"{END}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(f"{END}X-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: "), _record_id(F.col("first.page_id")))).otherwise(F.lit("")),
        F.lit(f"{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string")), F.lit(END + END),
    )
    records = joined.select(F.encode(header, "UTF-8").alias("header"), F.when(revisit, F.lit(None)).otherwise(F.col("digest")).alias("digest"))
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: header, payload (null for revisits) and record, the exact bytes of the format."""
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    records = spark.read.parquet(f"{path}/records")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary"))
    plain = records.where("digest IS NULL").select("header", F.lit(None).cast("binary").alias("payload"))
    full = records.where("digest IS NOT NULL").join(payloads, "digest").select("header", sound.alias("payload"))
    end = F.encode(F.lit(END + END), "UTF-8")
    return plain.unionByName(full).withColumn("record", F.concat("header", F.coalesce("payload", F.encode(F.lit(""), "UTF-8")), end))


def parsed(records: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url, from the records' bytes; ids as id_type."""
    blank = F.expr(r"position(encode('\r\n\r\n', 'UTF-8'), record)")
    head = records.select(F.col("record"), blank.cast("int").alias("cut")).select("record", "cut", F.decode(F.substring("record", F.lit(1), F.col("cut") - 1), "UTF-8").alias("head"))

    def field(name: str, pattern: str) -> Column:
        found = F.regexp_extract("head", rf"(?m)^{name}: {pattern}\r?$", 1)
        return F.when(found != "", found)

    body_size = F.octet_length("record") - F.col("cut") - 3 - 4
    body = F.expr("substring(record, cut + 4, octet_length(record) - cut - 7)")
    kind = field("WARC-Type", r"(\w+)")
    same = (body_size == field("Content-Length", r"(\d+)").cast("int")) & ((kind == "revisit") | (F.sha2(body, 256) == field("WARC-Payload-Digest", r"sha256:([0-9a-f]+)")))
    digest = F.when(same, field("WARC-Payload-Digest", r"sha256:([0-9a-f]+)")).otherwise(F.raise_error(F.lit("a record does not agree with its header")))
    page = r"<urn:docloom:page:([^>]*)>"
    target = field("WARC-Target-URI", "([^\r\n]*)")
    return head.select(
        F.url_decode(field("WARC-Record-ID", page)).cast(id_type).alias("page_id"), field("X-Payload-Length", r"(\d+)").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"), kind.alias("record_type"), F.url_decode(field("WARC-Refers-To", page)).cast(id_type).alias("refers_to"),
        F.when(field("X-Target-Encoded", "(yes)").isNotNull(), F.url_decode(target)).otherwise(target).alias("url"),
    )


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archive(pages, path)
    return parsed(read_archive(spark, path), pages.schema["page_id"].dataType.simpleString()).drop("url")


def op4_sql() -> str:
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_page FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT} AND first_page < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND first_page < page_id THEN first_page END AS refers_to FROM f"""
