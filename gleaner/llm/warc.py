"""Content-addressed web archive: payload bytes once, record headers apart, records by joins.

An archive is a folder in the shared storage with two Parquet tables:

- `payloads`: `strong` (SHA-256 of the bytes, lower-case hex), `payload` (the bytes). Each distinct payload lies here once.
- `headers`: one row per record: `header` (the exact bytes before the payload: WARC fields, and the HTTP header of its block)
  and `strong`, the payload that it is about.

A record is its header, then for a response its payload, then two line ends. A revisit has no payload bytes of its own and
names the record that has. Readers join the two tables on `strong` and check the stored bytes against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.storage import new_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Pages carry no time of capture; records need one.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: every five hexadecimal digits give four letters."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(F.sha1(payload), 5 * i + 1, F.lit(5)), 16, 10).cast("int"))
    letters = F.transform(bits, lambda v: F.concat(*[F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]))
    return F.array_join(letters, "")


def _record_id(page: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _header() -> Column:
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    # a line break in an address would end its field
    address = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    refers = F.concat(
        F.lit(f"WARC-Refers-To: "), _record_id(F.col("response.page_id"), F.col("response.row")),
        F.lit(f"{END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"),
    )
    fields = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.col("record_type"),
        F.lit(f"{END}WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("row")),
        F.lit(f"{END}WARC-Date: {DATE}{END}WARC-Target-URI: "), address,
        F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(END), F.when(revisit, refers).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{END}Content-Length: "), length.cast("string"), F.lit(END + END),
    )
    return F.encode(F.concat(fields, http), "UTF-8")


def write(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> str:
    """Archives `pages` (`page_id`, `url`, `html`; other columns are ignored), a record per row, and returns the folder.

    Of records with equal payloads of at least `least_bytes`, that with the largest page_id is a response and the others
    revisit it; null ids count as smallest, and of equal ids one record is taken. Smaller payloads are all responses. Null html is an empty payload, a null url the address
    `about:blank`. An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    read = pages.select("page_id", "url", payload.alias("payload"))
    # Numbered once and written, so that a record keeps its number.
    numbered = read.select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", F.sha2("payload", 256).alias("strong"),
        base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"),
    )
    numbered.write.option("compression", "zstd").parquet(f"{folder}/records")
    records = spark.read.schema(numbered.schema).parquet(f"{folder}/records")
    # one row per payload after combining in the map tasks; the join back is split where one payload is very frequent
    chosen = records.groupBy("strong").agg(F.max(F.struct("page_id", "row")).alias("response"), F.count(F.lit(1)).alias("n"))
    repeated = chosen.filter("n > 1").select("strong", "response")
    typed = records.join(repeated, "strong", "left").withColumn(
        "record_type", F.when((F.col("bytes") < least_bytes) | F.col("response").isNull() | (F.col("response.row") == F.col("row")), "response").otherwise("revisit")
    )
    typed.select("strong", _header().alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")
    once = read.groupBy(F.sha2("payload", 256).alias("strong")).agg(F.any_value("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's records: header, the payload they are about, and what header and stored bytes say.

    `page_id, record_type, refers_to` come from the header, `payload_bytes` and `payload_digest` from the stored bytes; the
    last two are null where these do not have the SHA-256 they are stored under.
    """
    headers = spark.read.schema("strong string, header binary").parquet(f"{folder}/headers")
    payloads = spark.read.schema("strong string, payload binary").parquet(f"{folder}/payloads")
    sound = F.sha2("payload", 256) == F.col("strong")
    measured = payloads.select(
        "strong", "payload", F.when(sound, F.octet_length("payload").cast("long")).alias("payload_bytes"), F.when(sound, base32_sha1(F.col("payload"))).alias("payload_digest")
    )
    text = F.decode("header", "UTF-8")
    page = lambda field: F.nullif(F.regexp_extract(text, rf"\r\n{field}: <urn:page:(-?[0-9]*):[0-9]+>\r\n", 1), F.lit("")).cast("long")
    parsed = headers.select(
        "strong", "header", page("WARC-Record-ID").alias("page_id"),
        F.regexp_extract(text, r"\r\nWARC-Type: ([a-z]+)\r\n", 1).alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
    )
    return parsed.join(measured, "strong", "left")


def record_bytes(records: DataFrame) -> DataFrame:
    """`(page_id, record)`: the whole WARC records, of rows that `read` gives."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", F.concat("header", body, F.lit((END + END).encode())).alias("record"))
