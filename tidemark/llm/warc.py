"""Content-addressed WARC archive: payloads once, record headers apart, records back by joins.

``write`` puts two Parquet tables into one folder: ``payloads`` (digest, bytes)
with each distinct payload once, under its SHA-256, and ``records`` with the
exact header bytes of each record and of the HTTP answer in it. ``records``
rebuilds each WARC record byte for byte by joining the two on the digest, and
every stored payload is held against its digest on the way. ``read`` takes all
fields from the rebuilt records: their header lines, and the payload's bytes.

Of records with equal payloads of at least ``min_bytes`` bytes the one of the
smallest page_id is a response and the others revisit it; smaller payloads are
all responses. Copies are counted and joined by digest, so that a payload that
many pages share is one row on one side; adaptive execution splits the other.

A url with line breaks would end its header line, so it is percent-encoded
there and a line says so: any url comes back as it was. Pages have no time of
capture, which WARC-Date requires; ``date`` stands for it.

Edge cases: a null html is an empty payload; a null url has no header line and
comes back null; rows with a null page_id are dropped, and of rows that repeat
a page_id all are kept; an empty table makes an empty archive; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir

_CRLF = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines of those values that aren't null, and the empty line after them."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(_CRLF)), F.lit("")) for k, v in pairs], F.lit(_CRLF))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _http() -> Column:
    """The head of the HTTP answer that carried the payload."""
    return F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("n_bytes").cast("string"))))


def _header(kind: Column, date: str) -> Column:
    """A record's header; its block is the answer's head and, in a response, the payload."""
    revisit = kind == "revisit"
    broken = F.col("url").rlike(r"[\r\n]")
    escaped = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    head = _lines(
        ("WARC-Type", kind),
        ("WARC-Record-ID", _urn(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.when(broken, escaped).otherwise(F.col("url"))),
        ("X-Target-URI-Encoding", F.when(broken, "percent")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("first")))),
        ("WARC-Profile", F.when(revisit, _REVISIT)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")),
    )
    return F.concat(F.lit("WARC/1.1" + _CRLF), head)


def write(pages: DataFrame, folder: str, min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive pages(page_id, url, html) into ``folder``."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.filter(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    # the payloads themselves don't move to find copies: digests do
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("first"))
    kind = F.when((F.col("n_bytes") >= min_bytes) & (F.col("page_id") > F.col("first")), "revisit").otherwise("response")
    records = keyed.join(firsts, "digest").withColumn("http", F.encode(_http(), "utf-8")).withColumn("header", F.encode(_header(kind, date), "utf-8"))
    records.select("digest", "header", "http").write.option("compression", "zstd").parquet(f"{folder}/records")
    # one row for each digest: that of its first page, of whose repeats any will do
    _firsts(rows, firsts).write.option("compression", "zstd").parquet(f"{folder}/payloads")


def _firsts(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Each digest's payload, once, from its first page.

    Payloads are dealt out once, by digest and page, which spreads the copies
    of a digest; the rows that repeat a page are then in one place already.
    """
    own = firsts.select("digest", F.col("first").alias("page_id"))
    picked = rows.withColumn("digest", F.sha2("payload", 256)).join(own, ["digest", "page_id"])
    return picked.dropDuplicates(["digest", "page_id"]).select("digest", "payload")


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads whose bytes have the digest they are stored under; any other stops the job."""
    p = spark.read.parquet(f"{folder}/payloads")
    ok = F.sha2("payload", 256) == F.col("digest")
    return p.withColumn("digest", F.when(ok, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest"))))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """header, http (the head of the answer) and record: each WARC record whole, as written to a file."""
    r = spark.read.parquet(f"{folder}/records")
    revisit = F.decode("header", "utf-8").startswith(f"WARC/1.1{_CRLF}WARC-Type: revisit{_CRLF}")
    whole = lambda *own: F.concat("header", "http", *own, F.encode(F.lit(_CRLF + _CRLF), "utf-8")).alias("record")
    # a revisit's record has no payload, so that many pages of one payload don't take its bytes along
    responses = r.filter(~revisit).join(_verified(spark, folder), "digest").select("header", "http", whole(F.col("payload")))
    return responses.unionByName(r.filter(revisit).select("header", "http", whole()))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (null in a revisit) of each rebuilt record.

    Size and digest of a response are those of its bytes, which must be as many
    as its header says and have the digest it names; a revisit has the digest
    of what it refers to, and the length from the answer's head.
    """
    head, http = F.decode("header", "utf-8"), F.decode("http", "utf-8")
    field = lambda k, text=head: F.nullif(F.regexp_extract(text, rf"\n{k}: ([^\r\n]*)\r", 1), F.lit(""))
    page = lambda k: F.regexp_extract(field(k), "<urn:page:([-0-9]+)>", 1).cast("long")
    present = head.contains(f"{_CRLF}WARC-Target-URI: ")
    url = F.when(present, F.coalesce(field("WARC-Target-URI"), F.lit("")))
    plain = F.replace(F.replace(F.replace(url, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    before = F.octet_length("header") + F.octet_length("http")
    parsed = records(spark, folder).select(
        page("WARC-Record-ID").alias("page_id"), F.when(field("X-Target-URI-Encoding") == "percent", plain).otherwise(url).alias("url"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha256:([0-9a-f]{64})", 1).alias("named"), field("Content-Length").cast("long").alias("block"), field("Content-Length", http).cast("long").alias("length"),
        F.octet_length("http").alias("http"), F.substring("record", before + 1, F.octet_length("record") - before - 4).alias("payload"),
    )
    response = F.col("record_type") == "response"
    parsed = parsed.withColumn("found", F.when(response, F.sha2("payload", 256)).otherwise(F.col("named")))
    whole = (F.col("found") == F.col("named")) & (F.col("http") + F.octet_length("payload") == F.col("block")) & (~response | (F.octet_length("payload") == F.col("length")))
    digest = F.when(whole, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("record differs from its header: page "), F.col("page_id").cast("string"))))
    return parsed.select("page_id", "url", "record_type", "refers_to", digest.alias("payload_digest"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("length")).alias("payload_bytes"), F.when(response, F.col("payload")).alias("payload"))


def report(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder and read the archive back, record by record."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    write(pages, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
