"""WARC archives: writing pages as records, and reading them back by their boundary chain.

Records are written by Spark's text writer, whose line end is the blank line that ends a record, as
gzip archives with at most `RECORDS` records each. Reading cuts the archives at every record mark,
also at marks that stand inside payloads. Each piece proposes, from its length field, where its successor
begins. A run of pieces that propose each other in file order is one link of the chain; from the link at the
start of the file, pointer jumping over the links finds what is reachable. The rest is payload.

A revisit has no payload of its own; it names the digest and the length of the payload, and the response
that holds it.

Defined results: a null payload counts as empty; a null address is left out; rows that repeat the smallest key of a
payload are all responses; a null key never is the smallest and is read back as null; payloads under 100 bytes are all
responses; an empty table has an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.shared import new_path, written

MARK = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Most records in an archive, and the least payload for revisits.
RECORDS = 20_000
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write one record per row; of equal payloads the smallest key is the response, others are revisits."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).alias("_key"), F.regexp_replace(F.col(url), r"[\r\n]", " ").alias("_url"), body.alias("_body"),
        F.sha2(body.cast("binary"), 256).alias("_digest"), F.octet_length(body).alias("_bytes"),
    )
    slim = rows.where(F.col("_bytes") >= LEAST).groupBy("_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(slim.where("_n > 1").drop("_n"), "_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_key"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value.cast("string"), F.lit("\r\n"))
    record = F.concat(
        F.lit(MARK),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("_key"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", F.col("_url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("_first"))), line("X-Payload-Length", F.col("_bytes")))).otherwise(F.lit("")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("_bytes"))),
        F.lit("\r\n"),
        F.when(again, F.lit("")).otherwise(F.col("_body")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two marks: file, order in the file, and the piece."""
    given = spark.read.option("lineSep", MARK).text(path)
    return given.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("cut"),
        F.monotonically_increasing_id().alias("seq"), F.col("value"),
    )


def _field(header: Column, label: str, pattern: str) -> Column:
    found = F.regexp_extract(header, rf"(?:^|\r\n){label}: {pattern}(?:\r\n|$)", 1)
    return F.when(found != "", found)


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates (file, at, next, ...) that the chain from the start of their file reaches.

    `at` is where a candidate begins and `next` where it says its successor does (null: unreadable).
    """
    line = Window.partitionBy("file").orderBy("at")
    broken = F.coalesce(F.lag("next").over(line) != F.col("at"), F.lit(True)).cast("int")
    linked = candidates.withColumn("broken", broken).withColumn("link", F.sum("broken").over(line))
    linked = written(linked.drop("broken"), "warc-candidates")
    links = linked.groupBy("file", "link").agg(F.max_by("next", "at").alias("exit"))
    into = linked.select("file", F.col("at").alias("exit"), F.col("link").alias("to"))
    now = links.join(into, ["file", "exit"], "left").select(
        "file", "link", "exit", "to", F.col("to").alias("jump"), (F.col("link") == 1).alias("ok")
    )
    now = written(now, "warc-links")
    while not now.where("jump is not null").isEmpty():
        marked = now.where("ok and jump is not null").select("file", F.col("jump").alias("link")).distinct().withColumn("hit", F.lit(True))
        ahead = now.select("file", F.col("link").alias("jump"), F.col("jump").alias("far"))
        now = now.join(marked, ["file", "link"], "left").join(ahead, ["file", "jump"], "left")
        now = written(
            now.select("file", "link", "exit", "to", F.col("far").alias("jump"), (F.col("ok") | F.col("hit").isNotNull()).alias("ok")),
            "warc-links",
        )
    landing = now.where("ok").select("file", F.col("to").alias("link"), F.col("exit").alias("from")).where("link is not null")
    start = now.where("link = 1").select("file", "link", F.lit(0).cast("long").alias("from"))
    return linked.join(start.union(landing), ["file", "link"]).where("at >= from").drop("link", "from")


def read(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives."""
    value = F.col("value")
    header = F.substring_index(value, END, 1)
    pieces = _pieces(spark, path).withColumn("header", header).withColumn(
        "declared", _field(F.col("header"), "Content-Length", r"(\d{1,18})").cast("long")
    )
    size = F.octet_length(value)
    own = size - F.octet_length("header") - 2 * len(END)
    body = F.expr("substr(value, char_length(header) + 5, char_length(value) - char_length(header) - 8)")
    page = lambda label: F.expr(f"try_cast({label} as {key_type})")
    slim = pieces.select(
        "file", "cut", "seq", size.cast("long").alias("size"), F.octet_length("header").alias("head"), "declared",
        _field(F.col("header"), "WARC-Type", r"(\w+)").alias("kind"),
        _field(F.col("header"), "WARC-Record-ID", r"<urn:page:([^>\r\n]*)>").alias("id"),
        _field(F.col("header"), "WARC-Refers-To", r"<urn:page:([^>\r\n]*)>").alias("refers"),
        _field(F.col("header"), "WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        _field(F.col("header"), "WARC-Payload-Digest", r"sha256:(\w+)").alias("said"),
        _field(F.col("header"), "X-Payload-Length", r"(\d{1,18})").cast("long").alias("full"),
        F.when(own == F.col("declared"), F.sha2(body.cast("binary"), 256)).alias("digest"),
    )
    order = Window.partitionBy("file").orderBy("cut", "seq")
    at = F.sum(F.col("size") + len(MARK)).over(order.rowsBetween(Window.unboundedPreceding, -1)) - len(MARK)
    after = F.col("at") + len(MARK) + F.col("head") + len(END) + F.col("declared") + len(END)
    # what stands before the first mark of a file has no place of its own
    candidates = slim.withColumn("at", at).where("at is not null").withColumn("next", after)
    records = written(reachable(candidates), "warc-records")
    if not records.where("digest is null and kind = 'response'").isEmpty():
        records = _with_marks_inside(pieces, candidates, records)
    again = F.col("kind") == "revisit"
    return records.select(
        page("id").alias("page_id"), "url",
        F.when(again, F.col("full")).otherwise(F.col("declared")).alias("payload_bytes"),
        F.when(again, F.col("said")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(again, page("refers")).alias("refers_to"),
    )


def _with_marks_inside(pieces: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Digests of payloads with record marks inside, put together again from their pieces."""
    line = Window.partitionBy("file").orderBy("at")
    known = records.select("file", "at", F.lit(True).alias("real"))
    owner = F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(line)
    every = candidates.select("file", "cut", "seq", "at").join(known, ["file", "at"], "left").withColumn("owner", owner)
    wanted = records.where("digest is null and kind = 'response'").select("file", F.col("at").alias("owner"), "head", "declared")
    part = every.join(wanted, ["file", "owner"]).select("file", "cut", "seq", "at", "owner", "head", "declared")
    whole = pieces.select("file", "cut", "seq", "value").join(part, ["file", "cut", "seq"])
    whole = whole.groupBy("file", "owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MARK).alias("value"),
        F.first("head").alias("head"), F.first("declared").alias("declared"),
    )
    body = F.expr("substring(cast(value as binary), head + 5, cast(declared as int))")
    found = whole.select("file", F.col("owner").alias("at"), F.sha2(body, 256).alias("put"))
    return records.join(found, ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "put"))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all rows to archives in the shared folder and return what reading them gives."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, key, url, payload)
    return read(pages.sparkSession, path, pages.schema[key].dataType.simpleString())
