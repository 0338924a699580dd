"""WARC archives: written by Spark's text sink, read in splits with a verified chain of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import attach, written
from tallyloom.session import scratch_dir

# What a record begins with, what ends its header and itself, and the alphabet of RFC 4648's base32.
MAGIC, BLANK = "WARC/1.1\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of fewer bytes are never stored as a revisit.
REVISIT_BYTES = 0
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal digest whose length is a multiple of 5 digits."""
    letters = []
    for part in range(8):
        number = F.conv(F.substring(hex_digest, 5 * part + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def _line(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), r"[\r\n]+", " ")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """One record per row below ``path``; equal payloads are stored once.

    Of equal payloads of ``revisit_bytes`` bytes or more the row with the smallest id is a response, the others are
    revisits that refer to it and hold no payload. Rows without id are responses, and rows that repeat the smallest id
    are too. Null html is an empty payload, a null url an empty one; line ends in ids and urls become blanks.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("payload", "UTF-8")))
    groups = rows.where("id is not null").groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = written(groups, "copies")  # its size is known then: few copies are broadcast, and the payloads stay where they are
    rows = attach(rows, groups, ["sha1"], "copies", F.col("id"))
    revisit = F.col("first").isNotNull() & (F.col("id") != F.col("first")) & (F.octet_length("payload") >= revisit_bytes)
    revisit = F.coalesce(revisit, F.lit(False))
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page-id:"), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("")), F.lit(">"))
    header = F.concat_ws(
        "\r\n", F.concat(F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name("id")), F.lit("WARC-Date: 2000-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), _line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"))), F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    rows.select(F.concat(header, F.lit(BLANK), block).alias("value")).write.option("lineSep", BLANK).text(path)


def _field(head: str, name: str, pattern: str = r"([^\r\n]*)") -> Column:
    value = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*{pattern}", 1)
    return F.when(value != "", value)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, with its file, split and order there. Spark's reader deals the files out by bytes."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("body"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place where the magic stands, with the offset of its body and that of the body of its successor.

    The offset is a prefix sum of lengths, in a split and over a file's splits (a short row each). ``closed``: the
    record ends where the next magic stands, and so its payload's size and digest are known here already.
    """
    head = F.substring_index(F.col("body").cast("string"), BLANK, 1)
    pieces = _pieces(spark, path).withColumn("size", F.octet_length("body").cast("long")).withColumn("head", head)
    length = _field("head", "Content-Length", r"(\d{1,18})").cast("long")
    pieces = pieces.withColumn("content", F.when(_field("head", "WARC-Type").isNotNull() & (F.octet_length("head") + 4 <= F.col("size")), length))
    need = F.octet_length("head") + 8 + F.col("content")
    pieces = pieces.withColumn("need", need).withColumn("closed", F.coalesce(F.col("need") == F.col("size"), F.lit(False)))
    block = F.substring("body", F.octet_length("head") + 5, F.col("content").cast("int"))
    payload = F.when(F.col("closed"), _payload(block))
    narrow = written(pieces.select("file", "file_size", "split", "at", "size", "need", "closed", *_header_fields("head"), *_measured(payload)), "candidates")
    inside = Window.partitionBy("file", "split").orderBy("at")
    sums = narrow.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))
    begun = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = narrow.withColumn("begun", begun).join(sums, ["file", "split"]).withColumn("offset", F.col("before") + F.col("begun"))
    return placed.withColumn("next", F.col("offset") + F.col("need") + len(MAGIC)).drop("before", "begun")


def _page_id(head: str, name: str) -> Column:
    """An id as it was before its special characters were percent-encoded."""
    written_id = _field(head, name, r"<urn:page-id:([^>\r\n]*)>")
    return F.coalesce(F.try_url_decode(written_id), written_id)


def _header_fields(head: str) -> list[Column]:
    return [
        F.lower(_field(head, "WARC-Type")).alias("record_type"), _page_id(head, "WARC-Record-ID").alias("page"),
        _page_id(head, "WARC-Refers-To").alias("refers"), _field(head, "WARC-Target-URI").alias("url")]


def _payload(block: Column) -> Column:
    """The block behind its HTTP header."""
    return F.substring(block, F.octet_length(F.substring_index(block.cast("string"), BLANK, 1)) + 5, 1 << 30)


def _measured(payload: Column) -> list[Column]:
    return [F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1")]


def verified(spark: SparkSession, path: str) -> DataFrame:
    """Candidates with ``real``: reachable from their file's start, from successor to successor.

    In each split, candidates whose successor is the next candidate form a run; only a run's last one leads elsewhere,
    so a run is reached as a whole from the place where it is entered. Runs get a pointer to the run of their last
    successor, and pointer jumping (each round doubles the pointers' reach) marks those reached from the file starts.
    A magic inside a payload is jumped over, whatever stands behind it, and a broken record ends its file's chain.
    """
    found = candidates(spark, path)
    inside = Window.partitionBy("file", "split").orderBy("at")
    leads = F.lead("offset").over(inside) == F.col("next")
    found = found.withColumn("leads", F.coalesce(leads, F.lit(False)))
    new = ~F.coalesce(F.lag("leads").over(inside), F.lit(False))
    found = found.withColumn("run", F.sum(new.cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    found = written(found.withColumn("run", F.concat_ws(":", "file", "split", "run")), "runs")

    exits = found.where("not leads and next is not null").select("file", F.col("next").alias("offset"), F.col("run").alias("source"))
    entries = exits.join(found.select("file", "offset", "run"), ["file", "offset"]).select("source", "run", "offset")
    entries = written(entries, "entries")
    start = found.where(F.col("offset") == len(MAGIC)).select(F.lit(None).cast("string").alias("source"), "run", "offset")
    jumps, reached = entries.select("source", F.col("run").alias("target")), written(start.select("run"), "reached")
    while True:
        further = reached.join(jumps, F.col("run") == F.col("source")).select(F.col("target").alias("run"))
        grown = written(reached.union(further).distinct(), "reached")
        if grown.count() == reached.count():
            break
        reached = grown
        jumps = written(jumps.alias("x").join(jumps.alias("y"), F.col("x.target") == F.col("y.source")).select("x.source", "y.target"), "jumps")
    entered = start.union(entries.join(reached.select(F.col("run").alias("source")), "source").select("source", "run", "offset"))
    entered = entered.groupBy("run").agg(F.min("offset").alias("entered"))
    marked = found.join(entered, "run", "left").withColumn("real", F.coalesce(F.col("offset") >= F.col("entered"), F.lit(False)))
    # A record that the file ends before is not whole.
    whole = F.col("need").isNotNull() & (F.col("offset") + F.col("need") <= F.col("file_size"))
    return written(marked.withColumn("real", F.col("real") & F.coalesce(whole, F.lit(False))), "verified")


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """``page``, ``url``, ``record_type``, ``refers``, ``payload_bytes``, ``sha1``, and with ``payload`` the bytes (``payload``), of all real records.

    Records with a magic inside are put together from their pieces; only these (or with ``payload`` all) are read again.
    ``page`` and ``refers`` are strings as they stand in the archive, null where it has none.
    """
    table = verified(spark, path)
    owner = F.max(F.when(F.col("real"), F.col("offset"))).over(Window.partitionBy("file").orderBy("offset"))
    owned = table.select("file", "split", "at", "offset", "real", "closed").withColumn("owner", owner)
    open_owner = table.where("real" if payload else "real and not closed").select("file", F.col("offset").alias("owner"))
    wanted = written(owned.join(open_owner, ["file", "owner"]).select("file", "split", "at", "offset", "owner"), "pieces")
    bodies = _pieces(spark, path).join(wanted, ["file", "split", "at"])
    parts = bodies.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "body"))).alias("parts"))
    joined = F.aggregate(F.slice("parts", 2, F.size("parts")), F.element_at("parts", 1)["body"], lambda done, p: F.concat(done, F.lit(bytearray(MAGIC.encode())), p["body"]))
    whole = parts.select("file", F.col("owner").alias("offset"), joined.alias("body"))
    head = F.substring_index(F.col("body").cast("string"), BLANK, 1)
    cut = F.substring("body", F.octet_length(head) + 5, F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d+)", 1).cast("int"))
    whole = whole.select("file", "offset", _payload(cut).alias("payload"))
    whole = whole.select("file", "offset", F.col("payload"), *[c.alias(f"whole_{n}") for c, n in zip(_measured(F.col("payload")), ("bytes", "sha1"), strict=True)])
    real = table.where("real").join(whole, ["file", "offset"], "left")
    return real.select(
        "page", "url", "record_type", "refers", F.coalesce("whole_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("whole_sha1", "sha1").alias("sha1"),
        *["payload"] * payload)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, path: str | None = None) -> DataFrame:
    """Writes ``pages`` as WARC and reads the archives back: id, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``url``.

    Size and digest are measured on the payload read back; revisits take those of the response that they refer to.
    An empty table gives an empty result; other columns don't matter. Nulls and repeated rows: see ``write_warc``.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    path = path or scratch_dir(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col, revisit_bytes)
    records = written(read_warc(spark, path), "records")
    counts = records.where("refers is not null").groupBy(F.col("refers").alias("page")).agg(F.count("*").alias("copies"))
    sources = records.where("record_type = 'response'").groupBy("page").agg(F.min("payload_bytes").alias("of_bytes"), F.min("sha1").alias("of_sha1"))
    sources = counts.join(sources, "page").withColumnRenamed("page", "refers")
    revisits = attach(records.where("refers is not null"), written(sources, "sources"), ["refers"], "copies", F.col("page")).drop("copies")
    full = revisits.unionByName(records.where("refers is null"), allowMissingColumns=True)  # responses meet nothing
    again = F.col("record_type") == "revisit"
    return full.select(
        F.col("page").cast(kind).alias(id_col), F.when(again, F.col("of_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        base32(F.when(again, F.col("of_sha1")).otherwise(F.col("sha1"))).alias("payload_digest"), "record_type", F.col("refers").cast(kind).alias("refers_to"), "url")
