"""Content-addressed WARC archive: payload bytes once, exact record headers beside them.

``write_archive`` turns rows (page_id, url, html) into two tables in the shared folder:
``payloads`` (sha256, size, bytes), one row per distinct payload, and ``records`` (page_id,
header, sha256, size) with the exact bytes of every WARC/1.1 record's header block.
``read_archive`` checks each stored payload against its SHA-256 and its size where it is read
(a payload that fails stops the job), parses the headers, and joins both by the digest;
``reconstruct`` gives the original record bytes, ``warc_text`` included, and Spark drops the
payload column before the join when a caller does not ask for it.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest
page_id is the response and the others are revisits that name it; shorter ones are all
responses. A null html is an empty payload, a null url an empty target; rows that repeat a
page_id become records of their own, and of those that also share the largest page_id all
are responses; a null page_id counts as the smallest. An empty table gives empty tables, other columns are ignored.

Digests are grouped with map-side combining, so a payload that a third of the pages share is
one row a task; it is joined back by ``lookup``. Payload bytes are shuffled once, when they
are made unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize

MIN_REVISIT = 1000
#: WARC records end their header lines so.
CRLF = "\r\n"
_DATE = "2024-01-01T00:00:00Z"


def _uri(page_id):
    """The record's WARC-Record-ID, a function of its page."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _header(kind, page_id, url, sha1, refers, size):
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _uri(page_id)),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.coalesce(line("WARC-Refers-To", _uri(refers)), F.lit("")) if refers is not None else F.lit(""),
        F.when(kind == "revisit", F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", 0).otherwise(size).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """(payloads, records), both written to the shared folder."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", body.alias("bytes"))
    # of one digest any row's bytes will do: the digest is the address
    payloads = materialize(full.select(F.sha2("bytes", 256).alias("sha256"), F.length("bytes").cast("long").alias("size"), "bytes").groupBy("sha256").agg(F.first("size").alias("size"), F.first("bytes").alias("bytes")), "payloads")
    light = full.select("page_id", "url", F.sha2("bytes", 256).alias("sha256"), F.sha1("bytes").alias("sha1"), F.length("bytes").cast("long").alias("size"))
    light = materialize(light, "digests")
    groups = light.where(F.col("size") >= min_revisit).groupBy("sha256").agg(F.count("*").alias("n"), F.max("page_id").alias("newest")).where("n > 1")
    groups = materialize(groups, "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    joined = lookup(light, groups, ["sha256"], "n", total, ["page_id", "url"])
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    kind = F.when(revisit, "revisit").otherwise("response")
    refers = F.when(revisit, F.col("newest"))
    header = F.when(revisit, _header(kind, F.col("page_id"), F.col("url"), F.col("sha1"), refers, F.col("size"))).otherwise(_header(kind, F.col("page_id"), F.col("url"), F.col("sha1"), None, F.col("size")))
    records = materialize(joined.select("page_id", F.encode(header, "UTF-8").alias("header"), "sha256", F.coalesce("n", F.lit(1)).alias("n")), "records")
    return payloads, records


def read_archive(payloads: DataFrame, records: DataFrame) -> DataFrame:
    """Every record with its parsed header and the payload it stands for: page_id, header,
    record_type, payload_digest, refers_to, payload_bytes, bytes."""
    sound = (F.sha2("bytes", 256) == F.col("sha256")) & (F.length("bytes") == F.col("size"))
    # the checked digest is what is joined on, so the check is never pruned away
    checked = F.when(sound, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), "sha256")))
    stored = payloads.select(checked.alias("sha256"), F.sha1("bytes").alias("stored_sha1"), F.length("bytes").cast("long").alias("payload_bytes"), "bytes")
    head = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(head, f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?\\d*)>", 1), F.lit("")).cast("long")
    parsed = records.select(
        number(field("WARC-Record-ID")).alias("page_id"), "header", "sha256", "n", field("WARC-Type").alias("record_type"), F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:([0-9a-f]{40})$", 1).alias("payload_digest"), number(field("WARC-Refers-To")).alias("refers_to")
    )
    counts = records.groupBy("sha256").agg(F.count("*").alias("copies"))
    total = records.count()
    # each payload with its number of records, so that one shared by many is a hot key
    found = lookup(parsed.drop("n"), stored.join(counts, "sha256"), ["sha256"], "copies", total, ["page_id", "header"], how="inner")
    good = F.when(F.col("stored_sha1") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("record and payload disagree: "), "sha256")))
    return found.select("page_id", "header", "record_type", good.alias("payload_digest"), "refers_to", "payload_bytes", "bytes")


def reconstruct(archive: DataFrame) -> DataFrame:
    """page_id and the record's exact bytes as a WARC file holds them; a revisit has no block."""
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    return archive.select("page_id", F.when(F.col("record_type") == "revisit", F.concat("header", end)).otherwise(F.concat("header", "bytes", end)).alias("record"))
