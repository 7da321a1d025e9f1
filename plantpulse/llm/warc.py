"""WARC derivatives: metadata and plain-text conversion records of response records, linked to them, in DataFrame functions only.

A record is a row: page_id, warc_type, record_id, refers_to, target_uri, date, headers (a map of further fields), content_type, block,
block_digest and payload_digest. Record ids are name-based, so a task that runs again writes the same ids. The conversion holds the text
of the payload without markup, scripts and styles; the metadata record holds facts about the response and its source headers. Both
refer to the response and carry its digests.

Defined results: null html counts as an empty payload; a null url becomes an empty target; a row with a null id has ids of its own kind;
repeated rows have equal ids, as equal pages would. An empty table gives no records. Texts of any length are kept whole.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: the date of records that state none; a parameter of the builders
DATE = "2026-01-01T00:00:00Z"

# The character references of the SQL that conversion is checked against, `amp` last. Conversion decodes all references.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: what ends a line of text
_BORDER = r"(?is)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|main|nav|header|footer|aside|title|body|head|html|br|form|blockquote|pre)\b[^>]*>"

#: comments, scripts, styles and doctypes, where never closed up to the end; titles and text areas ($2), which hold no markup, and tags
#: ($4, $5 without attributes) are passed over, so that nothing begins in them
_HIDDEN = (r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)|<!doctype[^>]*>"
           r"|(<(title|textarea)(?=[\s/>]).*?</\3(?=[\s/>]))|(</?[a-z][^\s/>]*+)(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(>)")
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
#: code points that numeric references do not stand for themselves: those of windows-1252, and what is no character
_REPLACED = {0: "\ufffd", 0x0D: "\r", 0xA0: " "} | {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}
_DROPPED = [*range(0x1, 0x9), 0xB, *range(0xE, 0x20), 0x7F, *range(0xFDD0, 0xFDF0), *(p * 0x10000 + k for p in range(17) for k in (0xFFFE, 0xFFFF))]
#: a no-break space becomes a space, as in the SQL
_NAMED = {name: value.replace("\u00a0", " ") for name, value in html5.items()}
_SHORT = {name: value for name, value in _NAMED.items() if not name.endswith(";")}


def _fixed(values: dict) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _decoded(reference: Column) -> Column:
    """The characters of one reference, by the rules of HTML as ``html.unescape`` has them, with a space for a no-break space."""
    name = F.substring(reference, 2, 33)
    digits = F.regexp_replace(reference, r"^&#[xX]?0*|;$", "")
    is_hex = reference.rlike("^&#[xX]")
    # longer ones are beyond the last code point
    code = F.when(F.length(digits) > 7, F.lit(0x110000)).when(digits == "", F.lit(0)).when(is_hex, F.conv(digits, 16, 10).cast("int")).otherwise(F.conv(digits, 10, 10).cast("int"))
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    numeric = (F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").when(code.isin(_DROPPED), "")
               .otherwise(F.coalesce(F.element_at(_fixed({str(k): v for k, v in _REPLACED.items()}), code.cast("string")), character)))
    begins = [F.concat(F.element_at(_fixed(_SHORT), F.substring(name, 1, k)), F.substr(name, F.lit(k + 1)))
              for k in range(max(map(len, _SHORT)), 1, -1)]
    return F.when(reference.startswith("&#"), numeric).otherwise(F.coalesce(F.element_at(_fixed(_NAMED), name), *begins, reference))


def unescaped(text: Column) -> Column:
    """The text with all numeric and named character references decoded once."""
    between, found = F.split(text, _REFERENCE, -1), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    joined = F.zip_with(between, found, lambda plain, reference: F.concat(plain, F.when(reference.isNull(), "").otherwise(_decoded(reference))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(joined, "")).otherwise(text)


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based urn:uuid of the kind of record and the values that make it."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    spans = [F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *spans), F.lit(">"))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def without_markup(html: Column) -> Column:
    """html without comments, scripts, styles and tags; block borders end lines, white space is collapsed, references stay."""
    text = F.regexp_replace(html, _HIDDEN, "$2$4$5")
    text = F.regexp_replace(text, r"[ \t\r\n\f]+", " ")
    text = F.regexp_replace(text, _BORDER, "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def plain_text(bare: Column) -> Column:
    """The text of html ``without_markup``: references decoded, empty lines gone.

    The decoding names its argument several times, so hand in a column of its own, which is computed once.
    """
    text = unescaped(bare)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" *\n[ \n]*", "\n"), r"^\n|\n$", ""))


def responses(pages: DataFrame, date: str = DATE, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Response records of fetched pages: the block is the HTTP response, the payload its html."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.coalesce(F.col(url_column), F.lit("")).alias("target_uri"),
                        F.coalesce(F.col(html_column), F.lit("")).alias("payload"))
    length = F.octet_length("payload").cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF))
    full = rows.withColumn("block", F.concat(head, "payload")).withColumn("payload_digest", digest(F.col("payload")))
    return full.select(
        "page_id", F.lit("response").alias("warc_type"), record_id("response", F.col("page_id"), F.col("target_uri"), F.col("payload_digest")).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
        F.create_map(F.lit("WARC-Identified-Payload-Type"), F.lit("text/html")).alias("headers"),
        F.lit("application/http; msgtype=response").alias("content_type"), "block", digest(F.col("block")).alias("block_digest"), "payload_digest", "payload")


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each response: metadata, then the conversion to plain text, both referring to it."""
    source = found.filter("warc_type = 'response'").withColumn("bare", without_markup(F.col("payload")))
    links = F.map_from_arrays(
        F.array(*map(F.lit, ("WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "X-Source-Block-Digest", "X-Source-Payload-Digest"))),
        F.array("target_uri", "date", "block_digest", "payload_digest"))
    text = plain_text(F.col("bare"))
    http_head = F.substring_index("block", CRLF + CRLF, 1)
    facts = F.concat(F.lit("source-headers: "), F.replace(http_head, F.lit(CRLF), F.lit("; ")), F.lit(CRLF + "source-bytes: "), F.octet_length("block").cast("string"),
                     F.lit(CRLF + "payload-bytes: "), F.octet_length("payload").cast("string"), F.lit(CRLF + "payload-digest: "), F.col("payload_digest"), F.lit(CRLF))
    kinds = F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), facts.alias("block"),
                 F.map_concat(links, F.create_map(F.lit("WARC-Concurrent-To"), record_id("conversion", F.col("record_id")))).alias("headers")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=UTF-8").alias("content_type"), text.alias("block"),
                 F.map_concat(links, F.create_map(F.lit("WARC-Concurrent-To"), record_id("metadata", F.col("record_id")))).alias("headers"))))
    both = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", kinds.alias("r"))
    conversion = F.when(F.col("r.warc_type") == "conversion", record_id("conversion", F.col("refers_to"))).otherwise(record_id("metadata", F.col("refers_to")))
    return both.select("page_id", "r.warc_type", conversion.alias("record_id"), "refers_to", "target_uri", "date", "r.headers", "r.content_type", "r.block",
                       digest(F.col("r.block")).alias("block_digest"), digest(F.col("r.block")).alias("payload_digest"), F.col("r.block").alias("payload"))


def record_text(records: DataFrame) -> DataFrame:
    """The serialised records, in a column ``value``, without the two line ends behind each record."""
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))

    further = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(CRLF))), "")
    return records.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Payload-Digest", F.col("payload_digest")), further, line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), F.col("block")).alias("value"))


def write_warc(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """WARC files, one per partition; the two line ends behind a record are the text sink's line separator."""
    record_text(records).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Serialised records of WARC files as ``value``; a record begins at a version line that follows two line ends.

    Blocks written by ``write_warc`` never hold a version line behind two line ends unless the source text does.
    """
    parts = spark.read.option("lineSep", f"{CRLF}{CRLF}WARC/1.1{CRLF}").text(folder)
    cleaned = F.regexp_replace("value", r"^WARC/1\.1\r\n|\r\n\r\n$", "")
    return parts.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), cleaned).alias("value"))
