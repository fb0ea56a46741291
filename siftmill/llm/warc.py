"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

A response gives a ``metadata`` record (source headers, date, length and digests as ``application/warc-fields``)
and a ``conversion`` record (its plain text). Both refer to the response's record id; the metadata record names
the conversion, and the conversion the metadata record. What the input has of the source (record id, date, HTTP
headers, payload digest) is passed on as it stands; what it lacks is derived from url and payload.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Optional columns of the input, passed on where they are given.
SOURCE = ("record_id", "warc_date", "http_headers", "payload_digest")
HEADER = (
    ("WARC-Type", "kind"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
    ("X-WARC-Related-ID", "related_id"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "mime"), ("Content-Length", "content_length"),
)
_HIDDEN = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_BREAK = re.compile(r"<br\b[^>]*>|</(?:p|div|li|h[1-6]|tr|title|ul|ol|table|nav|header|footer)\s*>", re.I)
_TAG = re.compile(r"</?[a-z!?][^>]*>", re.I)
_BLANK, _LINES = re.compile(r"[ \t\r\f]+"), re.compile(r" ?\n[ \n]*")


def text_of(page: str | None) -> str:
    """The text of a page without scripts, styles, comments and tags; block ends break lines, blank lines go.

    All named and numeric character references are decoded, once. A ``<`` that opens no tag stays. What an
    unclosed script, style or comment begins goes to the end, as a browser reads it.
    """
    text = _TAG.sub(" ", _BREAK.sub("\n", _HIDDEN.sub(" ", page or "")))
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip(" \n")


@F.pandas_udf(T.StringType())
def plain_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)


def record_id(*parts: Column) -> Column:
    """A stable ``<urn:uuid:...>`` from what the record is made of."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def digest(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256))


def one_line(value: Column) -> Column:
    """A header value that cannot begin another line: line breaks are percent-coded, other control characters go."""
    return F.regexp_replace(F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), r"[\x00-\x1F\x7F]", "")


def responses(pages: DataFrame, date: str) -> DataFrame:
    """page_id, target_uri, html, the source's own values, and ``refers_to``, which no other row has unless the source says so."""
    given = {c: F.col(c).cast("string") if c in pages.columns and c != "http_headers" else F.lit(None).cast("string") for c in SOURCE}
    headers = F.lit("")
    if "http_headers" in pages.columns:  # map<string,string>
        pairs = F.array_sort(F.map_entries("http_headers"))
        line = lambda e: F.concat(F.lit("http-header-"), F.lower(one_line(e["key"])), F.lit(": "), one_line(F.coalesce(e["value"], F.lit(""))), F.lit("\r\n"))
        headers = F.coalesce(F.array_join(F.transform(pairs, line), ""), F.lit(""))
    d = pages.select(
        F.col("page_id").cast("long").alias("page_id"), one_line(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        one_line(given["record_id"]).alias("given_id"), one_line(F.coalesce(given["warc_date"], F.lit(date))).alias("warc_date"), headers.alias("source_headers"), one_line(given["payload_digest"]).alias("given_digest"),
    )
    d = d.withColumn("source_digest", F.coalesce("given_digest", digest(F.col("html"))))
    return d.withColumn("own_id", F.coalesce("given_id", record_id(F.col("page_id").cast("string"), F.col("target_uri"), F.col("source_digest")))).drop("given_digest")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``copy``: 0 for a row whose ``own_id`` is its own, 0, 1, 2, ... where several rows have it.

    Only ids are shuffled to find the repeated ones; rows with such an id are dealt over salts, so that a
    page that stands in a third of all rows is no single group.
    """
    repeated = written(rows.groupBy("own_id").count().where("count > 1").select(F.col("own_id").alias("twice")), "repeated")
    known = rows.join(repeated, rows["own_id"] == repeated["twice"], "left")
    single = known.where("twice is null").drop("twice").withColumn("copy", F.lit(0).cast("long"))
    if repeated.isEmpty():
        return single
    several = written(known.where("twice is not null").drop("twice").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int")), "several")
    sizes = several.groupBy("own_id", "salt").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("own_id").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("own_id", "salt").orderBy("page_id")) - 1
    several = several.withColumn("place", place).join(before, ["own_id", "salt"]).withColumn("copy", (F.col("place") + F.col("before")).cast("long"))
    return single.unionByName(several.drop("salt", "place", "before"))


def derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Two rows a response, ``metadata`` and ``conversion``: ids, links, target, date, digests, body and the whole record.

    ``pages``: page_id, url, html; optionally record_id, warc_date, http_headers (map) and payload_digest of the
    source, passed on; ``date`` stands where there is none. Null html is an empty payload, a null url an empty
    target. Repeated rows give their records each, under ids of their own. Line breaks in a url are coded, so
    that it cannot open a header. Other extra columns are ignored. Empty table: no rows. A page is handled
    whole, however long; its text and record must fit a task several times over.
    """
    d = numbered(responses(pages, date))
    copy = F.when(F.col("copy") > 0, F.col("copy").cast("string"))
    d = d.withColumn("refers_to", F.when(F.col("given_id").isNotNull() | copy.isNull(), F.col("own_id")).otherwise(record_id(F.col("own_id"), copy)))
    ids = [record_id(F.col("own_id"), F.lit(kind), copy).alias(f"{kind}_id") for kind in ("metadata", "conversion")]
    d = d.select("*", *ids, plain_text("html").alias("text"))
    meta = F.concat(
        F.lit("source-record-id: "), "refers_to", F.lit("\r\nsource-date: "), "warc_date", F.lit("\r\nsource-payload-digest: "), "source_digest",
        F.lit("\r\nsource-length: "), F.octet_length("html").cast("string"), F.lit("\r\nconversion-record-id: "), "conversion_id", F.lit("\r\n"), "source_headers",
    )
    kinds = [("metadata", "application/warc-fields", meta, "metadata_id", "conversion_id"), ("conversion", "text/plain; charset=utf-8", F.col("text"), "conversion_id", "metadata_id")]
    record = lambda kind, mime, body, own, other: F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime"), body.alias("body"), F.col(own).alias("record_id"), F.col(other).alias("related_id"))
    d = d.select("page_id", "target_uri", "warc_date", "source_digest", "refers_to", F.inline(F.array(*(record(*k) for k in kinds))))
    d = d.withColumn("block_digest", digest(F.col("body"))).withColumn("content_length", F.octet_length("body").cast("long"))
    lines = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{n}: "), F.col(c).cast("string"), F.lit("\r\n")) for n, c in HEADER])
    return d.withColumn("record", F.concat(lines, F.lit("\r\n"), "body", F.lit("\r\n\r\n")))


#: The same in DuckDB over ``pages``, whose source values are all derived; it knows the references that stand there.
SQL = r"""
WITH source AS (
  SELECT page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS target_uri, coalesce(html, '') AS html,
         'sha256:' || sha256(coalesce(html, '')) AS source_digest FROM pages),
keyed AS (SELECT *, md5(concat_ws(chr(10), page_id, target_uri, source_digest)) AS h FROM source),
named AS (
  SELECT *, concat('<urn:uuid:', h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32], '>') AS own_id FROM keyed),
copies AS (SELECT *, row_number() OVER (PARTITION BY own_id) - 1 AS copy FROM named),
hashed AS (
  SELECT *, md5(own_id || chr(10) || copy) AS r,
         md5(own_id || chr(10) || 'metadata' || CASE WHEN copy > 0 THEN chr(10) || copy ELSE '' END) AS m,
         md5(own_id || chr(10) || 'conversion' || CASE WHEN copy > 0 THEN chr(10) || copy ELSE '' END) AS c FROM copies),
ids AS (
  SELECT *, CASE WHEN copy = 0 THEN own_id ELSE concat('<urn:uuid:', r[1:8], '-', r[9:12], '-', r[13:16], '-', r[17:20], '-', r[21:32], '>') END AS refers_to,
         concat('<urn:uuid:', m[1:8], '-', m[9:12], '-', m[13:16], '-', m[17:20], '-', m[21:32], '>') AS metadata_id,
         concat('<urn:uuid:', c[1:8], '-', c[9:12], '-', c[13:16], '-', c[17:20], '-', c[21:32], '>') AS conversion_id FROM hashed),
shown AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', ' ', 'g'),
      '(?i)<br\b[^>]*>|</(?:p|div|li|h[1-6]|tr|title|ul|ol|table|nav|header|footer)\s*>', chr(10), 'g'),
      '(?i)</?[a-z!?][^>]*>', ' ', 'g') AS raw FROM ids),
decoded AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
      '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS said FROM shown),
texts AS (
  SELECT *, trim(regexp_replace(regexp_replace(said, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM decoded),
records AS (
  SELECT page_id, target_uri, '2024-01-01T00:00:00Z' AS warc_date, source_digest, refers_to, 'metadata' AS kind, 'application/warc-fields' AS mime,
         concat('source-record-id: ', refers_to, chr(13), chr(10), 'source-date: 2024-01-01T00:00:00Z', chr(13), chr(10), 'source-payload-digest: ', source_digest,
                chr(13), chr(10), 'source-length: ', strlen(html), chr(13), chr(10), 'conversion-record-id: ', conversion_id, chr(13), chr(10)) AS body,
         metadata_id AS record_id, conversion_id AS related_id FROM texts
  UNION ALL
  SELECT page_id, target_uri, '2024-01-01T00:00:00Z', source_digest, refers_to, 'conversion', 'text/plain; charset=utf-8', text, conversion_id, metadata_id FROM texts)
SELECT *, 'sha256:' || sha256(body) AS block_digest, CAST(strlen(body) AS BIGINT) AS content_length,
       concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: ', kind, chr(13), chr(10), 'WARC-Record-ID: ', record_id, chr(13), chr(10), 'WARC-Date: ', warc_date, chr(13), chr(10),
              'WARC-Refers-To: ', refers_to, chr(13), chr(10), 'WARC-Target-URI: ', target_uri, chr(13), chr(10), 'X-WARC-Related-ID: ', related_id, chr(13), chr(10),
              'WARC-Block-Digest: sha256:', sha256(body), chr(13), chr(10), 'Content-Type: ', mime, chr(13), chr(10), 'Content-Length: ', strlen(body), chr(13), chr(10),
              chr(13), chr(10), body, chr(13), chr(10), chr(13), chr(10)) AS record
FROM records
"""
