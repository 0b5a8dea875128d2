r"""WARC derivatives: responses to linked metadata and plain-text conversion records.

For every response record two records are made. The *conversion* record holds
the page's text; the *metadata* record holds the source's HTTP header fields,
its digests, the title and the number of links. Both name the response in
``WARC-Refers-To``, keep its target URI and date, and carry digests of their own
blocks; the metadata record also names the conversion record. Record ids are
made from the source id, so a rerun gives the same ids.

Text extraction: scripts, styles, the head and comments go, block elements end
a line, other tags go, character references are resolved, white space is folded.
Numeric references need no semicolon and follow the HTML standard (128 to 159 are
Windows-1252, what is no character is U+FFFD); named ones are all of HTML 5 and need
one. A no-break space is a space.
Of comments and silent elements the one that opens first holds the other. A head
ends at the first thing that cannot stand in it, with or without ``</head>``.

Everything is built of DataFrame functions; records never meet, so there is no
shuffle at all.

Defined results: a null or empty page, URL or header is empty; a page without
text has an empty conversion block; repeated responses give repeated records
with equal ids; a null id counts as an empty id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast.llm.common import table

VERSION = "WARC/1.1"
SPACE = "[ \\t\\n\\r\\f]"
# fixed values: elements whose content is no text, empty elements of a head, elements that end a line
SILENT = ("script", "style", "noscript", "template", "head")
HEAD = "meta|link|base|basefont|bgsound"
LINES = "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|header|footer|nav|main|aside|blockquote|pre|form"
# fixed values: the usual references
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
            ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))
NAMED = {**{name[:-1]: text for name, text in html5.items() if name.endswith(";")}, "nbsp": " "}
# numeric references that do not mean their code point
CODES = {**{n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}, 160: " "}


def entities(text: Column) -> Column:
    """The text with its character references resolved, each once."""
    usual = F.create_map(*(F.lit(x) for name, character in ENTITIES for x in (name[1:-1], character)))  # found first, since maps are searched in order

    def reference(part: Column) -> Column:  # what follows an ampersand
        digits = lambda base, which: F.regexp_extract(part, f"^#{which}0*+([{base}]*+)", 1)
        number = F.when(F.rlike(part, F.lit("^#[0-9]")), digits("0-9", "")).when(F.rlike(part, F.lit("^#[xX][0-9a-fA-F]")), digits("0-9a-fA-F", "[xX]"))
        # more than seven digits are beyond the last code point
        code = F.when(F.length(number) == 0, 0).when(F.length(number) <= 7, F.conv(number, 10, 10).cast("int")).otherwise(-1)
        code = F.when(F.rlike(part, F.lit("^#[xX]")) & (F.length(number).between(1, 7)), F.conv(number, 16, 10).cast("int")).otherwise(code)
        other = F.try_element_at(F.from_json(F.lit(json.dumps(CODES)), "map<string,string>"), code.cast("string"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        own = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")  # after a byte order mark
        character = F.when(other.isNotNull(), other).when(valid, own).otherwise("\ufffd")
        name = F.when(F.instr(part, ";") > 1, F.substring_index(part, ";", 1))
        named = F.coalesce(F.try_element_at(usual, name), F.try_element_at(F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>"), name))
        after = F.substring(part, F.length(name) + 2, F.length(part))
        return F.when(number.isNotNull(), F.concat(character, F.regexp_replace(part, "^#(?:[0-9]++|[xX][0-9a-fA-F]++);?", ""))).otherwise(
            F.coalesce(F.concat(named, after), F.concat(F.lit("&"), part)))

    def resolved(t: Column) -> Column:
        parts = F.split(t, "&")
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), reference), ""))

    # of an array, so that the text is made once
    return F.transform(F.array(text), resolved)[0]


def folded(text: Column) -> Column:
    text = F.regexp_replace(text, "[ \\t\\r\\f]+", " ")
    return F.trim(F.regexp_replace(text, "[ \\n]*\\n[ \\n]*", "\n"), F.lit(" \n"))


def page_text(html: Column) -> Column:
    rest = "(?:[ \\t\\n\\r\\f/][^>]*)?>"
    silent = "|".join(element for element in SILENT if element != "head")
    html = F.regexp_replace(html, f"(?is)<!--.*?(?:-->|\\z)|<({silent}){rest}.*?(?:</\\1{SPACE}*>|\\z)", "")
    html = F.regexp_replace(
        html, f"(?is)<head{rest}(?:{SPACE}++|<title{rest}.*?(?:</title{SPACE}*>|\\z)|<(?:{HEAD}){rest}|<[!?][^>]*>|</(?!(?:head|body|html|br){SPACE}*>)[a-z][^>]*>)*+", "")
    html = F.regexp_replace(html, f"(?i)</?(?:{LINES})(?:[ \\t\\n\\r\\f/][^>]*)?>", "\n")
    return folded(entities(F.regexp_replace(html, "<[a-zA-Z/!?][^>]*>", "")))


def page_title(html: Column) -> Column:
    return F.regexp_replace(folded(entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title", 1))), "\n", " ")


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(kind: str, source: Column) -> Column:
    """A URN made from the kind and the source's id."""
    h = F.md5(F.concat(F.lit(kind + "|"), source).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*(part for name, value in pairs for part in (F.lit(name + ": "), value, F.lit("\r\n"))))


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records (id, record_id, target_uri, date, http_header, body, digests) of crawled pages."""
    body = F.coalesce(html_col, F.lit(""))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(url_col, F.lit("")))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    return pages.select(
        F.col(id_col).alias("id"), record_id("response", key).alias("record_id"), F.coalesce(url_col, F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"), header.alias("http_header"), body.alias("body")).select(
        "*", digest(F.concat("http_header", F.lit("\r\n"), "body")).alias("block_digest"), digest(F.col("body")).alias("payload_digest"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of uncompressed WARC 1.0 and 1.1 files of UTF-8 text; the files
    are split between tasks at record boundaries. ``complete`` tells whether the
    block has its declared length (a payload that holds a record boundary is
    cut). A file that does not begin with either version's line fails the job."""
    end, version = "\r\n\r\n", r"^(WARC/1\.)?[01]\r\n"
    raw = spark.read.text(path, lineSep=f"{end}WARC/1.").where("value <> ''")
    unknown = F.raise_error(F.concat(F.lit("no WARC 1.0 or 1.1 record: "), F.substring("value", 1, 40))).cast("boolean")
    raw = raw.where(F.when(F.col("value").rlike(version), F.lit(True)).otherwise(unknown)).select(F.regexp_replace("value", version, "").alias("value"))
    head, block = F.substring_index("value", end, 1), F.substring(F.col("value"), F.instr("value", end) + 4, F.length("value"))
    field = lambda name: F.regexp_extract(head, f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)
    # the last record of a file still has its end mark
    last = (F.octet_length(block) - 4).cast("string") == field("Content-Length")
    block = F.when(last & F.endswith(block, F.lit(end)), F.substring(block, F.lit(1), F.length(block) - 4)).otherwise(block)
    return raw.where(field("WARC-Type") == "response").select(
        field("WARC-Record-ID").alias("id"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"),
        F.concat(F.substring_index(block, end, 1), F.lit("\r\n")).alias("http_header"),
        F.when(F.instr(block, end) > 0, F.substring(block, F.instr(block, end) + 4, F.length(block))).otherwise("").alias("body"),
        field("WARC-Block-Digest").alias("block_digest"), field("WARC-Payload-Digest").alias("payload_digest"),
        (F.octet_length(block).cast("string") == field("Content-Length")).alias("complete"))


def derive(responses: DataFrame) -> DataFrame:
    """Two records for every response: ``id``, ``warc_type``, ``record_id``,
    ``refers_to``, ``target_uri``, ``content_type``, ``content_length``,
    ``block_digest``, ``source_digest`` and ``record`` (the whole record as it
    stands in a WARC file). A response that is marked as not complete fails the
    job: its text would be a part of the page's."""
    if "complete" in responses.columns:
        cut = F.raise_error(F.concat(F.lit("incomplete response record: "), F.coalesce("record_id", F.lit("?")))).cast("boolean")
        responses = responses.where(F.when(F.coalesce("complete", F.lit(False)), F.lit(True)).otherwise(cut))
    made = responses.select(
        "id", "target_uri", "date", F.col("record_id").alias("refers_to"), "block_digest", "payload_digest", "http_header",
        record_id("conversion", F.col("record_id")).alias("conversion_id"), record_id("metadata", F.col("record_id")).alias("metadata_id"),
        page_text(F.col("body")).alias("text"), page_title(F.col("body")).alias("title"),
        F.regexp_count("body", F.lit("(?i)<a[ \\t\\n\\r\\f][^>]*href")).alias("links"))
    about = F.concat(
        _fields(("conversion", F.col("conversion_id")), ("title", F.col("title")), ("links", F.col("links").cast("string")),
                ("source-block-digest", F.col("block_digest")), ("source-payload-digest", F.col("payload_digest"))),
        # the source's header fields, each marked as such
        F.regexp_replace("http_header", "(?m)^(?=[^\\r\\n])", "source-http: "))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col("metadata_id").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")))
    rows = made.select("id", "target_uri", "date", "refers_to", F.col("payload_digest").alias("source_digest"), F.inline(kinds))
    rows = rows.select("*", F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"))
    header = _fields(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")))
    return rows.select(
        "id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest",
        F.concat(F.lit(VERSION + "\r\n"), header, F.lit("\r\n"), "block", F.lit("\r\n\r\n")).alias("record"))


def write_records(records: DataFrame, path: str) -> None:
    """The records as WARC files, one per task; the end mark is the line separator."""
    records.select(F.substring(F.col("record"), F.lit(1), F.length("record") - 4)).write.text(path, lineSep="\r\n\r\n")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the derivative records of all pages."""
    return derive(responses_from_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def _oracle() -> str:
    sql = lambda s: "'" + s.replace("'", "''") + "'"
    again = lambda text, pattern, to: f"regexp_replace({text}, {sql(pattern)}, {to}, 'g')"

    def fold(text: str) -> str:
        text = again(again(text, r"[ \t\r\f]+", "' '"), r"[ \n]*\n[ \n]*", "chr(10)")
        return again(text, r"^[ \n]+|[ \n]+$", "''")

    def resolve(text: str) -> str:
        for name, character in ENTITIES:
            text = f"replace({text}, {sql(name)}, {sql(character)})"
        return text

    text = "body"
    for element in SILENT:
        text = again(text, rf"(?is)<{element}(?:[ \t\n\r\f/][^>]*)?>.*?(?:</{element}[ \t\n\r\f]*>|\z)", "''")
    text = again(again(text, r"(?s)<!--.*?(?:-->|\z)", "''"), rf"(?i)</?(?:{LINES})(?:[ \t\n\r\f/][^>]*)?>", "chr(10)")
    text = fold(resolve(again(text, "<[a-zA-Z/!?][^>]*>", "''")))
    title = f"replace({fold(resolve('regexp_extract(body, ' + sql('(?is)<title[^>]*>(.*?)</title') + ', 1)'))}, chr(10), ' ')"
    uuid = lambda kind, key: (
        f"(SELECT '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' "
        f"FROM (SELECT md5('{kind}|' || {key}) AS h))")
    nl = "chr(13) || chr(10)"
    line = lambda name, value: f"'{name}: ' || {value} || {nl}"
    return f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body,
         {uuid('response', "coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS refers_to FROM pages),
r AS (
  SELECT *, 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(body) || {nl} AS http_header FROM p),
d AS (
  SELECT *, 'sha256:' || sha256(http_header || {nl} || body) AS source_block, 'sha256:' || sha256(body) AS source_digest,
         {uuid('conversion', 'refers_to')} AS conversion_id, {uuid('metadata', 'refers_to')} AS metadata_id,
         {text} AS text, {title} AS title, len(regexp_extract_all(body, {sql('(?i)<a[ \t\n\r\f][^>]*href'.encode().decode())})) AS links FROM r),
b AS (
  SELECT page_id, target_uri, refers_to, source_digest, 'conversion' AS warc_type, conversion_id AS record_id,
         'text/plain; charset=utf-8' AS content_type, text AS block FROM d
  UNION ALL
  SELECT page_id, target_uri, refers_to, source_digest, 'metadata', metadata_id, 'application/warc-fields',
         {line('conversion', 'conversion_id')} || {line('title', 'title')} || {line('links', 'links')} || {line('source-block-digest', 'source_block')}
         || {line('source-payload-digest', 'source_digest')} || 'source-http: ' || replace(rtrim(http_header, {nl}), {nl}, {nl} || 'source-http: ') || {nl} FROM d),
c AS (SELECT *, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM b)
SELECT page_id, warc_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, source_digest,
       '{VERSION}' || {nl} || {line('WARC-Type', 'warc_type')} || {line('WARC-Record-ID', 'record_id')} || {line('WARC-Refers-To', 'refers_to')}
       || {line('WARC-Target-URI', 'target_uri')} || {line('WARC-Date', "'1970-01-01T00:00:00Z'")} || {line('WARC-Block-Digest', 'block_digest')}
       || {line('Content-Type', 'content_type')} || {line('Content-Length', 'content_length')} || {nl} || block || {nl} || {nl} AS record
FROM c
"""


ORACLE = _oracle()
