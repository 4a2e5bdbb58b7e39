"""WARC records, and resolution of not-modified revisits by an as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, spread_join, stored

#: Header fields that a not-modified response may update (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that a canonical URL drops: by start and by name.
TRACKING_START, TRACKING_NAMES = "utm_", ("ref", "fbclid", "gclid")
# Fixed value: the end of the profile of a revisit that tells of a not-modified response.
NOT_MODIFIED = "server-not-modified"
#: Ranges of time that the records of one URL are spread over: one for so many records, but of these numbers.
RECORDS_PER_BUCKET, BUCKETS = 500_000, (64, 1024)
_END = "\r\n"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, last slash, fragment and tracking; parameters sorted.

    Null for a null url and one without ``://``.
    """
    rest = F.substring_index(F.substr(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)
    base = F.substring_index(rest, "?", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(base, "/", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.substr(base, F.length(F.substring_index(base, "/", 1)) + 1, F.length(base)), r"/+$", "")
    query = F.substr(rest, F.length(base) + 2, F.length(rest))
    kept = F.array_sort(
        F.filter(
            F.split(query, "&"),
            lambda x: (x != "") & ~x.startswith(TRACKING_START) & ~F.substring_index(x, "=", 1).isin(*TRACKING_NAMES),
        )
    )
    joined = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, joined))


def _lines(fields: list[tuple[str, Column]]) -> Column:
    """Header lines of the fields that are not null."""
    return F.concat_ws("", *(F.concat(F.lit(f"{k}: "), F.regexp_replace(v.cast("string"), r"[\r\n]+", " "), F.lit(_END)) for k, v in fields))


def format_record(kind: Column, record_id: Column, url: Column, date: Column, http: list[tuple[str, Column]], payload: Column) -> Column:
    """A WARC/1.1 record as text. ``http`` are header fields of the response; null ones are left out."""
    status = F.when(kind == "revisit", "HTTP/1.1 304 Not Modified").otherwise("HTTP/1.1 200 OK")
    top, body = F.concat(status, F.lit(_END), _lines(http), F.lit(_END)), F.coalesce(payload, F.lit(""))
    head = _lines(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id),
            ("WARC-Target-URI", url),
            ("WARC-Date", date),
            ("Content-Length", F.octet_length(top) + F.octet_length(body)),
        ]
    )
    return F.concat(F.lit("WARC/1.1" + _END), head, F.lit(_END), top, body, F.lit(_END + _END))


def timestamp(date: Column) -> Column:
    """An ISO 8601 date as a timestamp, in UTC unless it names an offset; null if it is none.

    As WARC allows, it may stop after year, month, day or minute; digits past microseconds are cut.
    """
    date = F.regexp_replace(date, r"(T[0-9]{2}:[0-9]{2})(?![:0-9])", "$1:00")
    full = (
        F.when(F.length(date) == 4, F.concat(date, F.lit("-01-01T00:00:00Z")))
        .when(F.length(date) == 7, F.concat(date, F.lit("-01T00:00:00Z")))
        .when(F.length(date) == 10, F.concat(date, F.lit("T00:00:00Z")))
        .when(date.rlike(r"T[0-9:.]+$"), F.concat(date, F.lit("Z")))
        .otherwise(date)
    )
    return F.when(date.rlike(r"^[0-9]{4}(-|$)"), full.try_cast("timestamp"))


def _fields(block: Column) -> Column:
    """The header lines of a block after its first line, as a map of lower-cased names; of a repeated name the last counts."""
    lines = F.split(block, "\r\n")
    pairs = F.transform(
        F.filter(F.slice(lines, 2, F.size(lines)), lambda y: F.instr(y, ":") > 1),  # the first is no header
        lambda y: F.struct(
            F.lower(F.trim(F.substring_index(y, ":", 1))).alias("k"),
            F.trim(F.substr(y, F.instr(y, ":") + 1, F.length(y)), F.lit(" \t")).alias("v"),
        ),
    )
    last = lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"]))
    # bound to a name: the pairs are taken once, not for each of them
    return F.transform(F.array(pairs), lambda p: F.map_from_entries(last(p)))[0]


def _payload(octets: Column, top: Column, body: Column, length: Column) -> Column:
    """What follows the HTTP header ``top`` in the record's block of so many octets, of which ``length`` count."""
    ended = F.when(body.endswith(_END + _END), F.expr("left(body, length(body) - 4)")).otherwise(body)
    room = length - F.octet_length(top) - 4
    cut = F.decode(F.substring(F.encode(body, "utf-8"), F.lit(1), F.greatest(room, F.lit(0))), "utf-8")
    # without a length, one that is no number or more than there is, and one that ends before the blank lines, these go
    return F.when(length.isNull() | (length > octets) | (length == octets - 4), ended).otherwise(cut)


def parse_records(records: DataFrame, warc: str = "warc") -> DataFrame:
    """(record_id, kind, url, captured, profile, refers_to, headers, payload) of records as text; null where a field is missing.

    Header names are lower-cased; of a repeated name the last counts. Rows that are null or no
    WARC record are left out. White space around a header's value does not count. ``captured``
    is a timestamp. The payload is the part of the block after its HTTP header that
    Content-Length counts in octets; without a usable length, all but two blank lines at the end.
    ``profile`` and ``refers_to`` are WARC-Profile and WARC-Refers-To.
    """
    text, blank = F.col(warc), _END + _END
    after = lambda x, start: F.when(F.octet_length(x) > F.octet_length(start), F.substr(x, F.length(start) + 5, F.length(x)))
    length = F.when(F.length(F.col("w")["content-length"]) <= 9, F.col("w")["content-length"].try_cast("int"))
    cut = records.where(text.startswith("WARC/")).select(
        text.alias("text"), F.substring_index(text, blank, 1).alias("head"), F.substring_index(text, blank, 2).alias("both")
    )
    return (
        cut.select("*", after(F.col("both"), F.col("head")).alias("top"))
        .select(
            _fields(F.col("head")).alias("w"),
            _fields(F.col("top")).alias("headers"),
            "top",
            after(F.col("text"), F.col("both")).alias("body"),
            (F.octet_length("text") - F.octet_length("head") - 4).alias("octets"),
        )
        .select(
            F.col("w")["warc-record-id"].alias("record_id"),
            F.col("w")["warc-type"].alias("kind"),
            F.col("w")["warc-target-uri"].alias("url"),
            timestamp(F.col("w")["warc-date"]).alias("captured"),
            F.col("w")["warc-profile"].alias("profile"),
            F.col("w")["warc-refers-to"].alias("refers_to"),
            "headers",
            _payload(F.col("octets"), F.col("top"), F.col("body"), length).alias("payload"),
        )
    )


def _tag(value: Column) -> Column:
    return F.regexp_replace(value, "^W/", "")


def _other_profile(records: DataFrame) -> Column:
    if "profile" not in records.columns:
        return F.lit(False)
    return (F.col("kind") == "revisit") & F.coalesce(~F.col("profile").endswith(NOT_MODIFIED), F.lit(False))


def resolve(records: DataFrame, buckets: int | None = None) -> DataFrame:
    """(record_id, canonical_url, kind, captured, response_id, status, headers, payload_md5) of each record.

    A ``revisit`` takes the latest ``response`` of its canonical URL that was captured before it
    (of equal times the greatest record_id). Status: ``full`` for responses; ``resolved`` where
    the entity tags agree (weakly), or, if the revisit has none, the times of last change;
    ``changed`` where they don't; ``unverified`` where the revisit has neither; ``orphan`` where
    there is no earlier response, the URL or the time is missing; ``other_profile`` for a revisit
    whose ``profile``, if the column is there, is neither null nor that of a not-modified
    response. A resolved or unverified revisit gets the response's payload and its headers with
    the PERMITTED ones replaced. Other kinds of record are left out; repeated records give a row
    each.

    Records are spread by (URL, range of time): within a range the join is a running last
    value, and between ranges one row per URL and range is carried forward, so a URL with a
    third of all records is shared by ``buckets`` tasks. Records without URL or time take no part.
    Payloads are not shuffled: ``with_payload`` joins them back. ``captured`` is a timestamp or a
    whole number.
    """
    given = records.schema["captured"].dataType
    if isinstance(given, T.TimestampType):
        records = records.withColumn("captured", F.unix_micros("captured"))
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        canonical_url(F.col("url")).alias("canonical_url"),
        "kind",
        "captured",
        "headers",
        _other_profile(records).alias("other_profile"),
        F.when(F.col("kind") == "response", F.md5(F.coalesce("payload", F.lit("")).cast("binary"))).alias("payload_md5"),
    )
    every = durable(rows)  # payloads are read once; what goes on is small
    joins = F.col("canonical_url").isNotNull() & F.col("captured").isNotNull() & ~F.col("other_profile")
    rows = every.where(joins)
    if buckets is None:
        buckets = min(max(rows.count() // RECORDS_PER_BUCKET, BUCKETS[0]), BUCKETS[1])
    steps = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("captured", steps, 20_000)).first()[0] or []
    bucket = F.size(F.filter(F.lit(sorted(set(bounds))).cast("array<bigint>"), lambda b: b <= F.col("captured")))
    rows = rows.withColumn("bucket", bucket)
    response = F.when(F.col("kind") == "response", F.struct("captured", "record_id", "headers", "payload_md5"))
    rows = rows.withColumn("response", response)
    # strictly earlier: responses of the same second come after revisits of it
    order = ["captured", F.when(F.col("kind") == "revisit", 0).otherwise(1), "record_id"]
    inside = Window.partitionBy("canonical_url", "bucket").orderBy(*order)
    here = rows.withColumn("near", F.last("response", ignorenulls=True).over(inside))
    # a range without responses needs a carried one too
    lasts = rows.groupBy("canonical_url", "bucket").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("captured", "record_id"))).alias("newest"))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        lasts.withColumn("far", F.last("newest", ignorenulls=True).over(before))
        .where(F.col("far").isNotNull())
        .select("canonical_url", "bucket", "far")
    )
    joined = here.join(carried, ["canonical_url", "bucket"], "left").withColumn("found", F.coalesce("near", "far"))
    alone = every.where(~joins).withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    joined = joined.select(*alone.columns).unionByName(alone)
    own, theirs = F.col("headers"), F.col("found.headers")
    status = (
        F.when(F.col("kind") == "response", "full")
        .when(F.col("other_profile"), "other_profile")
        .when(F.col("found").isNull(), "orphan")
        .when(own["etag"].isNotNull(), F.when(F.coalesce(_tag(own["etag"]) == _tag(theirs["etag"]), F.lit(False)), "resolved").otherwise("changed"))
        .when(
            own["last-modified"].isNotNull(),
            F.when(F.coalesce(own["last-modified"] == theirs["last-modified"], F.lit(False)), "resolved").otherwise("changed"),
        )
        .otherwise("unverified")
    )
    merged = F.map_concat(
        F.map_filter(theirs, lambda k, _: ~(k.isin(*PERMITTED) & F.map_contains_key(own, k))),
        F.map_filter(own, lambda k, _: k.isin(*PERMITTED)),
    )
    taken = F.col("status").isin("resolved", "unverified")
    return joined.withColumn("status", status).select(
        "record_id",
        "canonical_url",
        "kind",
        F.timestamp_micros("captured").alias("captured") if isinstance(given, T.TimestampType) else F.col("captured"),
        F.when(F.col("status") == "full", F.col("record_id")).when(taken, F.col("found.record_id")).alias("response_id"),
        "status",
        F.when(taken, merged).otherwise(own).alias("headers"),
        F.when(taken, F.col("found.payload_md5")).otherwise(F.col("payload_md5")).alias("payload_md5"),
    )


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """``resolved`` with ``payload``: that of the response that a row names, null where it names none.

    Responses are found by record_id and digest, so repeated ids with other payloads do not mix.
    """
    body = F.coalesce("payload", F.lit(""))
    bodies = records.where("kind = 'response' AND record_id IS NOT NULL").select(
        F.col("record_id").alias("response_id"), F.md5(body.cast("binary")).alias("payload_md5"), body.alias("payload")
    )
    resolved = stored(resolved, "resolved")
    # a response may have very many revisits
    found = spread_join(resolved, bodies, ["response_id", "payload_md5"], ["record_id", "captured"], how="left", once=True)
    return found.select(*resolved.columns, "payload")
