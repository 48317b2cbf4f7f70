"""WARC archives: writing, reading, and resolving revisits.

Archives are written by Spark's text writer: a record is a line that ends with
the two line ends of the format, so files go to any file system that Spark
knows, compressed by gzip.  They are read by Spark's text reader, cut at the
first line of each record, so files of any size are read as a stream.  A
payload that holds such a cut itself is written in base 64, which a header
field says.

Resolution: only headers are shuffled, by payload digest and length; payloads
stay in the archives where they were captured.  The record with the largest page
id of a group is the response, and the others become revisits that refer to it.
The group's largest is found by a partial aggregate; groups of one record take
no part in the join, and the join's sides are tables of slim rows, so that Spark
can split a digest that a third of all records share.  Revisit records are
written from headers alone.  Responses are streamed once more from the captured
archives, a bounded set of archives at a time: the ids of the set's revisits, which
lie in a folder of the set's own, are broadcast (``SENT`` at most) and their records
passed over.

Every archive begins with a warcinfo record.  Written records have fresh headers: ids
of their own, the date of writing, the id of their archive's warcinfo record and
digests taken anew; revisits name the id of the response as it is written.

Defined results: a null html is the empty payload; a null url writes no target;
records without an id are revisits of the group's largest id, or responses if
no record of the group has an id; records that share the largest id are all
responses; repeated rows give repeated rows; ids of any type keep it; an empty
table gives empty archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import small
from .common import map_rows, shared_folder, stored

VERSION, END = "WARC/1.1", "\r\n"
CUT = END * 2 + VERSION + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of captures, unless one is given.
DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.UUID("8a3fb0cf-7f6c-4f8b-a0f6-3d9a4b5f2c11")
#: Records in one archive at most.
ARCHIVE_RECORDS = 100_000
#: Ids of revisits that are broadcast at once at most (some 100 bytes each).
SENT = 200_000
#: Sets of archives copied by one job.
SETS_AT_ONCE = 8
#: A warcinfo record, by its first field (the first record of a file has its version).
INFO = r"\A(?:WARC/1\.1\r\n)?WARC-Type: warcinfo\r\n"
RECORD_ID = r"\r\nWARC-Record-ID: <urn:uuid:([^>]+)>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, payload_digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{kind}|{page_id}|{payload_digest}')}>"


def framed(fields: list[tuple[str, str]], block: bytes) -> str:
    """A record as text, without the line ends behind it."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return VERSION + END + "".join(f"{k}: {v}{END}" for k, v in fields) + END + block.decode("utf-8", "surrogatepass")


class Archive:
    """The archives of one task: each begins with a warcinfo record, whose id the
    records behind it bear."""

    def __init__(self, date: str, most: int, what: str):
        self.date, self.most, self.what, self.n, self.info = date, most, what, 0, ""

    def begun(self) -> list[tuple[str]]:
        """The records to put in front of the next one."""
        self.n += 1
        if (self.n - 1) % self.most:
            return []
        self.n += 1
        self.info = f"<urn:uuid:{uuid.uuid4()}>"
        block = f"software: sedge{END}format: WARC File Format 1.1{END}description: {self.what}{END}".encode()
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", self.info), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")]
        return [(framed(fields, block),)]


def record(kind: str, page_id, url: str | None, payload: bytes | None, size: int, held: str, refers: tuple | None = None, date: str = DATE, info: str = "", own_id: str | None = None) -> str:
    """One record as text, without the line ends behind it.  A revisit has the
    size and the digest of a payload only."""
    top = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: {size}{END * 2}"
    body, coded = payload or b"", False
    if CUT.encode() in top.encode() + body + (END * 2).encode():
        body, coded = base64.b64encode(body), True
    block = top.encode() + body
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own_id or record_id(page_id, held, kind)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{held}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", str(size)),
    ]
    if info:
        fields.append(("WARC-Warcinfo-ID", info))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-Id", quote(str(page_id))))
    if coded:
        fields.append(("X-Payload-Encoding", "base64"))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Truncated", "length"), ("WARC-Refers-To-Date", date)]
        if refers:
            fields += [("WARC-Refers-To", record_id(refers[0], held, "response")), ("X-Refers-To-Page", quote(str(refers[0])))]
            if refers[1] is not None:
                fields.append(("WARC-Refers-To-Target-URI", refers[1].replace("\r", "%0D").replace("\n", "%0A")))
    return framed(fields, block)


def parsed(text: str) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record as the reader cuts it."""
    head, _, rest = text.removeprefix(VERSION + END).partition(END * 2)
    fields = dict(line.split(": ", 1) for line in head.split(END))
    data, size = rest.encode("utf-8", "surrogatepass"), int(fields["Content-Length"])
    if data[size:] not in (b"", (END * 2).encode()):
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has {len(data)} bytes for {size}")
    if digest(data[:size]) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"record {fields.get('WARC-Record-ID')} fails its digest")
    return fields, data[:size]


def _captured(date: str, most: int):
    def start():
        archive = Archive(date, most, "captured pages")

        def step(ids, urls, htmls):
            out = []
            for i, url, html in zip(ids, urls, htmls):
                payload = (html or "").encode("utf-8", "surrogatepass")
                held = digest(payload)
                out += archive.begun()
                out.append((record("response", i, url, payload, len(payload), held, None, date, archive.info, record_id(i, held, "captured")),))
            return out

        return step

    return start


def _revisits(date: str, most: int):
    def start():
        archive = Archive(date, most, "revisits of deduplicated pages")

        def step(ids, urls, sizes, digests, refers, refer_urls):
            out = []
            for i, url, size, held, to, to_url in zip(ids, urls, sizes, digests, refers, refer_urls):
                out += archive.begun()
                out.append((record("revisit", i, url, None, size, held, None if to is None else (to, to_url), date, archive.info),))
            return out

        return step

    return start


#: Fields that a copied record gets anew.
RENEWED = ("WARC-Record-ID", "WARC-Date", "WARC-Warcinfo-ID", "WARC-Block-Digest", "Content-Length")


def _renewed(date: str, most: int):
    def start():
        archive = Archive(date, most, "responses of deduplicated pages")

        def step(texts):
            out = []
            for text in texts:
                fields, block = parsed(text)
                page = fields.get("X-Page-Id")
                held = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                out += archive.begun()
                own = record_id(None if page is None else unquote(page), held, "response")
                kept = [(k, v) for k, v in fields.items() if k not in RENEWED and k != "WARC-Type"]
                fresh = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Warcinfo-ID", archive.info)]
                out.append((framed([*fresh, *kept], block),))
            return out

        return step

    return start


def _save(lines: DataFrame, path: str) -> None:
    # Fast compression: archives are read again soon.
    writer = lines.write.mode("append").option("lineSep", END * 2).option("maxRecordsPerFile", ARCHIVE_RECORDS)
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """A response record for each row (page_id, url, html)."""
    _save(map_rows(pages, ["page_id", "url", "html"], "value string", _captured(date, ARCHIVE_RECORDS)), path)


def _lines(spark: SparkSession, paths) -> DataFrame:
    """(value, file): the records of archives as text."""
    raw = spark.read.option("lineSep", CUT).schema("value string").text(paths)
    return raw.select("value", F.col("_metadata.file_path").alias("file"))


def _fields(with_payload: bool):
    def start():
        def step(texts, files):
            out = []
            for text, file in zip(texts, files):
                fields, block = parsed(text)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                _, _, body = block.partition((END * 2).encode())
                if fields.get("X-Payload-Encoding") == "base64":
                    body = base64.b64decode(body)
                held = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                whole = fields["WARC-Type"] == "response"
                if whole and (digest(body) != held or len(body) != int(fields["X-Payload-Length"])):
                    raise ValueError(f"record {fields['WARC-Record-ID']}: payload differs")
                page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                row = (
                    None if page is None else unquote(page),
                    int(fields["X-Payload-Length"]),
                    held,
                    fields["WARC-Type"],
                    None if to is None else unquote(to),
                    fields.get("WARC-Target-URI"),
                    fields["WARC-Record-ID"][len("<urn:uuid:") : -1],
                    file,
                )
                out.append((*row, body.decode("utf-8", "surrogatepass") if whole else None) if with_payload else row)
            return out

        return step

    return start


def read_archives(spark: SparkSession, path: str, with_payload: bool = False, id_type: str = "bigint") -> DataFrame:
    """The records of all archives in a folder, checked against their digests."""
    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, record_id string, file string"
    rows = map_rows(_lines(spark, path), ["value", "file"], schema + ", html string" * with_payload, _fields(with_payload))
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def resolved(headers: DataFrame) -> DataFrame:
    """``headers`` with ``record_type``, ``refers_to`` and ``refers_to_url`` by
    payload digest."""
    keys = ["payload_digest", "payload_bytes"]
    first = headers.groupBy(*keys).agg(F.max(F.struct("page_id", "url")).alias("__first"), F.count("*").alias("__n"))
    shared = stored(first.where("__n > 1").drop("__n"), "shared-payloads")
    joined = headers.drop("record_type", "refers_to").join(small(shared), keys, "left")
    lead = F.col("__first.page_id")
    response = lead.isNull() | F.coalesce(F.col("page_id") == lead, F.lit(False))
    return joined.select(
        *headers.drop("record_type", "refers_to").columns, F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, lead).alias("refers_to"), F.when(~response, F.col("__first.url")).alias("refers_to_url"),
    )


def _sets(by_file: DataFrame, limit: int):
    """(archives, revisits) of sets with ``limit`` revisits or fewer together; an
    archive with more is a set of its own.  The driver sees a row an archive, as
    it does when Spark lists them."""
    held, n = [], 0
    for x in by_file.orderBy("file").toLocalIterator():
        if held and n + x.n > limit:
            yield held, n
            held, n = [], 0
        held.append(x.file)
        n += x.n
    if held:
        yield held, n


def deduplicated(pages: DataFrame, folder: str | None = None, sent: int = SENT, date: str | None = None) -> DataFrame:
    """Archive all pages, read the archives, write deduplicated ones with fresh
    headers (of ``date``, the present unless it is given), and return what those hold."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    folder = folder or shared_folder(spark, "warc")
    captured, out = f"{folder}/captured", f"{folder}/deduplicated"
    write_archives(pages, captured)
    headers = stored(read_archives(spark, captured, id_type=kind), "headers")
    verdicts = stored(resolved(headers), "verdicts")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "refers_to", "refers_to_url"]
    _save(map_rows(verdicts.where("record_type = 'revisit'"), columns, "value string", _revisits(date, ARCHIVE_RECORDS)), out)
    _copy_responses(captured, verdicts, out, sent, date)
    return read_archives(spark, out, id_type=kind).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _copy_responses(captured: str, verdicts: DataFrame, out: str, sent: int, date: str) -> None:
    """Copy the captured records that are no revisits, ``SETS_AT_ONCE`` sets of
    archives in a job, each with the ids of its own revisits.

    The ids are written once, in a folder for each set, so each is read once more."""
    spark = verdicts.sparkSession
    gone = verdicts.where("record_type = 'revisit'").select("file", "record_id")
    by_file = verdicts.groupBy("file").agg(F.count_if(F.col("record_type") == "revisit").alias("n"))
    by_file = stored(by_file, "archives")
    if (by_file.agg(F.sum("n")).first()[0] or 0) <= sent:
        sets = [(captured, 0, gone)]
    else:
        held = list(_sets(by_file, sent))
        places = spark.createDataFrame([(f, k) for k, (files, _) in enumerate(held) for f in files], "file string, set int")
        folder = shared_folder(spark, "revisits-by-set")
        gone.join(small(places), "file").select("set", "record_id").repartition("set").write.partitionBy("set").parquet(folder)
        # A set without revisits has no folder.
        sets = [(files, n, spark.read.schema("record_id string").parquet(f"{folder}/set={k}") if n else gone.limit(0)) for k, (files, n) in enumerate(held)]
    jobs: list[DataFrame] = []

    def copy() -> None:
        _save(map_rows(reduce(DataFrame.union, jobs), ["value"], "value string", _renewed(date, ARCHIVE_RECORDS)), out)
        jobs.clear()

    for files, n, ids in sets:
        lines = _lines(spark, files).select("value", F.regexp_extract("value", RECORD_ID, 1).alias("record_id"))
        ids = ids.select("record_id").distinct()
        jobs.append(lines.where(~F.col("value").rlike(INFO)).join(F.broadcast(ids) if n <= sent else ids, "record_id", "left_anti"))
        if len(jobs) == SETS_AT_ONCE:
            copy()
    if jobs:
        copy()
