"""WARC archives with an external merge of the capture index.

Writer tasks put gzip members, one per record, into archives in the shared folder and end each archive
with a locally sorted run of capture entries (URL key, timestamp, id, archive, offset, length). The runs
are dealt by key range, so that every range holds a slice of every run, and each range is merged by a
k-way loser tree: the ranges in order are the globally ordered capture histories. The shuffle that deals the
ranges is what is external; a task holds the MERGE_ROWS or so entries of its range. Readers fetch records by the
merged entries and check them: length and digest of a response are worked out from the payload that was read.

Defined results: a null payload is the empty payload; of records with equal payloads of at least
``min_bytes`` bytes those with the smallest non-null id are responses and the others revisits (a repeated
row of the smallest id is again a response; if no such record has an id all are responses); a null or
blank URL gets the empty key; control characters in URLs are percent-encoded; extra columns are ignored.
A lost writer task leaves an archive that no entry names, so a retry never doubles a record.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Columns, arrow_rows, filesystem, scratch, written

MIN_BYTES = 100
#: An archive is closed, and its run of entries sorted, at this size.
ARCHIVE_BYTES = 128 << 20
#: Entries that one merge task takes, about.
MERGE_ROWS = 200_000
#: Timestamp of a capture without one: this plus its id in seconds.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)

ENTRY = "url_key string, captured string, page_id bigint, archive string, offset bigint, length bigint, run string, seq int"
CAPTURE = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, captured string, intact boolean, url_key string, nth bigint, place bigint"
INDEX = "url_key string, captured string, page_id bigint, archive string, offset bigint, length bigint, nth bigint, place bigint"


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, port, path and query; scheme, fragment and a leading www are dropped."""
    if not url or not url.strip():
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return f"{at}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def header_value(value: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record_bytes(page_id: int | None, url: str | None, when: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the response's HTTP header, whose Content-Length is the full payload's."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:capture:{name}>", f"WARC-Date: {when}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:capture:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(page_id, url, payload bytes, digest, type, refers_to, captured, intact) of one record. A response's length
    and digest are its payload's, a revisit's those of the payload that it refers to, as its headers tell; intact
    is false if what the record says of itself differs from what it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
    urn = lambda v: None if v is None or v[13:-1] == "null" else int(v[13:-1])
    said, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "revisit":
        found = (length, said)
        whole = not payload and fields.get("WARC-Refers-To") is not None
    else:
        found = (len(payload), hashlib.sha256(payload).hexdigest())
        whole = found == (length, said)
    whole = whole and len(body) == int(fields["Content-Length"]) and rest[len(body) :] == b"\r\n\r\n"
    return urn(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), *found, kind, urn(fields.get("WARC-Refers-To")), fields["WARC-Date"], whole


class LoserTree:
    """Merge of k sorted lists: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; an empty run goes last, equal heads by run."""
        x, y = self.at[a] < len(self.runs[a]), self.at[b] < len(self.runs[b])
        if not (x and y):
            return x
        p, q = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return p < q or p == q and a < b

    def _play(self, i: int) -> None:
        node, losers = (i + self.k) // 2, self.losers
        while node > 0:
            if losers[node] < 0:
                losers[node] = i
                return
            if self._less(losers[node], i):
                losers[node], i = i, losers[node]
            node //= 2
        losers[0] = i

    def __iter__(self) -> Iterator:
        if not self.k:
            return
        if self.k == 1:
            yield from self.runs[0]
            return
        while True:
            i = self.losers[0]
            if self.at[i] >= len(self.runs[i]):
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._play(i)


def marked_revisits(df: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """id, url, payload, digest, refers_to. The digests' smallest ids are pre-aggregated; the join's skew is
    left to AQE, as a row needs no other row of its digest."""
    rows = df.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload")
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = (
        df.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
        .where(F.octet_length("payload") >= min_bytes)
        .groupBy(F.sha2(F.col("payload").cast("binary"), 256).alias("first_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )
    joined = rows.join(first, F.col("digest") == F.col("first_digest"), "left")
    again = F.col("first_id").isNotNull() & ((F.col("page_id") > F.col("first_id")) | F.col("page_id").isNull())
    return joined.select("page_id", "url", "payload", "digest", F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(rows: DataFrame, base: str) -> DataFrame:
    """Write the records; returns the locally sorted runs of capture entries."""

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        fs, root = filesystem(base)
        fs.create_dir(root, recursive=True)
        out, name, offset, entries = None, "", 0, []

        def sealed() -> Columns:
            out.close()
            entries.sort()
            key, when, unnamed, ids, at, length = map(list, zip(*entries))
            n = len(entries)
            page_ids = [None if none else i for none, i in zip(unnamed, ids)]
            return {"url_key": key, "captured": when, "page_id": page_ids, "archive": [name] * n, "offset": at, "length": length, "run": [name] * n, "seq": list(range(n))}

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"]):
                if out is None:
                    name, offset, entries = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = fs.open_output_stream(posixpath.join(root, name), compression=None)
                when = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = gz.compress(record_bytes(page_id, url, when, payload.encode("utf-8", "replace"), digest, refers_to)) + gz.flush()
                out.write(member)
                entries.append((url_key(url), when, page_id is None, page_id or 0, offset, len(member)))
                offset += len(member)
                if offset >= ARCHIVE_BYTES:
                    yield sealed()
                    out = None
        if out is not None:
            yield sealed()

    return arrow_rows(rows, run, ENTRY)


def merge_runs(runs: DataFrame, n_rows: int, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """INDEX: capture histories in global order, by range-dealt loser-tree merges. place: a capture's place in the
    whole order, nth: in its URL's history, both from 1. A history may go on over ranges, so what the ranges
    before hold of it is added from a table of the ranges, one row each."""
    parts = max(1, -(-n_rows // merge_rows))
    dealt = runs.repartitionByRange(parts, "url_key", "captured", F.col("page_id").asc_nulls_last(), "archive", "offset")

    def merge(batches: Iterable[Columns]) -> Iterator[Columns]:
        slices: dict[str, list[tuple]] = {}
        for b in batches:
            for key, when, page_id, archive, offset, length, name, seq in zip(*(b[c] for c in ("url_key", "captured", "page_id", "archive", "offset", "length", "run", "seq"))):
                slices.setdefault(name, []).append((key, when, page_id is None, page_id or 0, archive, offset, length, seq))
        for part in slices.values():
            if any(a[-1] > b[-1] for a, b in zip(part, part[1:])):  # blocks of a run may be fetched in any order
                part.sort(key=lambda e: e[-1])
        names = ("url_key", "captured", "page_id", "archive", "offset", "length", "nth", "place", "range")
        chunk: list[tuple] = []
        at, last, nth = TaskContext.get().partitionId(), None, 0
        for place, e in enumerate(LoserTree([slices[k] for k in sorted(slices)]), 1):
            nth, last = (nth + 1 if e[0] == last else 1), e[0]
            chunk.append((e[0], e[1], None if e[2] else e[3], e[4], e[5], e[6], nth, place, at))
            if len(chunk) == 10_000:
                yield dict(zip(names, map(list, zip(*chunk))))
                chunk = []
        if chunk:
            yield dict(zip(names, map(list, zip(*chunk))))

    merged = written(arrow_rows(dealt, merge, INDEX + ", range int"), "index")
    first, last = F.min("url_key"), F.max("url_key")
    ranges = merged.groupBy("range").agg(first.alias("first"), last.alias("last"), F.max("place").alias("n"), F.max_by("nth", "place").alias("tail")).orderBy("range").collect()
    before, rows = 0, []
    held: tuple[str | None, int] = (None, 0)  # the URL that the ranges so far end with, and its captures
    for r in ranges:
        more = held[1] if r["first"] == held[0] else 0
        rows.append((r["range"], r["first"], more, before))
        before += r["n"]
        held = (r["last"], r["tail"] + (more if r["last"] == r["first"] else 0))
    told = merged.sparkSession.createDataFrame(rows, "of int, first string, more bigint, before bigint")
    nth = F.col("nth") + F.when(F.col("url_key") == F.col("first"), F.col("more")).otherwise(F.lit(0))
    joined = merged.join(F.broadcast(told), F.col("range") == F.col("of"))
    return joined.select("url_key", "captured", "page_id", "archive", "offset", "length", nth.alias("nth"), (F.col("place") + F.col("before")).alias("place"))


def read_captures(index: DataFrame, base: str) -> DataFrame:
    """Records that the index names, in CAPTURE columns. Tasks take stretches of 16 MB of an archive."""

    def read(batches: Iterable[Columns]) -> Iterator[Columns]:
        fs, root = filesystem(base)
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured", "intact", "url_key", "nth", "place")
        handle, opened = None, None
        for b in batches:
            rows = []
            for archive, offset, length, *history in sorted(zip(*(b[c] for c in ("archive", "offset", "length", "url_key", "nth", "place")))):
                if archive != opened:
                    if handle is not None:
                        handle.close()
                    handle, opened = fs.open_input_file(posixpath.join(root, archive)), archive
                try:
                    record = parse_record(zlib.decompress(handle.read_at(length, offset), 31))
                except (zlib.error, ValueError, KeyError, StopIteration) as e:
                    raise OSError(f"record at {offset} of {archive} can't be read: {e}") from e
                rows.append((*record, *history))
            if rows:
                yield dict(zip(names, map(list, zip(*rows))))
        if handle is not None:
            handle.close()

    places = index.select("archive", "offset", "length", "url_key", "nth", "place").withColumn("stretch", F.expr("`offset` div 16777216"))
    return arrow_rows(places.repartition("archive", "stretch").drop("stretch"), read, CAPTURE)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> tuple[DataFrame, str]:
    """Write archives of all rows; returns their ordered index and the folder of the archives."""
    spark = pages.sparkSession
    base = scratch(spark, "warc")
    runs = written(write_archives(marked_revisits(pages, id_col, url_col, html_col, min_bytes), base), "runs")
    return merge_runs(runs, runs.count()), base


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, base = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = read_captures(index, base)
    sound = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))))
    return found.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to", "nth", "place")


OP2_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
     m AS (SELECT *, strlen(h) AS n, min(page_id) OVER (PARTITION BY h) AS f,
                  coalesce(page_id, 0) % 1000000000 AS tick,
                  CASE WHEN url IS NULL OR trim(url) = '' THEN '' ELSE
                    array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', ''), '.')), ',')
                    || ')' || coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')
                    || regexp_extract(url, '^[^?#]*([?][^#]+)', 1) END AS k
           FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND (page_id > f OR page_id IS NULL AND f IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND (page_id > f OR page_id IS NULL AND f IS NOT NULL) THEN f END AS refers_to,
       row_number() OVER (PARTITION BY k ORDER BY tick, page_id NULLS LAST) AS nth,
       row_number() OVER (ORDER BY k, tick, page_id NULLS LAST) AS place
FROM m
"""
