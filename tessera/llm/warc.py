"""WARC archives with a globally ordered capture index.

Each task writes one archive, a gzip member per record, and sorts the index entries of every RUN
captures by URL key, time and page number. The sorted runs are dealt out by ranges, and each range merges its runs with a k-way loser tree,
which gives capture histories in one global order. The merge is external: HELD entries at most are in memory, what is more goes to
the shared folder as longer sorted runs, which are streamed through the tree. Records are read back through that index, in its order.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, partitions, table, written
from .files import make_folder, opened, part_name

RUN, HELD, REVISIT_FROM, EPOCH = 50_000, 200_000, 100, 1_700_000_000
READ_TOGETHER = 16_000_000  # bytes of payloads handed on at once
INDEX = "urlkey string, captured string, page_id string, url string, path string, offset long, length long"
#: Without capture times a page has its number in seconds after EPOCH, modulo SPREAD, so that any 64-bit number has a four-digit year. Given times are held within these.
SPREAD, FIRST_TIME, LAST_TIME = 1_000_000_000, "0001-01-01 00:00:00", "9999-12-31 23:59:59"
INFO = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-cased, without scheme, www, port and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, so that a new head plays one match a level."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, i: int) -> None:
        """Run i's head goes up; at an empty node it waits for its rival while the tree is being filled."""
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if not self._before(i, self.losers[node]):
                i, self.losers[node] = self.losers[node], i
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._play(self.winner)


def _urn(page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def _record(kind: str, page_id: str, url: str, date: str | None, digest: str, n: int, refers: tuple[str, str, str | None] | None, body: bytes) -> bytes:
    """A response, or a revisit of what `refers` (page number, url, date) captured; an unknown date has no header."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", *[f"WARC-Date: {date}"] * bool(date),
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(HTTP) + len(body)}", f"X-Page-Id: {page_id}", f"X-Payload-Length: {n}",
    ]
    if refers is not None:
        first, its_url, its_date = refers
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(first)}", f"WARC-Refers-To-Target-URI: {_uri(its_url)}"]
        lines += [f"WARC-Refers-To-Date: {its_date}"] * bool(its_date) + [f"X-Refers-To-Page-Id: {first}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP + body + b"\r\n\r\n"


def _info(name: str) -> bytes:
    """The warcinfo record that an archive begins with; no index entry names it."""
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(INFO)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + INFO + b"\r\n\r\n"


def squeezed(record: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if not head.startswith(b"WARC/1.1") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return headers, block.partition(b"\r\n\r\n")[2]


def with_decisions(pages: DataFrame, html: str, captured: Column | None) -> DataFrame:
    """page_id, url, html, digest, date and what it refers to (first, first_url, first_date) of each page. The pages of one payload meet in a join that AQE may split, never in a group."""
    number = F.col("page_id").cast("long")
    ts = F.timestamp_seconds(F.pmod(F.coalesce(number, F.lit(0)), F.lit(SPREAD)) + EPOCH) if captured is None else captured.cast("timestamp")
    held = F.least(F.greatest(ts, F.lit(FIRST_TIME).cast("timestamp")), F.lit(LAST_TIME).cast("timestamp"))
    kept = pages.select(
        number.alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(html, F.lit("")).alias("html"),
        F.date_format(F.when(ts.isNotNull(), held), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )
    kept = kept.withColumn("digest", F.sha2("html", 256))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))
    twice = kept.filter(F.octet_length("html") >= REVISIT_FROM).groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = kept.join(written(twice.select("digest", "first"), "payloads"), "digest", "left")
    refers = ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return met.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", "date",
        F.when(refers, F.col("first.page_id")).cast("string").alias("refers"), F.when(refers, F.col("first.url")).alias("first_url"), F.when(refers, F.col("first.date")).alias("first_date"),
    )


def write_archives(pages: DataFrame, html: str = "html", captured: Column | None = None) -> DataFrame:
    """Writes a record per row into archives in the shared folder; returns the index runs (schema INDEX), each sorted.

    A null html is an empty payload, a null url an empty one. Of records with equal payloads of REVISIT_FROM
    bytes or more, the one with the smallest page_id is the response (all rows that repeat it, too), the others
    are revisits. A page_id may be null, and is never referred to. `captured` is a timestamp; by default the page's number in seconds, modulo SPREAD,
    after a fixed time, as the tables have none. A null time gives a record without a date, which comes first in its history; times outside the years
    1 to 9999 count as the nearest within. Page numbers are any 64-bit integers. Other columns are ignored; an empty table writes nothing.
    """
    folder = new_folder(pages.sparkSession, "warc")
    make_folder(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at, entries = None, 0, []
        for b in batches:
            if out is None and len(b):
                path = part_name(folder, "warc.gz")[1]
                store, local = opened(path)
                out = store.open_output_stream(local, compression=None)  # the members are compressed one by one
                info = squeezed(_info(path.rsplit("/", 1)[-1]))
                out.write(info)
                at = len(info)
            for page_id, url, text, digest, date, first, its_url, its_date in zip(*(b[c] for c in ("page_id", "url", "html", "digest", "date", "refers", "first_url", "first_date"))):
                body = text.encode("utf-8", "replace")
                page_id, refers = page_id or "", (first, its_url, its_date) if first else None
                member = squeezed(_record("revisit" if refers else "response", page_id, url, date, digest, len(body), refers, b"" if refers else body))
                out.write(member)
                entries.append((url_key(url), re.sub(r"\D", "", date or ""), page_id, url, path, at, len(member)))
                at += len(member)
                if len(entries) == RUN:
                    yield pd.DataFrame(sorted(entries, key=place), columns=FIELDS)
                    entries = []
        if out is not None:
            out.close()
        if entries:
            yield pd.DataFrame(sorted(entries, key=place), columns=FIELDS)

    return written(with_decisions(pages, html, captured).mapInPandas(run, INDEX), "warc-runs")


FIELDS = [f.split()[0] for f in INDEX.split(", ")]


def place(entry: tuple) -> tuple:
    """Order of index entries: URL key, time, page number (none first), then where the record is."""
    return (entry[0], entry[1], int(entry[2]) if entry[2] else -(2**63), *entry[3:])


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Entries of sorted runs in one order."""
    return (entry for _, entry in LoserTree([((place(e), e) for e in r) for r in runs]))


def _frames(entries: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    while held := list(islice(entries, 10_000)):
        yield pd.DataFrame(held, columns=FIELDS)


def _spilled(uri: str, entries: Iterator[tuple]) -> None:
    store, path = opened(uri)
    with store.open_output_stream(path, compression=None) as out, pa.ipc.new_stream(out, SPILL) as to:
        for frame in _frames(entries):
            to.write_batch(pa.RecordBatch.from_pandas(frame, SPILL, preserve_index=False))


def _streamed(uri: str) -> Iterator[tuple]:
    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as file, pa.ipc.open_stream(file) as batches:
        for batch in batches:
            yield from zip(*batch.to_pydict().values())


SPILL = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in INDEX.split(", ")])


def capture_histories(runs: DataFrame) -> DataFrame:
    """The entries of all runs in global order of (urlkey, captured, page number): partitions are ascending ranges, each merged from its runs.

    Null page numbers come first, repeated entries stay, an empty table gives an empty one.
    """
    folder = new_folder(runs.sparkSession, "merge")
    make_folder(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: list[list[tuple]] = []
        held, spilled = 0, []
        try:
            for b in batches:
                for row in b[FIELDS].astype(object).where(b[FIELDS].notna(), None).itertuples(index=False, name=None):
                    if not pieces or place(row) < place(pieces[-1][-1]):  # a run ends where the order breaks
                        pieces.append([])
                    pieces[-1].append(row)
                    held += 1
                    if held == HELD:
                        spilled.append(part_name(folder, "run")[1])
                        _spilled(spilled[-1], merged([iter(p) for p in pieces]))
                        pieces, held = [], 0
            yield from _frames(merged([*map(_streamed, spilled), *map(iter, pieces)]))
        finally:
            for uri in spilled:
                store, path = opened(uri)
                store.delete_file(path)

    return runs.repartitionByRange(partitions(runs.sparkSession), "urlkey", "captured", F.col("page_id").try_cast("long")).mapInPandas(run, INDEX)


def read_archives(index: DataFrame) -> DataFrame:
    """The records that an index names, read and checked: urlkey, page_id, url, captured, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits).

    Entries are dealt out by ranges of (archive, offset) and read in that order, so that an archive is opened by few tasks, once each; sorted by urlkey,
    captured and page_id, nulls first, the records stand in the index's order. A record without a page number or a capture time comes back with a null one; entries
    that stand twice are read twice; an empty index gives no row. A payload that is not what its digest says is an error. What a revisit says
    about its payload is checked by `resolved`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_hand, f = None, None
        for b in batches:
            rows, held = [], 0
            for urlkey, url, captured, path, offset, length in zip(b["urlkey"], b["url"], b["captured"], b["path"], b["offset"], b["length"]):
                if path != at_hand:
                    if f is not None:
                        f.close()
                    store, local = opened(path)
                    at_hand, f = path, store.open_input_file(local)
                f.seek(offset)
                h, payload = parse_record(f.read(length))
                digest, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                full = h["WARC-Type"] == "response"
                if full and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
                    raise ValueError(f"{path} at {offset}: the payload is not what its digest says")
                rows.append((urlkey, h["X-Page-Id"] or None, url, captured or None, h["WARC-Type"], n, digest, h.get("X-Refers-To-Page-Id"), payload if full else None))
                held += len(payload)
                if len(rows) == 1_000 or held > READ_TOGETHER:
                    yield pd.DataFrame(rows, columns=RECORD)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=RECORD)
        if f is not None:
            f.close()

    dealt = index.repartitionByRange(partitions(index.sparkSession), "path", "offset").sortWithinPartitions("path", "offset")
    read = dealt.mapInPandas(run, "urlkey string, page_id string, url string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def resolved(records: DataFrame) -> DataFrame:
    """records, once every revisit has been met with the response it refers to; one that has none, or one of another payload, is an error.

    What the revisits of one response say is reduced to its different claims before they meet it, so that many revisits of one page are no hot key.
    """
    claim = ["payload_digest", "payload_bytes"]
    said = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *claim).distinct()
    wrong = said.join(records.filter("record_type = 'response'").select("page_id", *claim).distinct(), ["page_id", *claim], "left_anti").first()
    if wrong:
        raise ValueError(f"a revisit has no response of its payload: it refers to page {wrong.page_id}")
    return records


RECORD = ["urlkey", "page_id", "url", "captured", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = capture_histories(write_archives(table(spark, sf_dir, "pages")))
    records = read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "captured")
    return resolved(written(records, "records"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n, coalesce(url, '') AS url FROM pages),
r AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url,
       strftime(to_timestamp(1700000000 + (page_id % 1000000000 + 1000000000) % 1000000000) AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS captured
FROM p LEFT JOIN r ON p.d = r.d
"""
