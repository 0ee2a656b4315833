"""WARC archives of pages, and their capture index by an external merge of sorted runs."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, materialize

EPOCH = dt.datetime(2020, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FAN_IN = 128  # runs that one merge reads at once
FENCE_ROWS = 4096  # rows of a run between two index entries
RANGE_ROWS = 50_000
RANGE_KEYS = 4  # keys that come to the driver for each range
BATCH_ROWS = 10_000
CAPTURE = pa.schema([("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
CAPTURE_DDL = "url_key string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint"
KEYS = ("url_key", "captured_at", "page_id")


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then the path and query; no scheme, fragment or leading www."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return (url or "").strip()
    if not host:
        return (url or "").strip()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def captured_at(page_id: int | None) -> str:
    """The pages have no clock: a capture is as many seconds after EPOCH as its page_id says."""
    return (EPOCH + dt.timedelta(seconds=min(max(page_id or 0, 0), 200_000_000_000))).strftime("%Y-%m-%dT%H:%M:%SZ")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the HTTP header, and so the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {captured_at(page_id)}"]
    lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def read_records(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of each gzip member, read in order with one member in memory."""
    data, at, ended = b"", 0, False
    while True:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    ended = True
                    break
            parts.append(unpack.decompress(data))
            used += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        if ended:
            if used:
                raise ValueError(f"archive cut off in the member at {at}")
            return
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        header = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(header["Content-Length"])]
        if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError(f"not a WARC record at {at}")
        yield at, header, block
        at += used


def capture(archive: str, offset: int, header: dict[str, str], block: bytes) -> dict:
    """What one record says; a response's payload is hashed again and held against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = header["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{archive} at {offset}: the payload is not the one archived")
    return {"url_key": url_key(header["WARC-Target-URI"]), "captured_at": header["WARC-Date"], "page_id": _page_of(header["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page_of(header.get("WARC-Refers-To")), "archive": archive, "offset": offset}


def order(row: dict) -> tuple:
    return (row["url_key"], row["captured_at"], -1 if row["page_id"] is None else row["page_id"], row["archive"], row["offset"])


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so that a new row plays one match a level."""

    def __init__(self, runs: list[Iterator[dict]]):
        self.runs = runs
        self.k = len(runs)
        self.heads: list[tuple[tuple, dict] | None] = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int) -> tuple[tuple, dict] | None:
        row = next(self.runs[i], None)
        return None if row is None else (order(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def __iter__(self) -> Iterator[dict]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w][1]
            self.heads[w] = self._next(w)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def write_run(folder: str, rows: Iterable[dict]) -> Iterator[dict]:
    """Write sorted rows as a run file; yields its fences: run, batch, first and last key, rows."""
    path = f"{folder}/run-{uuid.uuid4().hex}.arrow"
    fs, local = pafs.FileSystem.from_uri(path)
    fs.create_dir(local.rpartition("/")[0])
    with fs.open_output_stream(local) as out, ipc.new_file(out, CAPTURE) as writer:
        batch: list[dict] = []
        number = 0

        def flush() -> dict:
            writer.write_batch(pa.RecordBatch.from_pylist(batch, CAPTURE))
            return {"run": path, "batch": number, "lo": _flat(batch[0]), "hi": _flat(batch[-1]), "rows": len(batch)}

        for row in rows:
            batch.append(row)
            if len(batch) == FENCE_ROWS:
                yield flush()
                batch, number = [], number + 1
        if batch:
            yield flush()


def _flat(row: dict) -> str:
    """The key as one string that sorts as the key does."""
    return f"{row['url_key']}\x00{row['captured_at']}\x00{(row['page_id'] if row['page_id'] is not None else -1) + 2**63:020d}"


def read_run(path: str, batches: list[int], lo: str | None, hi: str | None) -> Iterator[dict]:
    """Rows of the named batches with lo <= key < hi, one batch in memory."""
    fs, local = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(local) as f:
        reader = ipc.open_file(f)
        for b in batches:
            for row in reader.get_batch(b).to_pylist():
                key = _flat(row)
                if (lo is None or key >= lo) and (hi is None or key < hi):
                    yield row


def write_archives(pages: DataFrame, folder: str, *, archive_bytes: int = 32 << 20, same_bytes: int = 1000) -> DataFrame:
    """Archive pages (page_id, url, html); returns the table of archives, written so that it names those that count.

    Of payloads of at least `same_bytes` that are equal, that with the largest page_id is kept, others revisit it.  Each
    attempt of a task writes files of its own, so a repeated task leaves no half-written archive in the table.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= same_bytes)
    same = materialize(large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "kept"), "same-payloads")
    # small payloads, which revisit nothing, are dealt by row: very many of them may be equal
    key = F.when(F.octet_length("payload") >= same_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    same = same.withColumnRenamed("digest", "large")
    marked = rows.join(same, key == F.col("large"), "left").withColumn("refers_to", F.when((F.octet_length("payload") >= same_bytes) & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, data, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size, count = f"captures-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                made = record(page_id, url, data, digest, refers)
                out.write(made)
                size, count = size + len(made), count + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return materialize(marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, records bigint, bytes bigint"), "archives")


FENCE_DDL = "run string, batch bigint, lo string, hi string, rows bigint"


def _fences(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("run", pa.string()), ("batch", pa.int64()), ("lo", pa.string()), ("hi", pa.string()), ("rows", pa.int64())]))


def index_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Capture histories: every record of the archives by URL key, time and page, with merge_range and merge_rank.

    Each archive is read once, in order, and its captures sorted into one run.  While there are more runs than FAN_IN,
    groups of runs are merged into longer ones.  Then keys found at the runs' fences cut the order into ranges of about
    RANGE_ROWS, and each range is merged on its own from the batches of the runs that reach into it, so that a hot URL is
    spread over tasks too.  (merge_range, merge_rank) is the global order.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(local, compression=None) as stream:
                    rows = sorted((capture(path, at, header, block) for at, header, block in read_records(stream)), key=order)
                yield _fences(list(write_run(folder, rows)))

    n = archives.count()
    fences = materialize(archives.select("archive").repartition(max(1, n), "archive").mapInArrow(runs, FENCE_DDL), "fences")

    def merge_whole(t: pa.Table) -> pa.Table:
        by: dict[str, list[int]] = {}
        for r, b in sorted(zip(t["run"].to_pylist(), t["batch"].to_pylist())):
            by.setdefault(r, []).append(b)
        return pa.Table.from_batches([_fences(list(write_run(folder, LoserTree([read_run(r, b, None, None) for r, b in by.items()]))))])

    while (count := fences.select("run").distinct().count()) > FAN_IN:
        group = F.pmod(F.xxhash64("run"), F.lit(-(-count // (FAN_IN * 3 // 4))))
        fences = materialize(fences.withColumn("g", group).groupBy("g").applyInArrow(merge_whole, FENCE_DDL), "fences")

    total = fences.agg(F.sum("rows"), F.count(F.lit(1))).first()
    ranges = max(1, (total[0] or 0) // RANGE_ROWS)
    every = max(1, (total[1] or 0) // (ranges * RANGE_KEYS))
    keys = sorted(r["lo"] for r in fences.where(F.pmod(F.xxhash64("run", "batch"), F.lit(every)) == 0).select("lo").collect()) if ranges > 1 else []
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, int]] = []
            for run, b, lo, hi, _ in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(r, run, b) for r in range(bisect_right(cuts, lo), bisect_right(cuts, hi) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["range", "run", "batch"])

    merged = CAPTURE.append(pa.field("merge_range", pa.int64())).append(pa.field("merge_rank", pa.int64()))

    def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        r = t["range"][0].as_py()
        lo, hi = cuts[r - 1] if r else None, cuts[r] if r < len(cuts) else None
        by: dict[str, list[int]] = {}
        for run, b in sorted(zip(t["run"].to_pylist(), t["batch"].to_pylist())):
            by.setdefault(run, []).append(b)
        rows = (row | {"merge_range": r, "merge_rank": k} for k, row in enumerate(LoserTree([read_run(run, b, lo, hi) for run, b in by.items()])))
        while some := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_pylist(some, merged)

    reached = fences.select("run", "batch", "lo", "hi", "rows").mapInArrow(reach, "range bigint, run string, batch bigint")
    return reached.groupBy("range").applyInArrow(merge_range, CAPTURE_DDL + ", merge_range bigint, merge_rank bigint")


def archive_and_index(pages: DataFrame, **how) -> DataFrame:
    """Archive pages to the shared folder, read the archives back, and merge their captures into histories.

    Null html is an empty payload, a null url an empty one; a null page_id is never the page that others refer to.
    Payloads of under 1000 bytes, and repeated rows among them, are all responses; repeated rows with the largest
    page_id of a payload are all responses too.  Empty tables give no rows; other columns are ignored.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return index_archives(write_archives(pages, folder, **how), folder)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
