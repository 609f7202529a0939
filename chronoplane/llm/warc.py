"""WARC archives of captures, indexed by an external merge of sorted runs, and read back through that index.

Each task writes one archive (a gzip member per record, as the format asks) into the shared folder and one run of
index entries, sorted locally by URL key, timestamp and page. The runs are dealt out by key range; every range is
merged k-way by a loser tree, so the ranges one after another hold each URL's capture history in order. The range key
ends in the page id, so a URL or host with very many captures spreads over as many ranges as it needs. Reading back
seeks each record by its index entry. Archives of failed task attempts have names of their own and no index entries.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, modest_batches

RUN = 200_000  # index entries sorted together by a writing task
RANGE = 500_000  # index entries merged by a task
DECODED = 512  # entries of a run decoded together
READ_BATCH = 256  # records read together, in the order of their places
ENTRY = "url_key string, timestamp string, page_id long, run long, position long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sortable key: host labels reversed, then path and query, lower case without a leading www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + rest.lower()


def timestamp_of(page_id: int | None) -> datetime:
    """Captures without a time of their own count seconds from 1970 by page id (modulo 2**32)."""
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=(page_id or 0) % (1 << 32))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, when: datetime, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with the whole payload, or a revisit that names the page which holds it."""
    digest = base32_sha1(payload)
    kind = "response" if refers_to is None else "revisit"
    body = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(payload), payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"),
        ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if refers_to is not None:
        headers[4:4] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else b""


def loser_tree_merge(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs; equal entries keep the order of their runs. Each step replays one path of the tree."""
    k = len(runs)
    if not k:
        return
    following = [iter(r).__next__ for r in runs]

    def next_of(i: int) -> tuple | None:
        try:
            return following[i]()
        except StopIteration:
            return None

    heads: list[tuple | None] = [next_of(i) for i in range(k)]

    def beats(a: int, b: int) -> bool:
        """Run a's head goes before run b's; exhausted runs (None) and the empty seat (-1) lose."""
        if b < 0 or heads[b] is None:
            return a >= 0
        if a < 0 or heads[a] is None:
            return False
        return (heads[a], a) < (heads[b], b)

    losers = [-1] * k
    winners = [-1] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    champion = winners[1] if k > 1 else 0
    while heads[champion] is not None:
        yield heads[champion]
        heads[champion] = next_of(champion)
        node = (k + champion) // 2
        while node:
            if beats(losers[node], champion):
                losers[node], champion = champion, losers[node]
            node //= 2


# Names that Spark's file systems have for stores which Arrow knows by another one.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/"}


def store_of(path: str) -> str:
    """A folder's address as Arrow wants it."""
    for theirs, ours in SCHEMES.items():
        if path.startswith(theirs):
            return ours + path.removeprefix(theirs).lstrip("/")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(store_of(path))


def with_owners(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload binary) with ``refers_to``: the largest page id of an equal payload, null if its own.

    Only narrow (digest, id) rows are aggregated, partially before the shuffle, so a payload that very many pages
    share stays cheap; the join back is a plain equi-join, which adaptive execution splits where one key is hot.
    """
    keyed = pages.withColumn("payload_key", F.sha2("payload", 256))
    owners = keyed.groupBy("payload_key").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1").select("payload_key", "owner")
    return keyed.join(owners, "payload_key", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, run_rows: int = RUN) -> DataFrame:
    """Write each partition of (page_id, url, payload, refers_to) to one archive; the runs of index entries come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _system(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        entries: list[tuple] = []
        number = context.partitionId() << 24
        out, place = None, 0

        def sorted_run() -> pa.RecordBatch:
            nonlocal number
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
            url_keys, times, page_ids, offsets, lengths = zip(*entries, strict=True)
            n = len(entries)
            columns = [pa.array(url_keys), pa.array(times), pa.array(page_ids, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([name] * n), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            entries.clear()
            number += 1
            return pa.RecordBatch.from_arrays(columns, names=["url_key", "timestamp", "page_id", "run", "position", "archive", "offset", "length"])

        try:
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                    if out is None:
                        out = fs.open_output_stream(name, compression=None)
                    page_id, url, when = page_id.as_py(), url.as_py(), timestamp_of(page_id.as_py())
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, when, payload.as_py(), refers_to.as_py())) + packer.flush()
                    out.write(data)
                    entries.append((url_key(url), when.strftime("%Y%m%d%H%M%S"), page_id, place, len(data)))
                    place += len(data)
                    if len(entries) >= run_rows:
                        yield sorted_run()
        finally:
            if out is not None:
                out.close()
        if entries:
            yield sorted_run()

    return materialize(modest_batches(pages).select("page_id", "url", "payload", "refers_to").mapInArrow(run, ENTRY), "warc-runs")


def merged_index(runs: DataFrame, rows: int = RANGE) -> DataFrame:
    """The index in global order: key ranges of about ``rows`` entries, each merged from the parts of the runs in it.

    A task holds its range as Arrow columns, run by run, and decodes only a few entries of each run at a time: the tree
    sees streams, and what it emits are places, by which the columns are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        number = whole.column("run").to_numpy()
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])

        def entries(first: int, end: int) -> Iterator[tuple]:
            for low in range(first, end, DECODED):
                part = whole.slice(low, min(DECODED, end - low))
                ids = part.column("page_id").to_pylist()
                for i, (url, time, page_id) in enumerate(zip(part.column("url_key").to_pylist(), part.column("timestamp").to_pylist(), ids, strict=True)):
                    yield url, time, page_id is not None, page_id or 0, low + i

        merged = loser_tree_merge([entries(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())])
        while places := [entry[-1] for entry in islice(merged, 8192)]:
            yield from whole.take(pa.array(places, pa.int64())).combine_chunks().to_batches()

    entries_in_all = runs.count()  # of a written table
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries_in_all // rows))
    return runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id").sortWithinPartitions("run", "position").mapInArrow(run, ENTRY)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Fetch every indexed record; its payload must have the length and, for responses, the digest its header states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _system(folder)
        files: OrderedDict[str, pa.NativeFile] = OrderedDict()

        def fetch(archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
            if archive not in files:
                files[archive] = fs.open_input_file(archive)
                if len(files) > 64:
                    files.popitem(last=False)[1].close()
            files.move_to_end(archive)
            return parse(zlib.decompress(files[archive].read_at(length, offset), 31))

        for batch in batches:
            for start in range(0, batch.num_rows, READ_BATCH):
                part = batch.slice(start, READ_BATCH)
                places = list(zip(*(part.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
                rows: list = [None] * len(places)
                for i in sorted(range(len(places)), key=places.__getitem__):
                    headers, payload = fetch(*places[i])
                    size, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"damaged record at {places[i]}")
                    page, refers = headers["x-page-id"], headers.get("x-refers-to-page")
                    rows[i] = (int(page) if page else None, size, digest, headers["warc-type"], int(refers) if refers else None, headers["warc-target-uri"])
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, part.column("url_key"), part.column("timestamp")], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "url_key", "timestamp"])
        for f in files.values():
            f.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, timestamp string"
    return index.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives in ``folder`` (by default a new one in the shared folder), index them, read them back.

    Null html is an empty payload; equal payloads, the empty one too, have one response, the page with the largest
    id, and revisits. Rows repeated with that same id are responses each. A null id is never the largest while another
    is there. A null URL has the empty key. An empty table gives no archive and no row. Other columns are ignored.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return read_archives(merged_index(write_archives(with_owners(named), folder)), folder)
