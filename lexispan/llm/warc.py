"""WARC archives with revisit records, and a merged capture index.

Pages become WARC/1.1 records, one gzip member each, so that every record can be fetched by its offset in the
file. Of pages with equal payloads the one with the smallest page_id is a response, the others are revisits that refer
to it; payloads shorter than a bound are always responses. Digests are grouped in a narrow table (digest, page_id,
rows), so payloads never gather in a task; a digest that very many rows share is joined by broadcast. Records are
sorted by URL key and time inside every task and collected to files of a bounded number of bytes, each of them one
locally sorted run of captures that begins with a warcinfo record. Spark's text writer puts the files down as they
are (a row is a file, its closing line separator a zero byte, which gzip takes for padding), so a lost
task leaves nothing behind.

Reading opens the members of every file one after the other and checks lengths and digests. The index entries
are then range-partitioned by (URL key, time, id). In each range the runs keep the order they have in their files,
and a loser tree merges them, which gives capture histories in global order.

Defined results: a null html is an empty payload; a null url has no target and an empty key; rows that share page_id
and payload with a response are responses as well; a null page_id never is referred to; records of rows that repeat
page_id and payload, or have no page_id, have ids of their own, and revisits name such a response by page and date only;
empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, scratch_path, written

#: Bytes of an archive file, but for a last record that is larger, and index entries that one merging task takes, about.
FILE_BYTES = 8 << 20
MERGE_ROWS = 100_000
#: Rows (about 40 bytes each) that may be broadcast, and rows from which on a digest is a hot one.
BROADCAST_ROWS, HOT_ROWS = 500_000, 10_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
START = 1704067200  # pages have no capture time: it is this many seconds, and page_id


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then path and query, lower case: example.com/a -> com,example)/a."""
    pattern = r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]*)(?::\d+)?([^#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(F.regexp_extract(url, pattern, 2)))
    return F.when(url.isNull(), F.lit("")).when(host == "", F.lower(url)).otherwise(key)


def _captured_at(page_id: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(START) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def captures(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (bytes), digest (20 bytes), first_id (null for responses), repeated and first_repeated."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    held = rows.select("digest", "page_id", F.octet_length("payload").alias("size"))
    ids = written(held.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")), "digests")
    firsts = ids.groupBy("digest").agg(F.min_by(F.struct("page_id", "n"), "page_id").alias("first"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("pages"))
    firsts = written(firsts.filter("all > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.n").alias("first_n"), "pages"), "firsts")
    # a hot digest's rows stay where they are: there are few such digests, whatever the number of rows
    bound = max(HOT_ROWS, ids.count() // HOT_ROWS)
    hot = firsts.filter(F.col("pages") > bound)
    marked = ids.join(F.broadcast(hot), "digest").unionByName(ids.join(firsts.filter(F.col("pages") <= bound), "digest"))
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")) & (F.col("size") >= min_revisit_bytes)
    repeated = (F.col("n") > 1) | F.col("page_id").isNull()
    own = marked.filter(revisit | repeated).select(
        F.col("digest").alias("k_digest"), F.col("page_id").alias("k_id"), F.when(revisit, F.col("first_id")).alias("first_id"), repeated.alias("repeated"), (F.col("first_n") > 1).alias("first_repeated")
    )
    own = written(own, "revisits")
    known = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    joined = rows.join(known, rows["page_id"].eqNullSafe(own["k_id"]) & (rows["digest"] == own["k_digest"]), "left").drop("k_id", "k_digest")
    alone = F.col("page_id").isNull()  # such a row with a digest of its own is in no table
    return joined.withColumns({"repeated": F.coalesce("repeated", alone), "first_repeated": F.coalesce("first_repeated", F.lit(False))})


def _urn(digest: bytes, page_id: object, *more: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(repr((digest, page_id, *more)).encode(), digest_size=16).digest())}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()
    return packer.compress(data) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _record(row: dict, task: int, number: int) -> bytes:
    digest, first = base64.b32encode(row["digest"]).decode(), row["first_id"]
    revisit = first is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(row["digest"], row["page_id"], *((task, number) if row["repeated"] else ()))),
        ("WARC-Refers-To", _urn(row["digest"], first) if revisit and not row["first_repeated"] else None),
        ("WARC-Refers-To-Date", row["first_at"] if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Target-URI", row["target"]),
        ("WARC-Date", row["captured_at"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", len(row["payload"])),
        ("X-Page", row["page_id"]),
        ("X-Refers-To-Page", first),
        ("X-URL-Key", row["url_key"]),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(headers, HTTP if revisit else HTTP + row["payload"])


def write_archives(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Archives under path; every file is sorted by URL key, time and page_id, equal ones in any order."""
    names = ["page_id", "payload", "digest", "first_id", "repeated", "first_repeated", "first_at", "target", "captured_at", "url_key"]
    schema = pa.schema([("file", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, members, size = TaskContext.get().partitionId(), 0, [], 0
        about = lambda: _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(b"", None, task, number)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        for batch in batches:
            columns = {n: batch.column(n) for n in names}
            for k in range(batch.num_rows):
                if not members:
                    members.append(about())
                members.append(_record({n: c[k].as_py() for n, c in columns.items()}, task, number))
                number, size = number + 1, size + len(members[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], schema=schema)
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], schema=schema)

    keyed = rows.withColumns(
        {
            "url_key": F.regexp_replace(url_key(F.col("url")), r"[\x00-\x1F]", "%20"),
            "target": F.regexp_replace("url", r"[\x00-\x20]", "%20"),
            "captured_at": _captured_at(F.col("page_id")),
            "first_at": _captured_at(F.col("first_id")),
        }
    )
    files = mapped(keyed.sortWithinPartitions("url_key", "captured_at", "page_id").select(*names), run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member of a file; closing zero bytes are padding."""
    at, view = 0, memoryview(data)
    while at < len(data) and data[at]:
        opened = zlib.decompressobj(31)
        content = opened.decompress(view[at:])
        if not opened.eof:
            raise ValueError(f"the gzip member at byte {at} is cut off")
        yield at, content
        at = len(data) - len(opened.unused_data)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head = record.index(b"\r\n\r\n")
    version, *lines = record[:head].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    block = record[head + 4 : -4]
    if version != "WARC/1.1" or record[-4:] != b"\r\n\r\n" or len(block) != int(headers["Content-Length"]):
        raise ValueError(f"not a record of the length that it names: {lines[:2]}")
    return headers, block


_ENTRY = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("url_key", pa.string()), ("captured_at", pa.string()), ("run", pa.string()), ("place", pa.int64())]
)
ENTRY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string, run string, place long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An index entry for every record; run is its file and place the offset of its gzip member there."""
    number = lambda x: None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, rows = batch.column(0)[k].as_py(), []
                for at, content in members(batch.column(1)[k].as_py()):
                    head, block = parsed(content)
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    digest, size = head["WARC-Payload-Digest"][5:], int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = memoryview(block)[len(HTTP) :]
                        if (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (digest, size):
                            raise ValueError(f"{name}, byte {at}: the payload is not what its header says")
                    rows.append((number(head.get("X-Page")), size, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page")), head.get("X-URL-Key", ""), head["WARC-Date"], name, at))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ENTRY.types, strict=True)], schema=_ENTRY)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return mapped(files, run, ENTRY)


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its last match, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf, build=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, leaf: int, build: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and build:
                self.losers[node] = winner
                return
            if other >= 0 and self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def merge_index(entries: DataFrame, n_rows: int, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """entries in global order of (url_key, captured_at, page_id): by partition, and inside each of them.

    A task holds its range as one Arrow table; runs are slices of it in file order, ascending already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, _ENTRY).combine_chunks()
        if not held.num_rows:
            return
        keys = [(u, t, -1 if i is None else i) for u, t, i in zip(*(held.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id")), strict=True)]
        names = held.column("run").to_pylist()
        starts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        slices = [iter([(keys[k], k) for k in range(a, b)]) for a, b in zip(starts, starts[1:], strict=False)]
        order = pa.array([k for _, k in LoserTree(slices)], pa.int64())
        yield from held.take(order).to_batches(10_000)

    parts = max(1, -(-n_rows // merge_rows), min(n_rows // 2000, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # rows of a run come together again, in the order of their file
    dealt = entries.repartitionByRange(parts, "url_key", "captured_at", "page_id").sortWithinPartitions("run", "place")
    return mapped(dealt, run, ENTRY)


def archive_pages(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the archives under path (a new one in the shared folder by default) and gives the merged index of what they hold."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(captures(pages, min_revisit_bytes), path)
    index = written(read_archives(pages.sparkSession, path), "cdx")
    return merge_index(index, index.count())
