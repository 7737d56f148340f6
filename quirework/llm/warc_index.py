"""WARC: archives of captures, and an external merge of their indexes.

Writing: each capture becomes a record, compressed by itself, so that a reader
can start at any offset of the index. Records with equal payloads of at least
MIN_BYTES bytes are written once, under the smallest id; the others become
revisit records that name it. The records are made in one pass and written to
the shared folder; only digests and ids are shuffled to find the repeats, and
only their row numbers are joined back. Archives hold ARCHIVE_BYTES at most, or
one record: records of like size go together, so that a number of records bounds
the bytes. Spark's own committers write the files, so a lost executor leaves no
half archive.

Reading: each archive is read record by record into index lines. Lines are dealt
by archive into at most RUNS runs, each sorted by URL key and timestamp, and cut
into blocks, which are dealt by ranges of that order, at most RANGES. A range
takes its blocks by their first lines: what lies before the first line of the
next block can be merged by a loser tree over the runs and given out. So it
holds WINDOW blocks and one for each run, however long the range is. The ranges
one after another are the capture history of every URL in order; a URL with very
many captures spans ranges, for id and place follow in the order.

Results for odd input: a null html is an empty payload; a null url has an empty
key and no target line; a capture without id is a revisit if a capture with an
id has the payload, else a response, and so is every other without id; of
captures with one id and one payload the first written is the response, and the
others revisit the id they share; ids that aren't whole numbers are texts; a
null time is EPOCH; an id may be any long, and its time has a year of four
digits, as ids TIMES apart have the same and id follows in the order; very long
payloads make archives of their own; control characters in urls are escaped in
the record; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, IntegralType, StructField, StructType, _parse_datatype_string

from quirework.llm.common import BATCH_ROWS, drop_path, fields, file_system, fresh_path, join_unique, load, map_rows, shared, slices, staged, table

MIN_BYTES = 0
#: Seconds of the first capture where a table has no times; each id is one second later, and after so many seconds the first time comes again.
EPOCH, TIMES = 1704067200, 1 << 32
#: Compressed bytes in one archive.
ARCHIVE_BYTES = 64 << 20
#: Lines in a block, in a run and in a range; the last two are more where that would give more than RUNS or RANGES of them.
BLOCK_LINES, RUN_LINES, RUNS, RANGE_LINES, RANGES = 128, 50_000, 256, 20_000, 256
#: Blocks that a range takes at a time, and lines that are looked at to place the ranges, about so many for each.
WINDOW, SAMPLE = 256, 64
END = b"\r\n\r\n"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The host's labels in reverse, then path and query, in lower case."""
    try:
        at = urlsplit(url)
        host = at.hostname or ""
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (at.path or "/").lower() + (f"?{at.query.lower()}" if at.query else "")


def record(page_id, url: str | None, time: str, size: int, digest: str, payload: bytes | None, refers_to) -> bytes:
    """A compressed record; without a payload that of a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:capture:{'' if page_id is None else name_of(page_id)}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + escaped(url))
    lines += [f"WARC-Date: {time}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{name_of(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    out = gzip.compress("\r\n".join(lines).encode() + END + block + END, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", 6, mtime=0)


def escaped(text: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def name_of(page_id) -> str:
    return quote(str(page_id), safe="")


def size_class(n: int) -> int:
    """A power of eight that n bytes don't exceed, from 8 KB on."""
    size = 8192
    while size < n:
        size *= 8
    return size


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of pages, in folders under path by the size of their records.

    The text writer puts out bytes as they are and a separator after each row. A
    compressed member ends with the high byte of its length, zero, and that is
    the separator.
    """
    spark = pages.sparkSession
    number = isinstance(pages.schema[id_col].dataType, IntegralType)
    key = F.col(f"`{id_col}`").cast("long" if number else "string")
    later = F.coalesce(F.pmod(key, F.lit(TIMES)), F.lit(0)) if number else F.coalesce(F.crc32(key), F.lit(0))
    time = F.coalesce(F.col(f"`{time_col}`"), F.timestamp_seconds(F.lit(EPOCH))) if time_col else F.timestamp_seconds(F.lit(EPOCH) + later)
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(key.alias("id"), F.col(f"`{url_col}`").alias("url"), stamp.alias("time"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"))

    def start():
        def batch(rows: dict) -> dict:
            digests = [sha1(p) for p in rows["payload"]]
            sizes = [len(p) for p in rows["payload"]]
            made = [record(i, u, t, n, d, p, None)[:-1] for i, u, t, n, d, p in zip(rows["id"], rows["url"], rows["time"], sizes, digests, rows["payload"])]
            return {k: rows[k] for k in ("id", "url", "time")} | {"size": sizes, "digest": digests, "class": [size_class(len(x)) for x in made], "record": made}

        return batch

    made = map_rows(rows, rows.columns, start, fields(rows, ["id", "url", "time"], "size long, digest string, class long, record binary"))
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    folder = fresh_path(spark, "records")
    made = staged(made.withColumn("row", F.monotonically_increasing_id()), "records", folder)
    known = made.where((F.col("size") >= min_bytes)).select("row", "id", "digest")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = known.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1 AND first.id IS NOT NULL")
    again = join_unique(known, first, "digest", "n", known.count()).where("row <> first.row").select("row", F.col("first.id").alias("first"))
    again = staged(again, "again")

    def revisits():
        def batch(rows: dict) -> dict:
            return {"value": [record(i, u, t, n, d, None, f)[:-1] for i, u, t, n, d, f in zip(*(rows[k] for k in ("id", "url", "time", "size", "digest", "first")))]}

        return batch

    def put(values: DataFrame, name: str, at_most: int) -> None:
        values.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, archive_bytes // at_most)).text(f"{path}/{name}")

    for r in made.groupBy("class").count().orderBy("class").collect():
        put(made.where(F.col("class") == r["class"]).select("row", F.col("record").alias("value")).join(again, "row", "left_anti"), f"response-{r['class']}", r["class"])
    if not again.isEmpty():
        narrow = made.select("row", "id", "url", "time", "size", "digest").join(again, "row")
        values = map_rows(narrow, ["id", "url", "time", "size", "digest", "first"], revisits, "value binary")
        put(values, "revisit", 8192)
    drop_path(spark, folder)


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each compressed member."""
    at, view, step = 0, memoryview(content), 1 << 16
    while at < len(content):
        d, data, to = zlib.decompressobj(31), [], at
        while not d.eof:
            if to >= len(content):
                raise ValueError("an archive ends within a record")
            data.append(d.decompress(view[to : to + step]))
            to = min(to + step, len(content))
        to -= len(d.unused_data)
        yield at, to - at, b"".join(data)
        at = to


def parse(data: bytes, number: bool = True) -> dict:
    """What an index line holds of one record; the digest of a response is taken from its payload and held against the header."""
    head, _, rest = data.partition(END)
    lines = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(lines["Content-Length"])]
    if rest[len(block) :] != END:
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(END)
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = lines["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = lines["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1(payload) != digest):
        raise ValueError("a record's payload is damaged")

    def name(field: str):
        text = lines.get(field, "").removeprefix("<urn:capture:").rstrip(">")
        return None if not text else int(text) if number else unquote(text)

    return {"url_key": url_key(lines["WARC-Target-URI"]) if "WARC-Target-URI" in lines else "", "time": lines["WARC-Date"], "page_id": name("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": name("WARC-Refers-To")}


INDEX = "url_key string, time string, page_id long, run int, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
FIELDS = [x.split()[0] for x in INDEX.split(", ")]
PLACE = FIELDS[:6]


def index_schema(number: bool = True) -> StructType:
    return _parse_datatype_string(INDEX if number else INDEX.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string"))


def order(line) -> tuple:
    """What lines are ordered by, as Spark orders them."""
    key, time, page_id, run, archive, offset = line[:6]
    return key, time, page_id is not None, 0 if page_id is None else page_id, run, archive, offset


def index(spark: SparkSession, path: str, number: bool = True, run_lines: int = RUN_LINES, runs: int = RUNS) -> DataFrame:
    """A line for each record of the archives under path, in the shared folder. Archives are dealt into at most so many runs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("__path"), "content")

    def start():
        def batch(rows: dict) -> dict:
            out = []
            for archive, content in zip(rows["__path"], rows["content"]):
                name = "/".join(archive.split("/")[-2:])
                found = [parse(data, number) | {"archive": name, "offset": at, "length": n, "run": None} for at, n, data in members(content) if data]
                out += [tuple(x[f] for f in FIELDS) for x in found]
            return dict(zip(FIELDS, zip(*out))) if out else {f: [] for f in FIELDS}

        return batch

    lines = staged(map_rows(files, ["__path", "content"], start, index_schema(number), 1), "lines")
    n = max(1, min(runs, -(-lines.count() // run_lines)))
    return lines.withColumn("run", F.pmod(F.xxhash64("archive"), F.lit(n)).cast("int"))


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, and a new line plays one path up."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.keys = [order(h) if h else None for h in self.heads]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self.play(i)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and (x, a) < (y, b)

    def play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at:
            other = self.losers[at]
            if other < 0:  # the first to come waits for the one from the other side
                self.losers[at] = winner
                return
            if self.beats(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = line = next(self.sources[w], None)
            self.keys[w] = order(line) if line else None
            self.play(w)


def merge_slices(sources: dict[int, list[tuple]]) -> Iterator[tuple]:
    return iter(LoserTree([iter(sources[k]) for k in sorted(sources)]))


def merge(lines: DataFrame, range_lines: int = RANGE_LINES, ranges: int = RANGES, block_lines: int = BLOCK_LINES, window: int = WINDOW) -> DataFrame:
    """All index lines in order of url_key, time and id, in ranges that follow each other."""
    spark, n = lines.sparkSession, lines.count()
    n_ranges = max(1, min(ranges, -(-n // range_lines)))
    place = [f.name for f in lines.schema][: len(PLACE)]
    some = lines.select(*place).sample(min(1.0, SAMPLE * n_ranges / max(1, n)), 7).limit(2 * SAMPLE * n_ranges).collect() if n_ranges > 1 else []
    keys = sorted(order(tuple(r)) for r in some)
    bounds = shared(spark, [keys[len(keys) * i // n_ranges] for i in range(1, n_ranges)] if keys else [])
    kind = lines.schema
    line_arrow = pa.struct(list(to_arrow_schema(kind)))
    block_kind = StructType([StructField("range", IntegerType()), *(StructField(f.name, f.dataType) for f in list(kind)[: len(PLACE)]), StructField("lines", ArrayType(kind))])

    def tuples(batch: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(c.to_pylist() for c in batch.columns)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the sorted runs, none of which spans two ranges."""
        at = load(bounds)
        held: list[tuple] = []
        where = None

        def block() -> pa.RecordBatch:
            packed = pa.array([[dict(zip(FIELDS, x)) for x in held]], pa.list_(line_arrow))
            return pa.RecordBatch.from_arrays([pa.array([where[1]], pa.int32()), *(pa.array([v], f.type) for v, f in zip(held[0][: len(PLACE)], line_arrow)), packed], names=["range", *PLACE, "lines"])

        for batch in slices(batches, 4096):
            for line in tuples(batch):
                now = line[3], bisect_left(at, order(line))
                if held and (now != where or len(held) == block_lines):
                    yield block()
                    held = []
                where = now
                held.append(line)
        if held:
            yield block()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come by range and first line; what lies before the next block's first line is complete."""
        open_: dict[int, list[tuple]] = {}
        blocks = ([tuple(line.values()) for line in x] for batch in slices(batches, window) for x in batch.column(batch.num_columns - 1).to_pylist())
        following = next(blocks, None)
        while following is not None:
            for _ in range(window):
                open_.setdefault(following[0][3], []).extend(following)
                if (following := next(blocks, None)) is None:
                    break
            upto = order(following[0]) if following is not None else None
            ready = {}
            for run, held in list(open_.items()):
                k = bisect_left(held, upto, key=order) if upto else len(held)
                if k:
                    ready[run], open_[run] = held[:k], held[k:]
                    if not open_[run]:
                        del open_[run]
            out = list(merge_slices(ready))
            for i in range(0, len(out), BATCH_ROWS * 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + BATCH_ROWS * 16]), line_arrow)], names=FIELDS)

    n_runs = lines.agg(F.max("run")).first()[0]
    sorted_runs = lines.repartition((n_runs or 0) + 1, "run").sortWithinPartitions("run", *place)
    blocks = staged(sorted_runs.mapInArrow(cut, block_kind), "runs")
    dealt = blocks.repartitionByRange(n_ranges, "range").sortWithinPartitions("range", *place)
    return dealt.mapInArrow(join, kind)


def history(pages: DataFrame, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Writes the archives of pages, reads them back, and gives their merged index."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, id_col, **columns)
    return merge(index(spark, path, isinstance(pages.schema[id_col].dataType, IntegralType)))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "time")
