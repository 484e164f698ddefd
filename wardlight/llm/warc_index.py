"""WARC archives of pages, with capture runs merged into one globally ordered index.

Writer tasks put records into archive files and emit index lines as locally sorted runs.
The runs are cut at common key ranges; each range is merged from its runs by a loser tree,
so that URL key, time and id ascend within a range and from range to range.
"""

from __future__ import annotations

import gzip
import uuid
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardlight.llm.common import present, stage
from wardlight.sources.stage import shared_root

#: Production parameters.
REVISIT_BYTES = 100             # smaller payloads are always stored whole
RUN_BYTES = 256 << 20           # stored bytes per archive file and run, about
RANGE_LINES = 50_000            # index lines that one merging task holds, about
RANGES = 16                     # ranges of a small index
READ_TASKS = 20_000             # most tasks that read archives

INDEX = "run string, urlkey string, ts string, page_id long, offset long, length long, seq int, spot int"
RECORD = ("run string, seq int, page_id long, url string, ts string, record_type string, payload_bytes long, payload_digest string, "
          "refers_to long, payload binary")


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query, lower case, no fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = ",".join(reversed((parts.hostname or "").lower().split(".")))
        query = f"?{parts.query}" if parts.query else ""
        return f"{host}){parts.path or '/'}{query}".lower()
    except ValueError:
        return f"~{(url or '').lower()}"


def merge_runs(runs: list[list], key):
    """K-way merge by a loser tree: inner nodes keep the loser of their match, the root the winner.

    One comparison per level restores the tree after the winner is replaced. Equal keys come
    in the order of the runs.
    """
    k = len(runs)
    if not k:
        return
    spots = [0] * k

    def head(i: int):
        return (0, key(runs[i][spots[i]]), i) if spots[i] < len(runs[i]) else (1, i)

    heads = [head(i) for i in range(k)]
    tree = [-1] * k

    def settle(i: int) -> None:
        node, winner = (i + k) // 2, i
        while node:
            if tree[node] == -1:  # first match at this node: wait for the other side
                tree[node] = winner
                return
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner

    for i in range(k):
        settle(i)
    while heads[tree[0]][0] == 0:
        i = tree[0]
        yield runs[i][spots[i]]
        spots[i] += 1
        heads[i] = head(i)
        settle(i)


def classify(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Payload, digest, size, record type and refers_to of every page.

    Of equal payloads of at least REVISIT_BYTES the smallest id is the response. Copies are
    counted by digest with map-side minima; the digests go back by a join whose hot
    keys Spark can split.
    """
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.encode(present(html), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    firsts = stage(rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(
        F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-captures")
    joined = rows.join(firsts, "payload_digest", "left")
    revisit = F.col("least").isNotNull() & (F.coalesce(F.col("page_id") != F.col("least"), F.lit(True))) & (
        F.col("payload_bytes") >= REVISIT_BYTES)
    return joined.select(
        "page_id", "url", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("least")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))


def capture_time(page_id: Column) -> Column:
    """14-digit time of a capture; tables without one count seconds from the year 2000 by id.

    Without a time zone, so the session's does not matter.
    """
    seconds = (F.coalesce(page_id, F.lit(0)) % 700000000).cast("int")
    when = F.timestamp_add("SECOND", seconds, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return F.translate(when.cast("string"), "-: ", "")


def _record(r) -> bytes:
    when = datetime.strptime(r.ts, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    body = b"" if r.payload is None else r.payload
    page = "" if pd.isna(r.page_id) else int(r.page_id)
    head = ["WARC/1.1", f"WARC-Type: {r.record_type}", f"WARC-Record-ID: <urn:page:{page}>",
            f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {(r.url or '').encode('unicode_escape').decode()}",
            f"WARC-Payload-Digest: sha256:{r.payload_digest}", f"WARC-Payload-Length: {int(r.payload_bytes)}"]
    if r.record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{int(r.refers_to)}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if r.url is None:
        head.append("WARC-Target-Missing: true")
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write record members into archive files under `folder`; returns the stored index runs.

    A task rolls to a new file after RUN_BYTES of records and sorts that file's index lines: one
    run. File names are unique to the attempt and only a committed attempt's lines name
    them, so a file left by a lost executor is never read.
    """

    def write(batches):
        lines, size, out, name = [], 0, None, ""

        def run():
            lines.sort(key=lambda x: (x[1], x[2], x[3] is None, x[3] or 0))
            return pd.DataFrame([(*x, i) for i, x in enumerate(lines)], columns=[
                "run", "urlkey", "ts", "page_id", "offset", "length", "seq", "spot"]).astype({"page_id": "Int64"})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = store.open_output_stream(f"{root}/{name}", compression=None), 0
                member = gzip.compress(_record(r), 6, mtime=0)
                out.write(member)
                page = None if pd.isna(r.page_id) else int(r.page_id)
                lines.append((name, url_key(r.url), r.ts, page, at, len(member), len(lines)))
                at += len(member)
                size += len(member)
                if size >= RUN_BYTES:
                    out.close()
                    yield run()
                    lines, size, out = [], 0, None
        if out is not None:
            out.close()
            yield run()

    return stage(records.mapInPandas(write, INDEX), "capture-runs")


def merge_index(runs: DataFrame) -> DataFrame:
    """All index lines in global order: (range, place) ascend with (urlkey, ts, page_id).

    Ranges are cut on the whole order, so a hot URL, and even repeats of one capture, span ranges,
    and a task holds about RANGE_LINES lines at any table size. A range's slice of every run is put
    back in run order and merged by the loser tree.
    """
    ranges = max(RANGES, -(-runs.count() // RANGE_LINES))
    ranged = runs.repartitionByRange(
        ranges, "urlkey", "ts", F.col("page_id").asc_nulls_last(), "run", "spot").sortWithinPartitions("run", "spot")

    def merge(batches):
        slices: dict[str, list] = {}
        for b in batches:
            for x in b.itertuples(index=False):
                slices.setdefault(x.run, []).append(x)
        key = lambda x: (x.urlkey, x.ts, bool(pd.isna(x.page_id)), 0 if pd.isna(x.page_id) else int(x.page_id))
        block = []
        for place, x in enumerate(merge_runs(list(slices.values()), key)):
            block.append((*x, place))
            if len(block) == 10000:
                yield frame(block)
                block = []
        if block:
            yield frame(block)

    def frame(block):
        return pd.DataFrame(block, columns=["run", "urlkey", "ts", "page_id", "offset", "length", "seq", "spot", "place"]).astype({"page_id": "Int64"})

    return ranged.mapInPandas(merge, f"{INDEX}, place int").withColumn("range", F.spark_partition_id())


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records of the archives that `index` names, read back in whole files.

    One row per record: payload_bytes and payload_digest are computed from the stored
    payload; a revisit has the ones that its header states.
    """
    from hashlib import sha256

    def read(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b["run"]:
                rows, size, seq = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    while line := f.readline():
                        if not line.startswith(b"WARC/"):
                            continue
                        head = {}
                        while (line := f.readline().rstrip(b"\r\n")):
                            k, _, v = line.decode().partition(": ")
                            head[k] = v
                        body = f.read(int(head["Content-Length"]))
                        page = head["WARC-Record-ID"][len("<urn:page:"):-1]
                        again = head["WARC-Type"] == "revisit"
                        url = None if "WARC-Target-Missing" in head else head["WARC-Target-URI"].encode().decode("unicode_escape")
                        ts = "".join(c for c in head["WARC-Date"] if c.isdigit())
                        digest = head["WARC-Payload-Digest"][len("sha256:"):] if again else sha256(body).hexdigest()
                        rows.append((name, seq, int(page) if page else None, url, ts, head["WARC-Type"],
                                     int(head["WARC-Payload-Length"]) if again else len(body), digest,
                                     int(head["WARC-Refers-To"][len("<urn:page:"):-1]) if again else None, None if again else body))
                        size += len(body)
                        seq += 1
                        if size >= 4 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows):
        names = [c.split()[0] for c in RECORD.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    # A list of names is tiny, so adaptive execution would read all archives in one task.
    names = index.select("run").distinct()
    return names.repartition(min(READ_TASKS, max(1, names.count())), "run").mapInPandas(read, RECORD)


def _with_scheme(spark: SparkSession, path: str) -> str:
    """`path` on the file system that Spark itself writes it to."""
    if "://" in path or path.startswith("file:"):
        return path
    found = urlsplit(stage(spark.range(1), "file-system").inputFiles()[0])
    return f"{found.scheme}://{found.netloc}{path}"


def archive(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame, str]:
    """(merged index, records read back, folder) of the archives written for `pages`.

    Null html is an empty payload; a null url sorts under an empty key; null ids are written
    without a number and come last in their URL's history; repeated rows give records of their own
    (repeats of one id refer to it only if ids differ). Very long payloads are one record. An
    empty table writes nothing. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = f"{_with_scheme(spark, shared_root(spark))}/warc-{uuid.uuid4().hex}"
    records = classify(pages, page, url, html).withColumn("ts", capture_time(F.col("page_id")))
    runs = write_archives(records.select("page_id", "url", "ts", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"), folder)
    return merge_index(runs), read_archives(runs, folder), folder


def capture_history(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per record in the archives, with its place in the globally ordered index.

    page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, capture_time and
    place (from 1, by urlkey, capture_time and page_id, nulls last).
    """
    index, records, _ = archive(pages, page, url, html)
    order = stage(index.select("run", "seq", "urlkey", "ts", "range", "place"), "capture-index")
    sizes = order.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row per range
    placed = order.join(before, "range").select(
        "run", "seq", "urlkey", F.col("ts").alias("capture_time"), (F.col("before") + F.col("place") + 1).alias("place"))
    return records.drop("payload", "url", "ts").join(placed, ["run", "seq"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "capture_time", "place")
