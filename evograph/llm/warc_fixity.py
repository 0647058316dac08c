"""WARC files and their fixity audit by Merkle trees.

Pages become WARC/1.0 response records and get a place in files of a fixed number of
records by a distributed sort: rows are range-partitioned, numbered inside their
partition and shifted by the counts of the partitions before. Each file's tree has the
SHA-256 of its records as leaves; an inner node hashes the ordered offset range that it
covers and its children. The roots of the files are the leaves of a tree over the
collection. Two replicas are compared by the collection's root; below differing nodes
alone the next level is compared, down to the files that differ; only of those are the
levels of both file trees read, and only below differing nodes the leaves.

A record at a differing place is ``moved`` where its bytes stand elsewhere in the same
file of the other replica, else ``corrupt`` where its record id stands there with other
bytes, else ``lost``; records that only the other replica has are ``added``.

Defined cases: null bodies are empty ones; a page without a url is its own target, a
null id is written as ``none``; line ends in urls are percent-encoded; null ids come
last; equal ids are ordered by the record's hash, and equal records are interchangeable;
an empty table has no files; a file that one replica lacks is lost or added record by
record; extra columns are not looked at; bodies of any length are hashed whole.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, let, sized_join, stored

RECORDS = 512
FAN = 8
#: WARC-Date of records whose time of capture is not known.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """Text of a WARC record, without the two line ends that close it: an HTTP response with the page."""
    payload = F.coalesce(body, F.lit(""))
    name = F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))
    target = F.replace(F.replace(F.coalesce(F.nullif(url, F.lit("")), name), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    size = lambda c: F.octet_length(c).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size(payload), F.lit("\r\n\r\n"), payload)
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size(http), F.lit("\r\n\r\n"), http,
    )


def placed(leaves: DataFrame, order: list[str], records: int = RECORDS) -> DataFrame:
    """Adds file_id and record_no by the global order; rows that are equal in ``order`` are dealt over partitions too."""
    wide = leaves.withColumn("nth", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_last() for c in (*order, "nth")]
    runs = wide.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("nth")
    runs = stored(runs.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "sorted-records")
    sizes = runs.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    index = F.col("before") + F.col("at")
    return runs.join(before, "part").select("*", F.floor(index / records).alias("file_id"), (index % records).cast("int").alias("record_no")).drop("part", "at", "before")


def trees(leaves: DataFrame, records: int = RECORDS, fan: int = FAN) -> DataFrame:
    """file_id, root and levels (array of levels of hashes, leaves first) from (file_id, record_no, offset, length, sha256)."""
    spans = F.sort_array(F.collect_list(F.struct("record_no", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "sha256")))
    files = leaves.groupBy("file_id").agg(spans.alias("spans"))  # a file has about ``records`` leaves
    level = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["sha256"].alias("sha256")))
    files = files.select("file_id", level.alias("l0"))
    names, size = ["l0"], records
    while size > 1:
        size = -(-size // fan)
        below, name = F.col(names[-1]), f"l{len(names)}"

        def node(j: Column, below: Column = below) -> Column:
            own = F.slice(below, j * fan + 1, fan)
            return let(own, lambda c: F.struct(F.get(c, F.lit(0))["start"].alias("start"), F.element_at(c, -1)["end"].alias("end"), F.sha2(F.concat_ws(
                "|", F.get(c, F.lit(0))["start"].cast("string"), F.element_at(c, -1)["end"].cast("string"), F.array_join(F.transform(c, lambda x: x["sha256"]), "")), 256).alias("sha256")))

        over = F.sequence(F.lit(0), F.ceil(F.size(below) / fan).cast("int") - 1)
        files = files.withColumn(name, F.transform(over, lambda j: node(j)))  # noqa: B023
        names.append(name)
    levels = F.array(*[F.transform(n, lambda x: x["sha256"]) for n in names])
    return files.select("file_id", F.sha2(F.array_join(F.element_at(levels, -1), ""), 256).alias("root"), levels.alias("levels"))


def collection(files: DataFrame, depth: int, fan: int = FAN) -> list[DataFrame]:
    """Levels (node, sha256) over the roots of files, from the files to one node after ``depth`` steps."""
    out = [files.select(F.col("file_id").alias("node"), F.col("root").alias("sha256"))]
    for _ in range(depth):
        up = out[-1].groupBy(F.floor(F.col("node") / fan).alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "sha256"))).alias("c"))  # at most ``fan``
        named = F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["sha256"]))
        out.append(stored(up.select(F.col("up").alias("node"), F.sha2(F.array_join(named, "|"), 256).alias("sha256")), "collection"))
    return out


def differing_files(left: DataFrame, right: DataFrame, fan: int = FAN) -> DataFrame:
    """file_id of the files whose roots differ, or that one side lacks: from the collection's root down, below differing nodes only."""
    top = [r for r in (df.agg(F.max("file_id")).first()[0] for df in (left, right)) if r is not None]
    depth = 0
    while top and fan**depth <= max(top):
        depth += 1
    a, b = collection(left, depth, fan), collection(right, depth, fan)
    bad = None
    for x, y in zip(reversed(a), reversed(b)):
        if bad is not None:
            x, y = (sized_join(df, bad.withColumnRenamed("node", "up"), F.floor(F.col("node") / fan) == F.col("up"), "left_semi") for df in (x, y))
        both = x.join(y.select("node", F.col("sha256").alias("other")), "node", "full")
        before, bad = bad, stored(both.where(~F.col("sha256").eqNullSafe(F.col("other"))).select("node"), "differing")
        forget(before)
        if bad.isEmpty():
            break
    forget(*a[1:], *b[1:])
    return bad.select(F.col("node").alias("file_id"))


def differing_places(left: DataFrame, right: DataFrame, fan: int = FAN) -> DataFrame:
    """file_id and record_no where the leaves of two files differ or one has none, by descent of their trees."""
    a, b = left.select("file_id", F.col("levels").alias("a")), right.select("file_id", F.col("levels").alias("b"))
    depth = F.greatest(F.size("a"), F.size("b"))
    width = F.greatest(*[F.when(F.col(c).isNotNull(), F.size(F.element_at(c, -1))).otherwise(0) for c in "ab"])

    def at(levels: Column, level: Column, j: Column) -> Column:
        return F.get(F.get(levels, level), j)

    def children(bad: Column, level: Column) -> Column:
        """Differing nodes of ``level`` below the differing nodes of the level above."""
        some = F.flatten(F.transform(bad, lambda j: F.sequence(j * fan, j * fan + fan - 1)))
        return F.filter(some, lambda j: ~at(F.col("a"), level, j).eqNullSafe(at(F.col("b"), level, j)))

    both = a.join(b, "file_id", "full")
    top = F.filter(F.sequence(F.lit(0), width - 1), lambda j: ~at(F.col("a"), depth - 1, j).eqNullSafe(at(F.col("b"), depth - 1, j)))
    steps = F.when(depth <= 1, F.array().cast("array<int>")).otherwise(F.reverse(F.sequence(F.lit(0), depth - 2)))
    bad = F.aggregate(steps, top, lambda found, level: F.when(F.size(found) == 0, found).otherwise(children(found, level)))
    return both.select("file_id", F.explode(bad).alias("record_no"))


def audit(left: DataFrame, right: DataFrame, records: int = RECORDS, fan: int = FAN) -> DataFrame:
    """What became of the records of ``left`` in ``right``, two tables (record_id, file_id, record_no, offset, length, sha256).

    The columns of ``left``, root and other_root of the file, and status (ok, moved,
    corrupt or lost) for every record of ``left``; added for those that only ``right`` has.
    """
    columns = ["record_id", "file_id", "record_no", "offset", "length", "sha256"]
    left, right = left.select(*columns), right.select(*columns)
    a, b = stored(trees(left, records, fan), "trees"), stored(trees(right, records, fan), "replica-trees")
    files = stored(differing_files(a.select("file_id", "root"), b.select("file_id", "root"), fan), "differing-files")
    some = [sized_join(t.select("file_id", "levels"), files, "file_id", "left_semi") for t in (a, b)]
    places = stored(differing_places(*some, fan), "differing-places")
    mine, theirs = (stored(sized_join(t, places, ["file_id", "record_no"], "left_semi"), "differing-records") for t in (left, right))
    seen = lambda df, c, name: df.select("file_id", F.col(c)).distinct().withColumn(name, F.lit(True))

    def judged(own: DataFrame, other: DataFrame, alone: str) -> DataFrame:
        out = sized_join(sized_join(own, seen(other, "sha256", "same"), ["file_id", "sha256"]), seen(other, "record_id", "named"), ["file_id", "record_id"])
        return out.select(*columns, F.when(F.col("same"), "moved").when(F.col("named"), "corrupt").otherwise(alone).alias("status"))

    known = stored(judged(mine, theirs, "lost").select("file_id", "record_no", "status"), "judged")
    added = judged(theirs, mine, "added").where("status = 'added'")
    out = sized_join(left, known, ["file_id", "record_no"]).select(*columns, F.coalesce("status", F.lit("ok")).alias("status")).unionByName(added)
    roots = a.select("file_id", "root").join(b.select("file_id", F.col("root").alias("other_root")), "file_id", "full")
    return sized_join(out, roots, "file_id").select(*columns, "root", "other_root", "status")


def with_offsets(leaves: DataFrame, closing: int = 4) -> DataFrame:
    """Adds the byte offset of each record in its file; ``closing`` bytes end a record."""
    order = Window.partitionBy("file_id").orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)  # a bounded number of rows
    return leaves.withColumn("offset", F.coalesce(F.sum(F.col("length") + closing).over(order), F.lit(0)))


def write_warc(records: DataFrame, path: str, files: int) -> None:
    """Writes (file_id, record_no, text) as compressed WARC files, one folder for each file_id; a task writes a few of about ``files``."""
    dealt = records.repartition(max(1, min(20_000, -(-files // 4))), "file_id").sortWithinPartitions("file_id", "record_no")
    dealt.select("file_id", F.col("text").alias("value")).write.partitionBy("file_id").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """record_id, file_id, record_no, offset, length, sha256, page_id, url and body (null unless ``bodies``) of the records of files that write_warc made; offsets count bytes of the files unpacked."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, packed in zip(batch["file_id"], batch["content"]):
                data, rows, at = gzip.decompress(packed), [], 0
                while at < len(data):
                    head = data.index(b"\r\n\r\n", at) + 4
                    fields = dict(x.split(": ", 1) for x in data[at:head].decode().split("\r\n")[1:] if ": " in x)
                    end = head + int(fields["Content-Length"])
                    name, url = fields["WARC-Record-ID"][1:-1], fields["WARC-Target-URI"]
                    page = name.removeprefix("urn:page:")
                    body = data[data.index(b"\r\n\r\n", head) + 4 : end].decode("utf-8", "replace") if bodies else None
                    rows.append((name, file_id, len(rows), at, end - at, hashlib.sha256(data[at:end]).hexdigest(), None if page == "none" else page, None if url == name else url, body))
                    at = end + 4
                yield pd.DataFrame(rows, columns=["record_id", "file_id", "record_no", "offset", "length", "sha256", "page_id", "url", "body"])

    schema = "record_id string, file_id long, record_no int, offset long, length long, sha256 string, page_id string, url string, body string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select(F.regexp_extract("path", "file_id=([0-9]+)", 1).cast("long").alias("file_id"), "content").mapInPandas(parse, schema)


def manifest(pages: DataFrame, records: int = RECORDS) -> DataFrame:
    """page_id, record_id, file_id, record_no, offset, length, sha256: the place of each page's record, from hashes alone."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    leaves = pages.select("page_id", let(text, lambda t: F.struct(F.sha2(t, 256).alias("sha256"), F.octet_length(t).cast("long").alias("length"))).alias("r"))
    spots = placed(leaves.select("page_id", "r.sha256", "r.length"), ["page_id", "sha256"], records)
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    return stored(with_offsets(spots).select("page_id", name.alias("record_id"), "file_id", "record_no", "offset", "length", "sha256"), "manifest")


def in_place(pages: DataFrame, spots: DataFrame, body: Column) -> DataFrame:
    """file_id, record_no and text of the pages' records at the places of ``spots`` (a manifest of them), their bodies replaced by ``body``."""
    sha = F.sha2(record(F.col("page_id"), F.col("url"), F.col("html")), 256)
    texts = pages.select(sha.alias("sha256"), record(F.col("page_id"), F.col("url"), body).alias("text"))
    repeated = stored(spots.groupBy("sha256").count().where("count > 1").select("sha256"), "repeated-records")
    at = spots.select("sha256", "file_id", "record_no")
    if repeated.isEmpty():
        return sized_join(texts, at, "sha256", "inner").drop("sha256")
    # equal records: one text for all their places
    once = sized_join(sized_join(texts, repeated, "sha256", "left_anti"), at, "sha256", "inner")
    again = sized_join(sized_join(texts, repeated, "sha256", "left_semi").dropDuplicates(["sha256"]), at, "sha256", "inner")
    return once.unionByName(again).drop("sha256")


def audit_pages(pages: DataFrame, replica_body: Column, path: str, records: int = RECORDS, fan: int = FAN) -> DataFrame:
    """Writes the pages, with bodies ``replica_body``, as WARC files under ``path``, reads them and audits them against the pages' manifest.

    page_id, file_id, record_no, offset, length, sha256, root_sha256, replica_root_sha256, status and corrupt for every record.
    """
    spots = manifest(pages.select("page_id", "url", "html"), records)
    write_warc(in_place(pages, spots, replica_body), path, (spots.agg(F.max("file_id")).first()[0] or 0) + 1)
    files = stored(read_warc(pages.sparkSession, path, bodies=False).drop("page_id", "url", "body"), "replica-records") if not spots.isEmpty() else spots.drop("page_id")
    found = audit(spots, files, records, fan)
    page = F.regexp_extract("record_id", "^urn:page:(-?[0-9]+)$", 1)
    return found.select(
        F.when(page != "", page.cast("long")).alias("page_id"), "file_id", "record_no", "offset", "length", "sha256",
        F.col("root").alias("root_sha256"), F.col("other_root").alias("replica_root_sha256"), "status", (F.col("status") != "ok").alias("corrupt"),
    )
