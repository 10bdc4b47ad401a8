"""Paged scans of landed responses, as a data source for batches and streams (SC1, SC5, SC7-SC9, SC20; survey section 2.13).

A connector lands each response as one file:

    <root>/source=<name>/journal=<name>/<number>_<first day>_<last day>.json

with one item a line. Names are URL-quoted. Pages of a source are numbered from 0 over all its journals, in the
order in which they were asked for, whether the connector pages by cursor, offset or number, so that (source,
number) is a cursor for all of them. `land` writes such files.

    spark.read.format("landed_pages").load(root)
    spark.readStream.format("landed_pages").option("calls", 450).load(root)

Batches: filters on source and journal choose folders, and filters on indexed choose files by their days, before
any file is opened. A partition is a run of pages (option `run`) of one source.

Streams: the offset is the number of pages taken from each source. A batch takes at most `calls` pages, in turns from
all sources that have more. A page that has not landed stops its own source alone; when it comes, however late, the
source goes on from there. Spark keeps the offsets in the checkpoint of the query, writes them before a batch and
reads the same pages again if the batch did not end.

Files are reached through pyarrow's file systems, so the root may be in a store that they know.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source string, journal string, page long, place int, indexed string, item string"
NAME = re.compile(r"source=([^/]*)/journal=([^/]*)/(\d+)_([^_/]*)_([^_/]*)\.json$")
PAGE_ITEMS, RUN, CALLS = 100, 20, 450


@dataclass(frozen=True)
class Page:
    source: str
    journal: str
    number: int
    first: str
    last: str
    path: str


@dataclass
class Pages(InputPartition):
    """A run of pages that one task reads."""

    pages: tuple[Page, ...]


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root.rstrip("/"))


def folders(store: fs.FileSystem, at: str, key: str, wanted: set[str] | None) -> list[str]:
    """Folders <at>/<key>=..., only the wanted ones if these are told."""
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    names = [f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{key}=")]
    return sorted(n for n in names if wanted is None or unquote(n.rsplit("=", 1)[1]) in wanted)


def listed(root: str, sources: set[str] | None = None, journals: set[str] | None = None, since: str = "", until: str = "\U0010ffff") -> list[Page]:
    """Pages by source and number. Only folders that may hold wanted pages are listed; dates are those of the file names."""
    store, at = opened(root)
    out = []
    for source in folders(store, at, "source", sources):
        for journal in folders(store, source, "journal", journals):
            for f in store.get_file_info(fs.FileSelector(journal)):
                parts = NAME.search(f.path)
                if parts and parts[5] >= since and parts[4] <= until:
                    out.append(Page(unquote(parts[1]), unquote(parts[2]), int(parts[3]), parts[4], parts[5], f.path))
    return sorted(out, key=lambda p: (p.source, p.number))


def in_runs(pages: Iterable[Page], run: int) -> list[Pages]:
    by_source = defaultdict(list)
    for p in pages:
        by_source[p.source].append(p)
    return [Pages(tuple(ps[k : k + run])) for ps in by_source.values() for k in range(0, len(ps), run)]


def items_of(root: str, pages: Iterable[Page]) -> Iterator[pa.RecordBatch]:
    """The items of pages: a line is the day, a tab, and the item as it came."""
    store, _ = opened(root)
    for p in pages:
        with store.open_input_stream(p.path) as file:
            lines = [x.split("\t", 1) for x in file.read().decode().split("\n") if x]
        n = len(lines)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p.source] * n, pa.string()), pa.array([p.journal] * n, pa.string()), pa.array([p.number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([x[0] for x in lines], pa.string()), pa.array([x[1] for x in lines], pa.string())],
            names=["source", "journal", "page", "place", "indexed", "item"],
        )


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.run = options["path"], int(options.get("run", RUN))
        self.chosen: dict[str, set[str] | None] = {"source": None, "journal": None}
        self.since, self.until = "", "\U0010ffff"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on source and journal is settled here; days only choose files, so Spark filters items as well."""
        for f in filters:
            column, value = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, getattr(f, "value", None)
            if column in self.chosen and isinstance(f, (EqualTo, EqualNullSafe, In)) and value is not None:
                values = {v for v in value if v is not None} if isinstance(f, In) else {value}
                self.chosen[column] = values if self.chosen[column] is None else self.chosen[column] & values
                continue
            if column == "indexed" and isinstance(value, str):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.since = max(self.since, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.until = min(self.until, value)
            yield f

    def partitions(self) -> list[Pages]:
        return in_runs(listed(self.root, self.chosen["source"], self.chosen["journal"], self.since, self.until), self.run)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return items_of(self.root, partition.pages if partition else ())


def in_turns(landed: dict[str, int], taken: dict[str, int], calls: int) -> dict[str, int]:
    """How many pages of each source have been taken after at most `calls` more, one of each source that has more at a time."""
    out = {s: taken.get(s, 0) for s in sorted({*landed, *taken})}
    while calls > 0:
        open_ones = [s for s in out if out[s] < landed.get(s, 0)]
        if not open_ones:
            break
        each = max(1, min(calls // len(open_ones), min(landed[s] - out[s] for s in open_ones)))
        for s in open_ones[:calls]:
            out[s] += each
            calls -= each
    return out


def without_gaps(pages: list[Page]) -> dict[str, int]:
    """The number of pages of each source before the first that has not landed."""
    out: dict[str, int] = defaultdict(int)
    for p in pages:  # sorted
        if p.number == out[p.source]:
            out[p.source] += 1
    return dict(out)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.run, self.calls = options["path"], int(options.get("run", RUN)), int(options.get("calls", CALLS))
        self.at: dict[str, int] | None = None  # the end of the last batch planned; after a restart Spark plans that one again

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return in_turns(without_gaps(listed(self.root)), self.at or {}, self.calls)

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.at = end
        new = {s for s in end if end[s] > start.get(s, 0)}
        return in_runs([p for p in listed(self.root, new) if start.get(p.source, 0) <= p.number < end[p.source]] if new else [], self.run)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return items_of(self.root, partition.pages if partition else ())


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source known to it, and filters given to it."""
    spark.dataSource.register(LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_pages(spark: SparkSession, root: str, run: int = RUN) -> DataFrame:
    return registered(spark).read.format("landed_pages").option("run", run).load(root)


def stream_pages(spark: SparkSession, root: str, calls: int = CALLS, run: int = RUN) -> DataFrame:
    return registered(spark).readStream.format("landed_pages").option("calls", calls).option("run", run).load(root)


def land(items: DataFrame, root: str, size: int = PAGE_ITEMS) -> None:
    """Writes items (source, journal, indexed, item, place) as pages of `size`: what a connector does. place numbers the items
    of a journal in a source from 0; pages of a source are numbered journal by journal. A file appears under its name when it is whole."""
    pages = items.withColumn("local", F.floor(F.col("place") / size).cast("long"))
    counts = pages.groupBy("source", "journal").agg((F.max("local") + 1).alias("n"))
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY source ORDER BY journal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    numbered = pages.join(counts.select("source", "journal", before.alias("before")), ["source", "journal"])
    line = F.struct("place", F.concat_ws("\t", F.coalesce("indexed", F.lit("")), F.regexp_replace(F.coalesce("item", F.lit("")), "[\r\n]", " ")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")  # `size` items at most
    bodies = numbered.groupBy("source", "journal", (F.col("before") + F.col("local")).alias("page")).agg(F.min("indexed").alias("first"), F.max("indexed").alias("last"), body.alias("body"))
    bodies.foreachPartition(writer(root))


def writer(root: str) -> Callable[[Iterable[Row]], None]:
    """Writes pages one at a time. Rows come in batches by bytes (Arrow's are by rows, so that a task held 10,000 pages), and a page is one string."""

    def write(pages: Iterable[Row]) -> None:
        store, at = opened(root)
        for row in pages:
            folder = f"{at}/source={quote(row['source'] or '', safe='')}/journal={quote(row['journal'] or '', safe='')}"
            store.create_dir(folder, recursive=True)
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as file:
                file.write(row["body"].encode())
            store.move(hidden, f"{folder}/{row['page']:08d}_{row['first'] or ''}_{row['last'] or ''}.json")

    return write
