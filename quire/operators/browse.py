"""The interactive read path: serving view, filters, order, pages, facets, peers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.dates_urls import doi_url, year_of
from quire.functions.names import joined
from quire.functions.text import without_article
from quire.schema import filled, is_blank
from quire.storage import cut

TEXT_COLUMNS = ("title", "author", "reviewer", "journal", "date")


def serving_view(catalog: DataFrame) -> DataFrame:
    """The 12 columns that the browser shows."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return catalog.select(
        "id",
        text("book_title").alias("title"),
        joined(F.col("book_author_first_name"), F.col("book_author_last_name")).alias("author"),
        joined(F.col("reviewer_first_name"), F.col("reviewer_last_name")).alias("reviewer"),
        text("publication_source").alias("journal"),
        text("publication_date").alias("date"),
        F.coalesce(filled("review_link"), doi_url(text("doi"))).alias("link"),
        text("review_summary").alias("summary"),
        text("access_type").alias("access"),
        F.coalesce(filled("entry_type"), F.lit("review")).alias("type"),
        text("symposium_group").alias("symposium_group"),
        text("subfield_primary").alias("subfield"),
        text("subfield_secondary").alias("subfield2"),
    )


@dataclass(frozen=True)
class CatalogQuery:
    """A browse request. A selection of None means all, and an empty one selects nothing."""

    search: str = ""
    title: str = ""
    author: str = ""
    reviewer: str = ""
    journals: tuple[str, ...] | None = None
    subfields: tuple[str, ...] | None = None
    access: str = ""
    type: str = ""
    year_from: int | None = None
    year_to: int | None = None
    sort: str = "date"
    descending: bool = True
    page: int = 1
    per_page: int = 25
    names: dict[str, str] = field(default_factory=dict, compare=False, hash=False)  # subfield -> display name

    def predicate(self) -> Column:
        """Only filters that are set take part, so that what remains can be pushed down."""
        tests: list[Column] = []
        if self.search:
            shown = F.col("subfield")
            if self.names:
                shown = F.coalesce(F.create_map(*(F.lit(x) for kv in self.names.items() for x in kv))[F.col("subfield")], F.lit(""))
            tests.append(F.lower(F.concat_ws(" ", *TEXT_COLUMNS, shown)).contains(self.search.lower()))
        tests += [F.lower(c).contains(value.lower()) for c, value in (("title", self.title), ("author", self.author), ("reviewer", self.reviewer)) if value]
        if self.journals is not None:
            tests.append(F.col("journal").isin(*self.journals) if self.journals else F.lit(False))
        if self.subfields is not None:
            tests.append(F.col("subfield").isin(*self.subfields) | F.col("subfield2").isin(*self.subfields) if self.subfields else F.lit(False))
        if self.access:
            tests.append(F.lower("access") == self.access.lower())
        if self.type:
            tests.append(F.coalesce(filled("type"), F.lit("review")) == self.type)
        if self.year_from is not None:
            tests.append(year_of(F.col("date")) >= self.year_from)
        if self.year_to is not None:
            tests.append(year_of(F.col("date")) <= self.year_to)
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    def active_filters(self) -> int:
        """P12"""
        return sum((bool(self.search), bool(self.title), bool(self.author), bool(self.reviewer), self.journals is not None, self.subfields is not None, bool(self.access), bool(self.type), self.year_from is not None or self.year_to is not None))

    def order(self) -> list[Column]:
        """By the lower-cased column, journals without `The `, then by id (O1, O2)."""
        key = without_article(F.col("journal"), ignore_case=True) if self.sort == "journal" else F.col(self.sort)
        key = F.lower(key)
        return [key.desc() if self.descending else key.asc(), F.col("id")]

    def run(self, view: DataFrame) -> DataFrame:
        """One page (O3); the page is not clamped, since that needs a count: see page_count()."""
        return view.where(self.predicate()).orderBy(*self.order()).offset((max(self.page, 1) - 1) * self.per_page).limit(self.per_page)

    def clamped(self, view: DataFrame) -> CatalogQuery:
        last = max(1, -(-view.where(self.predicate()).count() // self.per_page))
        return CatalogQuery(**{**self.__dict__, "page": min(max(self.page, 1), last)})

    def to_params(self) -> str:
        """Lists are repeated keys, so names may hold commas; an empty selection is written too."""
        out: list[tuple[str, str]] = []
        for name in ("search", "title", "author", "reviewer", "access", "type", "year_from", "year_to", "sort", "page", "per_page"):
            value = getattr(self, name)
            if value not in ("", None) and value != getattr(CatalogQuery, name):
                out.append((name, str(value)))
        if not self.descending:
            out.append(("order", "asc"))
        for name in ("journals", "subfields"):
            chosen = getattr(self, name)
            if chosen is not None:
                out += [(name, x) for x in chosen] or [(name, "")]
        return urlencode(out)

    @classmethod
    def from_params(cls, text: str, known: dict[str, set[str]] | None = None) -> CatalogQuery:
        """Names that are not known are dropped silently."""
        got: dict = {}
        for name, value in parse_qsl(text.lstrip("#?"), keep_blank_values=True):
            if name in ("journals", "subfields"):
                kept = got.get(name, ())
                got[name] = kept + ((value,) if value and (not known or value in known.get(name, {value})) else ())
            elif name in ("year_from", "year_to", "page", "per_page"):
                if value.isdigit():
                    got[name] = int(value)
            elif name == "order":
                got["descending"] = value != "asc"
            elif name in ("search", "title", "author", "reviewer", "access", "type", "sort"):
                got[name] = value
        return cls(**got)


def page_strip(page: int, pages: int) -> list[int | None]:
    """Page numbers to show, None for an ellipsis."""
    near = sorted({1, pages, *(p for p in range(page - 2, page + 3) if 1 <= p <= pages)})
    out: list[int | None] = []
    for a, b in zip([0, *near], near):
        out += ([None] if a and b > a + 1 else []) + [b]
    return out


def facet(view: DataFrame, column: str) -> DataFrame:
    """Counts of non-blank values, largest first, ties by name (A1, A5)."""
    return view.where(~is_blank(column)).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def facets(view: DataFrame, columns: tuple[str, ...] = ("journal", "subfield", "type")) -> DataFrame:
    """All facets in one pass: (facet, value, n)."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns))).alias("f")
    return view.select(each).select("f.facet", "f.value").where(~is_blank("value")).groupBy("facet", "value").agg(F.count("*").alias("n")).orderBy("facet", F.desc("n"), "value")


def journal_names(view: DataFrame) -> DataFrame:
    """Distinct names in the order without `The ` (A2)."""
    return view.select("journal").where(~is_blank("journal")).distinct().orderBy(without_article(F.col("journal")), "journal")


def year_bounds(view: DataFrame, low: int = 2000, high: int = 2026) -> DataFrame:
    """A3"""
    y = year_of(F.col("date"))
    return view.agg(F.coalesce(F.min(y), F.lit(low)).alias("year_min"), F.coalesce(F.max(y), F.lit(high)).alias("year_max"))


#: Rows of a block, and pairs that a task makes in about a second.
BLOCK, PAIRS_A_TASK = 1_000, 5_000_000


def paired(rows: DataFrame, group: str, key: str, asked: Column | None = None) -> DataFrame:
    """(group, key, peer) for rows of equal groups and different keys. asked: which rows' peers, all if None.

    The answer grows with the square of a group, so each group is cut into blocks, and pairs of blocks, not groups, are dealt
    over tasks whose number follows the pairs. Rows are checkpointed, since both sides must find the same places.
    """
    asks = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    a = cut(rows.where(F.col(group).isNotNull()).select(group, key).withColumns({"asks": asks, "place": F.monotonically_increasing_id()}))
    sizes = a.groupBy(group).agg(F.count("*").alias("n"), F.count_if("asks").alias("n_asks")).where("n_asks > 0")
    tasks = max(1, math.ceil((sizes.agg(F.sum(F.col("n").cast("double") * F.col("n_asks"))).first()[0] or 0) / PAIRS_A_TASK))
    sized = a.join(sizes.select(group, F.ceil(F.col("n") / BLOCK).alias("peer_blocks"), F.ceil(F.col("n_asks") / BLOCK).alias("asking_blocks")), group)
    own, every = (lambda c: F.pmod(F.xxhash64("place"), F.col(c))), (lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)))
    of = sized.where("asks").select(group, key, own("asking_blocks").alias("i"), every("peer_blocks").alias("j")).repartition(tasks, group, "i", "j")
    among = sized.select(group, F.col(key).alias("peer"), every("asking_blocks").alias("i"), own("peer_blocks").alias("j")).repartition(tasks, group, "i", "j")
    return of.join(among, [group, "i", "j"]).where(F.col(key) != F.col("peer")).select(group, key, "peer")


def peers(view: DataFrame, group: str = "symposium_group", key: str = "id", asked: Column | None = None) -> DataFrame:
    """(key, peer) for rows that share a group that isn't blank (J11). asked: whose peers, all if None."""
    return paired(view.where(~is_blank(group)), group, key, asked).select(key, "peer")


def members(view: DataFrame, group: str = "symposium_group", key: str = "id") -> DataFrame:
    """(group, key, size of the group): as peers() for all rows, in as many rows as there are; counted before it is joined."""
    rows = view.where(~is_blank(group)).select(group, key)
    return rows.join(rows.groupBy(group).agg(F.count("*").alias("size")), group)


def coverage(catalog: DataFrame) -> DataFrame:
    """Totals and whole percentages."""
    share = lambda a: F.when(F.count("*") > 0, F.expr(f"{a} * 100 div count(*)")).otherwise(F.lit(0).cast("long"))
    classified, titled, authored = "count_if(subfield_primary <> '')", "count_if(book_title <> '')", "count_if(book_author_last_name <> '')"
    return catalog.agg(
        F.count("*").alias("total"), F.expr(classified).alias("classified"), F.expr(f"count(*) - {classified}").alias("unclassified"), share(classified).alias("classified_pct"),
        F.expr(titled).alias("with_title"), F.expr(authored).alias("with_author"), F.expr("count(DISTINCT nullif(publication_source, ''))").alias("journals"),
        F.expr("count_if(length(book_title) > 200)").alias("long_titles"), F.expr("count(DISTINCT nullif(symposium_group, ''))").alias("symposia"),
    )


def top_unclassified(catalog: DataFrame, n: int = 20) -> DataFrame:
    """A6"""
    return catalog.where(is_blank("subfield_primary")).groupBy("publication_source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "publication_source").limit(n)


def newest_unclassified(catalog: DataFrame, n: int = 200) -> DataFrame:
    """O5"""
    return catalog.where(is_blank("subfield_primary")).orderBy(F.desc("id")).limit(n)


def first_n(view: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order, ties by id; a run's limit."""
    return view.orderBy(*order, "id").limit(n)


def choices(names: dict[str, str]) -> list[tuple[str, str]]:
    """(value, display name) by display name, for a filter's menu."""
    return sorted(names.items(), key=lambda kv: (kv[1], kv[0]))
