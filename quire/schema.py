"""The catalog's schema and its notion of a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, WHOLE, TIME = T.StringType(), T.IntegerType(), T.TimestampType()


def record(**fields: T.DataType) -> T.StructType:
    """Fields in order; `__` in a name stands for `-`."""
    return T.StructType([T.StructField(k.replace("__", "-"), v) for k, v in fields.items()])


def many(item: T.DataType) -> T.ArrayType:
    return T.ArrayType(item)


CATALOG = record(
    id=T.LongType(), book_title=TEXT, book_author_first_name=TEXT, book_author_last_name=TEXT, reviewer_first_name=TEXT, reviewer_last_name=TEXT,
    publication_source=TEXT, publication_date=TEXT, review_link=TEXT, review_summary=TEXT, access_type=TEXT, doi=TEXT, entry_type=TEXT, symposium_group=TEXT,
    created_at=TIME, subfield_primary=TEXT, subfield_secondary=TEXT,
)
DATE_PARTS = record(date__parts=many(many(WHOLE)))
WORK_ITEM = record(
    title=many(TEXT), subtitle=many(TEXT), DOI=TEXT, container__title=many(TEXT), author=many(record(given=TEXT, family=TEXT)), issued=DATE_PARTS, published__print=DATE_PARTS,
    published__online=DATE_PARTS, URL=TEXT, abstract=TEXT, license=many(record(URL=TEXT)), volume=TEXT, issue=TEXT, page=TEXT, type=TEXT, indexed=TIME,
)
PUBLISHER_RECORD = record(genre=many(TEXT), title=TEXT, doi=TEXT, url=many(record(format=TEXT, value=TEXT)), publicationDate=TEXT, creators=many(record(creator=TEXT)), openaccess=TEXT)
POST = record(id=T.LongType(), date=TEXT, slug=TEXT, link=TEXT, content=record(rendered=TEXT))
NEWS_REVIEW = record(webTitle=TEXT, webUrl=TEXT, webPublicationDate=TEXT, fields=record(byline=TEXT, trailText=TEXT))
NEWS_ARTICLE = record(headline=record(main=TEXT), web_url=TEXT, keywords=many(record(name=TEXT, value=TEXT)), abstract=TEXT, snippet=TEXT, byline=record(original=TEXT), pub_date=TEXT, firstPublished=TEXT)
WORK_LOOKUP = record(title=TEXT, publication_year=WHOLE, authorships=many(record(author=record(display_name=TEXT))))
BOOK_LOOKUP = record(title=TEXT, author_name=many(TEXT), first_publish_year=WHOLE)


def is_blank(c: Column | str) -> Column:
    """Null and '' both mean missing."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def filled(c: Column | str) -> Column:
    """The value, or null where it is blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def conform(df: DataFrame, schema: T.StructType = CATALOG) -> DataFrame:
    """Additive schema evolution: the schema's columns in order, absent ones as nulls; others are dropped."""
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


#: Headings of exported records and the catalog's columns.
HEADINGS = {
    "Book Title": "book_title", "Book Author First Name": "book_author_first_name", "Book Author Last Name": "book_author_last_name", "Reviewer First Name": "reviewer_first_name", "Reviewer Last Name": "reviewer_last_name",
    "Publication Source": "publication_source", "Publication Date": "publication_date", "Review Link": "review_link", "Review Summary": "review_summary", "Access Type": "access_type", "DOI": "doi",
}


def from_headings(df: DataFrame) -> DataFrame:
    """Exported records under the catalog's column names (P2); absent texts become ''."""
    named = df.withColumnsRenamed({k: v for k, v in HEADINGS.items() if k in df.columns})
    out = conform(named)
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in (*HEADINGS.values(), "entry_type", "symposium_group")})


def titled(df: DataFrame) -> DataFrame:
    """Rows that may be written: those with a title."""
    return df.where(~is_blank("book_title"))
