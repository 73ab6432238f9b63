"""Discovery of published files: links of web pages, and catalogue responses landed as JSON."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Patterns that tell data files and pages that lead to them.
DATA_FILE = r"(?i)\.(csv|xlsx|xls)(\?|#|$)"
OTHER_FILE = r"(?i)\.(pdf|html|htm|aspx|php|doc|docx|pptx|png|jpg|jpeg|gif|svg|zip)(\?|#|$)"
PUBLICATION = r"(?i)gov\.uk/government/publications"
SPENDING = r"(?i)spend|expenditure|payment|supplier|invoice|over.500|over.250|transparency"
MONTH = r"(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
SUB_PAGE = r"(?i)download|current|archive|20|\d{4}"
FORMATS = ("csv", "xlsx", "xls")


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href")
            self.inside = href is not None
            if self.inside:
                self.found.append([href, ""])

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found[-1][1] += data


def resolve(href: str, base: str) -> str | None:
    """Absolute address; relative ones start from the base's origin, not its page."""
    if re.match(r"(?i)https?://", href):
        return href
    try:
        s = urlsplit(base)
        return urljoin(f"{s.scheme}://{s.netloc}/", href)
    except ValueError:
        return None


@udtf(returnType="pos long, href string, link_text string, target string", useArrow=True)
class PageAnchors:
    """The anchors of a page (url, html) but a bare #, mailto: and javascript: ones, as a table function."""

    def eval(self, url: str, html: str):
        p = _Anchors()
        p.feed(html or "")
        for pos, (href, text) in enumerate(p.found):
            href = href.strip()
            if href and href != "#" and not href.startswith(("mailto:", "javascript:")):
                yield pos, href, " ".join(text.split()), resolve(href, url or "")


def register(spark: SparkSession) -> None:
    """Makes the table function known to SQL: SELECT p.url, a.* FROM pages p, LATERAL page_anchors(p.url, p.html) a."""
    spark.udtf.register("page_anchors", PageAnchors)


def anchors(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, pos, href, link_text, target) of every anchor of every page, by a lateral join with the table function."""
    found = pages.select(url_col, html_col).lateralJoin(PageAnchors(F.col(url_col).outer(), F.col(html_col).outer()))
    return found.select(F.col(url_col).alias("page"), "pos", "href", "link_text", "target")


def link_class(href: Column, text: Column, pattern: str | Column | None = None) -> Column:
    """file, custom, spend, sub_page or none; the first that applies."""
    both = F.concat_ws(" ", href, text)
    spend = ~href.rlike(OTHER_FILE) & ~href.rlike(PUBLICATION) & both.rlike(SPENDING) & both.rlike(MONTH)
    out = F.when(href.rlike(DATA_FILE), "file")
    if pattern is not None:
        wanted = F.concat(F.lit("(?i)"), pattern if isinstance(pattern, Column) else F.lit(pattern))
        out = out.when(F.concat(href, F.lit(" "), text).rlike(wanted) if isinstance(pattern, str) else F.regexp_like(F.concat(href, F.lit(" "), text), wanted), "custom")
    return out.when(spend, "spend").when(both.rlike(SPENDING) & both.rlike(SUB_PAGE), "sub_page").otherwise("none")


def filename(url: Column, is_file: Column | None = None) -> Column:
    """Last part of the address up to a ?, percent-decoded where that is possible, white space as -; .csv is added unless is_file."""
    last = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    name = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last), r"\s+", "-")
    return name if is_file is None else F.when(is_file, name).otherwise(F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")), F.lit(".csv")))


def classified(links: DataFrame) -> DataFrame:
    """links (href, link_text, pattern) with kind; a null pattern is none."""
    return links.withColumn("kind", link_class(F.col("href"), F.col("link_text"), F.col("pattern")))


def discover(pages: DataFrame, pattern: str | None = None) -> DataFrame:
    """Files that pages link to: (url, filename, format), the first link of each url."""
    found = anchors(pages).withColumn("kind", link_class(F.col("href"), F.col("link_text"), pattern)).filter(F.col("kind").isin("file", "custom", "spend") & F.col("target").isNotNull())
    once = first_by(found, ("target",), "page", "pos")
    return once.select(F.col("target").alias("url"), filename(F.col("target"), F.col("kind") == "file").alias("filename"), F.coalesce(F.nullif(F.lower(F.regexp_extract("target", DATA_FILE, 1)), F.lit("")), F.lit("csv")).alias("format"))


def first_by(df: DataFrame, key: tuple[str, ...], *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


PACKAGE = "struct<success:boolean,result:struct<resources:array<struct<url:string,name:string,format:string,last_modified:string,created:string>>>>"


def catalogue_files(responses: DataFrame, json_col: str = "json", *keep: str) -> DataFrame:
    """(keep, url, filename, format, modified) of the spreadsheets in landed package_show responses; the resource's name where its url ends without one."""
    r = responses.select(*keep, F.explode(F.from_json(json_col, PACKAGE)["result"]["resources"]).alias("r")).withColumn("format", F.lower(F.trim("r.format")))
    named = F.concat(F.regexp_replace(F.lower(F.coalesce("r.name", F.lit(""))), r"[^a-z0-9]+", "-"), F.lit("."), F.col("format"))
    name = F.coalesce(F.nullif(filename(F.col("r.url")), F.lit("")), named)
    return r.filter(F.col("format").isin(*FORMATS)).select(*keep, "r.url", name.alias("filename"), "format", F.coalesce(F.nullif(F.col("r.last_modified"), F.lit("")), "r.created").alias("modified"))
