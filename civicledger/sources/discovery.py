"""Discovery of a council's files from landed responses: catalogue first, then its page, then one level of sub-pages.

Nothing is fetched here: pages and catalogue answers are tables of what a fetcher has landed, so a
page or sub-page that failed to load is one that isn't there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicledger.sources.links import FORMATS, anchors, catalogue_files, classified, filename, first_by

#: Sub-pages of a page that are looked at.
SUB_PAGES = 10
#: Extensions of content types.
EXTENSIONS = {
    "text/csv": ".csv",
    "application/csv": ".csv",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
}
SEARCH = "struct<success:boolean,result:struct<count:long,results:array<struct<id:string,name:string,title:string,organization:struct<title:string,name:string>,resources:array<struct<format:string>>>>>>"


def page_files(links: DataFrame) -> DataFrame:
    """(page, pos, url, filename, format) of the files among classified links; a url counts once a page, at its first link."""
    once = first_by(links.filter(F.col("target").isNotNull()), ("page", "target"), "pos")
    files = once.filter(F.col("kind").isin("file", "custom", "spend"))
    own = F.lower(F.regexp_extract("href", r"(?i)\.(csv|xlsx|xls)(\?|#|$)", 1))
    form = F.when(F.col("kind") == "file", own).otherwise(F.lit("csv"))
    return files.select("page", "pos", F.col("target").alias("url"), filename(F.col("target"), F.col("kind") == "file").alias("filename"), form.alias("format"))


def crawl(councils: DataFrame, pages: DataFrame, pattern_col: str = "file_pattern") -> DataFrame:
    """(id, url, filename, format, modified) of each council's page; of its first SUB_PAGES sub-pages where that has no files.

    councils: id, transparency_url, file_pattern (a regular expression or null). pages: url, html of what was landed, a row a url.
    """
    start = councils.filter(F.col("transparency_url").isNotNull()).select("id", F.col("transparency_url").alias("page"), F.col(pattern_col).alias("pattern"))
    # links are parsed once for each page that any council's search may reach
    links = anchors(pages).withColumnRenamed("page", "at")
    first = classified(start.join(links, F.col("page") == F.col("at")).drop("at"))
    found = page_files(first.withColumn("page", F.struct("id", "page"))).select(F.col("page.id").alias("id"), "pos", "url", "filename", "format")
    dry = start.join(found.select("id").distinct(), "id", "left_anti").select("id")
    subs = first_by(first.join(dry, "id", "left_semi").filter(F.col("target").isNotNull()), ("id", "target"), "pos").filter("kind = 'sub_page'")
    subs = subs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter(F.col("rank") <= SUB_PAGES)
    subs = subs.select("id", "rank", "pattern", F.col("target").alias("page"))
    second = classified(subs.join(links, F.col("page") == F.col("at")).drop("at"))
    deeper = page_files(second.withColumn("page", F.struct("id", "rank", "page"))).select(F.col("page.id").alias("id"), F.col("page.rank").alias("rank"), "pos", "url", "filename", "format")
    deeper = first_by(deeper, ("id", "url"), "rank", "pos")
    out = found.select("id", "url", "filename", "format").unionByName(deeper.select("id", "url", "filename", "format"))
    return out.withColumn("modified", F.lit(None).cast("string"))


def discover_files(councils: DataFrame, responses: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, url, filename, format, modified): the catalogue's files of councils that have a catalogue id and get any, the page's of the others.

    councils: id, data_gov_id, transparency_url, file_pattern. responses: data_gov_id, json of landed package_show answers.
    """
    answered = councils.filter(F.col("data_gov_id").isNotNull()).select("id", "data_gov_id").join(responses, "data_gov_id")
    listed = catalogue_files(answered, "json", "id")
    return listed.unionByName(crawl(councils.join(listed.select("id").distinct(), "id", "left_anti"), pages))


def search_packages(responses: DataFrame) -> DataFrame:
    """(data_gov_id, title, org) of landed package_search answers (query_no, offset, json): packages with a spreadsheet, each at its first place."""
    read = responses.select("query_no", "offset", F.from_json("json", SEARCH).alias("r")).filter("r.success")
    each = read.select("query_no", "offset", F.posexplode("r.result.results").alias("pos", "p"))
    once = first_by(each.withColumn("data_gov_id", F.col("p.id")), ("data_gov_id",), "query_no", "offset", "pos")
    sheets = F.exists("p.resources", lambda r: F.lower(F.trim(r.format)).isin(*FORMATS))
    org = F.coalesce(F.nullif(F.col("p.organization.title"), F.lit("")), F.nullif(F.col("p.organization.name"), F.lit("")), F.lit(""))
    return once.filter(sheets).select("data_gov_id", F.col("p.title").alias("title"), org.alias("org"))


def legacy_links(pages: DataFrame) -> DataFrame:
    """(url, filename) of .xlsx and .csv links alone, each url once."""
    found = anchors(pages).filter(F.col("href").rlike(r"(?i)\.(xlsx|csv)(\?|#|$)") & F.col("target").isNotNull())
    once = first_by(found, ("target",), "page", "pos")
    return once.select(F.col("target").alias("url"), filename(F.col("target"), F.lit(True)).alias("filename"))


def landed_name(name: Column, content_type: Column) -> Column:
    """A file's name with the extension that its content type tells, where the name has none."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    known = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in EXTENSIONS.items()))
    told = F.when(known.isNotNull(), known).when(kind.contains("csv") | kind.contains("text/plain"), F.lit(".csv")).when(kind.contains("excel") | kind.contains("spreadsheet"), F.lit(".xlsx"))
    return F.when(name.rlike(r"(?i)\.(csv|xlsx|xls)\z"), name).otherwise(F.concat(name, F.coalesce(told, F.lit(""))))


def council_label_fy(known: DataFrame, label: str | None) -> str | None:
    """The label itself if the council's years have it; None, which is all years, if not."""
    return label if label and not known.filter(F.col("label") == label).isEmpty() else None
