"""Constant relations: the curated registry of councils and the published budget books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Councils (name, slug, region), in their published order.
COUNCILS = [
    ("Kirklees Council", "kirklees", "West Yorkshire"),
    ("Birmingham City Council", "birmingham", "West Midlands"),
    ("Manchester City Council", "manchester", "Greater Manchester"),
    ("Leeds City Council", "leeds", "West Yorkshire"),
    ("Sheffield City Council", "sheffield", "South Yorkshire"),
    ("Liverpool City Council", "liverpool", "Merseyside"),
    ("Bristol City Council", "bristol", "South West"),
    ("Newcastle City Council", "newcastle", "Tyne and Wear"),
    ("Nottingham City Council", "nottingham", "East Midlands"),
    ("Leicester City Council", "leicester", "East Midlands"),
    ("Coventry City Council", "coventry", "West Midlands"),
    ("Westminster City Council", "westminster", "London"),
    ("Camden Council", "camden", "London"),
    ("Tower Hamlets Council", "tower-hamlets", "London"),
    ("Hackney Council", "hackney", "London"),
    ("Islington Council", "islington", "London"),
    ("Lambeth Council", "lambeth", "London"),
    ("Southwark Council", "southwark", "London"),
    ("Newham Council", "newham", "London"),
    ("Barnet Council", "barnet", "London"),
    ("Croydon Council", "croydon", "London"),
    ("Ealing Council", "ealing", "London"),
    ("Haringey Council", "haringey", "London"),
    ("Hounslow Council", "hounslow", "London"),
    ("Greenwich Council", "greenwich", "London"),
    ("Lewisham Council", "lewisham", "London"),
    ("Wandsworth Council", "wandsworth", "London"),
    ("Kent County Council", "kent", "South East"),
    ("Hampshire County Council", "hampshire", "South East"),
    ("Surrey County Council", "surrey", "South East"),
    ("Essex County Council", "essex", "East of England"),
    ("Lancashire County Council", "lancashire", "North West"),
    ("Devon County Council", "devon", "South West"),
    ("Norfolk County Council", "norfolk", "East of England"),
    ("Suffolk County Council", "suffolk", "East of England"),
    ("Hertfordshire County Council", "hertfordshire", "East of England"),
    ("Bradford Council", "bradford", "West Yorkshire"),
    ("Calderdale Council", "calderdale", "West Yorkshire"),
    ("Wakefield Council", "wakefield", "West Yorkshire"),
    ("Rochdale Borough Council", "rochdale", "Greater Manchester"),
    ("Bolton Council", "bolton", "Greater Manchester"),
    ("Wigan Council", "wigan", "Greater Manchester"),
    ("Stockport Council", "stockport", "Greater Manchester"),
    ("Tameside Council", "tameside", "Greater Manchester"),
    ("Oldham Council", "oldham", "Greater Manchester"),
    ("Trafford Council", "trafford", "Greater Manchester"),
    ("Salford City Council", "salford", "Greater Manchester"),
    ("Bury Council", "bury", "Greater Manchester"),
    ("Sunderland City Council", "sunderland", "Tyne and Wear"),
    ("Gateshead Council", "gateshead", "Tyne and Wear"),
    ("Cornwall Council", "cornwall", "South West"),
    ("Plymouth City Council", "plymouth", "South West"),
    ("Milton Keynes Council", "milton-keynes", "South East"),
    ("City of Edinburgh Council", "edinburgh", "Scotland"),
    ("Glasgow City Council", "glasgow", "Scotland"),
    ("Aberdeen City Council", "aberdeen", "Scotland"),
    ("Dundee City Council", "dundee", "Scotland"),
    ("Cardiff Council", "cardiff", "Wales"),
    ("Swansea Council", "swansea", "Wales"),
    ("Newport City Council", "newport", "Wales"),
]
#: Transparency pages of those that have one, by slug.
PAGES = {
    "kirklees": "https://www.kirklees.gov.uk/beta/information-and-data/expenditure-data.aspx",
    "birmingham": "https://www.birmingham.gov.uk/info/20215/corporate_procurement_services/517/invoicing_the_council/5",
    "manchester": "https://www.manchester.gov.uk/open-data/local-government-transparency-code",
    "leeds": "https://datamillnorth.org/dataset/council-spending-2gpp0",
    "sheffield": "https://datamillnorth.org/dataset/council-spend-over-250-emd0m",
    "liverpool": "https://liverpool.gov.uk/council/spending-and-performance/transparency-in-local-government/",
    "bristol": "https://www.bristol.gov.uk/council/council-spending-and-performance/spending-over-500",
}
#: Budget books and statements of accounts, and the folder where they are published.
BUDGET_FOLDER = "https://www.kirklees.gov.uk/beta/delivering-services/pdf/"
BUDGET_BOOKS = ["2025-26-summary-budget-book.pdf", "2025-26-budget.pdf", "statement-of-accounts-2024-25.pdf", "statement-of-accounts-2023-24.pdf"]


def curated_councils(spark: SparkSession) -> DataFrame:
    """(name, slug, region, url) of the curated registry, as `upsert_registry` takes them."""
    return spark.createDataFrame([(*c, PAGES.get(c[1])) for c in COUNCILS], "name string, slug string, region string, url string")


def budget_books(spark: SparkSession) -> DataFrame:
    """(url, filename) of the budget books."""
    return spark.createDataFrame([(BUDGET_FOLDER + n, n) for n in BUDGET_BOOKS], "url string, filename string")
