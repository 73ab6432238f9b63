"""The registered spending queries and their oracle SQL.

Each query runs over whole tables through `civicledger.sources.catalog`. The oracle of a query is the
same question as one SQL text over the driver's tables, written apart from the DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicledger.functions import exprs as X
from civicledger.operators import ingest as I
from civicledger.operators import runs as R
from civicledger.operators.publish import as_json
from civicledger.plans import flags as G
from civicledger.plans import queries as Q
from civicledger.sources import links as L
from civicledger.sources.catalog import load
from civicledger.sources.discovery import council_label_fy

SPEND_QUERIES: dict = {}
SPEND_ORACLES: dict[str, str] = {}

FY = "(case when month({d}) >= 4 then year({d}) else year({d}) - 1 end)"
FY_LABEL = f"({FY} || '-' || lpad((({FY} + 1) % 100)::varchar, 2, '0'))"
PREVIOUS = "((left({f}, 4)::int - 1)::varchar || '-' || substr({f}, 3, 2))"
# one decimal, rounded on the exact binary value, exact halves (odd quarters alone) away from zero
FIXED = "(case when abs({x}) * 4 = floor(abs({x}) * 4) and (abs({x}) * 4)::bigint % 2 = 1 then printf('%.1f', {x} + sign({x}) * 0.01) else printf('%.1f', {x}) end)"
SHORT = "(case when abs({x}) >= 1e9 then '£' || " + FIXED.replace("{x}", "({x} / 1e9)") + " || 'bn' when abs({x}) >= 1e6 then '£' || " + FIXED.replace("{x}", "({x} / 1e6)") + " || 'm' when abs({x}) >= 1e3 then '£' || printf('%.0f', round({x} / 1e3)) || 'k' else '£' || printf('%.0f', round({x})) end)"
SEVERITY = "(case when {x} > 30 then 'high' when {x} > 15 then 'medium' else 'low' end)"

BASE = f"""
with councils as (select n_nationkey::bigint as id, n_name as name, lower(replace(n_name, '_', '-')) as slug, r_name as region,
  case n_nationkey % 4 when 2 then 'pending' when 3 then 'failing' else 'active' end as status from nation join region on n_regionkey = r_regionkey),
suppliers as (select s_suppkey as id, case s_suppkey % 20 when 1 then 'REDACTED DATA' when 2 then 'Redacted Personal Data' when 3 then 'redacted misc' else s_name end as name from supplier),
tx as (select c_nationkey::bigint as council_id, case when l_suppkey % 20 <> 0 then l_suppkey end as supplier_id,
  ((case when l_returnflag = 'R' and l_linenumber = 7 then -1.0::double else 1.0::double end) * l_extendedprice * l_quantity)::decimal(18,2) as amount,
  strftime(l_shipdate, '%Y-%m-%d') as date, strftime(l_shipdate, '%Y-%m') as month, {FY_LABEL.format(d='l_shipdate')} as fy,
  case o_orderpriority when '4-NOT SPECIFIED' then '' when '5-LOW' then null else o_orderpriority end as directorate, p_brand as service,
  case when p_type like 'SMALL%' then '' when p_type like 'ECONOMY%' then 'REDACTED DATA' when p_type like 'PROMO%' then null else p_type end as category,
  p_name as description, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey),
plan as (select c_nationkey::bigint as council_id, {FY_LABEL.format(d='o_orderdate')} as fy, o_orderpriority as directorate,
  sum(case when o_orderstatus <> 'P' then o_totalprice::decimal(18,2) else 0 end) as net_budget, sum(o_totalprice::decimal(18,2)) as gross_budget,
  sum(case when o_orderstatus = 'F' then o_totalprice::decimal(18,2) else 0 end) as net_outturn from orders join customer on o_custkey = c_custkey group by all),
named as (select tx.*, s.name as supplier_name from tx left join suppliers s on s.id = tx.supplier_id)
"""
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"


def _register(name: str, oracle: str | None, base: bool = True):
    def add(f):
        SPEND_QUERIES[name] = f
        if oracle:
            SPEND_ORACLES[name] = (BASE if base else "") + oracle
        return f

    return add


def _plain(name: str, oracle: str, f) -> None:
    """A query that takes the catalog's tables."""
    _register(name, oracle)(lambda spark, sf_dir: f(load(spark, sf_dir)))


def _labelled(t) -> DataFrame:
    """A council's total in a year by its label; a label that it doesn't have is all years."""
    known = Q.financial_years(t, 6)
    totals = [_total(t, council_label_fy(known, asked)).select(F.lit(asked).alias("asked"), "total") for asked in ("1995-96", "2099-00")]
    return totals[0].unionByName(totals[1])


def _total(t, fy: str | None) -> DataFrame:
    rows = t["transactions"].filter("council_id = 6")
    return (rows.filter(F.col("fy") == fy) if fy else rows).agg(F.sum("amount").cast("double").alias("total"))


# lookups
_plain("council_by_slug", "select * from councils where slug = 'nation-6'", lambda t: Q.council_by_slug(t, "nation-6"))
_plain("financial_years", "select distinct council_id, fy as label from tx", Q.financial_years)
_plain("latest_financial_year", "select council_id, max(fy) as label from tx group by 1", Q.latest_financial_year)
_plain("directorates_list", "select distinct council_id, directorate from tx where directorate <> ''", lambda t: Q.distinct_values(t, "directorate"))
_plain("categories_list", "select distinct council_id, category from tx where category <> ''", lambda t: Q.distinct_values(t, "category"))
_plain("council_list", "select *, (select count(*) from tx where council_id = councils.id) as transaction_count from councils", Q.council_list)
_plain("council_regions", "select coalesce(region, 'Other') as region, count(*) as councils from councils where status = 'active' group by 1", Q.council_regions)
_plain("council_search", "select id, name, slug, region from councils where status = 'active' and (lower(name) like '%eur%' or lower(region) like '%eur%')", lambda t: Q.council_search(t, "EUR"))
_plain("registry_status_counts", "select status, count(*) as councils from councils group by 1", Q.registry_status_counts)
_plain("council_sections", "select id, name, slug, region, case when id % 7 = 5 then 'disabled' else status end as section from councils where id % 7 <> 5",
       lambda t: Q.council_sections({"councils": t["councils"].withColumn("status", F.when(F.col("id") % 7 == 5, "disabled").otherwise(F.col("status")))}))
_plain("councils_to_process", "select id, 'failing' as wanted from councils where status = 'failing' union all select id, 'nation-6' from councils where slug = 'nation-6' union all select id, 'active' from councils where status = 'active'",
       lambda t: R.councils_to_process(t["councils"], status="failing").select("id", F.lit("failing").alias("wanted")).unionByName(R.councils_to_process(t["councils"], "nation-6").select("id", F.lit("nation-6").alias("wanted"))).unionByName(R.councils_to_process(t["councils"]).select("id", F.lit("active").alias("wanted"))))
_plain("labelled_totals", "select '1995-96' as asked, sum(amount)::double as total from tx where council_id = 6 and (fy = '1995-96' or not exists (select 1 from tx where council_id = 6 and fy = '1995-96')) union all select '2099-00', sum(amount)::double from tx where council_id = 6", lambda t: _labelled(t))
_plain("councils_json", """select '{"id":' || id || ',"name":"' || name || '","slug":"' || slug || '","region":' || coalesce('"' || region || '"', 'null') || ',"status":"' || status || '","transaction_count":' || (select count(*) from tx where council_id = councils.id) || '}' as json from councils""", lambda t: as_json(Q.council_list(t)))
_plain("health_count", "select count(*) as councils from councils", Q.health)

# overview
_plain("overview_spend", "select council_id, fy, sum(amount)::double as total, count(*) as transactions, count(distinct supplier_id) as suppliers from tx group by 1, 2", Q.overview_spend)
_plain("overview_budget", "select council_id, fy, sum(net_budget)::double as net, sum(gross_budget)::double as gross from plan group by 1, 2", Q.overview_budget)
_plain("overview_outturn", "select council_id, fy, sum(net_outturn)::double as net, sum(net_outturn - net_budget)::double as variance from plan group by 1, 2", Q.overview_outturn)
_plain("overview_all_councils_budget", "select sum(net_budget)::double as net, sum(gross_budget)::double as gross from plan", Q.budget_of_all)
_YOY = f", y as (select council_id, fy, sum(amount)::double as total from tx group by 1, 2), yoy as (select a.council_id, a.fy, a.total, b.total as previous_total, case when b.total > 0 then round((a.total - b.total) / b.total * 100, 4) end as yoy_change from y a left join y b on a.council_id = b.council_id and b.fy = {PREVIOUS.format(f='a.fy')})"
_plain("overview_yoy", _YOY + " select * from yoy", Q.overview_yoy)
_plain("overview_average", "select council_id, fy, round(sum(amount)::double / count(*), 4) as average from tx group by 1, 2", Q.overview_average)
_plain("overview_cards", _YOY + """, p as (select council_id, fy, sum(net_budget) as nb, sum(gross_budget) as gb, sum(net_outturn) as o, sum(net_outturn - net_budget) as v from plan group by 1, 2)
select council_id, fy, case when coalesce(nb, 0) <> 0 or coalesce(gb, 0) <> 0 then 'budget' else 'average' end as first_card,
  case when coalesce(o, 0) <> 0 and coalesce(v, 0) > 0 then 'overspend' when coalesce(o, 0) <> 0 and coalesce(v, 0) <> 0 then 'underspend' when yoy_change is not null then 'yoy' else 'none' end as second_card
from yoy left join p using (council_id, fy)""", Q.overview_cards)

# listing
_SHOWN = "select supplier_name, amount::double as amount, date, month, directorate, service, category, description, 'spend-' || month || '.csv' as source_file from named"


def _page(name: str, where: str, order: str, offset: int, **kw) -> None:
    _plain(name, f"{_SHOWN} where council_id = 6 {where} order by {order}, {ORDER} limit 50 offset {offset}", lambda t: Q.transactions_page(t, 6, **kw))


_page("tx_page_amount_desc", "", "amount desc nulls last", 0)
_page("tx_page_date_asc", "", "date asc nulls first", 0, sort_by="date", sort_dir="asc")
_page("tx_page_supplier", "", "supplier_id desc nulls last", 0, sort_by="supplier")
_page("tx_page_2", "", "amount desc nulls last", 50, page=2)
# pages that lie too deep for the plain way, in orders that begin with many ties, by texts and with nulls
for _n, _by, _order, _way in (("amount", "amount", "amount desc nulls last", "desc"), ("date", "date", "date asc nulls first", "asc"), ("directorate", "directorate", "directorate asc nulls first", "asc"), ("directorate_desc", "directorate", "directorate desc nulls last", "desc")):
    _plain(f"tx_deep_page_{_n}", f"{_SHOWN} where council_id = 6 order by {_order}, {ORDER} limit 7 offset 147", lambda t, by=_by, way=_way: Q.transactions_page(t, 6, page=22, page_size=7, sort_by=by, sort_dir=way, deep=60))
_page("tx_filter_directorate_category", "and directorate = '2-HIGH' and category = 'REDACTED DATA'", "amount desc nulls last", 0, filters=Q.Filters(directorate="2-HIGH", category="REDACTED DATA"))
_page("tx_filter_amount", "and amount >= 1000 and amount <= 500000", "amount desc nulls last", 0, filters=Q.Filters(min_amount=1000, max_amount=500000))
_page("tx_filter_dates", "and date >= '1996-01-01' and date <= '1996-12-31'", "date asc nulls first", 0, filters=Q.Filters(start_date="1996-01-01", end_date="1996-12-31"), sort_by="date", sort_dir="asc")
_page("tx_search", "and (lower(description) like '%r_ng%' or lower(service) like '%r_ng%')", "amount desc nulls last", 0, filters=Q.Filters(search="R_nG"))
_plain("tx_count", "select count(*) as total, ceil(count(*) / 50.0)::bigint as total_pages from tx where council_id = 6 and fy = '1996-97'", lambda t: Q.transactions_count(t, 6, Q.Filters(fy="1996-97")))

# breakdowns
_CAT = ", c as (select council_id, category as raw, case when trim(coalesce(category, '')) = '' then 'No Category' else category end as category, sum(amount)::double as total, count(*) as count from tx group by 1, 2)"
_plain("by_category", _CAT + " select council_id, category, total, count from c", Q.by_category)
_RANKED = ", g as (select council_id, {c} as name, sum(amount)::double as total, count(*) as count from tx group by 1, 2), r as (select *, row_number() over (partition by council_id order by total desc, name asc nulls first) as rank from g)"
_plain("by_directorate", _RANKED.format(c="directorate") + " select council_id, name, total, count, 'directorate' as level from r where rank <= 15 and trim(coalesce(name, '')) <> ''", Q.by_directorate)
_plain("directorate_chart", _RANKED.format(c="directorate") + f""", s as (select *, row_number() over (partition by council_id order by total desc, name nulls first) as place from r where rank <= 15 and trim(coalesce(name, '')) <> ''),
l as (select *, total / 1000 as x from s where place <= 10)
select council_id, place, name, total, case when abs(x) >= 1e3 then {SHORT.replace("{x}", "x")} else (case when x < 0 then '-' else '' end) || '£' || format('{{:,}}', round(abs(x))::bigint) end as label from l""",
       lambda t: Q.directorate_chart(t).withColumn("label", X.short_amount(F.col("total") / 1000, plain=False)))
_plain("by_directorate_fallback", _RANKED.format(c="service") + " select council_id, name, total, count, 'service' as level from r where rank <= 15",
       lambda t: Q.by_directorate(t | {"transactions": t["transactions"].withColumn("directorate", F.lit(" "))}))
_TOP = ", g as (select council_id, supplier_id, sum(amount) as s, count(*) as count from tx group by 1, 2), r as (select *, sum(s) over (partition by council_id)::double as grand, row_number() over (partition by council_id order by s desc, supplier_id asc nulls first) as rank from g), top as (select council_id, rank, supplier_id, name as supplier_name, s::double as total, count, case when grand > 0 then round(s::double / grand * 100, 4) else 0 end as percentage from r left join suppliers on id = supplier_id where rank <= 20)"
_plain("top_suppliers", _TOP + " select council_id, rank::int as rank, * exclude (council_id, rank) from top", Q.top_suppliers)
_plain("supplier_ranking_bars", _TOP + " select council_id, rank::int as rank, coalesce(supplier_name, 'Unknown') as supplier_name, round(total / max(total) over (partition by council_id), 4) as width from top", Q.supplier_ranking_bars)
_plain("monthly_trend", "select council_id, month, sum(amount)::double as total, count(*) as count from tx where trim(month) <> '' group by 1, 2", Q.monthly_trend)
_plain("category_top8_other", """, g as (select council_id, service, sum(amount) as s from tx group by 1, 2),
r as (select *, least(row_number() over (partition by council_id order by s desc, service asc nulls first), 9)::int as rank from g)
select council_id, rank, case when rank <= 8 then service else 'Other' end as name, sum(s)::double as total from r group by 1, 2, 3 having rank <= 8 or sum(s) > 0""", Q.category_top_other)
_plain("category_share", _CAT + ", s as (select council_id, category, round(total / sum(total) over (partition by council_id), 4) as share from c) select *, share >= 0.06 as labelled from s", Q.category_share)

# flags
_STRICT = "(supplier_name is null or supplier_name in ('REDACTED', 'REDACTED DATA', 'REDACTED PERSONAL DATA', 'Redacted', 'Redacted Data', 'Redacted Personal Data'))"
_LOOSE = "coalesce(upper(trim(supplier_name)) like 'REDACTED%', false)"
_FLAGS = f""", sums as (select council_id, fy, sum(amount)::double as grand, coalesce(sum(amount) filter ({_STRICT}), 0)::double as redacted, count(*) filter ({_STRICT}) as n_redacted,
  coalesce(sum(amount) filter (coalesce(category, '') in ('', 'REDACTED DATA')), 0)::double as blank, count(*) filter (coalesce(category, '') in ('', 'REDACTED DATA')) as n_blank from named group by 1, 2),
shares as (select *, case when grand > 0 then redacted / grand * 100 end as p1, case when grand > 0 then blank / grand * 100 end as p2 from sums),
big as (select * from (select *, row_number() over (partition by council_id, fy order by amount desc, date, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn from named where amount >= 1000000) where rn <= 50),
bigred as (select council_id, fy, count(*) as n, sum(amount)::double as total from big where {_LOOSE} group by 1, 2),
firsts as (select * from big where not {_LOOSE} and coalesce(supplier_name, '') <> '' qualify row_number() over (partition by council_id, fy, upper(regexp_replace(supplier_name, '[^A-Za-z0-9_& ]', '', 'g')) order by rn) = 1),
three as (select * from firsts qualify row_number() over (partition by council_id, fy order by rn) <= 3),
bysup as (select council_id, fy, supplier_id, sum(amount) as s from tx group by 1, 2, 3),
ranked as (select *, sum(s) over (partition by council_id, fy)::double as grand, row_number() over (partition by council_id, fy order by s desc, supplier_id asc nulls first) as place from bysup),
conc as (select council_id, fy, sum(s)::double / any_value(grand) * 100 as p from ranked where place <= 5 and grand > 0 group by 1, 2),
cats as (select council_id, fy, category as raw, case when trim(coalesce(category, '')) = '' then 'No Category' else category end as label, sum(amount)::double as total from tx group by 1, 2, 3),
was as (select council_id, fy, label, min(total) as was from cats group by 1, 2, 3),
rise as (select c.*, w.was, c.total - w.was as up, (c.total - w.was) / w.was * 100 as p from cats c join was w on c.council_id = w.council_id and c.label = w.label and w.fy = {PREVIOUS.format(f='c.fy')} where w.was > 200000 and c.total > 200000),
rise3 as (select * from rise where p > 30 and up > 100000 qualify row_number() over (partition by council_id, fy order by up desc, label, raw asc nulls first) <= 3),
f1 as (select council_id, fy, 1::int as ord, 'redacted_spend' as type, {SEVERITY.format(x='p1')} as severity, {SHORT.format(x='redacted')} || ' to redacted suppliers' as title,
  format('{{:,}}', n_redacted) || ' payments (' || coalesce(printf('%.0f', round(p1)), '0') || '% of total spend) to undisclosed vendors' as detail from shares where redacted > 0),
f2 as (select council_id, fy, 2::int as ord, 'missing_data' as type, {SEVERITY.format(x='p2')} as severity, {SHORT.format(x='blank')} || ' with no category' as title,
  format('{{:,}}', n_blank) || ' transactions (' || coalesce(printf('%.0f', round(p2)), '0') || '% of spend) have blank or redacted category data' as detail from shares where n_blank > 0),
f3 as (select council_id, fy, 3::int as ord, 'large_payment' as type, 'high' as severity, n || ' large payments to redacted suppliers' as title, {SHORT.format(x='total')} || ' total across payments over £1m to undisclosed vendors' as detail from bigred),
f4 as (select council_id, fy, 4::int as ord, 'large_payment' as type, case when amount >= 5000000 then 'high' else 'medium' end as severity, {SHORT.format(x='amount::double')} || ' to ' || supplier_name as title, coalesce(nullif(description, ''), nullif(date, ''), '') as detail from three),
f5 as (select council_id, fy, 5::int as ord, 'supplier_concentration' as type, case when p > 40 then 'high' else 'medium' end as severity, case when p > 40 then 'High' else 'Moderate' end || ' supplier concentration' as title, 'Top 5 suppliers account for ' || {FIXED.format(x='p')} || '% of total spend' as detail from conc where p > 25),
f6 as (select council_id, fy, 6::int as ord, 'rising_category' as type, case when p > 100 then 'high' else 'medium' end as severity, 'Rising: ' || label as title, 'Up ' || printf('%.0f', round(p)) || '% (' || {SHORT.format(x='up')} || ') year-on-year' as detail from rise3)
"""
for _i, (_name, _rule) in enumerate(zip(("flag_redacted", "flag_missing_category", "flag_large_redacted", "flag_large_named", "flag_concentration", "flag_rising_category"), G.RULES), 1):
    _plain(_name, _FLAGS + f" select * from f{_i}", lambda t, rule=_rule: rule(G.sums(t), t["suppliers"]))
_plain("flags_all", _FLAGS + " " + " union all ".join(f"select * from f{i}" for i in range(1, 7)), G.all_flags)


# cleaning; inputs are texts made from keys, the same on both sides
def _over(table: str, f):
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


_register("clean_supplier_names", """
select doc_id, md5(trim(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Za-z0-9_&\\s\\x0B\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]', '', 'g'),
  '[\\s\\x0B\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g'))) as name_md5 from documents""", base=False)(
    _over("documents", lambda d: d.select("doc_id", F.md5(X.normalise_name(F.col("text")).cast("binary")).alias("name_md5"))))


def _key():
    return F.col("c_custkey").cast("string")


def _amounts():
    return F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("£1,"), _key(), F.lit(".50"))).when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("-£"), _key())).when(F.col("c_custkey") % 7 == 2, F.concat(F.lit("("), _key(), F.lit(")"))).when(
    F.col("c_custkey") % 7 == 3, F.concat(F.lit(" "), _key(), F.lit("abc"))).when(F.col("c_custkey") % 7 == 4, "1e3").when(F.col("c_custkey") % 7 == 5, "").otherwise("n/a")


_register("parse_amounts", """select c_custkey, case c_custkey % 7 when 0 then ('1' || c_custkey || '.5')::double when 1 then -c_custkey::double when 3 then c_custkey::double when 4 then 1000 else 0 end as amount from customer""", base=False)(
    _over("customer", lambda d: d.select("c_custkey", X.parse_amount(_amounts()).alias("amount"))))


def _odate():
    return F.col("o_orderdate")


def _dates():
    return F.when(F.col("o_orderkey") % 5 == 0, F.date_format(_odate(), "d/M/yyyy")).when(F.col("o_orderkey") % 5 == 1, F.date_format(_odate(), "dd.MM.yyyy")).when(F.col("o_orderkey") % 5 == 2, F.concat(F.date_format(_odate(), "yyyy-MM-dd"), F.lit("T00:00:00"))).when(F.col("o_orderkey") % 5 == 3, F.date_format(_odate(), "dd/MM/yy")).otherwise("31/02/2024")


_register("parse_dates", "select o_orderkey, case o_orderkey % 5 when 3 then '' when 4 then '2024-02-31' else strftime(o_orderdate, '%Y-%m-%d') end as date from orders", base=False)(_over("orders", lambda d: d.select("o_orderkey", X.parse_date(_dates()).alias("date"))))


def _file_names():
    return F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("spend_"), F.date_format(_odate(), "yyyy_MM_dd"), F.lit(".csv"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Purchase-Card-"), F.date_format(_odate(), "yyyy-MM"), F.lit(".xlsx"))).when(F.col("o_orderkey") % 4 == 2, "2023-2024.csv").otherwise("spend.csv")


_register("month_from_filename", "select o_orderkey, case o_orderkey % 4 when 2 then '2023-20' when 3 then '' else strftime(o_orderdate, '%Y-%m') end as month from orders", base=False)(_over("orders", lambda d: d.select("o_orderkey", X.month_of_filename(_file_names()).alias("month"))))
_register("doc_types", "select case o_orderkey % 4 when 1 then 'procurement_card' else 'expenditure' end as type, count(*) as files from orders group by 1", base=False)(_over("orders", lambda d: d.groupBy(X.document_type(_file_names()).alias("type")).agg(F.count("*").alias("files"))))
_register("fy_labels", f"select o_orderkey, {FY_LABEL.format(d='o_orderdate')} as fy, {PREVIOUS.format(f=FY_LABEL.format(d='o_orderdate'))} as previous from orders", base=False)(
    _over("orders", lambda d: d.select("o_orderkey", X.fy_of_month(F.date_format(_odate(), "yyyy-MM")).alias("fy"), X.previous_fy(X.fy_of_month(F.date_format(_odate(), "yyyy-MM"))).alias("previous"))))
_register("format_amounts", f"select o_orderkey, {SHORT.format(x='(o_orderkey * 7919 - 4000000)::double')} as short, case when o_orderkey % 2 = 0 and o_orderkey > 0 then '-' else '' end || '£' || format('{{:,}}', o_orderkey * 31) as currency from orders", base=False)(
    _over("orders", lambda d: d.select("o_orderkey", X.short_amount(F.col("o_orderkey") * 7919 - 4000000).alias("short"), X.currency(F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey") * 31).otherwise(F.col("o_orderkey") * 31)).alias("currency"))))
_register("month_labels", "select o_orderkey, strftime(o_orderdate, '%b %y') as label from orders", base=False)(_over("orders", lambda d: d.select("o_orderkey", X.month_label(F.date_format(_odate(), "yyyy-MM")).alias("label"))))
_register("truncate_labels", "select p_partkey, case when length(p_name) > 12 then left(p_name, 11) || '…' else p_name end as label from part", base=False)(_over("part", lambda d: d.select("p_partkey", X.truncated(F.col("p_name"), 12).alias("label"))))
_register("slugify", "select n_nationkey, 'royal-' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from nation", base=False)(_over("nation", lambda d: d.select("n_nationkey", X.slug(F.concat(F.lit("Royal Borough of "), F.col("n_name"), F.lit(" County Council"))).alias("slug"))))

# loading
_plain("supplier_dim", ", k as (select distinct council_id, supplier_name as name, trim(regexp_replace(upper(supplier_name), '[^A-Za-z0-9_& ]', '', 'g')) as normalised_name from named where supplier_name is not null) select council_id, normalised_name, min(name) as name from k group by 1, 2",
       lambda t: I.supplier_dimension(t["transactions"].join(t["suppliers"], F.col("supplier_id") == F.col("id")).select("council_id", "name")).drop("id"))
_register("new_files_anti", "select c_nationkey::bigint as council_id, 'f/' || o_orderkey as url from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'F'", base=False)(
    lambda s, d: I.new_files(_files(s, d).drop("status"), _files(s, d).filter("status = 'F'")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("council_id"), F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderstatus").alias("status"))


_register("row_skips", "select case when c_custkey % 7 in (2, 5, 6) then 'zero_amount' when c_custkey % 3 = 0 then 'totals_line' else 'kept' end as skip, count(*) as rows from customer group by 1", base=False)(
    _over("customer", lambda d: I.clean_rows(d.select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("supplier"), _amounts().alias("amount"), *(F.lit("").alias(f) for f in I.FIELDS[2:]), F.lit("spend-2024-05.csv").alias("__file")))
          .groupBy(F.coalesce("skip", F.lit("kept")).alias("skip")).agg(F.count("*").alias("rows"))))
_plain("registry_upsert", """, k as (select * from councils where id % 5 <> 0), o as (select slug, name || ' Council' as name, 'https://' || slug as url from councils where id % 2 = 0)
select slug, coalesce(k.name, o.name) as name, o.url as url, null::varchar as data_gov_id, coalesce(status, 'pending') as status from k full join o using (slug)""",
       lambda t: I.upsert_registry(t["councils"].filter("id % 5 <> 0").select("slug", "name", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("data_gov_id"), "status"),
                                   t["councils"].filter("id % 2 = 0").select("slug", F.concat("name", F.lit(" Council")).alias("name"), F.concat(F.lit("https://"), "slug").alias("url"), F.lit(None).cast("string").alias("data_gov_id"))))
_register("supplier_url_share", "select count(*) as filled, count(*) filter (s_suppkey % 3 = 0) as urls from (select * from supplier order by s_suppkey limit 100)", base=False)(
    _over("supplier", lambda d: d.orderBy("s_suppkey").limit(100).select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" HTTPS://x/"), F.col("s_name"))).otherwise(F.col("s_name")).alias("v")).agg(F.count("v").alias("filled"), F.count_if(F.lower(X.full_trim(F.col("v"))).rlike("^https?://")).alias("urls"))))


def _lines():
    return F.when(F.col("o_orderkey") % 6 == 0, "Adults and Health").when(F.col("o_orderkey") % 6 == 1, "PLACE").when(F.col("o_orderkey") % 6 == 2, F.concat(F.lit("Libraries "), F.col("o_orderkey").cast("string"), F.lit(" 1,200"))).when(
    F.col("o_orderkey") % 6 == 3, F.concat(F.lit("  Parks (1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(") -5"))).when(F.col("o_orderkey") % 6 == 4, "Outturn").otherwise("ab 7")


_BOOK = """
with l as (select o_custkey as file, o_orderkey as line_no, o_orderkey % 6 as k from orders),
a as (select *, last_value(case k when 0 then 'Adults and Health' when 1 then 'Place' end ignore nulls) over w as directorate, max(case when k = 4 then 1 else 0 end) over w as started
  from l window w as (partition by file order by line_no rows between unbounded preceding and current row))
"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line_no"), _lines().alias("line"))


_register("budget_lines", _BOOK + """select file, line_no, directorate, case k when 2 then 'Libraries' else 'Parks (' end as service, case k when 2 then 1200000.0::double else 5000.0::double end as net_budget,
  case when k = 2 then nullif(line_no * 1000.0::double, 0) else (1000 + line_no % 1000) * 1000.0::double end as gross_budget from a where k in (2, 3) and directorate is not null""", base=False)(lambda s, d: I.budget_lines(_book(s, d)))
_register("outturn_lines", _BOOK + """select file, line_no, directorate, case k when 2 then 'Libraries' else 'Parks (' end as service, case k when 2 then line_no * 1000.0::double else (1000 + line_no % 1000) * 1000.0::double end as net_outturn,
  case k when 2 then 1200000.0::double else -5000.0::double end as variance from a where k in (2, 3) and directorate is not null and started = 1""", base=False)(lambda s, d: I.outturn_lines(_book(s, d)))

_LINK = '<a href="([^"]*)">([^<]*)</a>'
_register("page_links", f"""
with a as (select url, regexp_extract_all(html, '{_LINK}', 1) as hrefs, regexp_extract_all(html, '{_LINK}', 2) as texts from pages),
p as (select url, hrefs, texts, unnest(range(len(hrefs))) as pos from a)
select url as page, pos, hrefs[pos + 1] as href, texts[pos + 1] as link_text, regexp_extract(url, '^https?://[^/?#]+') || hrefs[pos + 1] as target from p""", base=False)(_over("pages", L.anchors))
@_register("page_links_sql", f"""
with a as (select page_id, regexp_extract_all(html, '{_LINK}', 1) as hrefs from pages)
select page_id, count(*) as links, count(distinct href) as targets from (select page_id, unnest(hrefs) as href from a) group by 1""", base=False)
def _page_links_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function from SQL."""
    L.register(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return spark.sql("SELECT p.page_id, count(*) AS links, count(DISTINCT a.target) AS targets FROM {pages} p, LATERAL page_anchors(p.url, p.html) a GROUP BY p.page_id", pages=pages)

_register("link_classes", """
with p as (select page_id, url, regexp_extract(html, '<title>([^<]*)', 1) as t from pages),
q as (select *, url || ' ' || t as b from p)
select page_id, case when regexp_matches(url, '(?i)\\.(csv|xlsx|xls)(\\?|#|$)') then 'file'
  when not regexp_matches(url, '(?i)\\.(pdf|html|htm|aspx|php|doc|docx|pptx|png|jpg|jpeg|gif|svg|zip)(\\?|#|$)') and not regexp_matches(url, '(?i)gov\\.uk/government/publications')
    and regexp_matches(b, '(?i)spend|expenditure|payment|supplier|invoice|over.500|over.250|transparency') and regexp_matches(b, '(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec') then 'spend'
  when regexp_matches(b, '(?i)spend|expenditure|payment|supplier|invoice|over.500|over.250|transparency') and regexp_matches(b, '(?i)download|current|archive|20|\\d{4}') then 'sub_page' else 'none' end as class from q""", base=False)(
    _over("pages", lambda d: d.select("page_id", L.link_class(F.col("url"), F.regexp_extract("html", "<title>([^<]*)", 1)).alias("class"))))
_register("dedupe_urls", "select split_part(url, '?', 1) as url, min(page_id) as page_id from pages group by 1", base=False)(
    _over("pages", lambda d: L.first_by(d.select(F.substring_index("url", "?", 1).alias("url"), "page_id"), ("url",), "page_id")))
