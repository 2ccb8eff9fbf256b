"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

AT = "2020-01-02 03:04:05"
BASE = "https://catalogue.example.com"


def fp(*columns: str) -> str:
    parts = [f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in columns]
    return f"md5({' || '.join(parts)})"


# one row per nav link
LINKS = """links as (
  select page_id, url, unnest(l) as href, cast(generate_subscripts(l, 1) - 1 as int) as pos
  from (select page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) as l from pages))"""

TARGET = "regexp_extract(url, '^[a-z]+://[^/?#]+') || href"
# a page cut off inside an entity leaves it without its semicolon
DECODED = "regexp_replace(regexp_replace({}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"

# the rendered site: releases, their place in the search pages, and the search URL
RELEASES = f"""rel as (
  select doc_id as key, lang as country,
    case when n_chars < 1000 then 'short' when n_chars < 2000 then 'medium' else 'long' end as format,
    cast(2000 + n_chars % 2 as int) as year,
    case n_chars % 3 when 0 then 'Euro House' when 1 then 'Ambient' else 'Hard & Core' end as style,
    case when n_chars % 10 <> 0 then source end as artist,
    nullif(string_split(text, chr(10))[1], '') as title,
    source || ' & ' || lang as label,
    case when n_chars % 4 <> 0 then cast(n_chars as varchar) else 'Unknown' end as catalog_number,
    case when n_chars % 5 <> 0 then lang end as shown_country,
    case when n_chars % 7 <> 0 then 'https://img.example.com/R-' || doc_id || '.jpeg' end as cover_url,
    string_split(text, chr(10)) as lines
  from documents),
numbered as (
  select *, row_number() over (partition by country, format, year, style order by key) as n,
    count(*) over (partition by country, format, year, style) as total from rel),
listed as (
  select *, cast(ceil(n / 10) as int) as page,
    '{BASE}/search/?layout=sm&country_exact=' || country || '&format_exact=' || format || '&limit=10&year=' || year
    || '&style_exact=' || replace(replace(style, ' ', '+'), '&', '%26') || '&page=' || cast(ceil(n / 10) as int)
    || '&decade=2000' as url from numbered)"""

# searches the seed pages lead to: lists of one page combine, whatever the year
SEEDS = """seeds as (
  select distinct c.country, f.format, y.year, s.style, 1 as page
  from (select distinct year as p, replace(style, ' ', '+') as style from rel where style <> 'Ambient') s
  join (select distinct year as p, format from rel) f on f.p = s.p
  join (select distinct year as p, country from rel) c on c.p = s.p
  cross join (values (2000), (2001)) y(year))"""

# the same where only pages of even years answer
SEEDS_OK = SEEDS.replace("from rel", "from (select * from rel where year % 2 = 0)")

# the cards of the first pages of the searches, and of all pages that these lead to
FOUND = """firsts as (
  select l.* from listed l join seeds s on l.country = s.country and l.format = s.format and l.year = s.year
    and replace(l.style, ' ', '+') = s.style and l.page = 1),
led as (select distinct country, format, year, style from firsts where artist is not null),
found as (select * from firsts union all select l.* from listed l join led using (country, format, year, style) where l.page > 1)"""

TRACKS = """tracks as (
  select key, cover_url, i, line, length(line) % 9 = 0 as gap,
    i || '.' || case when i % 3 <> 0 then 'A' || i || '-' else '' end || line as item
  from (select key, cover_url, unnest(lines) as line, generate_subscripts(lines, 1) as i from rel)),
stops as (select key, min(i) filter (where gap) as stop from tracks group by key),
titles as (
  select key, cover_url, coalesce(string_agg(item, chr(10) order by i) filter (where i < coalesce(stop, i + 1)), '') as titles,
    coalesce(string_agg(item, chr(10) order by i) filter (where not gap), '') as all_titles
  from tracks join stops using (key) group by key, cover_url)"""

TURNS = """kept as (
  select *, row_number() over (partition by conv_id order by turn) as n from conversations c
  where not exists (select 1 from conversations e where e.conv_id = c.conv_id and e.turn <= c.turn and length(e.text) > 1500))"""

ORDER_LISTS = "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders"


def _items(event_type: str) -> str:
    return f"(select event_id, user_id, props->>'$.k' as k from events where event_type = '{event_type}')"


def _latest(where: str = "true") -> str:
    return f"""select user_id, max(event_id) as event_id,
    arg_max(value, event_id) filter (where event_type in ('click', 'purchase')) as value,
    arg_max(props, event_id) filter (where event_type in ('view', 'purchase')) as props
  from events where {where} group by user_id"""


FACETS = """(select 'style' as facet, p_type as name, count(*) as n from part
    where p_type like '%ECO%' or p_type like '%STAND%' group by p_type
  union all select 'format', o_orderpriority, count(*) from orders group by 2
  union all select 'country', n_name, count(*) from nation group by 2)"""

PRODUCT = """select replace(c.name, ' ', '+') as country, replace(f.name, ' ', '+') as format, y.year, replace(s.name, ' ', '+') as style, 1 as page
  from (select distinct n_name as name from nation) c
  cross join (select distinct o_orderpriority as name from orders) f
  cross join (select distinct p_type as name from part where p_type like '%ECO%' or p_type like '%STAND%') s
  cross join (values (2000), (2001)) y(year)"""

KEYS = f"select distinct {fp('user_id', 'event_type')} as fp from events"

INDEX_ROW = f"""cast(key as varchar) as obj_id, artist, title, '{BASE}/release/' || key as detail_url, label,
    catalog_number, format, cast(year as varchar) as year, shown_country as country, url, page as page_index,
    '{AT}' as crawler_time"""

ORACLE = {
    "page_links": f"with {LINKS} select page_id, pos, href from links",
    "page_links_joined": f"with {LINKS} select page_id, pos, {TARGET} as target from links",
    "link_tasks": f"""with {LINKS} select {fp('target')} as fp, page_id, pos, target from (
      select *, row_number() over (partition by target order by page_id, pos) as k
      from (select page_id, pos, {TARGET} as target from links)) where k = 1""",
    "page_title": "select page_id, regexp_extract(html, '<h1>([^<]*)', 1) as title from pages",
    "page_fingerprint": f"""select page_id, {fp('html')} as fp,
      regexp_extract(html, '<html lang="([^"]*)"', 1) as lang from pages""",
    "url_param_get_set": """select page_id,
      case when regexp_matches(url, '[?&]page=') then regexp_extract(url, '[?&]page=([^&#]*)', 1) end as page,
      regexp_replace(url, '([?&]page=)[^&#]*', '\\17') as page_7 from pages""",
    "url_tail": """select page_id, string_split(url, '/')[-1] as tail,
      replace(string_split(url || '.jpeg', '/')[-1], '.jpeg', '') as name from pages""",
    "clean_facets": """select p_name as name, replace(p_name, ' ', '+') as url_name,
      cast(sum(p_partkey) as varchar) as count, cast(sum(p_partkey) as bigint) as count_n from part group by p_name""",
    "search_urls": f"""with {RELEASES} select distinct replace(replace(url, '&limit=10&', '&limit=100&'), '&page=' || page || '&', '&page=1&') as url,
      '{AT}' as crawler_time from listed""",
    "image_uri": "select page_id, 'data:image/jpg;base64,' || to_base64(encode(html)) as uri from pages",
    "node_table": """select page_id, tag, count(*) as n from (
      select page_id, unnest(regexp_extract_all(
        regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '<\\1>', 'g'), '<([a-z0-9]+)[ >]', 1)) as tag
      from pages) group by page_id, tag""",
    "node_links": f"with {LINKS} select page_id, pos, href from links",
    "node_path_links": f"with {LINKS} select page_id, href from links",
    "node_heading": f"""select page_id, {DECODED.format("regexp_extract(html, '<article><h1>([^<]*)', 1)")} as heading from pages""",
    "deep_headings": f"""select page_id, {DECODED.format("regexp_extract(html, '<article><h1>([^<]*)', 1)")} as heading from pages""",
    "ad_blocks": f"""select page_id, {DECODED.format("regexp_extract(html, '<div class=\"ad\">([^<]*)', 1)")} as ad from pages""",
    "facet_counts": """select page_id, cast(len(l) as int) as n, array_to_string(l, '|') as names from (
      select page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)', 1) as l from pages)""",
    "cards_with_reject": """select page_id, page, campaign, case when page is null then 'page' end as reject from (
      select page_id, case when url like '%page=%' then regexp_extract(url, '[?&]page=([^&#]*)', 1) end as page,
        case when url like '%utm_source=%' then regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) else 'Unknown' end as campaign
      from pages)""",
    "gallery_link": f"select page_id, '{BASE}/release/' || page_id || '/images' as gallery_url from pages",
    "gallery_images": f"with {LINKS} select page_id, pos, 'https://img.example.com' || href || '.jpeg' as img_url from links",
    "take_while": f"with {TURNS} select conv_id, turn, n from kept",
    "take_while_list": f"""with {TURNS} select conv_id, cast(0 as bigint) as list_no,
      string_agg(n || '.' || role || '-' || text, '|' order by n) as items from kept group by conv_id""",
    "enumerate_rows": ORDER_LISTS,
    "enumerate_sparse": """select o_custkey, o_orderkey, place, row_number() over (partition by o_custkey order by place) as n
      from (select o_custkey, o_orderkey, o_orderkey * 7919003 % 1099511627776 as place from orders where o_orderkey % 13 <> 0)""",
    "image_files": "select s_suppkey, md5(lower(hex(s_name)) || chr(10)) as digest from supplier",
    "requeue_failed": f"""select {fp("'/release/' || doc_id")} as fp, cast(3 as bigint) as attempts, 'dead' as verdict, 'no cover' as last_error
      from documents where n_chars % 7 = 0""",
    "assemble_list": f"""select o_custkey, (n - 1) // 5 as list_no, string_agg(cast(o_orderkey as varchar), ',' order by n) as items
      from ({ORDER_LISTS}) group by 1, 2""",
    "first_seen": f"""select min(event_id) as event_id, user_id, event_type, {fp('user_id', 'event_type')} as fp
      from events group by user_id, event_type""",
    "dup_report": "select user_id, event_type, count(*) as n, count(*) - 1 as dups from events group by 1, 2",
    "unseen": f"""select min(event_id) as event_id, user_id, k, {fp('user_id', 'k')} as fp from {_items('click')} c
      where not exists (select 1 from {_items('purchase')} p where p.user_id = c.user_id and p.k = c.k) group by user_id, k""",
    "add_to_set": f"""select {fp('user_id', 'k')} as fp, cast(p.known is null as int) as added, n - 1 as repeats from (
      select user_id, k, count(*) as n from {_items('click')} group by 1, 2) c
      left join (select distinct user_id, k, true as known from {_items('purchase')}) p using (user_id, k)""",
    "claim": f"{KEYS} order by fp limit 20",
    "claim_rest": f"{KEYS} order by fp offset 20",
    "latest_fields": _latest(),
    "upsert_catalogue": _latest(),
    "stream_upsert": _latest(),
    "merge_metrics": f"""with b as ({_latest("event_type <> 'purchase'")}), a as ({_latest()}) select
      count(*) filter (where b.user_id is null) as inserted,
      count(*) filter (where b.user_id is not null and (a.event_id, a.value, a.props) is distinct from (b.event_id, b.value, b.props)) as modified,
      count(*) filter (where b.user_id is not null and (a.event_id, a.value, a.props) is not distinct from (b.event_id, b.value, b.props)) as unchanged
      from a left join b using (user_id)""",
    "stream_metrics": " union all ".join(
        f"""select cast({k} as bigint) as batch,
          count(*) filter (where b.user_id is null) as inserted,
          count(*) filter (where b.user_id is not null and (a.event_id, a.value, a.props) is distinct from (b.event_id, b.value, b.props)) as modified,
          count(*) filter (where b.user_id is not null and (a.event_id, a.value, a.props) is not distinct from (b.event_id, b.value, b.props)) as unchanged
        from (select distinct user_id from events where event_id % 4 = {k}) keys
          join ({_latest(f"event_id % 4 <= {k}")}) a using (user_id)
          left join ({_latest(f"event_id % 4 < {k}")}) b using (user_id)"""
        for k in range(4)
    ),
    "merge_sources": """select coalesce(o_orderkey, l_orderkey) as order_key, o_orderstatus as status, o_totalprice as total,
        l_partkey as part, l_quantity as quantity
      from orders full join (select *, row_number() over (partition by l_orderkey
          order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) as k from lineitem) l
        on o_orderkey = l_orderkey where coalesce(k, 1) = 1""",
    "delete_where": """select doc_id, lang, quality, toxic from documents left join labels using (doc_id)
      where toxic is null or toxic <> 0""",
    "pending_scan": """select doc_id, lang, quality as status from documents left join labels using (doc_id) where quality = 0""",
    "start_requests": f"""select '{BASE}/search/?limit=25&layout=sm&decade=2000&year=' || y || '&page=1' as url from (
      select unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) as y from orders)""",
    "facet_lists": f"""select facet, string_agg(name, '|' order by name) as names,
      string_agg(replace(name, ' ', '+'), '|' order by name) as url_names,
      string_agg(cast(n as varchar), '|' order by name) as counts from {FACETS} group by facet""",
    "frontier_product": PRODUCT,
    "task_roundtrip": PRODUCT,
    "page_expansion": """select c_nationkey, cast(unnest(generate_series(2, cast(ceil(n / 10) as bigint))) as int) as page
      from (select c_nationkey, count(*) as n from customer group by 1)""",
    "union_tasks": f"""with {RELEASES} select distinct country, format, year, style, page,
      {fp('country', 'format', 'year', 'style', 'page')} as fp from listed""",
    "ok_pages": "select page_id, url from pages where html like '%</html>%'",
    "fetch_join": """with c as (
        select url_key, page_id, status from (
          select string_split(url, '#')[1] as url_key, page_id, case when html like '%</html>%' then 200 else 201 end as status,
            row_number() over (partition by string_split(url, '#')[1] order by page_id desc) as k from pages) where k = 1),
      t as (select page_id as task_id, 0 as kind, string_split(url, '#')[1] || '#x' as url from pages
        union all select page_id, 1, regexp_replace(url, '([?&]page=)[^&#]*', '\\13') from pages)
      select task_id, kind, url, page_id, case status when 200 then 'ok' when 201 then 'unhandled' else 'failed' end as result
      from t left join c on string_split(t.url, '#')[1] = c.url_key""",
    "await_pages": """with t as (
        select page_id as task_id, 0 as kind, url, page_id * 10 as issued from pages
        union all select page_id, 1, regexp_replace(url, '([?&]page=)[^&#]*', '\\13'), page_id * 10 from pages),
      c as (select page_id, string_split(url, '#')[1] as k, case when html like '%</html>%' then 200 else 201 end as status,
        page_id * 10 + (page_id * 37) % 900 as fetched from pages)
      select t.task_id, t.kind, t.url, c.page_id, case c.status when 200 then 'ok' when 201 then 'unhandled' else 'failed' end as result
      from t left join c on string_split(t.url, '#')[1] = c.k and c.fetched between t.issued and t.issued + 600""",
    "frontier_rounds": """with recursive edges as (
        select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation
        union select 'n' || c_nationkey, 'c' || c_custkey from customer
        union select 'c' || o_custkey, 'o' || o_orderkey from orders
        union select 'o' || l_orderkey, 'p' || l_partkey from lineitem
        union select 'p' || l_partkey, 's' || l_suppkey from lineitem
        union select 's' || s_suppkey, 'n' || s_nationkey from supplier),
      reached(node, round) using key (node) as (
        select 'r' || r_regionkey, 0 from region where r_name = 'ASIA'
        union select dst, min(round) + 1 from reached join edges on node = src
          where dst not in (select node from recurring.reached) group by dst)
      select node, round from reached""",
    "retry_ledger": f"""select {fp('user_id', 'k')} as fp, attempts,
        case when good then 'done' when attempts < 3 then 'requeue' else 'dead' end as verdict,
        'event ' || last as last_error
      from (select user_id, props->>'$.k' as k, count(*) as attempts, bool_or(event_type = 'purchase') as good,
          max(event_id) filter (where event_type = 'error') as last
        from events where event_type in ('error', 'purchase') group by 1, 2)""",
    "write_missing": """with named as (
        select page_id, html, html not like '%</html>%' as cut,
          replace(string_split(string_split(url, '#')[1], '/')[-1], '.jpeg', '') as name from pages)
      select name, md5(html) as digest from (
        select *, row_number() over (partition by name order by cut desc, page_id) as k from named) where k = 1""",
    "stream_dedup": f"select distinct user_id, event_type, {fp('user_id', 'event_type')} as fp from events",
    "stream_commit": f"select distinct {fp('user_id', 'event_type')} as fp from events where event_type = 'purchase'",
    "site_facets": f"""with {RELEASES} select cast(year as bigint) as page_id, facet, name, replace(name, ' ', '+') as url_name,
        cast(n as varchar) as count, n as count_n from (
      select year, 'style' as facet, style as name, count(*) as n from rel where style <> 'Ambient' group by 1, 2, 3
      union all select year, 'format', format, count(*) from rel group by 1, 2, 3
      union all select year, 'country', country, count(*) from rel group by 1, 2, 3)""",
    "seed_tasks": f"with {RELEASES}, {SEEDS} select * from seeds",
    "pagination": f"with {RELEASES} select distinct url, total, cast(ceil(total / 10) as int) as pages from listed",
    "pages_with_more": f"with {RELEASES} select distinct url from listed where artist is not null",
    "site_cards": f"""with {RELEASES} select url, cast(n - 1 - 10 * (page - 1) as int) as pos, cast(key as varchar) as obj_id, artist, title,
      '/release/' || key as href, '{BASE}/release/' || key as detail_url, label, catalog_number, format,
      cast(year as varchar) as year, shown_country as country, case when artist is null then 'artist' end as reject from listed""",
    "site_covers": f"""with {RELEASES} select '{BASE}/release/' || key as url, cover_url,
      case when cover_url is null then 'no cover' end as reject from rel""",
    "tracklist": f"with {RELEASES}, {TRACKS} select '{BASE}/release/' || key as url, titles from titles",
    "tracklist_past_gaps": f"with {RELEASES}, {TRACKS} select '{BASE}/release/' || key as url, all_titles as titles from titles",
    "index_rows": f"with {RELEASES}, {SEEDS}, {FOUND} select {INDEX_ROW} from found where artist is not null",
    "index_rejects": f"""with {RELEASES}, {SEEDS}, {FOUND} select url, cast(n - 1 - 10 * (page - 1) as int) as pos, cast(key as varchar) as obj_id,
      'artist' as reject from found where artist is null""",
    "index_outcomes": f"""with {RELEASES}, {SEEDS}, {FOUND}, there as (select distinct country, format, year, replace(style, ' ', '+') as style, true as ok from rel),
      told as (select coalesce(ok, false) as ok from seeds left join there using (country, format, year, style)
        union all select true from (select distinct url from found where page > 1))
      select ok, case when not ok then 'no page' end as error, count(*) as n from told group by all""",
    "follow_up_tasks": f"""with {RELEASES}, {SEEDS}, {FOUND} select country, format, year, style, cast(unnest(generate_series(2, pages)) as int) as page
      from (select country, format, year, replace(style, ' ', '+') as style, cast(ceil(max(total) / 10) as bigint) as pages
        from found where artist is not null group by all)""",
    "stage_outcomes": """select e is null as ok, e as error, count(*) as n from (
      select case when doc_id % 5 = 0 or doc_id % 11 = 0 then 'no content' when n_chars % 7 = 0 then 'no cover' end as e from documents) group by all""",
    "linkless_cards": f"""select s_suppkey as page_id, cast(s_suppkey as varchar) as obj_id,
      case when s_suppkey % 3 <> 0 then '{BASE}/release/' || s_suppkey end as detail_url,
      case when s_suppkey % 3 = 0 then 'href' end as reject from supplier""",
    "seed_tasks_ok": f"with {RELEASES}, {SEEDS_OK} select * from seeds",
    "detail_rows": f"""with {RELEASES}, {TRACKS} select cast(key as varchar) as obj_id, cover_url, titles, '{AT}' as crawler_time
      from titles where cover_url is not null""",
    "cover_rows": f"""select cast(doc_id as varchar) as obj_id, 'https://img.example.com/R-' || doc_id || '.jpeg' as cover_url,
      md5('data:image/jpg;base64,' || to_base64(encode(text))) as digest, '{AT}' as detail_time
      from documents where n_chars % 7 <> 0""",
    "gallery_store": "select 'R-' || doc_id as name, md5(text) as digest from documents where n_chars % 7 <> 0",
    "crawl_catalogue": f"""with {RELEASES}, {SEEDS}, {TRACKS}, firsts as (
        select distinct country, format, year, style from listed l where page = 1 and artist is not null
          and exists (select 1 from seeds s where s.country = l.country and s.format = l.format and s.year = l.year
            and s.style = replace(l.style, ' ', '+'))),
      found as (select l.* from listed l where artist is not null and (page = 1 or exists (select 1 from firsts f
          where f.country = l.country and f.format = l.format and f.year = l.year and f.style = l.style))
        and exists (select 1 from seeds s where s.country = l.country and s.format = l.format and s.year = l.year
            and s.style = replace(l.style, ' ', '+')))
      select {INDEX_ROW}, t.cover_url, case when t.cover_url is not null then titles end as title_list, '{AT}' as index_time,
        case when t.cover_url is not null then '{AT}' end as detail_time
      from found join titles t using (key)""",
}
_CRAWLED = f"""with {RELEASES}, {SEEDS}, {FOUND}, crawled as (
  select f.key, f.artist, f.cover_url, d.text from found f join documents d on d.doc_id = f.key
  where f.artist is not null and f.cover_url is not null)"""
ORACLE["crawl_covers"] = f"""{_CRAWLED} select cast(key as varchar) as obj_id, artist, cover_url,
  md5('data:image/jpg;base64,' || to_base64(encode(text))) as digest from crawled"""
ORACLE["crawl_gallery"] = f"{_CRAWLED} select 'R-' || key as name, md5(text) as digest from crawled"
ORACLE["stage_streams"] = ORACLE["crawl_catalogue"]
