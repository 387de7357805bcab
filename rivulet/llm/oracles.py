"""SQL, as DuckDB runs it, for the corpus queries that SQL can express."""

from __future__ import annotations

from rivulet.llm.hostrules import BASE, HOST_LIMIT, MEASURES, RULES

SPACE = r"[\x20\x09-\x0D]+"


def host_rules() -> str:
    """Measures of each document, failures by host shrunk by a beta prior, and verdicts."""
    fails = ", ".join(f"sum(case when {c} then 1.0 else 0.0 end) as f_{r}" for r, c in RULES.items())
    moments = ", ".join(f"sum(f_{r}) / sum(n) as m_{r}, sum(f_{r} * f_{r} / n) / sum(n) as q_{r}" for r in RULES)
    spread = lambda r: f"greatest(q_{r} - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * hosts / total, 1e-9)"
    weight = ", ".join(f"greatest(1.0, least(1e6, m_{r} * (1 - m_{r}) / {spread(r)} - 1)) as s_{r}" for r in RULES)
    bad = " or ".join(f"(f_{r} + m_{r} * s_{r}) / (n + s_{r}) > {HOST_LIMIT}" for r in RULES)
    base = " or ".join(f"({RULES[r]})" for r in BASE)
    return f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
windows as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as c from windows) where c > 1),
hit as (select doc_id, count(distinct i + j) as n from again, (select unnest([0, 1, 2]) as j) group by doc_id),
m as (select w.doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words from w left join hit on hit.doc_id = w.doc_id),
h as (select source, count(*)::double as n, {fails} from m where source is not null group by source),
g as (select count(*) as hosts, sum(n) as total, {moments} from h),
p as (select *, {weight} from g),
bad as (select source from h, p where {bad})
select doc_id, n_words, {', '.join(MEASURES)}, {base} as base_failed, not ({base}) and all_bad is null as kept from (select m.*, bad.source as all_bad from m left join bad on bad.source = m.source)"""


def revisits(lag: int = 1000) -> str:
    """Each page's revisit and the latest response of its canonical URL before it."""
    uri = r"""lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':(80|443)$', '')
 || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '')"""
    query = r"list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)='))"
    return f"""
with c as (select page_id, html, {uri} || case when len({query}) > 0 then '?' || array_to_string({query}, '&') else '' end as uri from pages),
a as (select page_id, uri, md5(coalesce(html, '')) as tag, 2 * (page_id + {lag}) + 1 as at from c),
b as (select page_id as response_page_id, uri, md5(coalesce(html, '')) as tag, html, 2 * page_id as at from c)
select a.page_id, a.uri, coalesce(response_page_id, -1) as response_page_id, case when response_page_id is null then 'orphan' when a.tag = b.tag then 'matched' else 'mismatch' end as status,
 cast(a.page_id + {lag} as varchar) as header_date, case when a.tag = b.tag then cast(length(html) as varchar) else '0' end as header_length, case when a.tag = b.tag and html is not null then length(html) else 0 end as payload_chars
from a asof left join b on a.uri = b.uri and a.at > b.at"""


ORACLES = {"op6_warc_revisits": revisits(), "op9_host_rules": host_rules()}
