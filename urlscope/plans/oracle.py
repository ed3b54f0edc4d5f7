"""DuckDB SQL twins of the registered queries, written independently of the Spark code.

Every statement inlines the ``urls_raw`` / ``url_feed`` fixtures as CTEs over the pre-registered
driver views, so DuckDB recomputes everything from the raw tables. Regex patterns are written
so RE2 (DuckDB) and java.util.regex (Spark) read them the same way; doubles are rounded to six
places in both engines.
"""

from __future__ import annotations

from ..functions.constants import THREAT_TLDS, WHITESPACE
from ..functions.suffix_list import icann_rules
from ..sources.fixtures import COUNTRY_DIM, SEARCH_NAMES


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


WS = q(WHITESPACE)

URLS_RAW = """
urls_raw_p AS (select page_id, url, regexp_extract(url,'//([^/]*)',1) as host,
                  regexp_extract(url,'^([^?#]*)',1) as base, page_id % 10 as m from pages),
urls_raw AS (
select page_id,
 case when page_id % 50 = 19 then '   '
      when m in (0,1,2) then url
      when m = 3 then replace(base, host, 'proj' || cast(page_id as varchar) ||
           case page_id % 40 when 3 then '.web.app' when 13 then '.github.io'
                             when 23 then '.netlify.app' else '.vercel.app' end)
      when m = 4 then replace(base, host, '10.0.' || cast(page_id % 256 as varchar) || '.7')
           || '/login.php?user=' || cast(page_id as varchar)
      when m = 5 then regexp_replace(base, '[.](com|net|org)/', '.tk/') || '/verify?redirect=//x'
      when m = 6 then regexp_replace(base, '[.](com|net|org)/', '.ru/') || '/setup.exe'
      when m = 7 then case when page_id % 20 = 7 then 'http://kq3.zv7.j9w.x2u5g.'
                           else 'http://a.b.c.d.' end || host || '/x@y/index.jsp'
      when m = 8 then replace(replace(base,'https://',''),'http://','') || '/administrator/'
      else '  ' || url || ' ' end as url,
 case when page_id % 50 = 9 then '' when m in (0,1,2,3) then 'benign'
      when m in (4,5) then 'phishing' when m in (6,7) then 'malware'
      when m = 8 then 'defacement' else 'DEFACEMENT ' end as type
from urls_raw_p)"""

URL_FEED = """
url_feed AS (
select k.event_id, k.ts, r.url, r.type, n.n_name as country
from (select e.*, e.event_id % c.n_pages as page_id, e.user_id % 25 as nk
      from events e cross join (select count(*) as n_pages from pages) c) k
join urls_raw r on k.page_id = r.page_id
join nation n on k.nk = n.n_nationkey)"""

RE_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
RE_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
RE_AFTER_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
RE_QUERY = r"^[^?#]*\?([^#]*)"
RE_NETLOC_OK = r"^(?:[^\[\]]*|[^\[]*\[(?:v[0-9A-Fa-f]+\.[^\]]+|[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*)\].*)$"
RE_IPV4 = (r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
           r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$")


def sql_path(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, {q(RE_AFTER_NETLOC)}, 1), ';[^/]*$', '')"


def sql_netloc(url: str) -> str:
    return f"regexp_extract({url}, {q(RE_NETLOC)}, 1)"


def sql_query(url: str) -> str:
    return f"regexp_extract({url}, {q(RE_QUERY)}, 1)"


def sql_suffix_host(url: str) -> str:
    u = f"regexp_replace({url}, '^(?:[a-zA-Z0-9+.\\-]+:)?//', '')"
    u = f"regexp_extract({u}, '^([^/?#]*)', 1)"
    u = f"regexp_replace({u}, '^.*@', '')"
    u = f"regexp_extract({u}, '^([^:]*)', 1)"
    u = f"trim({u}, {WS})"
    u = f"regexp_replace({u}, '[.。．｡]+$', '')"
    return f"translate({u}, '。．｡', '...')"


def suffix_ctes(rules=None) -> str:
    """The plain rule table: what a rule must end a host with, and its kind."""
    rules = icann_rules() if rules is None else rules
    kinds = [(r[1:], "exception") if r[0] == "!" else (r[2:], "wildcard") if r[:2] == "*." else (r, "plain") for r in rules]
    values = ", ".join(f"({q(base)}, {q(kind)})" for base, kind in kinds)
    return f"""
sfx_rules(base, kind) AS (VALUES {values})"""


def suffix_resolve(src: str, name: str, host: str = "_host") -> str:
    """CTEs ending in ``{name}``: ``src`` plus ``_sub, _dom, _suf`` of the longest matching rule.

    A plain rule matches the labels it has, a wildcard one label more, an exception one less;
    an exception prevails, else the longest match, else there is no suffix.
    """
    return f"""
{name}_h AS (select distinct {host} as h, string_split({host}, '.') as labs from {src}),
{name}_t AS (select h, len(labs) as n, d, lower(array_to_string(list_slice(labs, len(labs) - d + 1, len(labs)), '.')) as tail
             from (select h, labs, unnest(generate_series(1, len(labs))) as d from {name}_h)),
{name}_m AS (select t.h, max(case when r.kind = 'exception' then t.d - 1 end) as exc,
                    max(case when r.kind = 'plain' then t.d when r.kind = 'wildcard' and t.n > t.d then t.d + 1 end) as longest
             from {name}_t t join sfx_rules r on r.base = t.tail group by t.h),
{name}_s AS (select h, labs, len(labs) as n, coalesce(exc, longest, 0) as s from {name}_h left join {name}_m using (h)),
{name}_p AS (select h, case when s = 0 and n = 4 and regexp_matches(h, {q(RE_IPV4)}) then true else false end as ip,
                    labs, n, s, n - s as i from {name}_s),
{name} AS (select a.*,
   case when not ip and i >= 2 then array_to_string(list_slice(labs, 1, i - 1), '.') else '' end as _sub,
   case when ip then h when i >= 1 then labs[i] else '' end as _dom,
   case when not ip and s > 0 then array_to_string(list_slice(labs, i + 1, n), '.') else '' end as _suf
 from {src} a join {name}_p b on a.{host} = b.h)"""


def enriched_ctes(source: str = "urls_raw", keys: str = "page_id", country: bool = False) -> str:
    """CTEs ending in ``urls``: the enriched table (P1-P4) over ``source``."""
    ctry = "country" if country else "'Unknown'"
    return f"""
cln AS (select {keys}, trim(url, {WS}) as url, lower(trim(type, {WS})) as type, {ctry} as country
        from {source} where length(trim(url, {WS})) > 0),
nrm AS (select {keys},
          case when starts_with(url, 'http://') or starts_with(url, 'https://') then url
               else 'http://' || url end as url,
          coalesce(nullif(type, ''), 'unknown') as type, country from cln),
prs AS (select *, {sql_netloc('url')} as _netloc, {sql_suffix_host('url')} as _host from nrm
        where regexp_matches({sql_netloc('url')}, {q(RE_NETLOC_OK)})),
{suffix_ctes()},
{suffix_resolve('prs', 'rsl')},
urls AS (select {keys}, url, type,
   case when concat_ws('.', nullif(_dom, ''), nullif(_suf, '')) = '' then _netloc
        else concat_ws('.', nullif(_dom, ''), nullif(_suf, '')) end as domain,
   _sub as subdomain, _suf as tld, {sql_path('url')} as path, {sql_query('url')} as query,
   lower(regexp_extract(url, {q(RE_SCHEME)}, 1)) as scheme,
   lower(regexp_extract(url, {q(RE_SCHEME)}, 1)) = 'https' as has_https,
   cast(length(url) as bigint) as url_length,
   cast(case when _sub = '' then 0 else len(string_split(_sub, '.')) end as bigint) as num_subdomains,
   country,
   cast(length(url) as double) / cast(100 as double)
     + (case when _sub = '' then 0 else len(string_split(_sub, '.')) end) * 2
     + case when _suf in {in_list(THREAT_TLDS)} then 1 else 0 end as threat_score
 from rsl)"""


def with_urls(body: str, feed: bool = False) -> str:
    """A statement over the enriched ``urls`` CTE (``urls_raw`` or ``url_feed`` based)."""
    if feed:
        ctes = URLS_RAW + "," + URL_FEED + "," + enriched_ctes("url_feed", "event_id, ts", country=True)
    else:
        ctes = URLS_RAW + "," + enriched_ctes()
    return "WITH " + ctes.strip() + "\n" + body


# --- statements ------------------------------------------------------------------------------

from ..functions.constants import (FUZZY_MAX_DISTANCE, HOSTING_EXAMPLE_REPEATS,  # noqa: E402
                                   HOSTING_EXAMPLE_URLS, HOSTING_SUFFIXES, LEGIT_DOMAINS,
                                   MALICIOUS_TLDS, RISK_CHAR_PATTERN, RISK_WEIGHTS, RULE_REASONS,
                                   SIMPLE_RISK_TLDS, SIMPLE_RISK_WORDS, SPECIAL_CHAR_CLASS,
                                   SUSPICIOUS_PATTERN_SHORT, SUSPICIOUS_WORDS, TRAINING_FEATURES)

ORACLE: dict[str, str] = {}

SAMPLE_N, STRAT_N, STRAT_FLOOR, RANDOM_SEED, PAGE_NO = 100, 60, 10, "7", 2


def r6(x: str) -> str:
    return f"round({x}, 6)"


def dbl(x) -> str:
    return f"cast({x} as double)"


def entropy(s: str) -> str:
    """Shannon entropy (bits) of column ``s`` via list lambdas."""
    p = f"(cast(length({s}) - length(replace({s}, c, '')) as double) / length({s}))"
    return (f"(case when {s} is null or length({s}) = 0 then 0.0 else "
            f"0.0 - list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: {p} * log2({p}))) + 0.0 end)")


def any_contains(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def b(cond: str) -> str:
    return f"(case when {cond} then 1 else 0 end)"


MAL = "type is distinct from 'benign'"

F1_SQL = f"""
f1a AS (select page_id, url, type, tld, {sql_netloc('url')} as _nl, {sql_path('url')} as _pth,
               {sql_query('url')} as _qry, lower(url) as _low from urls),
f1b AS (select *, regexp_replace(_nl, '[^\\p{{L}}\\p{{N}}]', '', 'g') as _aln from f1a),
f1c AS (select page_id, url, type, tld, _nl,
  cast(length(url) as bigint) as url_length,
  cast(length(_nl) as bigint) as domain_length,
  cast(len(regexp_extract_all(url, {q(SPECIAL_CHAR_CLASS)})) as bigint) as special_char_count,
  cast(len(regexp_extract_all(url, '\\p{{Nd}}')) as bigint) as digit_count,
  cast(len(regexp_extract_all(url, '[a-zA-Z]')) as bigint) as letter_count,
  cast(case when length(_nl) - length(replace(_nl, '.', '')) > 1 then len(string_split(_nl, '.')) - 2 else 0 end as bigint) as subdomain_count,
  {b("starts_with(_nl, 'www.')")} as has_www,
  {b("contains(_nl, '-')")} as has_hyphen_domain,
  {b(any_contains('_low', SUSPICIOUS_WORDS))} as has_suspicious_words,
  {b("lower(tld) in " + in_list(MALICIOUS_TLDS))} as malicious_tld,
  {b("starts_with(url, 'https://')")} as has_https,
  {b("starts_with(url, 'http://')")} as has_http,
  {b("regexp_matches(_nl, '^\\p{Nd}{1,3}\\.\\p{Nd}{1,3}\\.\\p{Nd}{1,3}\\.\\p{Nd}{1,3}')")} as is_ip_address,
  cast(length(_pth) as bigint) as path_length,
  cast(length(_qry) as bigint) as query_length,
  {b("length(_qry) > 0")} as has_query,
  cast(length(_pth) - length(replace(_pth, '/', '')) as bigint) as path_depth,
  {b("contains(lower(_pth), '.php') or contains(lower(_qry), '.php')")} as has_php,
  {b("contains(lower(_pth), '.jsp') or contains(lower(_qry), '.jsp')")} as has_jsp,
  {b("contains(_low, '.exe')")} as has_exe,
  {b("contains(url, '@')")} as has_at_symbol,
  {b("contains(substr(url, 9), '//')")} as has_double_slash,
  {b("contains(_low, 'redirect') or contains(_low, 'redir')")} as has_redirect,
  {entropy('_aln')} as domain_entropy
 from f1b),
f1 AS (select *,
  case when url_length > 0 then cast(digit_count as double) / url_length else 0.0 end as digit_ratio,
  greatest(cast(-5 as double), least(cast(10 as double),
     {' + '.join(['cast(0 as double)'] + [f'{n} * {dbl(w)}' for n, w in RISK_WEIGHTS])})) as security_risk_score
 from f1c)"""

F1_COLS = ["url_length", "domain_length", "special_char_count", "digit_count", "letter_count",
           "digit_ratio", "subdomain_count", "has_www", "has_hyphen_domain", "has_suspicious_words",
           "malicious_tld", "has_https", "has_http", "is_ip_address", "path_length", "query_length",
           "has_query", "path_depth", "has_php", "has_jsp", "has_exe", "has_at_symbol",
           "has_double_slash", "has_redirect", "domain_entropy", "security_risk_score"]

_RULE_COND = {
    "has_exe": "has_exe = 1", "is_ip_address": "is_ip_address = 1", "malicious_tld": "malicious_tld = 1",
    "has_at_symbol": "has_at_symbol = 1", "many_subdomains": "subdomain_count >= 4",
    "has_suspicious_words": "has_suspicious_words = 1",
    "long_hyphen_domain": "has_hyphen_domain = 1 and domain_length > 20",
    "high_risk_score": "security_risk_score > 3", "high_entropy": "domain_entropy > 4",
    "has_https": "has_https = 1", "has_www": "has_www = 1",
}
_HOSTING = "case " + " ".join(f"when ends_with(lower(_nl), {q(sfx)}) then {q(reason)}" for sfx, reason in HOSTING_SUFFIXES) + " end"

RULES_SQL = F1_SQL + f""",
r1 AS (select *, {_HOSTING} as _hosting from f1),
r2 AS (select *, {' + '.join(f'(case when {_RULE_COND[k]} then {pts} else 0 end)' for k, _, pts in RULE_REASONS)}
                  + (case when _hosting is not null then -5 else 0 end) as rule_score,
              concat_ws('; ', {', '.join(f'case when {_RULE_COND[k]} then {q(t)} end' for k, t, _ in RULE_REASONS)}, _hosting) as reasons
       from r1),
scored AS (select *,
  case when rule_score >= 8 then 'malware' when rule_score >= 5 then 'phishing'
       when rule_score >= 2 then 'defacement' else 'benign' end as prediction,
  case when rule_score >= 8 then least({dbl(0.95)}, {dbl(0.7)} + (rule_score - 8) * {dbl(0.05)})
       when rule_score >= 5 then least({dbl(0.9)}, {dbl(0.6)} + (rule_score - 5) * {dbl(0.06)})
       when rule_score >= 2 then least({dbl(0.8)}, {dbl(0.4)} + (rule_score - 2) * {dbl(0.1)})
       else greatest({dbl(0.6)}, {dbl(0.8)} - rule_score * {dbl(0.1)}) end as confidence
 from r2)"""


def over_urls(body: str, extra: str = "", feed: bool = False) -> str:
    s = with_urls("", feed=feed).rstrip()
    if extra:
        s += "," + extra
    return s + "\n" + body


def over_scored(body: str) -> str:
    return over_urls(body, RULES_SQL)


def reg(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


CLEAN = f"""cln0 AS (select page_id, trim(url, {WS}) as url, lower(trim(type, {WS})) as type from urls_raw
              where length(trim(url, {WS})) > 0)"""
NORM = """nrm0 AS (select page_id, case when starts_with(url, 'http://') or starts_with(url, 'https://') then url
                  else 'http://' || url end as url from cln0)"""


def over_raw(body: str, *ctes: str) -> str:
    return "WITH " + URLS_RAW.strip() + "".join("," + c for c in ctes) + "\n" + body


reg("clean_urls", over_raw("select page_id, url, type from cln0", CLEAN))
reg("normalize_url", over_raw("select page_id, url from nrm0", CLEAN, NORM))
reg("default_label", over_raw(f"select page_id, coalesce(nullif(lower(trim(type, {WS})), ''), 'unknown') as type from urls_raw"))
reg("enrich_urls", over_urls("select page_id, url, type, domain, subdomain, tld, path, query, scheme, has_https, "
                             "url_length, num_subdomains, country, round(threat_score, 6) as threat_score from urls"))
reg("malicious_only", over_urls(f"select page_id, type from urls where {MAL}"))
reg("is_malicious_type", over_urls("select page_id, type, coalesce(lower(type) in ('phishing', 'malware', 'defacement'), false) as is_malicious from urls"))
reg("project_columns", over_urls("select page_id, url, type, domain from urls"))
reg("drop_null_rows", over_raw("select page_id, url, type from urls_raw where url is not null and type is not null"))
reg("numeric_only", over_urls("select page_id, round(threat_score, 6) as threat_score from urls where threat_score is not null and not isnan(threat_score)"))
reg("drop_null_rows_mixed", over_raw("select page_id, url, type from urls_raw where page_id % 7 <> 2 and page_id % 11 <> 3"))
reg("numeric_only_mixed", over_urls("select page_id, cast(url_length as double) as threat_score from urls where page_id % 5 > 2"))
reg("match_class", over_urls("select page_id, url from urls where type = 'phishing'"))

SAMPLE_IDS = f"smp AS (select page_id from urls order by md5('42|' || cast(page_id as varchar)) limit {SAMPLE_N})"
reg("restrict_to_sample", over_urls("select type, count(*) as cnt from urls where page_id in (select page_id from smp) group by type", SAMPLE_IDS))

_DIM_VALUES = ", ".join(f"({q(n)}, {q(a)}, {q(c)})" for n, a, c in COUNTRY_DIM)
DIM = f"""cdim(name, alias, alpha_3) AS (VALUES {_DIM_VALUES}),
ccanon AS (select alpha_3, min(name) as canonical from cdim group by alpha_3),
ckeys AS (select key, min(alpha_3) as alpha_3 from (
            select lower(trim(name)) as key, alpha_3 from cdim
            union all select lower(trim(alias)), alpha_3 from cdim where alias is not null) group by key),
cnames AS (select k.key, k.alpha_3, c.canonical from ckeys k join ccanon c using (alpha_3))"""

reg("country_lookup", over_urls(
    """select n.country,
              case when m.alpha_3 is not null and n.country <> 'Unknown' then m.alpha_3 else 'OTHER' end as country_code,
              case when m.alpha_3 is not null and n.country <> 'Unknown' then m.canonical else 'Other/Unknown' end as country_name
       from (select distinct coalesce(nullif(country, ''), 'Unknown') as country from urls) n
       left join cnames m on lower(trim(n.country)) = m.key""", DIM, feed=True))

PER_NAME = f"""pername AS (select coalesce(nullif(country, ''), 'Unknown') as country, count(*) as cnt
                 from urls where {MAL} group by 1)"""
COUNTRY_COUNTS = PER_NAME + """,
ccounts AS (select case when m.alpha_3 is not null and p.country <> 'Unknown' then m.alpha_3 else 'OTHER' end as country_code,
                   case when m.alpha_3 is not null and p.country <> 'Unknown' then m.canonical else 'Other/Unknown' end as country_name,
                   cast(sum(p.cnt) as bigint) as cnt
            from pername p left join cnames m on lower(trim(p.country)) = m.key group by 1, 2)"""

reg("country_lookup_fuzzy", over_urls(
    f"""select u.country, coalesce(arg_min(k.alpha_3, (levenshtein(lower(trim(u.country)), k.key), k.alpha_3)), 'OTHER') as country_code,
               cast(min(levenshtein(lower(trim(u.country)), k.key)) as bigint) as distance
        from (select country from pername where lower(trim(country)) not in (select key from cnames)) u
        left join cnames k on levenshtein(lower(trim(u.country)), k.key) <= {FUZZY_MAX_DISTANCE}
        group by u.country""", DIM + "," + PER_NAME, feed=True))

reg("resolve_suffix", over_raw(
    "select page_id, _sub as subdomain, _dom as domain_label, _suf as suffix from rsl0",
    CLEAN, NORM, f"hst0 AS (select page_id, {sql_suffix_host('url')} as _host from nrm0)",
    suffix_ctes().strip(), suffix_resolve("hst0", "rsl0").strip()))

_LEGIT = any_contains("lower(_nl)", LEGIT_DOMAINS)
reg("legit_override", over_scored(
    f"""select page_id,
          case when ov then 'benign' else prediction end as prediction,
          round(case when ov then {dbl(0.95)} else confidence end, 6) as confidence,
          ov as override_applied,
          (case when ov then 'benign' else prediction end) in ('phishing', 'malware', 'defacement') as is_malicious
        from (select *, coalesce(prediction <> 'benign' and {_LEGIT}, false) as ov from scored)"""))

# --- A
reg("counts_by_type", over_urls("select type, count(*) as cnt from urls group by type"))
reg("mal_domains", over_urls(f"select domain, count(*) as cnt from urls where {MAL} group by domain"))
reg("malicious_tld_counts", over_urls(f"select coalesce(nullif(tld, ''), 'unknown') as tld, count(*) as cnt from urls where {MAL} group by 1"))
THREAT = """ts AS (select type, sum(threat_score) as sum_score, max(threat_score) as max_score, count(*) as cnt,
                  case when count(*) > 0 then sum(threat_score) / count(*) else 0.0 end as avg_score
           from urls where threat_score is not null and not isnan(threat_score) group by type)"""
reg("threat_scores", over_urls("select type, round(sum_score, 6) as sum_score, round(max_score, 6) as max_score, cnt, round(avg_score, 6) as avg_score from ts", THREAT))
reg("country_counts", over_urls("select * from ccounts", DIM + "," + COUNTRY_COUNTS, feed=True))
LENB = "cast(floor(coalesce(url_length, 0) / 50) * 50 as bigint)"
ULBT = f"""ulbt AS (select coalesce(nullif(type, ''), 'unknown') as type,
                   cast({LENB} as varchar) || '-' || cast({LENB} + 49 as varchar) as bucket, count(*) as cnt
            from urls group by 1, 2)"""
reg("url_length_by_type", over_urls("select * from ulbt", ULBT))
reg("class_distribution", over_urls("select type, count(*) as cnt from urls group by type"))
reg("threat_summary", over_urls(
    f"""select cast(coalesce(sum(cnt), 0) as bigint) as total_urls,
               cast(coalesce(sum(case when {MAL} then cnt else 0 end), 0) as bigint) as malicious_urls,
               cast(coalesce(sum(cnt), 0) - coalesce(sum(case when {MAL} then cnt else 0 end), 0) as bigint) as benign_urls,
               case when coalesce(sum(cnt), 0) > 0 then round(sum(case when {MAL} then cnt else 0 end) / sum(cnt) * {dbl(100)}, 2) else 0.0 end as threat_percentage,
               round(coalesce(avg(avg_score), 0.0), 2) as avg_threat_score
        from (select type, count(*) as cnt, avg(threat_score) as avg_score from urls group by type)"""))
reg("mean_of_type_means", over_urls("select round(avg(avg_score), 6) as avg_threat_score from ts", THREAT))
reg("table_cardinalities", over_urls(
    f"""select 'urls' as table_name, count(*) as cnt from urls
        union all select 'mal_domains', count(*) from (select domain from urls where {MAL} group by domain)
        union all select 'threat_scores', count(*) from ts
        union all select 'counts_by_type', count(*) from (select type from urls group by type)""", THREAT))
reg("type_share", over_urls("select type, cnt, round(cnt / sum(cnt) over () * cast(100 as double), 1) as pct from (select type, count(*) as cnt from urls group by type)"))
reg("top_malicious_hosts", over_urls(f"select {sql_netloc('url')} as host, count(*) as cnt from urls where {MAL} group by 1 order by cnt desc, host limit 10"))
reg("top_host_labels", over_urls(
    f"""select tld, count(*) as cnt from (select case when contains(nl, '.') then split_part(nl, '.', -1) else 'unknown' end as tld
        from (select {sql_netloc('url')} as nl from urls)) group by tld order by cnt desc, tld limit 10"""))


def box_sql(value: str, outliers: bool) -> str:
    base = f"bx AS (select type, cast({value} as bigint) as v from urls)"
    stats = """bs AS (select type, count(*) as n, min(v) as min_len, max(v) as max_len, avg(v) as mean_len,
                       quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3
                from bx group by type)"""
    if not outliers:
        return over_urls("select type, n, min_len, max_len, round(mean_len, 6) as mean_len, round(q1, 6) as q1, "
                         "round(median, 6) as median, round(q3, 6) as q3 from bs", base + "," + stats)
    return over_urls(
        """select s.type, s.n, s.min_len, s.max_len, round(s.mean_len, 6) as mean_len, round(s.q1, 6) as q1,
                  round(s.median, 6) as median, round(s.q3, 6) as q3,
                  round(s.q1 - 1.5 * (s.q3 - s.q1), 6) as lower_fence, round(s.q3 + 1.5 * (s.q3 - s.q1), 6) as upper_fence,
                  cast(sum(case when x.v < s.q1 - 1.5 * (s.q3 - s.q1) or x.v > s.q3 + 1.5 * (s.q3 - s.q1) then 1 else 0 end) as bigint) as n_outliers
           from bs s join bx x using (type)
           group by s.type, s.n, s.min_len, s.max_len, s.mean_len, s.q1, s.median, s.q3""", base + "," + stats)


reg("url_length_box", box_sql("length(url)", True))
reg("domain_length_box", box_sql(f"length({sql_netloc('url')})", False))
SIMPLE_RISK = (f"least({b('length(lower(url)) > 75')} + {b(any_contains('lower(url)', SIMPLE_RISK_WORDS))}"
               f" + (case when {any_contains('lower(url)', SIMPLE_RISK_TLDS)} then 2 else 0 end), 5)")
reg("avg_risk_by_type", over_urls(f"select type, round(avg({SIMPLE_RISK}), 6) as avg_risk from urls group by type"))
reg("tld_share", over_urls(
    f"""select tld, cnt, round(cnt / sum(cnt) over () * cast(100 as double), 1) as pct from (
          select coalesce(nullif(tld, ''), 'unknown') as tld, count(*) as cnt from urls where {MAL}
          group by 1 order by cnt desc, tld limit 20)"""))
reg("country_map_data", over_urls(
    """select country_code, country_name, cnt, round(ln(1 + cnt), 6) as log_cnt,
              round(min(ln(1 + cnt)) over (), 6) as min_log, round(max(ln(1 + cnt)) over (), 6) as max_log
       from ccounts where country_code <> 'OTHER'""", DIM + "," + COUNTRY_COUNTS, feed=True))
reg("avg_score_by_type", over_urls("select type, round(avg_score, 6) as avg_score from ts", THREAT))

# --- T
MALD = f"mald AS (select domain, count(*) as cnt from urls where {MAL} group by domain)"
reg("top_k", over_urls("select domain, cnt from mald order by cnt desc, domain limit 20", MALD))
reg("chart_top_n", over_urls("select domain, cnt from mald order by cnt desc, domain limit 15", MALD))
reg("page_of_domains", over_urls(f"select domain, cnt from mald order by cnt desc, domain limit 25 offset {(PAGE_NO - 1) * 25}", MALD))
reg("next_page_of_domains", ORACLE["page_of_domains"])
reg("numbered_page_of_domains", ORACLE["page_of_domains"])
reg("named_counts", over_urls("select domain as name, format('{:,}', cnt) as value from mald order by cnt desc, domain limit 25", MALD))
reg("recent_urls", over_urls("select page_id, url, type from urls order by page_id desc limit 25"))
_STACK = " union all ".join(
    f"select page_id, {i} as pos, {q(c)} as feature, cast({c} as double) as value from f1" for i, c in enumerate(F1_COLS))
reg("top_features_per_url", over_urls(
    f"""select page_id, feature, round(value, 6) as value, rnk from (
          select *, row_number() over (partition by page_id order by value desc, pos) as rnk
          from ({_STACK}) where value > 0) where rnk <= 10""", F1_SQL))
reg("display_rows", over_urls(
    "select page_id, case when length(url) > 60 then substr(url, 1, 60) || '...' else url end as url_display, type, "
    "format('{:,}', url_length) as url_length_display from urls"))
reg("sample_preview", over_urls("select * from ulbt order by type, bucket limit 30", ULBT))

# --- F
_F1_OUT = ", ".join(f"round({c}, 6) as {c}" if c in ("digit_ratio", "domain_entropy", "security_risk_score") else c for c in F1_COLS)
reg("lexical_features", over_urls(f"select page_id, {_F1_OUT} from f1", F1_SQL))
_FAILED = ", ".join(f"case when page_id % 4 < 2 then {5.0 if c == 'security_risk_score' else 0} else {e} end as {c}" for c, e in (
    (c, f"round({c}, 6)" if c in ("digit_ratio", "domain_entropy", "security_risk_score") else c) for c in F1_COLS))
reg("failed_features", over_urls(f"select page_id, {_FAILED} from f1", F1_SQL))


def training_like(url: str, host: str, url_len: str) -> dict:
    return {
        "domain_length": f"cast(length({host}) as bigint)",
        "special_char_count": f"cast(len(regexp_extract_all({url}, '[^a-zA-Z0-9]')) as bigint)",
        "digit_count": f"cast(len(regexp_extract_all({url}, '[0-9]')) as bigint)",
        "is_ip_address": b(f"regexp_matches({host}, '^\\p{{Nd}}{{1,3}}\\.\\p{{Nd}}{{1,3}}\\.\\p{{Nd}}{{1,3}}\\.\\p{{Nd}}{{1,3}}$')"),
        "has_suspicious_words": b(f"regexp_matches({url}, {q('(?i)(?:' + SUSPICIOUS_PATTERN_SHORT + ')')})"),
        "security_risk_score": f"cast(len(regexp_extract_all({url}, {q(RISK_CHAR_PATTERN)})) as bigint)",
        "path_length": f"cast(length({url}) - length({host}) as bigint)",
        "dir_count": f"cast(length({url}) - length(replace({url}, '/', '')) as bigint)",
        "has_www": b(f"starts_with({host}, 'www.')"),
        "has_params": b(f"contains({url}, '?')"),
        "digit_ratio": f"round(cast(len(regexp_extract_all({url}, '[0-9]')) as double) / {url_len}, 6)",
    }


_T = training_like("url", "domain", "url_length")
_T.update({"url_length": "url_length", "has_https": "cast(has_https as integer)"})
reg("training_features", over_urls("select page_id, " + ", ".join(f"{_T[c]} as {c}" for c in TRAINING_FEATURES) + " from urls"))
QUICK_COLUMNS = ["url_length", "domain_length", "special_char_count", "digit_count", "digit_ratio",
                 "is_ip_address", "has_suspicious_words", "security_risk_score", "path_length",
                 "dir_count", "has_www", "has_params", "has_https"]
_Q = training_like("url", "qh", "length(url)")
_Q.update({"url_length": "cast(length(url) as bigint)", "has_https": b("starts_with(url, 'https://')"),
           "digit_ratio": "round(case when length(url) > 0 then cast(len(regexp_extract_all(url, '[0-9]')) as double) / length(url) else 0.0 end, 6)"})
reg("quick_features", over_urls(
    "select page_id, " + ", ".join(f"{_Q[c]} as {c}" for c in QUICK_COLUMNS)
    + " from (select *, case when contains(url, '//') then coalesce(string_split(url, '/')[3], '') else string_split(url, '/')[1] end as qh from urls)"))
reg("simple_risk_score", over_urls(f"select page_id, {SIMPLE_RISK} as risk_score from urls"))
reg("char_entropy", over_urls(f"select page_id, round({entropy('url')}, 6) as entropy from urls"))
reg("url_parts", over_raw(
    f"""select page_id, lower(regexp_extract(url, {q(RE_SCHEME)}, 1)) as scheme, {sql_netloc('url')} as netloc,
               {sql_path('url')} as path, regexp_extract(regexp_extract(url, {q(RE_AFTER_NETLOC)}, 1), ';([^/]*)$', 1) as params,
               {sql_query('url')} as query, regexp_extract(url, '^[^#]*#(.*)$', 1) as fragment from nrm0""", CLEAN, NORM))

# --- R
reg("rule_score", over_scored("select page_id, rule_score from scored"))
reg("rule_reasons", over_scored("select page_id, reasons from scored"))
reg("rule_prediction", over_scored("select page_id, prediction from scored"))
reg("rule_confidence", over_scored("select page_id, round(confidence, 6) as confidence from scored"))
reg("score_urls", over_scored(
    "select page_id, url, prediction, round(confidence, 6) as confidence, prediction in ('phishing', 'malware', 'defacement') as is_malicious, "
    "rule_score, reasons from scored"))

reg("score_result", over_scored(
    "select s.page_id, s.url, prediction, round(confidence, 6) as confidence, prediction in ('phishing', 'malware', 'defacement') as is_malicious, "
    f"rule_score, reasons, {_F1_OUT} from scored s"))
reg("quantile_sketch_facts", over_urls("select type, count(*) as n, true as within_error from urls group by type"))

# --- M, U
reg("fixed_sample", over_urls(f"select page_id, url, type from urls order by md5('42|' || cast(page_id as varchar)) limit {SAMPLE_N}"))
reg("stratified_sample", over_urls(
    f"""select r.page_id, r.type from (
          select page_id, type, row_number() over (partition by type order by md5('42|' || cast(page_id as varchar))) as rn from urls) r
        join (select type, least(c, greatest({STRAT_FLOOR}, cast(floor({STRAT_N} * c / sum(c) over ()) as bigint))) as k
              from (select type, count(*) as c from urls group by type)) a using (type)
        where r.rn <= a.k"""))
reg("stratified_split", over_urls(
    """select page_id, type, case when rn * 100 <= c * 20 then 'test' else 'train' end as split from (
         select page_id, type, row_number() over (partition by type order by md5('42|' || cast(page_id as varchar))) as rn,
                count(*) over (partition by type) as c from urls)"""))
reg("random_url", over_urls(f"select url, type from urls order by md5('{RANDOM_SEED}|' || cast(page_id as varchar)) limit 1"))
_AUG = ", ".join(f"({q(u)})" for u in HOSTING_EXAMPLE_URLS)
reg("augment_training", over_urls(
    f"""select url, type from urls union all
        select u.url, 'benign' as type from (VALUES {_AUG}) u(url), range({HOSTING_EXAMPLE_REPEATS}) r"""))

# --- Z


def z_sql(src_cte: str, cols: str, value: str) -> str:
    return (f"""select {cols}, round(({value} - mu) / sd, 6) as z from {src_cte},
                (select avg({value}) as mu, stddev_pop({value}) as sd from {src_cte} where {value} is not null) st
               where {value} is not null and sd > 0 and abs(({value} - mu) / sd) > 3""")


reg("zscore_outliers", over_urls(z_sql("hc", "host, cnt", "cnt"),
                                 f"hc AS (select {sql_netloc('url')} as host, count(*) as cnt from urls group by 1)"))
reg("outlier_types", over_urls(z_sql("ct", "type, cnt", "cnt"), "ct AS (select type, count(*) as cnt from urls group by type)"))
reg("outlier_lengths", over_urls(z_sql("cl", "step, cnt", "cnt"), """cl AS (select case when page_id % 2 = 0 then -1
        else cast(floor(url_length / 2) as bigint) end as step, count(*) as cnt from urls group by 1)"""))
reg("outlier_scores", over_urls(z_sql("ts", "type, round(avg_score, 6) as avg_score", "avg_score"), THREAT))

# --- L, S, W ----------------------------------------------------------------------------------

reg("index_labels", over_urls("select page_id, type, cast(dense_rank() over (order by type) - 1 as bigint) as label from urls"))
_TF = {c: _T[c] for c in TRAINING_FEATURES}
_TF["digit_ratio"] = "cast(len(regexp_extract_all(url, '[0-9]')) as double) / url_length"
reg("scale_features", over_urls(
    "select page_id, " + ", ".join(
        f"round(case when stddev_pop({c}) over () > 0 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0.0 end, 6) as {c}"
        for c in TRAINING_FEATURES)
    + " from (select page_id, " + ", ".join(f"{_TF[c]} as {c}" for c in TRAINING_FEATURES) + " from urls)"))
reg("accuracy", over_scored("select round(avg(case when type = prediction then 1.0 else 0.0 end), 6) as accuracy from scored"))
reg("classification_report", over_scored(
    """, per AS (
         select coalesce(t.class, p.class) as class, coalesce(t.support, 0) as support, coalesce(t.tp, 0) as tp,
                coalesce(p.predicted, 0) as predicted
         from (select type as class, count(*) as support, sum(case when type = prediction then 1 else 0 end) as tp
               from scored group by type) t
         full outer join (select prediction as class, count(*) as predicted from scored group by prediction) p
           on t.class = p.class),
       pr AS (select class, support, tp,
                     case when predicted > 0 then cast(tp as double) / predicted else 0.0 end as precision,
                     case when support > 0 then cast(tp as double) / support else 0.0 end as recall from per),
       f AS (select *, case when precision + recall > 0 then 2.0 * precision * recall / (precision + recall) else 0.0 end as f1 from pr)
     select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from f
     union all select 'accuracy', null, null, round(cast(sum(tp) as double) / sum(support), 6), cast(sum(support) as bigint) from f
     union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from f
     union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                      round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from f""".replace(", per AS", "select * from (with per AS", 1)
    + ")"))
reg("confusion_matrix", over_scored(
    """select a.c as label, b.c as prediction, cast(coalesce(n.cnt, 0) as bigint) as cnt
       from (select type as c from scored union select prediction from scored) a
       cross join (select type as c from scored union select prediction from scored) b
       left join (select type, prediction, count(*) as cnt from scored group by type, prediction) n
         on n.type = a.c and n.prediction = b.c"""))

reg("upsert_metrics", f"""select 'accuracy' as part, '' as a, '' as b, accuracy as value from ({ORACLE["accuracy"]})
    union all select p.part, class, '', case p.part when 'precision' then precision when 'recall' then recall when 'f1' then f1 else support end
        from ({ORACLE["classification_report"]}), (VALUES ('precision'), ('recall'), ('f1'), ('support')) p(part) where class <> 'accuracy'
    union all select 'matrix', label, prediction, cast(cnt as double) from ({ORACLE["confusion_matrix"]})""")
reg("rules_without_model", over_scored(
    "select page_id, prediction, round(confidence, 6) as confidence, false as override_applied from scored"))
reg("override_facts", over_urls("""select page_id, case when m < 2 then 'benign' else 'malware' end as prediction,
        cast(case when m < 2 then 0.95 else 0.8 end as double) as confidence, m = 2 as is_malicious, m < 2 as override_applied, m = 1 as strict_applied
        from (select page_id, page_id % 3 as m from urls)"""))


def model_facts() -> str:
    """Counts that the split of the whole table and the sample of its train part fix, and what holds of any fitted model."""
    return over_urls("""select cast(sum(k) as bigint) as n_train, cast(sum(test) as bigint) as n_test,
        cast(count(*) as int) as n_classes, true as sums_to_one, true as confidence_is_largest, true as at_least_majority, true as importances_sum_to_one
        from (select test, least(c - test, greatest(1000, cast(floor(20000 * (c - test) / sum(c - test) over ()) as bigint))) as k
              from (select type, count(*) as c, cast(floor(count(*) * 20 / 100) as bigint) as test from urls group by type))""")


for _name in ("gbt_facts", "forest_facts", "text_facts"):
    reg(_name, model_facts())

_TEST = """(select cast(sum(floor(c * 20 / 100)) as bigint) as n_test from (select count(*) as c from urls group by type))"""
reg("model_metrics_facts", over_urls(f"""select cast({len(F1_COLS)} as bigint) as features, true as importances_sum_to_one, n_test, n_test as support,
        cast(0 as bigint) as out_of_range from {_TEST}"""))
reg("save_model_facts", over_urls(f"select n_test, true as equal from {_TEST}"))
reg("score_batch_facts", over_urls("""select count(*) as n, count(distinct page_id) as ids, true as sums_to_one, true as confidence_is_largest,
        cast(count(distinct type) as int) as n_classes from urls"""))
reg("model_then_rules_facts", over_urls("""select count(*) as n, count(distinct page_id) as ids, true as overrides_are_benign, true as confidence_in_range,
        true as reasons_given from urls"""))

RAW_ROWS = "select url, type from urls_raw"
reg("read_raw_urls", over_raw(RAW_ROWS))
reg("drop_header_row", over_raw(RAW_ROWS))
reg("pick_source", over_raw(RAW_ROWS))
reg("with_fallback_source", over_raw(RAW_ROWS))
_LINE = f"trim(concat_ws(' ', url, type), {WS})"
reg("split_fallback", over_raw(
    f"""select regexp_extract(l, '^(\\S+)\\s+(.*)$', 1) as url, regexp_extract(l, '^(\\S+)\\s+(.*)$', 2) as type
        from (select {_LINE} as l from urls_raw) where regexp_matches(l, '^\\S+\\s+')"""))
reg("write_jsonl", ORACLE["enrich_urls"])
reg("read_jsonl", over_urls("""select count(*) as lines, count(*) filter (page_id % 7 <> 3) as good,
        count(*) filter (page_id % 7 = 3) as bad from urls"""))
reg("append_urls_total", over_raw("select count(*) as added, 2 * count(*) as stored from urls_raw"))
_PART = """(select page_id, url, coalesce(nullif(type, ''), 'none') as type from urls_raw where length(trim(url)) > 0)"""
reg("read_raw_folder", over_raw(f"""select url, type from {_PART} where page_id % 3 < 2
        union all select url || '/a,b', type from {_PART} where page_id % 3 = 2 and page_id % 2 = 1"""))
reg("rejected_lines", over_raw(f"""select url || '/x,y,' || type as line, count(*) as n from {_PART}
        where page_id % 3 = 2 and page_id % 2 = 0 group by 1"""))
reg("read_raw_bare", over_raw(f"select url, case when page_id % 5 = 0 then type end as type from {_PART}"))
reg("read_raw_breaks", over_raw(f"""select case when page_id % 3 = 0 then url || chr(10) || '/a,"b"' || chr(10) || chr(10) || '/c'
        when page_id % 7 = 0 then url || '"q' else url end as url, type from {_PART}"""))
_BLANKS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
_NOT_BLANKS = "[^" + _BLANKS[1:]
reg("split_fallback_unicode", over_raw(
    f"""select regexp_extract(l, '^({_NOT_BLANKS}+){_BLANKS}+(.*)$', 1) as url, regexp_extract(l, '^({_NOT_BLANKS}+){_BLANKS}+(.*)$', 2) as type
        from (select trim(concat_ws(chr(160), url, type), {WS}) as l from urls_raw) where regexp_matches(l, '^{_NOT_BLANKS}+{_BLANKS}+')"""))
reg("append_urls", over_raw("select page_id, url, type from urls_raw union all select page_id, url, type from urls_raw"))
reg("overwrite_result", ORACLE["counts_by_type"])
reg("layout_urls", over_urls("select page_id, url, domain, type from urls"))
reg("layout_for_lookups", over_urls("select event_id, url, domain, type, country from urls", feed=True))

reg("stream_new_urls", "WITH " + URLS_RAW.strip() + "," + URL_FEED.strip() + "\nselect event_id, url, type from url_feed")
reg("stream_counts", over_urls("select type, count(*) as cnt from urls group by type", feed=True))
reg("stream_alerts", over_urls(
    "select event_id, url, type, prediction, rule_score, round(confidence, 6) as confidence from scored "
    "where prediction in ('phishing', 'malware', 'defacement')",
    RULES_SQL.replace("page_id", "event_id"), feed=True))
reg("stream_counts_state", ORACLE["stream_counts"])
_NAMED = " ".join(f"when {i} then {q(code)}" for i, (_, code, _) in enumerate(SEARCH_NAMES))
_HOW = " ".join(f"when {i} then {q(how)}" for i, (_, _, how) in enumerate(SEARCH_NAMES) if how)
reg("country_search", "WITH " + URLS_RAW.strip() + "," + URL_FEED.strip() + f"""
    select case event_id % {len(SEARCH_NAMES)} {_NAMED} end as country_code, case event_id % {len(SEARCH_NAMES)} {_HOW} end as found_by, count(*) as cnt
    from url_feed group by 1, 2""")
_LONGER = " ".join(f"when ends_with(lower({sql_netloc('url')}), '.{x}') then {q(x)}" for x in ("web.app", "github.io", "netlify.app", "vercel.app"))
reg("stream_alerts_versions", over_urls(
    f"""select event_id, url, type, case when event_id % 2 = 0 then tld else case {_LONGER} else tld end end as tld, prediction, rule_score,
        round(confidence, 6) as confidence, cast(event_id % 2 + 1 as int) as version from scored where prediction in ('phishing', 'malware', 'defacement')""",
    RULES_SQL.replace("page_id", "event_id"), feed=True))
