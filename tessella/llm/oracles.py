"""SQL twins of the corpus queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: One step of CRC-32 for each bit of a byte, from the polynomial.
CRC_TABLE = "crc_table as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b.range) order by b.range) as crcs from range(256) b)"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; needs ``crc_table`` beside it."""
    hexed = f"hex(encode({text}))"
    each = f"[('0x' || substr({hexed}, 2 * k + 1, 2))::bigint for k in range(octet_length(encode({text})))]"
    return f"xor(list_reduce({each}, lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def importance_sql() -> str:
    words = lambda table, key, name: f"""{name}_words as (select {key}, unnest(regexp_extract_all({LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from {table})"""
    return f"""with {CRC_TABLE},
{words("documents", "doc_id", "doc")},
{words("benchmark", "item_id", "item")},
distinct_words as (select distinct word from (select word from doc_words union all select word from item_words)),
hashed as (select word, {crc32("word")} % 10000 as bucket from distinct_words, crc_table),
s as (select bucket, count(*) as s from doc_words join hashed using (word) group by bucket),
t as (select bucket, count(*) as t from item_words join hashed using (word) group by bucket),
totals as (select (select count(*) from doc_words)::double as ns, (select count(*) from item_words)::double as nt),
gains as (select b.range as bucket, floor(1000.0::double * ln((coalesce(t, 0)::double + 1) * (ns + 10000) / ((coalesce(s, 0)::double + 1) * (nt + 10000))))::bigint as gain
  from range(10000) b left join s on s.bucket = b.range left join t on t.bucket = b.range, totals),
sums as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from doc_words join hashed using (word) join gains using (bucket) group by doc_id),
scored as (select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000.0::double * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from documents d left join sums using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end as rank from scored left join placed using (doc_id)"""


def url_filters_sql(rules: list[tuple[str, str, str]]) -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""with rests as (select row_number() over () as row, page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
hosts as (select row, page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from rests),
split as (select row, page_id, {LOWERED.format("raw")} as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from hosts),
rules(rule_host, rule_path, rule_verdict) as (values {rows}),
best as (select row, rule_host || rule_path as rule, rule_verdict from split join rules on (host = rule_host or suffix(host, '.' || rule_host)) and prefix(path, rule_path)
  qualify row_number() over (partition by row order by length(rule_host || rule_path) desc, length(rule_host) desc) = 1)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from split left join best using (row)"""


def prefix_trie_sql() -> str:
    return f"""with {CRC_TABLE},
turns as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as u, strlen(coalesce(text, '')) as bytes from conversations where conv_id is not null),
sized as (select c as b, count(*) as nb from turns group by c),
ids as (select distinct c from turns),
convs as (select c, c - c % 5 as b, {crc32("c::varchar")} % 9 as h from ids, crc_table),
rebuilt as (select k.c, t.i as d, u, bytes from convs k join turns t on t.c = k.b and t.i <= h
  union all select k.c, least(h, coalesce(nb, 0)) + t.i - h, u, bytes from convs k join turns t on t.c = k.c and t.i > h left join sized s on s.b = k.b),
paths as (select c, 0 as d, '' as p, 0 as bytes from convs union all select c, d, string_agg(u, '') over (partition by c order by d rows unbounded preceding), bytes from rebuilt),
nodes as (select p, d, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as saved from paths group by p, d),
children as (select left(p, 64 * (d - 1)) as p, count(*) as n_children from nodes where d > 0 group by 1),
ends as (select p, sha256(string_agg(c::varchar, ',' order by c)) as sha from (select c, arg_max(p, d) as p from paths group by c) group by p),
sums as (select a.p, count(*) filter (where k.p is null) as n_leaves, sum(n.saved)::bigint as saved_tokens from nodes n left join children k on k.p = n.p join paths a on a.c = n.conv_id and a.d <= n.d group by a.p)
select n.conv_id, n.d::bigint as depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) as ends_sha256
from nodes n join sums using (p) left join children k on k.p = n.p left join ends e on e.p = n.p left join nodes q on n.d > 0 and q.d = n.d - 1 and q.p = left(n.p, 64 * (n.d - 1))"""


def oracle_sql(url_rules: list[tuple[str, str, str]]) -> dict[str, str]:
    return {"op11_prefix_trie": prefix_trie_sql(), "op12_importance_resampling": importance_sql(), "op13_url_filters": url_filters_sql(url_rules)}
