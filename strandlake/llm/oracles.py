"""SQL twins, for DuckDB, of the queries that SQL can express over whole tables."""

from __future__ import annotations

from . import chat, prefix_trie, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

NEAR_DEDUP = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') words from documents),
k as (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) i from w where len(words) > 0),
s as (select distinct doc_id, array_to_string(words[i:i + 3], ' ') shingle from k),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) same from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 80 * (x.n + y.n - same)),
reach(doc_id, root) as (select doc_id, doc_id from documents union select l.a, r.root from reach r join links l on l.b = r.doc_id),
least_ as (select doc_id, min(root) component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, l.component_id, d.doc_id = l.component_id kept
from documents d join least_ l using (doc_id) left join n using (doc_id)
"""

SUBSTRING_DEDUP = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') words from documents),
k as (select doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) h from (select doc_id, words, unnest(range(1, len(words) - 33)) i from w)),
r as (select h from k group by 1 having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) i from k semi join r using (h)),
p as (select doc_id, words[i] word, i from (select doc_id, words, unnest(range(1, len(words) + 1)) i from w)),
kept as (select p.doc_id, string_agg(word, ' ' order by i) t, count(*) n from p anti join gone using (doc_id, i) group by 1)
select w.doc_id, len(words)::bigint n_words, (len(words) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from w left join kept using (doc_id)
"""


def _quoted(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _secret_scan() -> str:
    """Places come from the lengths of the pieces between matches and of the matches."""
    parts = []
    for order, rule in enumerate(secrets.BASE + secrets.MORE):
        regex = _quoted(rule.regex)
        parts.append(f"""
  select doc_id, {order} rank, '{rule.kind}' kind, m, {rule.least} fewest, c,
    sum(length(g) + coalesce(length(p), 0)) over (partition by doc_id order by i) place
  from (select doc_id, i, ms[i] m, cs[i] c, gs[i] g, case when i > 1 then ms[i - 1] end p
        from (select doc_id, ms, cs, gs, unnest(range(1, len(ms) + 1)) i
              from (select doc_id, regexp_extract_all(text, {regex}) ms, regexp_extract_all(text, {regex}, {rule.group}) cs,
                      regexp_split_to_array(text, {regex}) gs from d)))""")
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
x as ({" union all ".join(parts)}),
s as (select doc_id, rank, kind, place, concat(kind, ':', cast(place as bigint), ':', cast(place + length(m) as bigint)) span from x where length(c) >= fewest),
a as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
    string_agg(span, ',' order by place, rank) filter (rank < {len(secrets.BASE)}) base, string_agg(span, ',' order by place, rank) spans from s group by 1)
select d.doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join a using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": NEAR_DEDUP,
        "op7_secret_scan": _secret_scan(),
        "op8_substring_dedup": SUBSTRING_DEDUP,
        "op10_perspective_rotation": chat.SQL,
        "op11_prefix_trie": prefix_trie.SQL,
    }
