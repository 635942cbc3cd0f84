"""DuckDB SQL for the queries of the subpackage that SQL can express."""

from qaloom.llm import merkle
from qaloom.llm.licenses import CAPITALS, COVERED, SLACK, SMALL, STRETCH, template_grams

ORACLES: dict[str, str] = {}

ORACLES["op6_host_rules"] = r"""
with docs as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents
), split as (
  select rid, doc_id, source, text,
         [x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x <> ''] as ws,
         [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls
  from docs
), grams as (
  select rid, unnest(range(1, len(ws) - 1)) as i, ws from split where len(ws) >= 3
), named as (
  select rid, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] as g from grams
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from named) where n > 1
), covered as (
  select rid, count(distinct p) as n_repeat_words
  from (select rid, unnest([i, i + 1, i + 2]) as p from twice) group by rid
), counted as (
  select doc_id, source, len(ws)::bigint as n_words,
         coalesce(length(array_to_string(ws, '')), 0)::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines
  from split left join covered using (rid)
), based as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
), marked as (
  select *, base_failed or 100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 30 * n_lines as junk from based
), hosts as (
  select source, count(*)::double as n, (count(*) filter (junk))::double as k from marked group by source
), moments as (
  select sum(k) / sum(n) as m, avg((k / n) * (k / n)) - avg(k / n) * avg(k / n) as v, avg(1 / n) as inv from hosts
), prior as (
  select m, case when v - m * (1 - m) * inv <= 0 then 10000.0
                 else greatest(1.0, least(10000.0, m * (1 - m) / (v - m * (1 - m) * inv) - 1)) end as weight
  from moments
), verdicts as (
  select source, (k + weight * m) / (n + weight) > 0.5 as host_failed from hosts, prior
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not host_failed as kept, host_failed
from marked join verdicts on marked.source is not distinct from verdicts.source
"""

_GRAMS = ", ".join(
    f"({number}, '{label}', {str(base).lower()}, {n}, {at}, '{gram}')"
    for number, label, base, n, at, gram in template_grams()
)

ORACLES["op9_license_scan"] = rf"""
with docs as (
  select row_number() over () as rid, doc_id,
         [x for x in regexp_split_to_array(
            translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as ws
  from documents
), places as (
  select rid, unnest(range(1, len(ws) - 1)) as i, ws from docs where len(ws) >= 3
), grams as (
  select rid, i - 1 as pos, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram from places
), templates(template, label, is_base, n, tpos, gram) as (values {_GRAMS}),
hits as (
  select rid, template, label, is_base, n, tpos, pos - tpos as diagonal from grams join templates using (gram)
), votes as (
  select rid, template, label, is_base, n, diagonal, list(tpos) as seen, min(tpos) as lo, max(tpos) as hi
  from hits group by all
), gaps as (
  select *, coalesce((diagonal - lag(diagonal) over (partition by rid, template order by diagonal) > {SLACK})::int, 0) as new
  from votes
), runs as (
  select *, sum(new) over (partition by rid, template order by diagonal) as run from gaps
), merged as (
  select rid, template, label, is_base, n, run, list_distinct(flatten(list(seen))) as seen,
         min(diagonal + lo) as f, max(diagonal + hi + 2) as l,
         count(*) filter (len(seen) = n - 2) as whole,
         min(diagonal) filter (len(seen) = n - 2) as p0, max(diagonal) filter (len(seen) = n - 2) as p1
  from runs group by all
), scored as (
  select *, len(list_distinct(flatten([[t, t + 1, t + 2] for t in seen]))) / n as coverage from merged
), labelled as (
  select *, case when is_base and whole > 0 then label end as base_label,
         case when (is_base and whole > 0) or (coverage >= {COVERED} and l - f + 1 <= {STRETCH} * n) then label end as any_label
  from scored
), summed as (
  select rid, sum(case when is_base then whole else 0 end)::bigint as n_base,
         min(p0) filter (is_base) as first_word, max(p1) filter (is_base) as last_word,
         coalesce(array_to_string(list_sort(list(distinct base_label) filter (base_label is not null)), ','), '') as base_labels,
         coalesce(array_to_string(list_sort(list(distinct any_label) filter (any_label is not null)), ','), '') as labels,
         max(coverage) as score
  from labelled group by rid
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
       first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0)::double, 6) as score
from docs left join summed using (rid)
"""

ORACLES["op3_warc_revisits"] = r"""
with raw as (
  select page_id as p, url, coalesce(html, '') as html,
         regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as bare
  from pages
), split as (
  select *, split_part(bare, '?', 1) as place,
         list_sort([x for x in string_split(case when contains(bare, '?') then substr(bare, strpos(bare, '?') + 1) else '' end, '&')
                    if x <> '' and not regexp_matches(x, '^(utm_\w+|gclid|fbclid)=')]) as params
  from raw
), keyed as (
  select p, html, '"' || md5(html)[1:16] || '"' as tag,
         regexp_replace(regexp_replace(lower(split_part(place, '/', 1)), '^.*@', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(place, '^[^/]*(/.*)$', 1), '/+$', '')
         || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as k,
         p * 60 as t, p * 60 + case when p % 13 = 0 then -86400 * 90 else 86400 * 7 end as seen
  from split
), stamped as (
  select *, strftime(make_timestamp((1704067200 + t) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as made,
         strftime(make_timestamp((1704067200 + seen) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as at_text,
         case when p % 7 = 0 then '"gone"' when p % 5 = 0 then 'W/' || tag
              when p % 3 = 0 or p % 11 = 0 then null else tag end as sent
  from keyed
), ranked as (
  select v.p, v.k, v.sent, v.made, v.at_text, r.p as rp, r.tag as rtag, r.made as rmade, r.html as rhtml,
         row_number() over (partition by v.p order by r.t desc nulls last, r.p desc) as n
  from stamped v left join stamped r on v.k = r.k and r.t < v.seen
), judged as (
  select *, case when rp is null then 'no_response'
                 when sent is not null then case when replace(sent, 'W/', '') = rtag then 'resolved' else 'mismatch' end
                 when p % 3 = 0 then case when made = rmade then 'resolved' else 'mismatch' end
                 else 'unvalidated' end as outcome
  from ranked where n = 1
)
select 'v' || p as record_id, k as canonical_url, 'r' || rp as response_id, outcome,
       case when outcome = 'resolved' then 'cache-control: max-age=120' || chr(10) || 'content-length: ' || strlen(rhtml) || chr(10)
         || 'content-type: text/html' || chr(10) || 'date: ' || at_text || chr(10) || 'etag: ' || coalesce(sent, rtag) || chr(10)
         || 'last-modified: ' || rmade end as headers,
       case when outcome = 'resolved' then 'md5:' || md5(rhtml) end as digest
from judged
"""


def _merkle(levels: int = 5) -> str:
    """Trees of up to ``16 ** levels`` leaves, level by level; a tree of one node stays as it is."""
    def field(column: str) -> str:
        return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    n, parts = merkle.ARITY, [f"""crc(c) as (
  select list(x order by i) from (select i, list_reduce(list_prepend(i, range(8)),
    lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as x from range(256) r(i))
), docs as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda x, b: xor(c[(xor(x, b) & 255) + 1], x >> 8))) % 5 = 0 as tampered
  from documents, crc
), own as (
  select doc_id, coalesce('+' || source, '') as key, {leaf("text")} as leaf,
         case when tampered then {leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} end as shown
  from docs
), s_leaves as (
  select *, (row_number() over (partition by key order by doc_id nulls first, leaf)) - 1 as place from own
), s0 as (select key, place, leaf as h from s_leaves)"""]

    def rise(name: str) -> None:
        for k in range(levels):
            parts.append(f"""{name}{k}r as (
  select key, place // {n} as up, list(h order by place) as hs, count(*) over (partition by key) as runs from {name}{k} group by key, place // {n}
), {name}{k + 1} as (
  select key, up as place, case when runs = 1 and len(hs) = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h from {name}{k}r
)""")

    def steps(name: str, rows: str, place: str) -> str:
        """(siblings so far, folded so far) of the rows after all levels of a tree."""
        for k in range(levels):
            at = f"({place} // {n ** k}) % {n} + 1"
            alone = f"(r.runs = 1 and len(r.hs) = 1)"
            left, right = f"array_to_string(r.hs[:{at} - 1], '')", f"array_to_string(r.hs[{at} + 1:], '')"
            parts.append(f"""{rows}{name}{k} as (
  select x.* exclude (proof, folded), proof || {left} || {right} as proof,
         case when {alone} then folded else sha256({left} || folded || {right}) end as folded
  from {rows if k == 0 else f"{rows}{name}{k - 1}"} x join {name}{k}r r on r.key = x.{name}key and r.up = x.{place} // {n ** (k + 1)}
)""")
        return f"{rows}{name}{levels - 1}"

    rise("s")
    parts.append(f"""t0 as (select 0 as key, row_number() over (order by key) - 1 as place, key as skey, h from s{levels} where place = 0)""")
    rise("t")
    parts.append("""walk as (
  select l.doc_id, l.leaf, l.key as skey, 0 as tkey, l.place, t.place as tree, t.h as subroot, '' as proof, coalesce(shown, leaf) as folded
  from s_leaves l join t0 t on t.skey = l.key
)""")
    last = steps("t", steps("s", "walk", "place"), "tree")
    return "with " + ", ".join(parts) + f"""
select doc_id, leaf, subroot, root.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = root.h as verified
from {last}, t{levels} root"""


ORACLES["op11_merkle_manifest"] = _merkle()

ORACLES["op12_ranked_search"] = rf"""
with split as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term, rid
  from (select *, row_number() over () as rid from documents)
), tf as (select rid, doc_id, term, count(*) as tf from split group by all),
lengths as (select rid, sum(tf)::bigint as n from tf group by rid),
corpus as (select count(*) as docs, sum(n)::bigint as total from lengths),
items as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, corpus group by term, docs
), scores as (
  select item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::bigint as score
  from items join weights using (term) join tf using (term) join lengths using (rid), corpus group by item_id, rid, doc_id
)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0
) where rank <= 50
"""
