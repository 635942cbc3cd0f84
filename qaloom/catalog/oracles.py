"""The registered queries again, as DuckDB SQL over the same tables."""

from __future__ import annotations

from qaloom.catalog import views as V
from qaloom.catalog.views import AS_OF, TOOL_SCHEMA
from qaloom.functions import validation as vd
from qaloom.operators import decisions as D
from qaloom.operators import leases as L
from qaloom.operators import rules as R
from qaloom.sources import documents as docs
from qaloom.sources import imports as im

VIEWS = {
    "v_records": """
  select conv_id*4294967296+turn as position, cast(conv_id as varchar) as source_id,
         coalesce(sys,'') as instruction, text as input_text, nt as output
  from (select conv_id, turn, role, text,
               lead(role) over (partition by conv_id order by turn) nr,
               lead(text) over (partition by conv_id order by turn) nt,
               max(case when role='system' then text end) over (partition by conv_id) sys
        from conversations) t
  where role='user' and nr='assistant'""",
    "v_batches": """
  select cast(substr(source,4) as bigint) as id, concat(source,'.json') as filename,
         sha256(source) as file_hash,
         timestamp '2024-01-01 00:00:00' + to_hours(cast(substr(source,4) as int)) as uploaded_at,
         case when cast(substr(source,4) as int)%10=9 then 'uploading' else 'ready' end as status,
         count(*) as imported_count, cast(0 as bigint) as skipped_count
  from documents group by source""",
    "v_questions": """
  select doc_id as id, cast(substr(source,4) as bigint) as batch_id,
         cast(doc_id%500 as varchar) as source_id, lang as instruction, text as input_text,
         translate(text,'.,','') as output
  from documents""",
    "v_reviews": """
  select doc_id+1 as id, doc_id as question_id,
         case when quality=1 then 'Pass' else 'Fail' end as decision,
         case when quality=1 then '' when toxic=1 then 'toxic' else 'low quality' end as notes,
         concat('r',cast(doc_id%7 as varchar)) as reviewer,
         timestamp '2024-01-01 00:00:00' + to_minutes(7*doc_id) as reviewed_at
  from labels""",
    "v_leases": """
  select s_suppkey as question_id, concat('r',cast(s_suppkey%7 as varchar)) as reviewer,
         concat('s',cast(s_suppkey%11 as varchar)) as session_id,
         timestamp '2024-01-10 00:00:00' + to_minutes(s_suppkey%60) as last_activity_at,
         timestamp '2024-01-10 00:30:00' + to_minutes(s_suppkey%60) as lease_expires_at
  from supplier""",
    "v_tool_records": f"""
  select event_id as position, cast(event_id as varchar) as source_id,
         case when event_id%17=0 then 'no tools' else '{TOOL_SCHEMA}' end as instruction,
         event_type as input_text, event_type, props,
         case when event_id%10=0 then 'no call'
              else concat('<tool_call>{{"name": "',event_type,'", "arguments": ',props,',}}</tool_call>') end as output
  from events""",
    "v_claims": """
  select event_id as claim_id, concat(' r',cast(user_id as varchar)) as reviewer,
         concat('s',cast(user_id%3 as varchar)) as session_id,
         cast(json_extract_string(props,'$.k') as bigint) as exclude_question_id
  from events""",
    "v_requests": """
  select o_orderkey as request_id, o_custkey as question_id,
         concat('r',cast(o_custkey%7 as varchar)) as reviewer,
         concat('s',cast((o_custkey + case when o_orderpriority='1-URGENT' then 1 else 0 end)%11 as varchar)) as session_id,
         case o_orderstatus when 'F' then 'Fail' when 'O' then 'Pass' else 'Maybe' end as decision,
         case when o_totalprice>250000 then 'costly' else '' end as notes,
         timestamp '2024-01-10 00:30:00' + to_minutes(o_orderkey%60) as requested_at
  from orders""",
    "v_raw": """
  select concat('u', cast(user_id as varchar)) as file, event_id + 1 as row, event_type, cast(value as decimal(12,1)) as value,
         case event_type
           when 'click' then concat('{"id": ', event_id, ', "instruction": "i", "input": ["a", "b"], "output": "ok", "more": ', props, '}')
           when 'view' then concat('{"id": ', event_id, ', "instruction": "i", "input": "one"}')
           when 'purchase' then concat('{"id": ', cast(value as decimal(12,1)), ', "instruction": "i", "input": "one", "output": "ok"}')
           when 'signup' then concat('{"id": ', event_id, ', "instruction": "i", "input": ["a", ', props, '], "output": "ok"}')
           else concat('[', props, ']') end as line
  from events""",
    "v_lease_events": """
  select event_id, timestamp '2024-01-01 00:00:00' + to_seconds(event_id) as moment,
         user_id*10 + cast(json_extract_string(props,'$.k') as bigint)//10 as question_id,
         concat('r', cast(json_extract_string(props,'$.k') as bigint) % 2) as reviewer,
         case event_type when 'signup' then 'claim' when 'view' then 'renew' when 'error' then 'skip'
              else 'submit' end as action,
         case event_type when 'purchase' then 'Fail' when 'click' then 'Pass' end as decision,
         case event_type when 'purchase' then 'wrong' else '' end as notes
  from events""",
}
ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, ctes: str = "") -> None:
    """Register SQL; the views it names come first as common table expressions."""
    text = f"{ctes}\n{body}"
    used = [f"{view} as ({sql})" for view, sql in VIEWS.items() if view in text]
    if ctes:
        used.append(ctes.strip().rstrip(","))
    head = "with recursive " + ",\n".join(used) + "\n" if used else ""
    ORACLES[name] = head + body.strip()


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Whole-text helpers, as SQL expressions.
def _marks(text: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({text}, '\\p{{P}}')))"


def _words(text: str) -> str:
    bare = "regexp_replace(regexp_replace(w, '^\\p{P}+', ''), '\\p{P}+$', '')"
    return f"[v for v in [{bare} for w in regexp_split_to_array({text}, '\\s+')] if v <> '']"


def _hash(instruction: str, parts: str, output: str) -> str:
    return f"sha256({instruction} || chr(31) || {parts} || chr(31) || {output})"


_NOTE = "case chk " + " ".join(f"when '{k}' then '{v}'" for k, v in R.NOTES.items()) + " end"

# ---- text functions ---------------------------------------------------------

oracle("punctuation_set", f"select doc_id, array_to_string({_marks('text')}, '') as marks from documents")
oracle("words", f"""
select doc_id, cast(len(w) as bigint) as n_words, sha256(array_to_string(w, ' ')) as words_hash
from (select doc_id, {_words('text')} as w from documents)""")
oracle("row_hash", f"select id, {_hash('instruction', 'input_text', 'output')} as row_hash from v_questions")
oracle("text_flags", """
select doc_id, cast(regexp_matches(text, '[\\p{Latin}]') as int) as latin,
       cast(regexp_matches(text, '\\p{P}') as int) as marks,
       length(regexp_replace(regexp_replace(text, '^\\p{P}+', ''), '\\p{P}+$', '')) as trimmed_chars,
       length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) as stripped_chars
from documents""")

# ---- rules ------------------------------------------------------------------

_RECORD_RULES = f"""
r_fired as (
  select *, row_number() over (partition by instruction, input_text order by position) > 1 as dup,
         regexp_matches(output, '\\p{{Latin}}') as eng, {_marks('input_text')} <> {_marks('output')} as pun
  from v_records)"""
oracle("failure_rows", f"""
select position, source_id, instruction, input_text as input, output,
       concat_ws(chr(10), case when dup then '{R.NOTES['duplicate']}' end,
                 case when eng then '{R.NOTES['english']}' end,
                 case when pun then '{R.NOTES['punctuation']}' end) as notes,
       concat_ws(chr(10), case when dup then 'duplicate' end, case when eng then 'english' end,
                 case when pun then 'punctuation' end) as "check",
       {_hash('instruction', 'input_text', 'output')} as row_hash
from r_fired where dup or eng or pun""", _RECORD_RULES)
oracle("rule_duplicate", """
select position, source_id from (
  select id as position, source_id,
         row_number() over (partition by instruction, input_text order by id) as n from v_questions)
where n > 1""")
oracle("rule_english", "select position, source_id from v_records where regexp_matches(output, '\\p{Latin}')")
oracle("rule_punctuation", f"""
select position, source_id from v_records where {_marks('input_text')} <> {_marks('output')}""")
oracle("rule_output_punctuation", """
select id as position, source_id from v_questions where regexp_matches(output, '\\p{P}')""")
_MISMATCH_CTE = f"""
q_pairs as (
  select distinct w.id, w.word from (
    select id, unnest({_words('output')}) as word from v_questions) w
  where not exists (select 1 from (
    select id, unnest({_words('input_text')}) as word from v_questions) a
    where a.id = w.id and a.word = w.word)),
q_mismatch as (select distinct id from q_pairs)"""
oracle("rule_word_mismatch", """
select q.id as position, q.source_id from v_questions q join q_mismatch m on m.id = q.id""", _MISMATCH_CTE)
oracle("rule_not_an_option", f"""
select position, source_id from v_records
where regexp_replace(regexp_replace(output, '^\\s+', ''), '\\s+$', '') not in ({_quoted(R.GRAMMAR_OPTIONS)})""")

# A tool call names its event type; each type has one fixed outcome under the schema.
_TOOL_OUTCOME = f"""
t_out as (
  select *, case when instruction = 'no tools' then '{R.NO_SCHEMA}'
                 when output = 'no call' then '{R.NO_CALL}' end as reason
  from v_tool_records),
t_args as (
  select *,
         [k for k in json_keys(props) if not list_contains(
             case event_type when 'click' then ['k'] when 'view' then ['k','v']
                  when 'purchase' then ['amount'] else []::varchar[] end, k)] as extra,
         [r for r in case event_type when 'click' then ['k'] when 'view' then ['k','v']
                     when 'purchase' then ['amount','ghost'] else []::varchar[] end
          if not list_contains(json_keys(props), r)] as lacking
  from t_out),
t_checks as (
  select position, source_id, reason,
         case when reason is not null then ''
              when event_type not in ('click','view','purchase','error') then 'unknown_tool'
              else concat_ws('|', case when len(extra) > 0 then 'unknown_argument' end,
                             case when len(lacking) > 0 then 'missing_required' end) end as checks
  from t_args)"""
oracle("rule_tool_calling", "select position, checks, reason from t_checks", _TOOL_OUTCOME)
oracle("unchecked_rows", "select source_id, reason from t_checks where reason is not null", _TOOL_OUTCOME)
oracle("findings", f"""
select position, source_id, chk as "check", {_NOTE} as note from (
  select q.id as position, q.source_id, unnest([c for c in [
    case when row_number() over (partition by instruction, input_text order by q.id) > 1 then 'duplicate' end,
    case when instruction = 'fr' and regexp_matches(output, '\\p{{Latin}}') then 'english' end,
    case when instruction = 'fr' and {_marks('input_text')} <> {_marks('output')} then 'punctuation' end,
    case when instruction not in ('fr','de','es') and regexp_matches(output, '\\p{{P}}') then 'output_punctuation' end,
    case when instruction not in ('fr','de','es') and m.id is not null then 'word_mismatch' end,
    case when instruction = 'de' and output not in ({_quoted(R.GRAMMAR_OPTIONS)}) then 'not_an_option' end
  ] if c is not null]) as chk
  from v_questions q left join q_mismatch m on m.id = q.id)""", _MISMATCH_CTE)
oracle("rule_summary", """
select 'read' as section, '' as label, count(*) as records, min(position) as first_position from s_all
union all select 'failed', '', count(*), min(position) from s_all where checks <> ''
union all select 'unchecked', '', count(*), min(position) from s_all where reason is not null
union all select 'reason', reason, count(*), min(position) from s_all where reason is not null group by reason
union all select 'check', chk, count(*), min(position)
  from (select position, unnest(string_split(checks, '|')) as chk from s_all where checks <> '') group by chk""",
_TOOL_OUTCOME + """,
s_dup as (
  select position, row_number() over (partition by instruction, input_text order by position) > 1 as dup
  from v_tool_records),
s_all as (
  select c.position, c.reason,
         concat_ws('|', case when dup then 'duplicate' end, nullif(checks, '')) as checks
  from t_checks c join s_dup d on d.position = c.position)""")


# ---- analytics --------------------------------------------------------------

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {column}"


def _progress(source: str, by: str = "") -> str:
    group = f"group by {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""
select *, greatest(total - reviewed - assigned, 0) as pending,
       case when reviewed > 0 then round_even(passed / reviewed * 100, 1) else 0.0 end as pass_rate,
       case when total > 0 then reviewed / total else 0.0 end as progress_ratio
from (
  select {head}count(*) as total, count(r.id) as reviewed,
         count(*) filter (r.decision = 'Pass') as passed, count(*) filter (r.decision = 'Fail') as failed,
         count(*) filter (r.id is null and l.lease_expires_at > timestamp '{AS_OF}') as assigned
  from {source} q left join v_reviews r on r.question_id = q.id
  left join v_leases l on l.question_id = q.id {group})"""


oracle("progress", _progress("v_questions"))
oracle("progress_by_batch", _progress("v_questions", "batch_id"))
oracle("progress_ready", _progress(
    "(select * from v_questions where batch_id in (select id from v_batches where status = 'ready'))"))
oracle("pass_rate", """
select reviewer, count(*) as reviewed, count(*) filter (decision = 'Pass') as passed,
       round_even(count(*) filter (decision = 'Pass') / count(*) * 100, 1) as pass_rate
from v_reviews group by reviewer""")
oracle("by_reviewer", """
select reviewer, count(*) as reviews from v_reviews r join v_questions q on q.id = r.question_id
group by reviewer order by reviews desc, reviewer""")
oracle("over_time", """
select strftime(reviewed_at, '%Y-%m-%d') as date, count(*) as reviews
from v_reviews r join v_questions q on q.id = r.question_id group by 1 order by 1""")
oracle("share_of_max", """
select reviewer, count(*) as reviews, count(*) / max(count(*)) over () * 100 as percent
from v_reviews group by reviewer""")
_LISTED = """
b_listed as (
  select b.id, any_value(filename) as filename, any_value(file_hash) as file_hash,
         any_value(uploaded_at) as uploaded_at, any_value(imported_count) as imported_count,
         any_value(skipped_count) as skipped_count, any_value(status) as status,
         count(q.id) as stored, count(r.id) as reviewed
  from v_batches b left join v_questions q on q.batch_id = b.id
  left join v_reviews r on r.question_id = q.id group by b.id)"""
oracle("batch_list", f"""
select id, filename, file_hash, {_ts('uploaded_at')}, imported_count, skipped_count, status, stored, reviewed
from b_listed order by id desc""", _LISTED)
oracle("held_back", """
select cast(coalesce(sum(stored) filter (status <> 'ready'), 0) as bigint) as questions,
       count(*) filter (status <> 'ready') as uploads from b_listed""", _LISTED)
_SEARCHED = f"""
s_rows as (
  select r.id as review_id, q.id as question_id, q.source_id, q.batch_id, b.filename, q.instruction,
         q.input_text as question, q.output, r.decision, r.notes, r.reviewer, r.reviewed_at
  from v_reviews r join v_questions q on q.id = r.question_id join v_batches b on b.id = q.batch_id)"""


def _like(columns: str, pattern: str) -> str:
    return " or ".join(f"lower({c}) like '{pattern}' escape '\\'" for c in columns.split())


oracle("review_search", f"""
select * replace ({_ts('reviewed_at')}) from (
  select * from s_rows
  where {_like('source_id instruction question output notes reviewer filename', '%the%_r%')}
  order by reviewed_at desc, review_id desc limit 50) where decision = 'Pass'""", _SEARCHED)
oracle("review_search_by_id", f"""
select review_id, source_id, instruction, question, output, decision, notes, reviewer, {_ts('reviewed_at')}
from s_rows where {_like('source_id instruction output notes reviewer', '%r3%')}
order by review_id desc limit 500""", _SEARCHED)
oracle("export_rows", """
select instruction, question, output, decision as "pass/fail", notes from s_rows
order by reviewed_at, review_id""", _SEARCHED)

# ---- leases and decisions ---------------------------------------------------

oracle("lease_status", f"""
select question_id, reviewer,
       case when lease_expires_at > timestamp '{AS_OF}' then 'live' else 'expired' end as status from v_leases""")
oracle("lease_expiry_audit", f"""
select 'lease_expired' as event_type, question_id, cast(null as bigint) as review_id, reviewer as actor,
       '{{}}' as details_json, '{AS_OF}' as created_at
from v_leases where lease_expires_at <= timestamp '{AS_OF}'""")
oracle("renew_batch", f"""
select r.request_id, r.question_id, r.reviewer,
       case when l.question_id is not null then 1 else 0 end as renewed
from v_requests r left join v_leases l on l.question_id = r.question_id and l.reviewer = r.reviewer
 and l.session_id = r.session_id and l.lease_expires_at > timestamp '{AS_OF}'""")
oracle("renewed_leases", f"""
select question_id, reviewer, session_id, strftime(last_activity_at, '%Y-%m-%d %H:%M:%S') as assigned_at,
       '{AS_OF}' as last_activity_at,
       strftime(timestamp '{AS_OF}' + interval 30 minute, '%Y-%m-%d %H:%M:%S') as lease_expires_at
from v_leases l where lease_expires_at > timestamp '{AS_OF}' and exists (
  select 1 from v_requests r where l.question_id = r.question_id and l.reviewer = r.reviewer
   and l.session_id = r.session_id)""")
oracle("skip_batch", f"""
select request_id, question_id, reviewer,
       case when not held or row_number() over (
         partition by question_id, reviewer, session_id order by request_id) > 1 then '{L.INACTIVE}' end as reason
from (select r.*, l.question_id is not null as held from v_requests r
      left join v_leases l on l.question_id = r.question_id and l.reviewer = r.reviewer
       and l.session_id = r.session_id)""")
_SUBMIT = f"""
m_seen as (
  select r.*, case
      when decision not in ('Pass','Fail') then '{D.BAD_DECISION.replace("'", "''")}'
      when decision = 'Fail' and notes = '' then '{D.NOTES_REQUIRED}'
    end as invalid,
    exists (select 1 from labels w where w.doc_id = r.question_id) as reviewed,
    exists (select 1 from v_leases l where l.question_id = r.question_id and l.reviewer = r.reviewer
            and l.session_id = r.session_id and l.lease_expires_at > r.requested_at) as held
  from v_requests r),
m_first as (
  select *, sum(case when invalid is null and not reviewed and held then 1 else 0 end) over (
      partition by question_id order by requested_at, request_id
      rows between unbounded preceding and 1 preceding) as won_before
  from m_seen),
m_out as (
  select *, case when invalid is not null then invalid
                 when reviewed or coalesce(won_before, 0) > 0 then '{D.REVIEWED}'
                 when not held then '{L.INACTIVE}' end as reason
  from m_first)"""
oracle("submit_batch", "select request_id, question_id, reviewer, reason from m_out", _SUBMIT)
oracle("submitted_reviews", f"""
select question_id, decision, case when decision = 'Pass' then '' else notes end as notes, reviewer,
       strftime(requested_at, '%Y-%m-%d %H:%M:%S') as reviewed_at
from m_out where reason is null""", _SUBMIT)
_HELD = f"""
l_held as (
  select reviewer, session_id, min(question_id) as question_id from v_leases
  where lease_expires_at > timestamp '{AS_OF}' and question_id not in (select doc_id from labels)
  group by reviewer, session_id)"""
oracle("claim_resume", """
select distinct r.reviewer, r.session_id, l.question_id
from v_requests r join l_held l on l.reviewer = r.reviewer and l.session_id = r.session_id""", _HELD)
oracle("claim_batch", """
select trim(v.reviewer) as reviewer, v.session_id, v.claim_id, v.exclude_question_id, a.question_id,
       case when v.claim_id <> a.claim_id and a.outcome = 'claimed' then 'resumed' else a.outcome end as outcome
from v_claims v join (
select reviewer, session_id, claim_id, question_id, 'resumed' as outcome from c_valid
where question_id is not null
union all
select p.reviewer, p.session_id, p.claim_id, given as question_id,
       case when given is null then 'none' else 'claimed' end
from (
  select p.*, case when clash and c.n = 1 then s.spare when clash then k.question_id
                   when p.rank = h.heir then c.only_question else p.question_id end as given
  from c_pairs p cross join c_clash c cross join c_spare s cross join c_heir h
  left join c_ring g on g.rank = p.rank left join c_ring k on k.ring = g.ring % c.n + 1) p
) a on a.reviewer = trim(v.reviewer) and a.session_id = v.session_id""",
_HELD + f""",
c_one as (
  select trim(reviewer) as reviewer, session_id, min(claim_id) as claim_id,
         arg_min(exclude_question_id, claim_id) as exclude_question_id
  from v_claims group by 1, 2),
c_valid as (
  select c.*, l.question_id from c_one c left join l_held l
    on l.reviewer = c.reviewer and l.session_id = c.session_id),
c_asking as (
  select *, row_number() over (order by sha256('seed:' || reviewer || ':' || session_id)) as rank
  from c_valid where question_id is null),
c_pool as (
  select id, row_number() over (order by sha256('seed:' || cast(id as varchar))) as rank from v_questions
  where batch_id in (select id from v_batches where status = 'ready')
    and id not in (select doc_id from labels)
    and id not in (select question_id from v_leases where lease_expires_at > timestamp '{AS_OF}')),
c_pairs as (
  select a.reviewer, a.session_id, a.claim_id, a.exclude_question_id, a.rank, p.id as question_id,
         coalesce(p.id = a.exclude_question_id, false) as clash
  from c_asking a left join c_pool p on p.rank = a.rank),
c_ring as (
  select rank, question_id, row_number() over (
    order by sha256('seed:' || reviewer || ':' || session_id)) as ring from c_pairs where clash),
c_clash as (select count(*) as n, min(question_id) as only_question from c_ring),
c_spare as (select min(id) as spare from c_pool where rank = (select max(rank) + 1 from c_asking)),
c_heir as (
  select min(p.rank) as heir from c_pairs p cross join c_clash c cross join c_spare s
  where p.question_id is null and c.n = 1 and s.spare is null
    and p.exclude_question_id is distinct from c.only_question)""")
_BULK = f"""
u_items as (
  select source_id, row_hash, arg_max(notes, ord) as item_notes from (
    select source_id, '{R.NOTES['duplicate']}' as notes, position as ord,
           {_hash('instruction', 'input_text', 'output')} as row_hash
    from (select *, id as position, row_number() over (
            partition by instruction, input_text order by id) as n from v_questions) where n > 1
    union all
    select source_id, concat_ws(chr(10), case when dup then '{R.NOTES['duplicate']}' end,
             case when eng then '{R.NOTES['english']}' end, case when pun then '{R.NOTES['punctuation']}' end),
           position, {_hash('instruction', 'input_text', 'output')}
    from r_fired where dup or eng or pun)
  group by source_id, row_hash),
u_keyed as (
  select id as question_id, source_id, {_hash('instruction', 'input_text', 'output')} as row_hash
  from v_questions),
u_actions as (
  select k.question_id, k.source_id, k.row_hash, i.item_notes, r.id as review_id, r.decision,
         case r.decision when 'Fail' then 'already_failed' when 'Pass' then 'overwritten'
              else 'failed' end as action
  from u_keyed k join u_items i on i.source_id = k.source_id and i.row_hash = k.row_hash
  left join v_reviews r on r.question_id = k.question_id)"""
_BULK = _RECORD_RULES + "," + _BULK
oracle("bulk_fail_actions", "select question_id, source_id, row_hash, item_notes, action from u_actions", _BULK)
_UNMATCHED = """from u_items i where not exists (
  select 1 from u_keyed k where k.source_id = i.source_id and k.row_hash = i.row_hash)"""
oracle("bulk_fail_unmatched", f"select source_id, row_hash {_UNMATCHED}", _BULK)
oracle("bulk_fail_summary", f"""
select count(*) filter (action = 'failed') as failed, count(*) filter (action = 'overwritten') as overwritten,
       count(*) filter (action = 'already_failed') as already_failed,
       (select count(*) {_UNMATCHED}) as unmatched from u_actions""", _BULK)
oracle("auto_vs_human", f"""
select kind, count(*) as reviews, count(*) filter (decision = 'Fail') as failed from (
  select 'human' as kind, decision from v_reviews
  where question_id not in (select question_id from u_actions where action = 'overwritten')
  union all select 'automatic', 'Fail' from u_actions where action <> 'already_failed')
group by kind""", _BULK)
_RESET = f"""
z_out as (
  select request_id, question_id as review_id,
         case when question_id not in (select doc_id + 1 from labels) or row_number() over (
           partition by question_id order by request_id) > 1 then '{D.NO_REVIEW}' end as reason
  from v_requests)"""
oracle("reset_reviews", "select request_id, review_id, reason from z_out", _RESET)
oracle("delete_batches", f"""
select n.batch_id, coalesce(stored, 0) as stored, coalesce(reviewed, 0) as reviewed,
       case when b.id is null then '{D.NO_UPLOAD}'
            when reviewed > 0 then cast(reviewed as varchar) || '{D.HAS_REVIEWS}' end as reason
from (select distinct cast(n_nationkey as bigint) as batch_id from nation) n
left join v_batches b on b.id = n.batch_id
left join (select batch_id, count(*) as stored, count(r.id) as reviewed from v_questions q
           left join v_reviews r on r.question_id = q.id group by 1) c on c.batch_id = n.batch_id""")
oracle("audit_by_type", f"""
select 'lease_expired' as event_type, count(*) as events from v_leases
where lease_expires_at <= timestamp '{AS_OF}' having count(*) > 0
union all
select 'skip', count(*) from (
  select distinct l.question_id from v_leases l join v_requests r on l.question_id = r.question_id
   and l.reviewer = r.reviewer and l.session_id = r.session_id) having count(*) > 0
union all select 'review_reset', count(*) from z_out where reason is null having count(*) > 0
union all
select case action when 'failed' then 'auto_fail' else 'review_overridden' end, count(*)
from u_actions where action <> 'already_failed' group by 1""", _BULK + "," + _RESET)
oracle("lease_sessions", """
select question_id, session_no, strftime(min(moment), '%Y-%m-%d %H:%M:%S') as started_at,
       strftime(max(moment), '%Y-%m-%d %H:%M:%S') as last_at, count(*) as events
from (select question_id, moment, cast(sum(new) over (partition by question_id order by moment) as bigint) as session_no
      from (select question_id, moment, case when moment - lag(moment) over (partition by question_id order by moment)
                   < interval 30 minute then 0 else 1 end as new from v_lease_events))
group by question_id, session_no""")


# ---- ingest -----------------------------------------------------------------

oracle("parse_documents", f"""
select event_id, case when ok and json_type(plain, '$.data') = 'ARRAY' then json_array_length(plain, '$.data')::bigint end as n_records,
       case when not ok then '{docs.NOT_JSON}' when coalesce(json_type(plain, '$.data'), '') <> 'ARRAY'
            then '{docs.NO_DATA.replace("'", "''")}' end as error
from (select *, json_valid(plain) as ok from (select row - 1 as event_id, case (row - 1) % 7
        when 0 then '{{"data": [' || line || ']}}' when 1 then '{{"x": {{"data": 1}}, "data": [' || line || ', 5, ' || line || ']}}'
        when 2 then '{{"rows": [' || line || ']}}' when 3 then '[' || line || ']' when 4 then '{{"data": [' || line || ']'
        when 5 then '{{"data": []}}' || line else '{{"data": ["' || (row - 1) || '"]}}' end as plain from v_raw))""")
_JSON_LINES = f"""
l_lines as (
  select n // {V.LINES_PER_FILE} as up, n % {V.LINES_PER_FILE} + 1 as row,
         case when n % 13 = 0 then '' when n % 11 = 0 then line || '}}' when n % 19 = 0 then line || ' ' || line
              when n % 23 = 0 then line || chr(13) else line end as line
  from (select row - 1 as n, line from v_raw))"""
oracle("json_lines", """
select up, row, json_valid(line) as is_json, case when json_valid(line) then json_extract_string(line, '$.output') end as output
from l_lines where line <> ''""", _JSON_LINES)
oracle("json_lines_digests", f"""
select up, lines, sha256(size || ':' || sha256(h)) as file_hash from (
  select up, lines, size, sha256(string_agg(h, '' order by pos)) as h from (
    select up, pos // {docs.FAN} as pos, any_value(lines) as lines, any_value(size) as size, sha256(string_agg(h, '' order by pos)) as h from (
      select up, (row - 1) // {docs.FAN} as pos, sum(count(*)) over (partition by up)::bigint as lines,
             sum(sum(strlen(line) + 1)) over (partition by up) as size, sha256(string_agg(sha256(line), '' order by row)) as h
      from l_lines group by up, (row - 1) // {docs.FAN}) group by up, pos // {docs.FAN}) group by up, lines, size)""", _JSON_LINES)

_TYPES = """
i_types as (
  select *, json_type(line) as whole, json_type(line, '$.id') as id_type,
         json_type(line, '$.instruction') as instruction_type, json_type(line, '$.output') as output_type,
         json_type(line, '$.input') as input_type,
         coalesce(len([e for e in json_extract(line, '$.input[*]') if json_type(e) <> 'VARCHAR']), 0) as odd_parts,
         json_extract_string(line, '$.id') as id_text
  from v_raw),
i_tests as (
  select *, whole = 'OBJECT' as is_object, coalesce(instruction_type = 'VARCHAR', false) as instruction_ok,
         coalesce(output_type = 'VARCHAR', false) as output_ok,
         coalesce(id_type in ('BIGINT', 'UBIGINT'), false) as id_ok,
         coalesce(id_type in ('BIGINT', 'UBIGINT') or (id_type = 'DOUBLE'
                  and cast(id_text as double) = floor(cast(id_text as double))), false) as whole_id_ok,
         coalesce(input_type = 'VARCHAR' or (input_type = 'ARRAY' and odd_parts = 0), false) as input_ok
  from i_types)"""


def _message(messages: dict[str, str], first: str, id_test: str) -> str:
    m = {k: v.replace("'", "''") for k, v in messages.items()}
    return f"""case {first} when not {id_test} then '{m['id']}'
       when not instruction_ok then '{m['instruction']}' when not input_ok then '{m['input']}'
       when not output_ok then '{m['output']}' end"""


_BROWSER = _message(vd.BROWSER_MESSAGES, f"""when whole not in ('OBJECT', 'ARRAY')
       then '{vd.BROWSER_MESSAGES['object']}'""", "whole_id_ok")
_ABSENT = "[f for f in ['id','instruction','input','output'] if not json_exists(line, '$.' || f)]"
_STORE = _message(vd.STORE_MESSAGES, f"""when not is_object then '{vd.STORE_MESSAGES['object']}'
       when len({_ABSENT}) > 0 then concat('Missing required field(s): ', array_to_string({_ABSENT}, ', '), '.')""",
       "id_ok")
_API = _message(vd.BROWSER_MESSAGES, f"when not is_object then '{vd.BROWSER_MESSAGES['object']}'", "whole_id_ok")
_CHECKER = f"""case when not is_object then '{vd.CHECKER_MESSAGES['object']}'
       when not instruction_ok or not output_ok then '{vd.CHECKER_MESSAGES['text']}'
       when not input_ok then '{vd.CHECKER_MESSAGES['input']}' end"""
for _name, _sql in {"store": _STORE, "browser": _BROWSER, "api": _API, "checker": _CHECKER}.items():
    oracle(f"validate_{_name}", f"select file, row, {_sql} as message from i_tests", _TYPES)
oracle("input_normalised", f"""
select row, case when id_type = 'DOUBLE' then cast(cast(cast(id_text as double) as bigint) as varchar) else id_text end as source_id,
       cast(case when input_type = 'VARCHAR' then 1 else json_array_length(line, '$.input') end as bigint) as n_parts,
       case when input_type = 'VARCHAR' then json_extract_string(line, '$.input')
            else array_to_string(json_extract_string(line, '$.input[*]'), chr(10)) end as input,
       case when input_type = 'VARCHAR' then '["one"]' else '["a", "b"]' end as stored
from i_tests where ({_BROWSER}) is null""", _TYPES)
oracle("load_records", f"""
select file, row_number() over (partition by file order by row) - 1 as position,
       case when id_type = 'DOUBLE' and whole_id_ok
            then cast(cast(cast(id_text as double) as bigint) as varchar) else id_text end as source_id
from i_tests where ({_CHECKER}) is null""", _TYPES)
oracle("malformed_rows", f"""
select file, case when is_object then id_text else concat('row ', row) end as source_id, {_CHECKER} as reason
from i_tests where ({_CHECKER}) is not null""", _TYPES)
oracle("upload_preview", f"""
select file, count(*) filter (({_STORE}) is null) as valid_count,
       count(*) filter (({_STORE}) is not null) as skipped_count from i_tests group by file""", _TYPES)
_IMPORT = _TYPES + f""",
i_files as (
  select file, file_hash, row_number() over (order by file_hash)
           + (select max(id) from v_batches) as batch_id
  from (select file, sha256(cast(same as varchar)) as file_hash,
               row_number() over (partition by same order by file) as n
        from (select distinct file, number - (number % 4 = 3)::bigint as same
              from (select file, cast(substr(file, 2) as bigint) as number from v_raw)))
  where n = 1)"""
oracle("import_batches", f"""
select batch_id as id, any_value(f.file || '.json') as filename, any_value(file_hash) as file_hash,
       '{AS_OF}' as uploaded_at, count(*) filter (({_STORE}) is null) as imported_count,
       count(*) filter (({_STORE}) is not null) as skipped_count, 'ready' as status
from i_files f join i_tests t on t.file = f.file group by batch_id""", _IMPORT)
oracle("import_questions", f"""
select batch_id * 4294967296 + row as id, batch_id, id_text as source_id,
       json_extract_string(line, '$.instruction') as instruction,
       case when input_type = 'VARCHAR' then json_extract_string(line, '$.input')
            else array_to_string(json_extract_string(line, '$.input[*]'), chr(10)) end as input,
       json_extract_string(line, '$.output') as output, '{AS_OF}' as imported_at
from i_files f join i_tests t on t.file = f.file where ({_STORE}) is null""", _IMPORT)
oracle("file_dedupe", f"""
select doc_id as file, case when row_number() over (partition by text order by doc_id) > 1
         or text in (select text from benchmark) then '{im.DUPLICATE_FILE}' end as reason
from documents""")
oracle("finish_import", f"""
select n.batch_id, case when b.status is distinct from 'uploading' then '{im.NOT_OPEN}' end as reason
from (select distinct cast(n_nationkey as bigint) as batch_id from nation) n
left join v_batches b on b.id = n.batch_id""")
oracle("import_chunks", """
select b.id, imported_count + count(*) as imported_count,
       skipped_count + count(*) filter (event_type = 'error') as skipped_count
from v_batches b join events e on e.user_id = b.id
where status = 'uploading' group by b.id, imported_count, skipped_count""")
oracle("failure_reader", f"""
select position, source_id, concat_ws(chr(10), case when dup then '{R.NOTES['duplicate']}' end,
         case when eng then '{R.NOTES['english']}' end, case when pun then '{R.NOTES['punctuation']}' end) as notes,
       {_hash('instruction', 'input_text', 'output')} as row_hash
from r_fired where dup or eng or pun""", _RECORD_RULES)

# ---- JSON in text -----------------------------------------------------------

# The one schema of the tool records, with its comment and loose comma removed by hand.
_PLAIN_SCHEMA = TOOL_SCHEMA.replace("// first", "").replace('"v",]', '"v"]')
oracle("relaxed_json", f"""
select position, case when instruction = 'no tools' then instruction else '{_PLAIN_SCHEMA}' end as instruction,
       replace(output, ',}}</tool_call>', '}}</tool_call>') as output from v_tool_records""")
oracle("contains_json", """
select event_id, cast(json_valid(props) and json_type(props) in ('OBJECT', 'ARRAY') as int) as has_json from events""")
oracle("json_segments", """
select event_id, ix, text, is_json from (
  select event_id, event_type, props,
         unnest([0, 1, 2, 3, 4]) as n from events) cross join lateral (
  select cast(n as bigint) as ix, case n when 0 then event_type || ' {x} ' when 1 then props
    when 2 then ' then ' when 3 then '[1, ' || props || ']' else ' end [unclosed' end as text,
    cast(n in (1, 3) as int) as is_json)""")
_SCHEMA_JSON = f"""
j_fns as (
  select position, unnest(json_extract('{_PLAIN_SCHEMA}', '$[*]')) as entry
  from v_tool_records where instruction <> 'no tools'),
j_tools as (
  select position, coalesce(json_extract(entry, '$.function'), entry) as fn from j_fns),
j_flat as (
  select position, json_extract_string(fn, '$.name') as name,
         coalesce(json_extract_string(fn, '$.description'), '') as description,
         coalesce(json_keys(fn, '$.parameters.properties'), []) as properties,
         coalesce(json_extract_string(fn, '$.parameters.required[*]'), []) as required,
         json_extract(fn, '$.parameters.properties') as specs
  from j_tools)"""
oracle("tool_catalog", """
select position, name, array_to_string(list_sort(properties), '|') as properties,
       array_to_string(required, '|') as required from j_flat""", _SCHEMA_JSON)
oracle("schema_lint", """
select position, name, array_to_string([r for r in required if not list_contains(properties, r)], '|') as undeclared
from j_flat""", _SCHEMA_JSON)
oracle("tool_catalog_params", """
select position, name, description, param,
       case when param is not null then coalesce(json_extract_string(specs, '$.' || param || '.type'), '') end as type,
       case when param is not null then coalesce(json_extract_string(specs, '$.' || param || '.description'), '') end
         as param_description,
       case when param is not null then cast(list_contains(required, param) as int) end as required
from (select *, unnest(case when len(properties) = 0 then [null] else properties end) as param from j_flat)""",
_SCHEMA_JSON)
oracle("tool_calls", """
select position, event_type as name, array_to_string(list_sort(json_keys(props)), '|') as arguments
from v_tool_records where output <> 'no call'""")


# ---- streams ----------------------------------------------------------------

# The lease rules once more, one action per step and question.
_WALK = f"""
w_events as (
  select *, row_number() over (partition by question_id order by moment, event_id) as n
  from v_lease_events),
w_walk as (
  select question_id, cast(0 as bigint) as n, cast(null as varchar) as holder,
         cast(null as timestamp) as expires, false as reviewed, cast(null as varchar) as outcome,
         cast(null as varchar) as lost_holder, cast(null as timestamp) as lost_at
  from (select distinct question_id from w_events)
  union all
  select question_id, n, case when outcome in ('claimed', 'resumed', 'renewed') then reviewer
                              when live and outcome not in ('skipped', 'submitted') then holder end,
         case when outcome in ('claimed', 'resumed', 'renewed') then moment + interval 30 minute
              when live and outcome not in ('skipped', 'submitted') then expires end,
         reviewed or outcome = 'submitted', outcome,
         case when expires <= moment then holder end, case when expires <= moment then expires end
  from (
    select *, case
        when action = 'claim' then case when mine then 'resumed' when reviewed or live then 'none' else 'claimed' end
        when action = 'renew' and mine then 'renewed' when action = 'skip' and mine then 'skipped'
        when action = 'submit' and mine and not reviewed then 'submitted' else 'refused' end as outcome
    from (
      select e.question_id, e.n, e.moment, e.reviewer, e.action, w.holder, w.expires, w.reviewed,
             coalesce(w.expires > e.moment, false) as live,
             coalesce(w.expires > e.moment and w.holder = e.reviewer, false) as mine
      from w_walk w join w_events e on e.question_id = w.question_id and e.n = w.n + 1))),
w_last as (select question_id, max(n) as n from w_events group by question_id),
w_expired as (
  select question_id, lost_at as lost, lost_holder as who, true as touched from w_walk where lost_at is not null
  union all
  select w.question_id, w.expires, w.holder, false from w_walk w join w_last l on l.question_id = w.question_id
   and l.n = w.n where w.expires is not null)"""


def _walk_sql(untouched: str) -> str:
    stamp = "strftime({}, '%Y-%m-%d %H:%M:%S')"
    return f"""
select e.question_id, {stamp.format('e.moment')} as at, e.event_id, e.action, w.outcome, e.reviewer, e.decision,
       case when e.decision = 'Fail' then e.notes else '' end as notes,
       case when w.outcome <> 'refused' then null
            when e.action = 'submit' and b.reviewed then '{D.REVIEWED}' else '{L.INACTIVE}' end as reason,
       {stamp.format('w.expires')} as lease_expires_at
from w_events e join w_walk w on w.question_id = e.question_id and w.n = e.n
join w_walk b on b.question_id = e.question_id and b.n = e.n - 1
union all
select question_id, {stamp.format('lost')}, null, 'expire', 'expired', who, null, null, null, {stamp.format('lost')}
from w_expired where touched or {untouched}"""


oracle("lease_fold", _walk_sql("true"), _WALK)
oracle("lease_stream", _walk_sql("lost <= (select max(moment) from w_events)"), _WALK)
oracle("live_by_reviewer", "select reviewer, count(*) as reviews from v_reviews group by reviewer")
oracle("live_over_time", """
select strftime(reviewed_at, '%Y-%m-%d') as date, count(*) as reviews from v_reviews group by 1""")
oracle("incremental_ingest", f"""
select batch_id, count(*) filter (open and ({_STORE}) is null) as imported,
       count(*) filter (open and ({_STORE}) is not null) as skipped, count(*) filter (not open) as closed
from (select *, cast(substr(file, 2) as bigint) as batch_id, cast(substr(file, 2) as bigint) % 4 in (0, 1) as open from i_tests)
group by batch_id""", _TYPES)
ORACLES["incremental_duplicates"] = ORACLES["rule_duplicate"]
