"""Operator 13 in DuckDB's SQL: the cheapest edits row by row from the end, all states together.

crc32 is computed bit by bit. A step keeps for each state the cost in eight digits before the edits, so that the
least text is the cheapest and of equal ones sorts first, and beside it the messages that stand.
"""

from __future__ import annotations


def step() -> str:
    """The four states' best before a row, from those after it."""
    to, role = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    made = lambda cost, letter, q, said: f"{{'k': printf('%08d', {cost} + cast(left(c{q}.k, 8) as int)) || '{letter}' || substr(c{q}.k, 9), 'm': {said} c{q}.m}}"
    rows = []
    for q in range(4):
        options = [made("2", "D", q, "")]
        for (state, initial), after in keep.items():
            if state == q:
                options.append(f"case when not gone and left(role, 1) = '{initial}' then {made('more', 'K', after, 'chr(10) || role || chr(58) || text ||')} end")
        options.append(f"case when not gone then {made('1 + more', 'R', to[q], f'chr(10) || chr(39) || text ||').replace('chr(39)', repr(role[q] + ':'))} end")
        rows.append(f"list_min([x for x in [{', '.join(options)}] if x is not null]) as r{q}")
    return ",\n      ".join(rows)


def inserted(best: tuple[str, ...]) -> str:
    """The four states' best once messages may be inserted before what comes next."""
    add = lambda r, role: f"{{'k': printf('%08d', 5 + cast(left({r}.k, 8) as int)) || 'I' || substr({r}.k, 9), 'm': chr(10) || '{role}:' || {r}.m}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    u, a = least(best[2], add(best[3], "assistant")), least(best[3], add(best[2], "user"))
    return ", ".join(f"{x} as c{q}" for q, x in enumerate((least(best[0], add(u, "user")), least(best[1], add(u, "user")), u, a)))


END = "{'k': '00000000', 'm': ''} as c0, {'k': '00000010II', 'm': chr(10) || 'user:' || chr(10) || 'assistant:'} as c1, {'k': '00000005I', 'm': chr(10) || 'assistant:'} as c2, {'k': '00000000', 'm': ''} as c3"

SQL = f"""
with recursive damaged as (
  select *, list_reduce(
    list_prepend(cast(4294967295 as bigint), [cast(ord(x) as bigint) for x in string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [cast(i as bigint) for i in range(8)]), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))
  ) as crc from conversations
),
coded as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(crc, 4294967295) % 20 as code from damaged),
all_rows as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
         case when code = 1 then '' when code = 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case when code = 0 then 0 when code = 3 then 2 else 1 end)) as copy
  from coded
),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i,
         count(*) over (partition by conv_id) as n, not regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') as blank,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
         not regexp_matches(text, '[.!?][ \\t\\n\\x0B\\f\\r]*\\z') as cut,
         lag(role) over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as previous
  from all_rows
),
faults as materialized (select *, blank or again as gone, case when cut then 5 else 0 end as more from numbered),
costs as (
  select distinct conv_id, n + 1 as i, {END} from faults
  union all
  select conv_id, i, {inserted(("r0", "r1", "r2", "r3"))} from (
    select f.conv_id, f.i,
      {step()}
    from costs c join faults f on f.conv_id is not distinct from c.conv_id and f.i = c.i - 1
  )
),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
         count(*) filter (not blank and again) as duplicate, count(*) filter (not gone and cut) as truncated,
         count(*) filter (i > 1 and left(previous, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id
),
best as (select conv_id, c0 from costs where i = 1),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cast(coalesce(cast(left(c0.k, 8) as int), 0) as bigint) as cost, coalesce(substr(c0.k, 9), '') as audit,
       sha256(coalesce(substr(c0.m, 2), '')) as repaired_sha256
from ids left join counts on counts.conv_id is not distinct from ids.conv_id left join best on best.conv_id is not distinct from ids.conv_id
"""
