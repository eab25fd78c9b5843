"""DuckDB twins of the operators that SQL can express on whole tables."""

#: crc32 of a text of plain characters, from its bytes: eight shifts a byte by the reversed polynomial 0xEDB88320.
CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
        lambda a, i: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)), 4294967295)"""

#: Operator 13 by all least audits of all four states, turn after turn.
CONVERSATION_REPAIR = f"""
with recursive
coded as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           {CRC32.format(text="coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k
    from conversations),
left_over as (
    select conv_id, turn, case when k = 4 then 'user' else role end as role,
           case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
           unnest(case when k = 3 then [1, 2] else [1] end) as copy
    from coded where k <> 0),
numbered as (
    select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, left(role, 1) as initial,
           row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n,
           row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as time
    from left_over),
turns as (
    select *, case when bare = '' then 'blank' when time > 1 then 'duplicate'
                   when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
           lag(initial) over (partition by conv_id order by n) || initial as pair
    from numbered),
-- states: 0 nothing, 1 system, 2 user, 3 assistant; before each turn up to two inserts
inserts(before, letters, made, state) as (values
    (0, '', '', 0), (0, 'I', 'user:' || chr(10), 2), (0, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3),
    (1, '', '', 1), (1, 'I', 'user:' || chr(10), 2), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3),
    (2, '', '', 2), (2, 'I', 'assistant:' || chr(10), 3), (2, 'II', 'assistant:' || chr(10) || 'user:' || chr(10), 2),
    (3, '', '', 3), (3, 'I', 'user:' || chr(10), 2), (3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3)),
steps(state, initial, letter, role, after) as (values
    (0, null, 'D', null, 0), (1, null, 'D', null, 1), (2, null, 'D', null, 2), (3, null, 'D', null, 3),
    (0, 's', 'K', null, 1), (0, 'u', 'K', null, 2), (1, 'u', 'K', null, 2), (2, 'a', 'K', null, 3), (3, 'u', 'K', null, 2),
    (0, null, 'R', 'user', 2), (1, null, 'R', 'user', 2), (2, null, 'R', 'assistant', 3), (3, null, 'R', 'user', 2)),
ways(conv_id, n, state, best) as (
    select distinct conv_id, 0::bigint, 0, {{'cost': 0, 'audit': '', 'made': ''}} from left_over
    union all
    select w.conv_id, t.n, s.after, min({{
        'cost': w.best.cost + 2 * length(i.letters) + case s.letter when 'D' then 3 when 'R' then 2 else 0 end
                + case when s.letter <> 'D' and t.fault = 'truncated' then 1 else 0 end,
        'audit': w.best.audit || i.letters || s.letter,
        'made': w.best.made || i.made || case when s.letter = 'D' then '' else coalesce(s.role, t.role) || ':' || t.text || chr(10) end}})
    from ways w join turns t on t.conv_id is not distinct from w.conv_id and t.n = w.n + 1
    join inserts i on i.before = w.state
    join steps s on s.state = i.state and (s.initial is null or s.initial = t.initial)
                 and (s.letter = 'D' or t.fault not in ('blank', 'duplicate'))
    group by w.conv_id, t.n, s.after),
totals as (
    select conv_id, max(n) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
           count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
           count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
    from turns group by conv_id),
repaired as (
    select w.conv_id, min({{'cost': w.best.cost + 2 * length(i.letters), 'audit': w.best.audit || i.letters,
                            'made': w.best.made || i.made}}) as best
    from ways w join totals t on t.conv_id is not distinct from w.conv_id and t.n = w.n
    join inserts i on i.before = w.state and i.state in (0, 3)
    group by w.conv_id)
select c.conv_id, coalesce(t.gaps, 0)::bigint as gaps, coalesce(t.blank, 0) as blank, coalesce(t.duplicate, 0) as duplicate,
       coalesce(t.truncated, 0) as truncated, coalesce(t.illegal, 0) as illegal, coalesce(r.best.cost, 0)::bigint as cost,
       coalesce(r.best.audit, '') as audit, sha256(coalesce(left(r.best.made, -1), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join totals t on t.conv_id is not distinct from c.conv_id
left join repaired r on r.conv_id is not distinct from c.conv_id
"""


#: Operator 11 by the words of every window of a document, for each length that windows of items have.
DECONTAMINATION = """
with words(kind, id, place, w) as (
    select 'document', doc_id::varchar, row_number() over (),
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from documents
    union all
    select 'item', coalesce(item_id::varchar, ''), row_number() over (),
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
texts as (select * from words where len(w) > 0),
windows as (
    select id, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as b, w
    from texts where kind = 'item'),
grams as (select distinct id, n, array_to_string(list_slice(w, b, b + n - 1), ' ') as gram from windows),
starts as (
    select place, n, unnest(range(1, len(w) - n + 2)) as b, w
    from texts, (select distinct n from grams) where kind = 'document' and len(w) >= n),
hits as (
    select s.place, s.b, s.n, g.id
    from starts s join grams g on g.n = s.n and g.gram = array_to_string(list_slice(s.w, s.b, s.b + s.n - 1), ' ')),
hit_words as (select place, count(distinct p) as n_hit
              from (select place, unnest(range(b, b + n)) as p from (select distinct place, b, n from hits)) group by place),
hit_items as (select place, count(*) as n_items, string_agg(id, ',' order by id) as ids
              from (select distinct place, id from hits) group by place)
select d.id::bigint as doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
       sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from words d left join hit_words h using (place) left join hit_items i using (place)
where d.kind = 'document'
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_decontamination": DECONTAMINATION,
            "op13_conversation_repair": CONVERSATION_REPAIR}
