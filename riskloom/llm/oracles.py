"""SQL for the operators that SQL can express, over the same tables.

No SQL exists for byte-level BPE and token counts (merges by rank), license scans (edit distance inside text),
fingerprints (64-bit hashes of shingles) and language identification (compression): those are tested against brute
force, the reference tokenizer or held-out labels.
"""

ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_temperature_mixing"] = f"""
with recursive rows as (
  select doc_id, coalesce(source, '') as source, len({WORDS}) as n_tokens, md5(coalesce(text, '')) as content,
         row_number() over (partition by doc_id, coalesce(text, '') order by source nulls first) as copy from documents),
sources as (select source, sum(n_tokens)::bigint as tokens from rows group by source having sum(n_tokens) > 0),
shares as (select source, tokens, tokens / (select sum(tokens) from sources)::double as p from sources),
entropy(step, lo, width) as (
  select 0, 0.0::double, 1.0::double
  union all
  select step + 1, case when (select (ln(sum(pow(p, lo + width / 2)))
                                      - (lo + width / 2) * sum(pow(p, lo + width / 2) * ln(p))
                                        / sum(pow(p, lo + width / 2))) / case when count(*) > 1 then ln(count(*)) else 1 end
                              from shares) >= 0.95 - 1e-12 then lo + width / 2 else lo end, width / 2
  from entropy where step < 20),
repeats(step, lo, width) as (
  select 0, 0.0::double, 1.0::double
  union all
  select step + 1, case when (select pow(min(p), lo + width / 2 - 1) / sum(pow(p, lo + width / 2)) from shares)
                             > 4 + 1e-12 then lo + width / 2 else lo end, width / 2
  from repeats where step < 20),
alpha as (
  select greatest(
    case when (select count(*) < 2 or -sum(p * ln(p)) / ln(count(*)) >= 0.95 - 1e-12 from shares) then 1.0
         else (select lo from entropy where step = 20) end,
    case when (select pow(min(p), -1) / count(*) from shares) <= 4 + 1e-12 then 0.0
         else (select lo + width from repeats where step = 20) end) as a),
budgets as (
  select source, tokens, floor(pow(p, a) / (select sum(pow(p, a)) from shares, alpha)
                               * (select sum(tokens) from sources) + 0.5)::bigint as budget from shares, alpha),
blocks as (select greatest(1, ceil(sum(budget) / 1000000.0))::bigint as n from budgets),
drawn as (
  select doc_id, rows.source, n_tokens, tokens, budget, e.epoch::int as epoch,
         md5('mix:' || e.epoch || ':' || coalesce(doc_id::varchar, '') || ':' || content || ':' || copy) as order_key
  from rows join budgets using (source), unnest(range(0, (budget - 1) // tokens + 1)) as e(epoch) where budget > 0),
placed as (
  select *, epoch * tokens + coalesce(sum(n_tokens) over (
    partition by source, epoch order by order_key rows between unbounded preceding and 1 preceding), 0) as place
  from drawn),
taken as (select *, (place * n // budget)::int as block from placed, blocks where place < budget and n_tokens > 0)
select doc_id, source, n_tokens, epoch, block,
       (row_number() over (partition by block order by md5(block || ':' || order_key)))::int as slot from taken
"""

ORACLES["op2_substring_dedup"] = f"""
with docs as (select doc_id, {WORDS} as w from documents),
windows as (select doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) as h
            from docs, unnest(range(1, len(w) - 18)) as r(p) where len(w) >= 20),
judged as (select doc_id, p, row_number() over (partition by h order by doc_id, p) as n from windows),
gone as (select distinct doc_id, p + i as p from judged, range(0, 20) as r(i) where n > 1),
words as (select doc_id, p, w[p] as word from docs, unnest(range(1, len(w) + 1)) as r(p)),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p)
         group by doc_id),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from docs left join kept using (doc_id) left join removed using (doc_id)
"""

ORACLES["op4_balanced_shards"] = """
with recursive table_of(n, c, step) as (
  select r.n::bigint, r.n::bigint, 0 from range(256) as r(n)
  union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from table_of where step < 8),
crc_table as (select list(c order by n) as t from table_of where step = 8),
raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
summed as (
  select doc_id, len(h) // 2 + 8 as size,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
               range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
  from raw, crc_table),
ordered as (
  select *, coalesce(sum(size) over (order by doc_id, text_crc32 rows between unbounded preceding and 1 preceding), 0)
              as before, sum(size) over () as total, row_number() over (order by doc_id, text_crc32) as position
  from summed),
placed as (select *, least((2 * before + size) * 24 // (2 * total), 23)::int as shard from ordered)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard,
       (position - min(position) over (partition by shard))::bigint as slot, null::int as grown_shard
from placed
"""

ORACLES["op8_quality_rules"] = rf"""
with docs as (
  select doc_id, coalesce(text, '') as text, {WORDS} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
grams as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as g
          from docs, unnest(range(1, len(w) - 1)) as r(p) where len(w) >= 3),
again as (select doc_id, p, count(*) over (partition by doc_id, g) as n from grams),
covered as (select doc_id, count(distinct p + i) as n from again, range(0, 3) as r(i) where n > 1 group by doc_id),
measured as (
  select doc_id, len(w)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n, 0)::bigint as n_repeat_words, len(lines) as n_lines,
         len(list_filter(w, lambda x: strlen(x) > 1 and regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]')))
           as n_shouted
  from docs left join covered using (doc_id)),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 10 * n_symbols <= n_words and 2 * n_dup_lines <= n_lines
         and word_chars between 2 * n_words and 12 * n_words and 2 * n_shouted <= n_words as kept
from base
"""

ORACLES["op10_setsketch_near_dedup"] = rf"""
with recursive docs as (
  select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, md5(array_to_string(w[p:p + 3], ' ')) as h
  from docs, unnest(range(1, len(w) - 2)) as r(p) where len(w) >= 4
  union all
  select doc_id, md5(array_to_string(w, ' ')) from docs where len(w) between 1 and 3),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b
           on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
          where 100 * common >= 80 * (x.n + y.n - common)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select a, b from edges union select reach.doc_id, edges.b from reach join edges on edges.a = reach.other),
lowest as (select doc_id, min(other) as low from reach group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(low, doc_id))::bigint as component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) as kept
from docs left join sizes using (doc_id) left join lowest using (doc_id)
"""

ORACLES["op11_norm_sorted_topk"] = """
with vectors as (
  select vec_id, row_number() over () as n, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.n, q.vec_id as query_id, c.vec_id as vec_id,
                  list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
           from vectors q join vectors c on q.vec_id % 100 = 0 and q.n <> c.n)
select query_id, row_number() over (partition by n order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 10
"""

ORACLES["op12_merkle_manifest"] = """
with recursive tagged as (
  select doc_id, lang, n_chars,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') as front,
         coalesce(strlen(text) || ':' || text, '-') as back,
         coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as size,
         coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as larger from documents),
crcs(n, c, step) as (
  select r.n::bigint, r.n::bigint, 0 from range(256) as r(n)
  union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from crcs where step < 8),
crc_table as (select list(c order by n) as t from crcs where step = 8),
leaves as (
  select doc_id, lang, sha256(front || size || back) as leaf,
         case when xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
                    range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i + 1, 1))::bigint)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0
              then sha256(front || larger || back) else sha256(front || size || back) end as changed,
  from tagged, crc_table),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
         count(*) over (partition by lang) as n from leaves),
nodes(level, lang, pos, n, h) as (
  select 0, lang, pos, n, leaf from placed
  union all
  select level + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from nodes where n > 1
  group by level, lang, pos // 2, n),
subroots as (select lang, h as subroot, level as height,
                    row_number() over (order by lang nulls first) - 1 as place, count(*) over () as trees
             from nodes where n = 1),
upper(level, pos, n, h) as (
  select 0, place, trees, subroot from subroots
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from upper where n > 1
  group by level, pos // 2, n),
top as (select h as root, level as height from upper where n = 1),
siblings as (
  select p.doc_id, p.lang, p.pos, l.level as step, s.h, (p.pos >> l.level) & 1 = 1 as at_left
  from placed p join subroots r on p.lang is not distinct from r.lang, range(r.height) as l(level)
  left join nodes s on s.level = l.level and s.lang is not distinct from p.lang and s.pos = xor(p.pos >> l.level, 1)
  union all
  select p.doc_id, p.lang, p.pos, r.height + l.level, s.h, (r.place >> l.level) & 1 = 1
  from placed p join subroots r on p.lang is not distinct from r.lang, top, range(top.height) as l(level)
  left join upper s on s.level = l.level and s.pos = xor(r.place >> l.level, 1)),
proofs as (select doc_id, lang, pos, sha256(coalesce(string_agg(h, '' order by step), '')) as proof_sha256
           from siblings group by all),
folded(step, lang, pos, h) as (
  select 0, lang, pos, changed from placed
  union all
  select f.step + 1, f.lang, f.pos, sha256(case when at_left then coalesce(s.h, '') || f.h else f.h || coalesce(s.h, '') end)
  from folded f join siblings s on s.step = f.step and s.lang is not distinct from f.lang and s.pos = f.pos)
select p.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, f.h as folded_root,
       f.h = root as verified
from placed p join subroots r on p.lang is not distinct from r.lang cross join top
left join proofs q on q.pos = p.pos and q.lang is not distinct from p.lang
join folded f on f.step = r.height + top.height and f.pos = p.pos and f.lang is not distinct from p.lang
"""

TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op13_ranked_search"] = rf"""
with docs as (select doc_id, row_number() over () as row, {TERMS} as t from documents),
totals as (select count_if(len(t) > 0)::bigint as n_docs, sum(len(t))::bigint as n_terms from docs),
sized as (select doc_id, row, t, 75 + (25 * len(t)::bigint * n_docs) // n_terms as m from docs, totals where len(t) > 0),
counts as (select doc_id, row, m, term, count(*)::bigint as tf from sized, unnest(t) as u(term) group by all),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w
            from counts, totals group by term, n_docs),
items as (select item_id, row_number() over () as item_row, {TERMS} as t from benchmark),
asked as (select item_id, item_row, term, count(*) as times from items, unnest(t) as u(term) group by all),
scored as (select item_id, item_row, doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
           from asked join weights using (term) join counts using (term) group by all)
select item_id, (row_number() over (partition by item_row order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 20
"""
