"""DuckDB twins of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

SPACED = r"[^\x20\x09-\x0D]+"
LETTERED = r"[0-9a-z\x{80}-\x{10FFFF}]+"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# the level of the budget: the fewest full sources for which no other source lies above its limit
MIX = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents
), sources as (
  select source, sum(size)::bigint as s from sized group by source
), weighed as (
  select *, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from sources
), filled as (
  select *, coalesce(sum(2 * s) over o, 0) as full_sum, sum(w) over () - coalesce(sum(w) over o, 0) as open_weight, sum(s) over () as total
  from weighed window o as (order by 2.0 * s / w, source nulls last rows between unbounded preceding and 1 preceding)
), levels as (
  select (1.5 * total - full_sum) / open_weight as level, 2.0 * s / w as bound, row_number() over (order by 2.0 * s / w, source nulls last) as n from filled
), chosen as (
  select arg_min(level, n) as level from levels where bound >= level
), goals as (
  select source, s, case when w * level > 2 * s then (2 * s)::double else w * level end as target from weighed, chosen
), steps as (
  select *, case when s > 0 then floor(target / s) else 0 end as passes from goals
), ordered as (
  select z.*, t.s, t.target, t.passes, t.target - t.passes * t.s as rest,
         sum(size) over (partition by z.source order by h) as upto,
         sum(size) over (partition by z.source, h) as inside, count(*) over (partition by z.source, h) as members
  from sized z join steps t on z.source is not distinct from t.source
)
select doc_id, size, s as source_size, target::double as target,
  (passes * size + case
     when rest <= 0 then 0
     when upto <= rest then size
     when upto - inside > rest then 0
     when members = 1 then case when upto - rest < rest - (upto - inside) then size else 0 end
     else floor(size * (rest - (upto - inside)) / inside) end)::bigint as taken
from ordered
"""

DECONTAMINATION = rf"""
with items as (
  select item_id, regexp_extract_all({LOW}, '{LETTERED}') as w from benchmark
), grams as (
  select distinct item_id, w[i:i + least(len(w), 10) - 1] as gram
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)
), docs as (
  select row_number() over () as k, doc_id, regexp_extract_all({LOW}, '{LETTERED}') as w from documents
), runs as (
  select k, w, n, unnest(range(1, len(w) - n + 2)) as i
  from docs, (select distinct len(gram) as n from grams) where len(w) >= n
), hits as (
  select k, i, n, item_id from runs join grams on w[i:i + n - 1] = gram
), covered as (
  select k, count(distinct p)::bigint as n_hit from (select k, unnest(range(i, i + n)) as p from (select distinct k, i, n from hits)) group by k
), found as (
  select k, count(distinct item_id)::bigint as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by k
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (k) left join found using (k)
"""


def _quality() -> str:
    from rainweave.llm.quality_rules import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
    return rf"""
with docs as (
  select row_number() over () as k, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '{SPACED}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACED}')) as lines
  from documents
), runs as (
  select k, i, w[i:i + 7] as gram from (select k, w, unnest(range(1, len(w) - 6)) as i from docs where len(w) >= 8)
), twice as (
  select k, i from (select k, i, count(*) over (partition by k, gram) as c from runs) where c > 1
), covered as (
  select k, count(distinct p)::bigint as n from (select k, unnest(range(i, i + 8)) as p from twice) group by k
), measured as (
  select doc_id, len(w)::bigint as n_words, len(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    len(list_filter(w, lambda x: lower(x) in ({stop}))) as stops, len(lines) as n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(!!\s+\S+){{3}}'))) as bangs
  from docs left join covered using (k)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words
    or word_chars < 1.5 * n_words or word_chars > 40 * n_words
    or n_symbols > 0.4 * n_words
    or (n_words >= 60 and 100 * stops < 0.5 * n_words)
    or 100 * n_dup_lines > 60 * n_lines
    or 100 * bangs > 60 * n_lines) as kept
from measured
"""


QUALITY = _quality()


def _secrets() -> str:
    from rainweave.llm.secrets import BASE_RULES, RULES

    def matches(number: int) -> str:
        rule = RULES[number]
        pattern = rule.pattern.replace("'", "''")
        return f"""
  select k, {number} as rule, '{rule.kind}' as kind, {rule.least} as least, string_split_regex(t, '{pattern}') as gaps,
         regexp_extract_all(t, '{pattern}') as found, regexp_extract_all(t, '{pattern}', {rule.group}) as part
  from docs"""

    counts = ", ".join(f"count(*) filter (kind = '{r.kind}')::bigint as n_{r.kind}" for r in BASE_RULES)
    named = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE_RULES)
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, rule)"
    return f"""
with docs as (
  select row_number() over () as k, doc_id, coalesce(text, '') as t from documents
), matches as ({" union all ".join(matches(i) for i in range(len(RULES)))}
), places as (
  select *, coalesce(list_sum(list_transform(gaps[:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: len(x))), 0) as start
  from (select *, unnest(range(1, len(found) + 1)) as i from matches where len(found) > 0)
), spans as (
  select k, rule, kind, start::bigint as start, (start + len(found[i]))::bigint as stop from places where len(part[i]) >= least
), found as (
  select k, {counts}, {listed} filter (rule < {len(BASE_RULES)}) as base, {listed} as all_spans from spans group by k
)
select doc_id, {named}, sha256(coalesce(base, '')) as base_sha256, coalesce(all_spans, '') as spans
from docs left join found using (k)
"""


SECRETS = _secrets()

# every run counted as it is, without a graph
COLLOCATIONS = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOW}, '[.,;:!?\x0A-\x0D]')) as piece from documents
), split as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), runs as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as run
  from split, (select unnest([1, 2, 3]) as k)
), f as materialized (
  select lang, k, run, count(*)::hugeint as c from runs group by all
), totals as (
  select lang, sum(c)::bigint as n from f where k = 1 group by lang
), candidates as materialized (
  select lang, k, run, c, string_split(run, ' ') as w from f where k > 1 and c >= 10
), cuts as (
  select lang, k, run, c, w, j, array_to_string(w[1:j], ' ') as front, array_to_string(w[j + 1:k], ' ') as back
  from candidates, (select unnest([1, 2]) as j) where j < k
), scored as (
  select x.lang, x.k, x.run, x.c, x.j, y.c as l, z.c as r, (1000000::hugeint * x.c * x.c) // (y.c * z.c) as score
  from cuts x
  join f y on y.lang = x.lang and y.k = x.j and y.run = x.front
  join f z on z.lang = x.lang and z.k = x.k - x.j and z.run = x.back
), lowest as (
  select * from scored qualify row_number() over (partition by lang, run order by score, j) = 1
), longer as (
  select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as run, c from candidates where k = 3
), covering as (
  select lang, run, max(c) as c from longer group by all
), kept as (
  select x.* from lowest x left join covering y on x.k = 2 and y.lang = x.lang and y.run = x.run
  where y.c is null or 100 * y.c < 50 * x.c
)
select lang, rank, run as phrase, c::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, c desc, encode(run)) as rank from kept) join totals using (lang)
where rank <= 2000
"""


def _round(number: int) -> str:
    """Assignment to the centroids of a round, and the centroids of the next one."""
    return f"""
a{number} as materialized (
  select v.k, arg_min(c.c, d * 1000 + c.c) as c, min(d) as d from (
    select v.k, c.c, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{number} c on v.i = c.i group by v.k, c.c
  ) c join (select distinct k from v) v using (k) group by v.k
), m{number} as materialized (
  select a.c, v.i, sum(v.x) as s, count(*) as n from v join a{number} a using (k) group by a.c, v.i
), c{number + 1} as materialized (
  select o.c, o.i, case when m.n is null then o.x else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as x
  from c{number} o left join m{number} m on m.c = o.c and m.i = o.i
),"""


# ten rounds written out, every distance measured
CENTROIDS = f"""
with kept as materialized (
  select row_number() over () as k, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), v as materialized (
  select k, i, floor(embedding[i]::double * 1024)::hugeint as x from kept, (select unnest(range(1, 65)) as i)
), firsts as (
  select k, row_number() over (order by sha256('3:' || vec_id)) - 1 as c from kept qualify c < 8
), c0 as materialized (
  select f.c, v.i, v.x from firsts f join v using (k)
),{"".join(_round(i) for i in range(10))}
e as materialized (
  select v.k, arg_min(c.c, d * 1000 + c.c) as c, min(d) as d from (
    select v.k, c.c, sum((v.x - c.x) * (v.x - c.x)) as d from v join c10 c on v.i = c.i group by v.k, c.c
  ) c join (select distinct k from v) v using (k) group by v.k
), names as (
  select c, sha256(string_agg(x::varchar, ',' order by i)) as h from c10 group by c
)
select vec_id, e.c::integer as cluster, d::bigint as distance, (sum(d) over (partition by e.c))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, h as centroid_sha256
from e join kept using (k) join names using (c)
"""
