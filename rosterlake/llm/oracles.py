"""DuckDB SQL of the training-data queries that SQL can express."""

#: The words of benchmark items, of documents for op1 and op12.
WORDS = (r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])")

RESAMPLE = f"""
with crc_table as (
  select list(v order by i) as crc from (
    select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) as t(i)) q),
d as (select row_number() over () as r, doc_id, {WORDS} as ws from documents),
b as (select {WORDS} as ws from benchmark),
df as (select r, ws[k] as f from d, unnest(range(1, len(ws) + 1)) as t(k)
       union all select r, ws[k] || ' ' || ws[k + 1] from d, unnest(range(1, len(ws))) as t(k)),
bf as (select ws[k] as f from b, unnest(range(1, len(ws) + 1)) as t(k)
       union all select ws[k] || ' ' || ws[k + 1] from b, unnest(range(1, len(ws))) as t(k)),
dn as (select r, f, count(*) as n from df group by r, f),
features as (select f, hex(encode(f)) as h, sum(s) as s, sum(t) as t from (
      select f, sum(n) as s, 0 as t from dn group by f union all select f, 0, count(*) from bf group by f) q group by f),
coded as (select f, s, t, xor(list_reduce([4294967295] || list_transform(range(0, len(h) // 2), lambda i: cast('0x' || h[2 * i + 1 : 2 * i + 2] as bigint)),
              lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from features, crc_table),
sums as (select cast(sum(s) as double) as s_all, cast(sum(t) as double) as t_all from features),
gains as (select bucket, cast(floor(1000 * ln((sum(t) + 1.0::double) * (any_value(s_all) + 10000) / ((sum(s) + 1.0::double) * (any_value(t_all) + 10000)))) as bigint) as gain
          from coded, sums group by bucket),
by_feature as (select f, gain from coded join gains using (bucket)),
totals as (select r, cast(sum(n * gain) as bigint) as total, cast(sum(n) as bigint) as n from dn join by_feature using (f) group by r),
weighed as (select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_features,
      case when coalesce(n, 0) = 0 then 0 else (total - ((total % n) + n) % n) // n end as weight,
      cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from d left join totals using (r)),
scored as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from weighed),
ranked as (select doc_id, n_features, n_words, row_number() over (order by score desc, doc_id asc nulls last, n_features) as k, count(*) over () as every from scored where n_words >= 20)
select s.doc_id, s.n_features, s.weight, s.score, case when k <= 25 * every // 100 then k end as rank
from scored s left join ranked k on s.doc_id is not distinct from k.doc_id and s.n_features = k.n_features
"""

FILTER_AUDIT = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
least as (select text, min(doc_id) as first_id from d group by text),
f as (select d.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
       (case when len(ws) < 50 then 1 else 0 end)
       + (case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 2 else 0 end)
       + (case when 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) then 4 else 0 end)
       + (case when regexp_matches(d.text, '[#$%&*|]') then 8 else 0 end)
       + (case when d.doc_id > least.first_id then 16 else 0 end) as bits
      from d join least on d.text = least.text left join l on l.doc_id = d.doc_id),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as b),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.b, b.b, c.b, d.b, e.b] as bs
  from letters a join letters b on b.b <> a.b join letters c on c.b not in (a.b, b.b)
  join letters d on d.b not in (a.b, b.b, c.b) join letters e on e.b not in (a.b, b.b, c.b, d.b)),
steps as (select filter_order, step, bs[step] as bit, cast(coalesce(list_sum(bs[1 : step - 1]), 0) as integer) as before from orders, unnest(range(1, 6)) as t(step)),
cells as (select part, bits, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, bits),
told as (
  select part, filter_order, step, bit,
    sum(case when bits & bit = 0 and bits & before = 0 then n else 0 end) as kept,
    sum(case when bits & bit > 0 and bits & before = 0 then n else 0 end) as removed,
    sum(case when bits & bit > 0 and bits & before > 0 then n else 0 end) as redundant,
    sum(case when bits = bit then n else 0 end) as unique_fails,
    sum(case when bits & bit > 0 and bits & before = 0 then good else 0 end) as good_lost,
    sum(case when bits & bit > 0 and bits & before = 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by part, filter_order, step, bit)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from told
"""
