"""SQL for the operators that SQL can express, on whole tables, by plain means: windows and shingles as rows."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str, key: str, pattern: str, lower: bool) -> str:
    """Rows numbered, with their words; none where the text is null."""
    text = LOWER.format("text") if lower else "text"
    return f"select row_number() over () as r, {key}, coalesce(regexp_extract_all({text}, {pattern}), []) as words from {table}"


OP1 = f"""
with d as ({_words("documents", "doc_id", WORDS, False)}),
w as (select r, i, md5(array_to_string(words[i:i + 34], ' ')) as h from (select r, words, unnest(range(1, len(words) - 33)) as i from d)),
twice as (select h from w group by h having count(*) > 1),
hit as (select distinct r, i + k as p from (select r, i, unnest(range(0, 35)) as k from w semi join twice using (h))),
word as (select r, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from d),
kept as (select r, string_agg(word, ' ' order by p) as kept from word anti join hit using (r, p) group by r),
gone as (select r, count(*) as n from hit group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join gone using (r) left join kept using (r)
"""

OP8 = f"""
with recursive d as ({_words("documents", "doc_id", WORDS, True)}),
s as (
  select distinct r, doc_id, hash(array_to_string(words[i:i + 2], ' ')) as h
  from (select r, doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) as i from d where len(words) > 0)
),
n as (select r, doc_id, count(*) as n, list(h order by h) as hashes from s group by r, doc_id),
c as (select r, min(doc_id) over (partition by hashes) as class_id from n),
met as (select a.r as x, b.r as y, count(*) as n from s a join s b on a.h = b.h and a.r < b.r group by a.r, b.r),
link as (
  select x, y from met join n a on a.r = x join n b on b.r = y where 100 * met.n >= 90 * (a.n + b.n - met.n)
),
edge as (select x, y from link union all select y, x from link),
reach(r, least) as (select r, doc_id from d union select edge.y, reach.least from reach join edge on edge.x = reach.r)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reach.least) as component_id,
  coalesce(any_value(c.class_id), d.doc_id) as class_id
from d join reach on reach.r = d.r left join n on n.r = d.r left join c on c.r = d.r group by d.r, d.doc_id
"""

OP9 = f"""
with d as ({_words("documents", "doc_id", ALNUM, True)}),
b as ({_words("benchmark", "item_id", ALNUM, True)}),
bw as (
  select distinct item_id, size, md5(array_to_string(words[i:i + size - 1], ' ')) as h
  from (select item_id, words, least(len(words), 10) as size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from b where len(words) > 0)
),
dw as (
  select r, i, size, md5(array_to_string(words[i:i + size - 1], ' ')) as h
  from (select r, words, size, unnest(range(1, len(words) - size + 2)) as i from d, (select distinct size from bw))
),
met as (select r, i, size, item_id from dw join bw using (size, h)),
hit as (select r, count(distinct p) as n from (select r, i + unnest(range(0, size)) as p from met) group by r),
items as (select r, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct r, item_id::varchar as item from met) group by r)
select doc_id, len(words)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)
"""

OP11 = f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from d),
k as (select *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as line_key from l),
c as (select line_key, max(doc_id) as keep from k where length(line_key) >= 20 group by line_key having count(distinct doc_id) >= 3),
m as (select r, line, i, coalesce(doc_id <> keep, false) as gone from k left join c using (line_key))
select doc_id, len(lines)::bigint as n_lines, n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from d join (select r, count(*) filter (gone) as n_dropped, string_agg(line, chr(10) order by i) filter (not gone) as kept from m group by r) using (r)
"""

OP12 = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (select a.vec_id as anchor, a.label = b.label as same, b.vec_id as other, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor, other as positive, score from s where same qualify row_number() over (partition by anchor order by score desc, other) <= 5),
n as (
  select p.anchor, p.positive, p.score as positive_score, s.other as negative_id, s.score as negative_score, row_number() over (partition by p.anchor, p.positive order by s.score desc, s.other) as r
  from p join s on s.anchor = p.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
)
select anchor as anchor_id, positive as positive_id, r::int as rank, negative_id, positive_score, negative_score from n where r <= 10
"""

#: The crc32 goes bit by bit: eight entries a byte, of which the first brings the byte in. Characters lie below U+0100, so they have two bytes at most.
OP13 = f"""
with recursive r as (select doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[a-zÀ-ÿ]+')) as run from documents),
d as (select doc_id, run, count(*) as times from r where length(run) >= 5 group by all),
b as (select *, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] end)) as bytes from d),
s as (select run, times, list_prepend(4294967295::bigint, flatten(list_transform(bytes, lambda x: [x::bigint, 0, 0, 0, 0, 0, 0, 0]))) as steps from b),
c as (select run, times, xor(list_reduce(steps, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) as h from s),
o as (select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from c),
v as (select word, sum(times)::bigint as n from o where length(word) >= 5 group by word having sum(times) >= 3),
i as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
g as (select word, n, i, left(word, i - 1) || '_' || substr(word, i + 1) as pattern, left(word, i - 1) || substr(word, i + 1) as shorter from i),
p as (
  select a.word, b.word as near, b.n as near_n from g a join g b on a.pattern = b.pattern and a.word <> b.word
  union select g.word, v.word, v.n from g join v on g.shorter = v.word union select v.word, g.word, g.n from g join v on g.shorter = v.word
),
m as (select word, count(*) as n_near, arg_min({{'near': near, 'n': near_n}}, {{'less': -near_n, 'near': near}}) as best from p group by word),
f as (select word, n, coalesce(n_near, 0) as n_near, case when best.n >= 2 * n then best.near end as form, case when best.n >= 2 * n then best.n end as form_n from v left join m using (word)),
t(word, root) as (select word, word from f where form is null union all select f.word, t.root from f join t on f.form = t.word)
select word, form, root, n, n_near, form_n from f join t using (word)
"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op8_ngram_jaccard_join": OP8, "op9_benchmark_decontamination": OP9, "op11_line_dedup": OP11, "op12_hard_negatives": OP12, "op13_spelling_variants": OP13}
