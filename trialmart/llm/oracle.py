"""The same results in DuckDB's SQL, for the queries that SQL can express."""

from .license_texts import TEMPLATES

WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (
  select page_id, strlen(h) as n, sha1(h) as x,
         max(page_id) over (partition by h) as last_id
  from p
)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((cast('0x' || substr(x, 5 * (i // 4) + 1, 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31) + 1,
    1)), '') as payload_digest,
  case when last_id is null or page_id = last_id then 'response' else 'revisit' end as record_type,
  case when page_id <> last_id or page_id is null then last_id end as refers_to
from d
"""

QUALITY = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
win as (
  select doc_id, i, i + j as pos, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w), (select unnest([0, 1, 2]) as j)
),
rep as (
  select doc_id, count(distinct pos) as n_repeat_words
  from (select *, count(*) over (partition by doc_id, g) as c from win) where c > 3 group by doc_id
),
ln as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as k
  from t
),
lw as (
  select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws,
         row_number() over (partition by doc_id, line order by k) > 1 as again
  from ln where regexp_matches(line, '[^\x20\x09-\x0D]')
),
lm as (
  select doc_id, again, len(ws) as n, length(array_to_string(ws, '')) as chars,
    len(regexp_extract_all(line, '[!-/:-@\[-`{-~]')) as marks,
    len(list_filter(ws, lambda x: x in ('|', '>', '/', '-', '·', '•', '»', '«', '›', '→'))) as parts,
    regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      'all rights reserved|accept cookies|click here|cookie policy|enable javascript|lorem ipsum|'
      || 'privacy policy|read more|sign up|subscribe now|terms of use') as phrase
  from lw
),
lf as (
  select *, again or (marks >= 5 and marks > 0.15 * chars) or (parts >= 3 and 5 * parts >= n)
         or (n <= 25 and phrase) as failed
  from lm
),
la as (
  select doc_id, sum(chars) as word_chars, count(*) filter (again) as n_dup_lines,
         count(*) filter (failed) as n_failed_lines,
         coalesce(sum(chars) filter (failed), 0) as failed_chars
  from lf group by doc_id
),
r as (
  select w.doc_id, cast(len(ws) as bigint) as n_words,
    cast(coalesce(word_chars, 0) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    cast(coalesce(n_failed_lines, 0) as bigint) as n_failed_lines,
    cast(coalesce(failed_chars, 0) as bigint) as failed_chars
  from w left join la using (doc_id) left join rep using (doc_id)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
    and failed_chars <= 0.5 * word_chars as kept
from r
"""

SHARDING = """
with d as (
  select doc_id, coalesce(strlen(text), 0) as n_bytes,
    right(bin(cast('0x' || left(md5(coalesce(cast(doc_id as varchar), '')), 8) as bigint)
              + 4294967296), 32) as bits
  from documents
),
l as (select *, left(bits, k) as bucket, k from d, (select unnest(range(0, 33)) as k)),
t as (
  select bucket, cast(sum(n_bytes) as bigint) as shard_bytes, count(*) as c
  from l group by bucket
),
f as (
  select l.*, shard_bytes, row_number() over (partition by doc_id order by k) as r
  from l join t using (bucket) where shard_bytes <= 33554432 or c = 1
)
select doc_id, cast(n_bytes as bigint) as n_bytes, 'b' || bucket as shard,
  cast(k as int) as depth, shard_bytes
from f where r = 1
"""


def licenses() -> str:
    """Every template against every unit of every document, without pruning."""
    given = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items()
    )
    return f"""
with u as (
  select distinct doc_id, unit from (
    select doc_id, unnest(string_split(text, chr(10))) as unit from documents
    union all
    select doc_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) from documents
    union all select doc_id, text from documents)
),
w as (select doc_id, regexp_extract_all(lower(unit), '[\\p{{L}}\\p{{N}}]+') as ws from u),
g as (
  select doc_id,
    list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as own
  from w where len(ws) > 1
),
t as (
  select license, list_distinct(list_transform(range(1, len(ws)),
    lambda i: ws[i] || ' ' || ws[i + 1])) as theirs
  from (select license, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') as ws
        from (values {given}) v(license, body))
),
m as (
  select doc_id, license,
    max(2.0::double * len(list_intersect(own, theirs)) / (len(own) + len(theirs))) as dice
  from g, t group by doc_id, license
),
b as (
  select *, row_number() over (partition by doc_id order by dice desc, license) as r
  from m where dice >= 0.8
)
select d.doc_id, b.license, round(b.dice, 6) as dice
from documents d left join b on d.doc_id = b.doc_id and b.r = 1
"""


LEXICAL_SEARCH = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null
),
s as (select count(*) as docs, cast(sum(len(terms)) as bigint) as all_terms from d where len(terms) > 0),
p as (
  select r, doc_id, any_value(n) as n, term, count(*) as tf
  from (select r, doc_id, len(terms) as n, unnest(terms) as term from d)
  group by r, doc_id, term
),
w as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as weight
  from p, s group by term, docs
),
q as (
  select item_id, text, term, count(*) as times from (
    select item_id, text, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select distinct item_id, text from benchmark))
  group by item_id, text, term
),
g as (
  select item_id, text, r, doc_id, cast(sum(times * weight
      * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // all_terms)))) as bigint) as score
  from q join w using (term) join p using (term), s
  group by item_id, text, r, doc_id
),
o as (
  select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as place
  from g where score > 0
)
select item_id, cast(place as int) as rank, doc_id, score from o where place <= 10
"""
