"""DuckDB SQL of the queries, written from their definitions.

Where a method's own part has no SQL, a query without the op prefix takes the
rest of that operator's result, and its SQL is here.
"""

from __future__ import annotations

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = "coalesce(text, '')"
_WORDS = r"'[^\x20\x09-\x0D]+'"


def _crc32(values: str) -> str:
    """crc32 of a list of bytes, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {values}), lambda c, b: {byte}), 4294967295::bigint)"


_ID_CRC = _crc32("list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)")

JACCARD = f"""
with recursive words as (
  select doc_id, regexp_extract_all({_FOLD.format(_TEXT)}, {_WORDS}) as w from documents
), grams as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)
), sizes as (
  select doc_id, count(g) as n from words left join grams using (doc_id) group by doc_id
), links as (
  select x.doc_id as a, y.doc_id as b
  from (select p.doc_id as x, q.doc_id as y, count(*) as i from grams p join grams q on p.g = q.g and p.doc_id <> q.doc_id group by 1, 2) o
  join sizes x on x.doc_id = o.x join sizes y on y.doc_id = o.y
  where 100 * i >= 90 * (x.n + y.n - i)
), reached(doc_id, c) as (
  select doc_id, doc_id from words union select b, c from reached join links on a = doc_id
)
select doc_id, n::bigint as n_shingles, min(c) as component_id from reached join sizes using (doc_id) group by doc_id, n
"""

REPEATS = f"""
with words as (
  select doc_id, regexp_extract_all({_TEXT}, {_WORDS}) as w from documents
), windows as (
  select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as win
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)
), firsts as (
  select win, min(doc_id) as first_doc from windows group by win
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as i
  from windows join firsts using (win) where first_doc < doc_id
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as kept
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words) anti join gone using (doc_id, i)
  group by doc_id
), removed as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from words left join removed using (doc_id) left join kept using (doc_id)
"""

#: Matches are set between two marks; their places follow from the lengths of all
#: pieces before them.
PII_BASE = rf"""
with patterns(kind, place, pattern) as (values
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  ('card', 2, '[0-9](?:[\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')
), cut as (
  select doc_id, kind, place, string_split(regexp_replace({_TEXT}, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) as p from documents, patterns
), pieces as (
  select doc_id, kind, place, unnest(p) as piece, generate_subscripts(p, 1) as i from cut where len(p) > 1
), placed as (
  select doc_id, kind, place, i, split_part(piece, chr(2), 1) as hit, length(split_part(piece, chr(2), 1)) as n,
    coalesce(sum(case when i = 1 then length(piece) else length(piece) - 1 end) over (partition by doc_id, kind order by i rows between unbounded preceding and 1 preceding), 0) as spot
  from pieces
), judged as (
  select *, list_reverse(list_transform(regexp_extract_all(hit, '[0-9]'), lambda d: d::int)) as digits from placed where i > 1
), spans as (
  select doc_id, kind, place, spot::bigint as a, (spot + n)::bigint as b from judged
  where case kind
    when 'ip' then len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(x as int), 999) > 255)) = 0
    when 'card' then len(digits) between 16 and 19 and list_sum(list_transform(range(1, len(digits) + 1), lambda j: case when j % 2 = 1 then digits[j] when digits[j] > 4 then 2 * digits[j] - 9 else 2 * digits[j] end)) % 10 = 0
    when 'phone' then len(digits) between 8 and 15
    else true end
)
select d.doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by place, a), '')) as base_sha256
from (select distinct doc_id from documents) d left join spans using (doc_id) group by d.doc_id
"""

SHARD_TOTALS = f"select count(*) as n_rows, sum(octet_length(encode({_TEXT})) + 1)::bigint as bytes, 8::bigint as shards, 0::bigint as gaps, 0::bigint as split_copies, true as near_equal from documents"
SHARD_SIZES = f"select doc_id, (octet_length(encode({_TEXT})) + 1)::bigint as size, {_crc32(f"list_transform(regexp_extract_all(hex(encode({_TEXT})), '..'), lambda h: ('0x' || h)::bigint)")} as text_crc32, 'bytes' as law from documents"
DECODED = f"select doc_id, sha256({_TEXT}) as decoded_sha256 from documents"

LANGUAGE_MODEL_BASE = f"""
with d as (
  select doc_id, {_ID_CRC} % 7 = 2 as held_out, regexp_extract_all({_FOLD.format(_TEXT)}, {_WORDS}) as w from documents
), t as (
  select doc_id, held_out, unnest(list_append(list_transform(w, lambda x: 'w' || x), 'end')) as token from d
), c as (select token, count(*) as c from t where not held_out group by token),
n as (select sum(c)::bigint as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n.n) as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n.n + n.v + 1)::double)), 6) as base_score
from t left join c using (token), n group by doc_id, held_out
"""

LICENSE_BASE = rf"""
with d as (
  select doc_id, regexp_extract_all({_FOLD.format(_TEXT)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), p as (
  select doc_id, w, list_filter(range(1, len(w)), lambda i: w[i] = 'mit' and w[i + 1] = 'license') as m, list_filter(range(1, len(w)), lambda i: w[i] = 'apache' and w[i + 1] = 'license') as a,
    list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license') as g from d
)
select doc_id, len(w)::bigint as n_words, (len(m) + len(a) + len(g))::bigint as n_base,
  (list_min(list_concat(m, a, g)) - 1)::bigint as first_word, (list_max(list_concat(m, a, g)) - 1)::bigint as last_word,
  array_to_string(list_filter([case when len(a) > 0 then 'apache' end, case when len(g) > 0 then 'gpl' end, case when len(m) > 0 then 'mit' end], lambda x: x is not null), ',') as base_labels
from p
"""

QUALITY_BASE = rf"""
with d as (
  select doc_id, {_TEXT} as t, regexp_extract_all({_TEXT}, {_WORDS}) as w from documents
), wins as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)
), twice as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from wins) where n > 1
), covered as (
  select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 8)) as j from twice) group by doc_id
), f as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(n, 0)::bigint as n_repeat_words
  from d left join covered using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f
"""

ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": JACCARD,
    "op6_substring_dedup": REPEATS,
    "pii_base": PII_BASE,
    "shard_totals": SHARD_TOTALS,
    "shard_sizes": SHARD_SIZES,
    "bpe_decoded": DECODED,
    "language_model_base": LANGUAGE_MODEL_BASE,
    "license_base": LICENSE_BASE,
    "quality_base": QUALITY_BASE,
}
