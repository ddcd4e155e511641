"""SQL of the queries op3 and op11 to op13, in DuckDB's dialect."""

_WORD = "[^\\x20\\x09-\\x0D]+"

RUNS = f"""
with crc_table as (
  select k, list_reduce(list_prepend(k, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v
  from (select unnest(range(256))::bigint k)),
tb as (select list(v order by k) t from crc_table),
dx as (
  select doc_id, text, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint) digits from documents),
ha as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w,
    xor(list_reduce(list_prepend(4294967295::bigint, digits), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) h
  from dx, tb),
pa as (
  select doc_id, w, len(w) n, h, h // 10 g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end a from ha),
pb as (select *, 1 + (n - a) // (3 + g % 8) p from pa),
wo as (
  select doc_id, n, k, case when a is null or k < a then w[k + 1] else w[a + (k - a) % p + 1] end word
  from (select *, unnest(range(n)) k from pb)),
gr as (
  select doc_id, n, k, string_agg(word, ' ') over v s, count(*) over v m
  from wo window v as (partition by doc_id order by k rows between current row and 7 following)),
gg as (select doc_id, n, k, md5(s) s from gr where m = 8),
pr as (
  select x.doc_id, x.k, y.k - x.k q from gg x join gg y on x.doc_id = y.doc_id and x.s = y.s and y.k > x.k and 3 * (y.k - x.k) <= x.n),
il as (select doc_id, q, k, k - row_number() over (partition by doc_id, q order by k) island from pr),
ru as (
  select doc_id, min(k) start, count(*) + 7 + q length, q from il group by doc_id, q, island
  having count(*) + 7 + q >= 24 and count(*) + 7 + q >= 3 * q),
mi as (select doc_id, start, length, min(q) period from ru group by 1, 2, 3),
be as (
  select doc_id, start, length, period,
    row_number() over (partition by doc_id order by length::decimal(18, 9) / period desc, start, period) place from mi),
li as (
  select doc_id, count(*) n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) lines
  from mi group by 1),
dr as (select distinct doc_id, unnest(range(start + period, start + length)) k from mi),
ke as (
  select wo.doc_id, string_agg(word, ' ' order by wo.k) kept
  from wo left join dr on wo.doc_id = dr.doc_id and wo.k = dr.k where dr.k is null group by 1)
select d.doc_id, coalesce(n_runs, 0) n_runs, be.start::bigint start, be.length::bigint length, be.period::bigint period,
  (be.length * 1000 // be.period)::bigint exponent_milli, sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(kept, '')) collapsed_sha256
from documents d left join li using (doc_id) left join be on be.doc_id = d.doc_id and place = 1 left join ke on ke.doc_id = d.doc_id
"""

NEAREST = """
with us as (
  select vec_id id, embedding::double[] e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
sc as (
  select x.id query_id, y.id vec_id,
    list_reduce(list_prepend(0::double, list_transform(range(1, len(x.e) + 1), lambda i: x.e[i] * y.e[i])), lambda s, p: s + p) score
  from us x join us y on x.id % 20 = 0 and x.id <> y.id and len(x.e) = len(y.e)),
ra as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from sc)
select query_id, rank::integer rank, vec_id, score from ra where rank <= 20
"""

NEGATIVES = """
with us as (
  select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
    list_transform(embedding::double[], lambda x: floor(x * 256)::bigint) e
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
sc as (
  select x.id a, y.id b, x.label = y.label same, list_sum(list_transform(range(1, len(x.e) + 1), lambda i: x.e[i] * y.e[i]))::bigint s
  from us x join us y on x.id % 50 = 0 and x.id <> y.id and len(x.e) = len(y.e)),
po as (
  select a, b, s from (select *, row_number() over (partition by a order by s desc, b) place from sc where same) where place <= 5),
ne as (
  select po.a, po.b positive, po.s positive_score, sc.b negative, sc.s negative_score,
    row_number() over (partition by po.a, po.b order by sc.s desc, sc.b) rank
  from po join sc on po.a = sc.a and not same and 50 * po.s <= 100 * sc.s and 100 * sc.s <= 95 * po.s)
select a anchor_id, positive positive_id, rank::integer rank, negative negative_id, positive_score, negative_score from ne where rank <= 3
"""

SUBSTRINGS = """
with he as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
sz as (select doc_id, h, len(h) // 2 n from he),
pi as (select doc_id, i, substr(h, 2 * i + 1, 2 * 611) p, n from (select doc_id, h, n, unnest(range(0, n, 512)) i from sz)),
wi as (select doc_id, i + k k, md5(substr(p, 2 * k + 1, 200)) m from (select *, unnest(range(512)) k from pi) where i + k + 100 <= n),
fi as (select m, min((doc_id, k)) first from wi group by 1 having count(*) > 1),
ag as (select doc_id, k from wi join fi using (m) where (doc_id, k) <> first),
he2 as (select *, coalesce(k > lag(k) over (partition by doc_id order by k) + 100, true) head from ag),
nu as (select *, sum(head::integer) over (partition by doc_id order by k) island from he2),
sp as (select doc_id, min(k) a, max(k) + 100 b from nu group by doc_id, island),
ed as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) s, a e from sp
  union all select sz.doc_id, coalesce(max(b), 0), any_value(n) from sz left join sp on sz.doc_id = sp.doc_id group by sz.doc_id),
ke as (select ed.doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' order by s) kept from ed join sz on ed.doc_id = sz.doc_id group by 1),
su as (select doc_id, sum(b - a)::bigint n_removed, count(*) n_spans from sp group by 1)
select sz.doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(kept)) kept_sha256
from sz left join su on sz.doc_id = su.doc_id left join ke on ke.doc_id = sz.doc_id
"""
