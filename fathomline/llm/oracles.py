"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

NIBBLES = ", ".join(f"'{n:04b}'" for n in range(16))
FIVE = " + ".join(f"(ascii(s[i + {k + 1}]) - 48) * {16 >> k}" for k in range(5))

WARC = f"""with d as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
 b as (select *, array_to_string(list_transform(string_split(h, ''), lambda c: [{NIBBLES}][strpos('0123456789abcdef', c)]), '') as s from d),
 k as (select *, array_to_string(list_transform(range(0, 160, 5), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {FIVE}, 1)), '') as digest from b),
 m as (select *, max(page_id) over (partition by digest) as head from k)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when page_id = head then 'response' else 'revisit' end as record_type, case when page_id <> head then head end as refers_to from m"""


def vector_codes(rounds: int = 6) -> str:
    """k-means of 8 parts and 16 entries over vectors of one length, a pair of common tables a round."""
    near = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as materialized (select vec_id, j, e, d from (select p.vec_id, p.j, c.e, {near} as d from parts p join c{r} c using (j))
  qualify row_number() over (partition by vec_id, j order by d, e) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} as materialized (select c.j, c.e, coalesce(n.x, c.x) as x from c{r} c left join (
  select j, e, list(cast(floor(s / n) as bigint) order by i) as x from (
   select a.j, a.e, i, sum(p.x[i]) as s, count(*) as n from a{r} a join parts p using (vec_id, j), unnest(range(1, len(p.x) + 1)) t(i) group by a.j, a.e, i) group by j, e) n using (j, e))"""
            )
    tables = ",\n ".join(steps)
    return f"""with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 parts as materialized (select vec_id, j, v[j * (len(v) // 8) + 1 : (j + 1) * (len(v) // 8)] as x from kept, unnest(range(8)) t(j)),
 c0 as materialized (select j, row_number() over (partition by j order by vec_id) - 1 as e, x from parts where vec_id in (select vec_id from kept order by vec_id limit 16)),
 {tables},
 b as (select sha256(string_agg(array_to_string(x, ','), ',' order by j, e)) as sha from c{rounds}),
 o as (select vec_id, string_agg(printf('%02x', cast(e as int)), '' order by j) as code, cast(sum(d) as bigint) as error from a{rounds} group by vec_id)
select k.vec_id, o.code, o.error, cast(sum(o.error) over (partition by k.label) as bigint) as label_error, b.sha as codebooks_sha256 from kept k join o using (vec_id), b"""

#: crc32 of a short text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)))"""

PREFIX_TRIE = f"""with own as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first) as x from conversations where conv_id is not null group by conv_id),
 h as (select *, {CRC32.format(text="conv_id::varchar")} % 4 as h from own),
 rebuilt as (select c.conv_id, list_concat(case when b.x is null then [] else b.x[1:c.h] end, c.x[c.h + 1:]) as x from h c left join own b on b.conv_id = c.conv_id - c.conv_id % 20),
 places as (select conv_id, d, x[1:d] as k, len(x) = d as ends from rebuilt, unnest(range(len(x) + 1)) u(d)),
 nodes as materialized (select k, d, min(conv_id) as conv_id, count(*) as n, (count(*) - 1) * coalesce(len(regexp_extract_all(k[d].t, '[^\\x20\\x09-\\x0D]+')), 0) as saved,
   sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends from places group by k, d),
 children as (select k[1:d - 1] as k, count(*) as c from nodes where d > 0 group by 1),
 valued as materialized (select n.*, coalesce(c, 0) as c from nodes n left join children using (k)),
 sums as (select k[1:a] as k, sum(cast(c = 0 as int)) as leaves, sum(saved) as saved from valued, unnest(range(d + 1)) u(a) group by 1)
select v.conv_id, v.d as depth, p.conv_id as parent_conv_id, v.n as n_convs, cast(v.c as bigint) as n_children, cast(s.leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, v.ends as ends_sha256
from valued v join sums s using (k) left join nodes p on v.d > 0 and p.k = v.k[1:v.d - 1]"""
