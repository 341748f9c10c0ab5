"""DuckDB SQL for the queries of this package that SQL can express, written apart from their operators."""

OP5_ORACLE = r"""
with item as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
), doc as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), win as (
    select distinct item_id, list_slice(words, i, i + 12) as win from (select item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as i from item where len(words) > 0)
), place as (
    select r, n, i, list_slice(words, i, i + n - 1) as win from (select r, words, n, unnest(range(1, len(words) - n + 2)) as i from doc cross join (select distinct len(win) as n from win))
), hit as (
    select r, i, n, item_id from place join win using (win)
), covered as (
    select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by 1
), named as (
    select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from hit) group by 1
)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from doc left join covered using (r) left join named using (r)
"""
OP10_ORACLE = r"""
with recursive doc as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), shingle as (
    select distinct doc_id, array_to_string(list_slice(words, i, i + 2), ' ') as s from (select doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) as i from doc where len(words) > 0)
), size as (
    select doc_id, count(*) as n from shingle group by 1
), edge as (
    select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from shingle x join shingle y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2)
    join size p on p.doc_id = a join size q on q.doc_id = b where 100 * common >= 85 * (p.n + q.n - common)
), reach as (
    select doc_id, doc_id as root from doc union select e.b, r.root from reach r join edge e on e.a = r.doc_id
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from (select doc_id, min(root) as component_id from reach group by 1) left join size using (doc_id)
"""

OP7_ORACLE = r"""
with rest as (
    select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), page as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from rest
), rules(v, h, p) as (
    values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit as (
    select page_id, max_by(h || p, len(h || p) * 1000 + len(h)) as rule, max_by(v, len(h || p) * 1000 + len(h)) as said
    from page join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1
), cut as (
    select page_id, host, path, rule, said, list_transform(list_slice(list_filter(string_split(path, '/'), lambda x: x <> ''), 1, 3), lambda x: case when regexp_matches(x, '[0-9]') then '*' else x end) as parts
    from page left join fit using (page_id)
), base as (
    select host, parts, count(said) as labelled, count(*) filter (said = 'block') as blocked from cut group by 1, 2
), wide as (
    select host, list_slice(parts, 1, d) as head, d from base, range(0, 3) t(d) where len(parts) > d group by all having count(distinct parts[d + 1]) > 50
), template as (
    select b.*, list_transform(parts, lambda x, i: case when list_contains(w, i - 1) then '*' else x end) as t
    from (select b.host, b.parts, any_value(labelled) as labelled, any_value(blocked) as blocked, coalesce(list(d) filter (d is not null), []) as w
          from base b left join wide on wide.host = b.host and len(b.parts) > d and list_slice(b.parts, 1, d) = head group by 1, 2) b
), node as (
    select host, list_slice(t, 1, d) as node, d, sum(labelled)::bigint as l, sum(blocked)::bigint as b from template, range(0, 4) r(d) where d <= len(t) group by 1, 2, 3
), root as (
    select coalesce(sum(blocked) / nullif(sum(labelled), 0)::double, 0) as rate from base
), s0 as (
    select host, node, d, l, b, (b + 5.0::double * rate) / (l + 5.0::double) as purity from node, root where d = 0
), s1 as (
    select n.host, n.node, n.d, n.l, n.b, (case when alike then pb else n.b end + 5.0::double * up) / (case when alike then pl else n.l end + 5.0::double) as purity from (
        select n.*, s.l as pl, s.b as pb, s.purity as up, coalesce(abs(n.b / nullif(n.l, 0)::double - (s.b - n.b) / nullif(s.l - n.l, 0)::double)
            <= 1.96 * sqrt(s.b / nullif(s.l, 0)::double * (1 - s.b / nullif(s.l, 0)::double) * (1.0 / nullif(n.l, 0)::double + 1.0 / nullif(s.l - n.l, 0)::double)), false) as alike
        from node n join s0 s on n.host = s.host and list_slice(n.node, 1, 0) = s.node where n.d = 1) n
), s2 as (
    select n.host, n.node, n.d, n.l, n.b, (case when alike then pb else n.b end + 5.0::double * up) / (case when alike then pl else n.l end + 5.0::double) as purity from (
        select n.*, s.l as pl, s.b as pb, s.purity as up, coalesce(abs(n.b / nullif(n.l, 0)::double - (s.b - n.b) / nullif(s.l - n.l, 0)::double)
            <= 1.96 * sqrt(s.b / nullif(s.l, 0)::double * (1 - s.b / nullif(s.l, 0)::double) * (1.0 / nullif(n.l, 0)::double + 1.0 / nullif(s.l - n.l, 0)::double)), false) as alike
        from node n join s1 s on n.host = s.host and list_slice(n.node, 1, 1) = s.node where n.d = 2) n
), s3 as (
    select n.host, n.node, n.d, n.l, n.b, (case when alike then pb else n.b end + 5.0::double * up) / (case when alike then pl else n.l end + 5.0::double) as purity from (
        select n.*, s.l as pl, s.b as pb, s.purity as up, coalesce(abs(n.b / nullif(n.l, 0)::double - (s.b - n.b) / nullif(s.l - n.l, 0)::double)
            <= 1.96 * sqrt(s.b / nullif(s.l, 0)::double * (1 - s.b / nullif(s.l, 0)::double) * (1.0 / nullif(n.l, 0)::double + 1.0 / nullif(s.l - n.l, 0)::double)), false) as alike
        from node n join s2 s on n.host = s.host and list_slice(n.node, 1, 2) = s.node where n.d = 3) n
), level as (
    select * from s0 union all select * from s1 union all select * from s2 union all select * from s3
)
select page_id, c.host, path, rule, coalesce(said, case when purity > 0.8 and l >= 3 then 'block' else 'allow' end) as verdict,
    case when len(t) = 0 then '' else '/' || array_to_string(t, '/') end as template, round(purity, 9) as purity
from cut c left join template x on c.host = x.host and c.parts = x.parts left join level v on x.host = v.host and x.t = v.node
"""


def _lloyd(rounds: int = 4) -> str:
    """Plain Lloyd: every part against every entry, in each round."""
    steps = [
        r"""with kept as (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), part as (
    select vec_id, label, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) as x from kept, (select unnest(range(4)) as p)
), book0 as (
    select p, row_number() over (partition by p order by vec_id) - 1 as e, x from part qualify e < 256
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""near{i} as (
    select vec_id, label, p, x, min({{'d': d, 'e': e}}) as best from (
        select part.vec_id, part.label, part.p, part.x, e, list_sum(list_transform(list_zip(part.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from part join book{i} b on b.p = part.p
    ) group by all
)"""
        )
        if i < rounds:
            steps.append(
                f"""mean{i} as (
    select p, e, list(m order by j) as x from (
        select p, best.e as e, j, cast(floor(sum(x[j]) / count(*)) as bigint) as m from (select *, unnest(range(1, len(x) + 1)) as j from near{i}) group by all
    ) group by all
), book{i + 1} as (
    select b.p, b.e, coalesce(m.x, b.x) as x from book{i} b left join mean{i} m on m.p = b.p and m.e = b.e
)"""
            )
    return (
        ", ".join(steps)
        + f""", coded as (
    select vec_id, any_value(label) as label, string_agg(format('{{:02x}}', best.e), '' order by p) as code, cast(sum(best.d) as bigint) as error from near{rounds} group by vec_id
), by_label as (
    select label, cast(sum(error) as bigint) as label_error from coded group by label
), flat as (
    select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds}
)
select vec_id, code, error, label_error, codebooks_sha256 from coded join by_label on coded.label is not distinct from by_label.label cross join flat
"""
    )


OP11_ORACLE = _lloyd()

OP12_ORACLE = r"""
with turn as (
    select conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as digest, length(coalesce(text, '')) as chars from conversations where conv_id is not null
), own as (
    select conv_id, list({'digest': digest, 'chars': chars} order by turn nulls first, digest) as turns,
        -- CRC-32 of the decimal digits, bit by bit
        xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint)),
            lambda s, b: list_reduce(range(0, 8), lambda a, i: xor(a >> 1, (a & 1) * 3988292384), xor(s, b)), 4294967295), 4294967295) % 6 as h
    from turn group by conv_id
), rebuilt as (
    select own.conv_id, list_concat(list_slice(coalesce(head.turns, []), 1, h), list_slice(own.turns, h + 1, len(own.turns))) as turns
    from own left join (select conv_id, turns from own) head on head.conv_id = own.conv_id - own.conv_id % 100
), member as (
    select conv_id, d, len(turns) = d as ends, md5(array_to_string(list_transform(list_slice(turns, 1, d), lambda t: t.digest), '')) as node,
        case when d > 0 then md5(array_to_string(list_transform(list_slice(turns, 1, d - 1), lambda t: t.digest), '')) end as parent, coalesce(turns[d].chars, 0) as chars
    from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from rebuilt)
), node as (
    select node, parent, d, min(conv_id) as conv_id, count(*) as n, any_value(chars) as chars, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
    from member group by node, parent, d
), child as (
    select parent, count(*) as n from node group by parent
), leaf as (
    select node.*, coalesce(child.n, 0) as n_children from node left join child on child.parent = node.node
), below as (
    select m.node, count(*) filter (where leaf.n_children = 0) as n_leaves, sum((leaf.n - 1) * leaf.chars) as saved
    from leaf join member m on m.conv_id = leaf.conv_id and m.d <= leaf.d group by m.node
)
select leaf.conv_id, leaf.d as depth, up.conv_id as parent_conv_id, leaf.n as n_convs, leaf.n_children, below.n_leaves, cast(below.saved as bigint) as saved_tokens, leaf.ends_sha256
from leaf join below using (node) left join node up on up.node = leaf.parent
"""

OP13_ORACLE = r"""
with doc as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), win as (
    select r, doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) as win from (select r, doc_id, words, unnest(range(1, len(words) - 48)) as i from doc where doc_id is not null)
), hit as (
    select r, i from win join (select win, min(doc_id) as least from win group by 1) using (win) where doc_id > least
), gone as (
    select distinct r, unnest(range(i, i + 50)) as p from hit
), word as (
    select r, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from doc
), kept as (
    select r, string_agg(word, ' ' order by p) as kept from word anti join gone using (r, p) group by 1
), removed as (
    select r, count(*) as n from gone group by 1
)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from doc left join removed using (r) left join kept using (r)
"""
