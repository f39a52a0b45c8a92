"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables.

The others (label model, suffix index, XXH64 fingerprints, tag paths, lattices, gear hashes) are
tested against brute-force versions in tests/llm.
"""

from __future__ import annotations

from .licences import BLANK, CUE, FILE_NAME, FILE_SHARE, OPENING, TEMPLATES, THRESHOLD
from .mixing import Recipe

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACED = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def shards() -> str:
    table = []
    for i in range(16):  # the checksum of four bits, from its polynomial
        for _ in range(4):
            i = 0xEDB88320 ^ i >> 1 if i & 1 else i >> 1
        table.append(str(i))
    step = f"xor(a // 16, ([{','.join(table)}]::bigint[])[cast(xor(a & 15, x) as integer) + 1])"
    return f"""with recursive b as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
v as (select r, doc_id, t, list_transform(string_split(regexp_replace(hex(encode(t)), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: cast(instr('0123456789ABCDEF', x) - 1 as bigint)) as v from b),
c as (select r, doc_id, strlen(t) + 1 as size, case when t = '' then 0 else xor(4294967295, list_reduce(list_prepend(4294967295, v), lambda a, x: {step})) end as text_crc32 from v),
j as (select r, n, case when coalesce(doc_id, 0) >= 0 then coalesce(doc_id, 0)::hugeint else doc_id::hugeint + 18446744073709551616 end as key, 0::bigint as b, 0::bigint as j from c, (values (16), (17)) s(n)
      union all select r, n, k2, j, cast(floor((j + 1) * (2147483648.0::double / (k2 // 8589934592 + 1)::double)) as bigint) from (select *, (key * 2862933555777941757 + 1) % 18446744073709551616 as k2 from j where j < n)),
s as (select r, n, cast(max(b) as integer) as shard from j where j >= n group by all),
a as (select c.doc_id, c.size, c.text_crc32, s.shard, g.shard as grown_shard from c join s on s.r = c.r and s.n = 16 join s g on g.r = c.r and g.n = 17)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, shard, row_number() over (partition by shard order by substr(md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), size, text_crc32, shard, grown_shard)), 1, 3), doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard from a"""


def contamination() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w"
    return f"""with dw as (select row_number() over () as r, doc_id, {words} from documents),
bl as (select item, w, least(10, len(w)) as k from (select coalesce(cast(item_id as varchar), '') as item, {words} from benchmark) where len(w) > 0),
bg as (select distinct item, k, array_to_string(w[i : i + k - 1], ' ') as g from (select *, unnest(range(1, len(w) - k + 2)) as i from bl)),
dg as (select r, k, i, array_to_string(w[i : i + k - 1], ' ') as g from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, (select distinct k from bg) where len(w) >= k)),
hits as (select r, i, k, item from dg join bg using (k, g)),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from (select distinct r, i, k from hits)) group by r),
m as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join n using (r) left join m using (r)"""


def cases(column: str, names: dict, other) -> str:
    return f"case {' '.join(f'when {column} in ({', '.join(map(quoted, k))}) then {v}' for k, v in names.items())} else {other} end"


def filled(source: str, parent: str, name: str) -> str:
    family = f"partition by {parent}" if parent else ""
    order = f"{family} order by c / w, {name}"
    return f"""(select *, case when full_ then c else (rest * upto) // open_ - (rest * (upto - w)) // open_ end as quota from (
 select *, b - sum(case when full_ then c else 0 end) over ({family}) as rest, sum(case when full_ then 0 else w end) over ({family}) as open_, sum(case when full_ then 0 else w end) over ({order} rows unbounded preceding) as upto from (
 select *, c * (wsum - wb) <= w * (b - cb) as full_ from (
 select *, sum(w) over ({family}) as wsum, coalesce(sum(w) over ({order} rows between unbounded preceding and 1 preceding), 0) as wb, coalesce(sum(c) over ({order} rows between unbounded preceding and 1 preceding), 0) as cb from {source}))))"""


def mix(recipe: Recipe = Recipe()) -> str:
    domain = cases("source", {v: quoted(k) for k, v in recipe.domain_sources.items()}, "'other'")
    weight = {level: cases(level, {(k,): v for k, v in recipe.weights[level].items()}, recipe.other[level]) for level in recipe.weights}
    return f"""with d as (select doc_id, {domain} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '{SPACED}')), 0) as n_tokens from documents),
leaf as (select domain, lang, source, cast(sum(n_tokens) as hugeint) as tokens, {weight['source']} as w, cast(sum(n_tokens) as hugeint) * {recipe.max_epochs} as c from d group by all having sum(n_tokens) > 0),
q1 as (select domain, quota from {filled(f"(select domain, {weight['domain']} as w, sum(c) as c, (select cast(sum(n_tokens) as hugeint) * {recipe.budget_percent} // 100 from d) as b from leaf group by domain)", "", "domain")}),
q2 as (select domain, lang, quota from {filled(f"(select domain, lang, {weight['lang']} as w, sum(c) as c, any_value(q1.quota) as b from leaf join q1 using (domain) group by domain, lang)", "domain", "lang")}),
q3 as (select domain, lang, source, tokens, quota from {filled("(select leaf.*, q2.quota as b from leaf join q2 using (domain, lang))", "domain, lang", "source")}),
p as (select *, cast(quota // tokens as bigint) as epochs, quota % tokens as rest from q3),
x as (select d.*, epochs, rest, md5('{recipe.seed}:' || epochs || ':' || coalesce(cast(doc_id as varchar), '')) as place from d join p using (domain, lang, source) where n_tokens > 0),
y as (select *, sum(n_tokens) over (partition by domain, lang, source order by place rows unbounded preceding) - n_tokens as before from x)
select doc_id, domain, lang, source, e as epoch, n_tokens, n_tokens as take_tokens from (select *, unnest(range(epochs)) as e from y)
union all select doc_id, domain, lang, source, epochs, n_tokens, cast(least(n_tokens, rest - before) as bigint) from y where rest > before"""


def licences() -> str:
    known = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    term = "unnest(regexp_extract_all(lower({0}), '[a-z0-9]+(\\.[0-9]+)?')) as term"
    part = lambda c: f"coalesce(cast({c} as varchar), '_')"
    return f"""with f as (select doc_id, '/' || {part("source")} || '/' || {part("lang")} || '/' || {part("doc_id // 1000")} || '/' || {part("doc_id")} || '.txt' as path, text from documents),
g as (select *, regexp_replace(path, '/[^/]*$', '') as dir from f),
s0 as (select path, dir, text, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{CUE}')) as ls, list_filter(string_split_regex(text, '{BLANK}'), lambda l: regexp_matches(l, '{CUE}')) as ps, len(regexp_extract_all(text, '{SPACED}')) as n_words, regexp_matches(split_part(path, '/', -1), '{FILE_NAME}') as named from g where regexp_matches(text, '{CUE}')),
s as (select path, dir, n_words, named, list_concat(case when named or regexp_matches(text, '{OPENING}') or coalesce(list_sum(list_transform(ls, lambda l: len(regexp_extract_all(l, '{SPACED}')))), 0) >= n_words * {FILE_SHARE} then [{{'kind': 0, 'line': text}}] else [] end, list_transform(ps, lambda l: {{'kind': 1, 'line': l}}), list_transform(ls, lambda l: {{'kind': 2, 'line': l}})) as units from s0),
said as (select path, dir, named, n_words, u.kind as kind, u.line as line from (select *, unnest(units) as u from s)),
t(template, licence, text) as (values {known}),
l as (select line, count(*) as n from said group by line),
lt as (select line, n, term, count(*) as tf from (select line, n, {term.format("line")} from l) group by all),
df as (select term, sum(n) as df from lt group by term),
mine as (select line, term, tf * (ln((1.0 + (select count(*) from said)) / (1 + df)) + 1) as w from lt join df using (term)),
theirs as (select template, licence, term, tf * (ln((1.0 + (select count(*) from said)) / (1 + coalesce(df, 0))) + 1) as v from (select template, licence, term, count(*) as tf from (select template, licence, {term.format("text")} from t) group by all) left join df using (term)),
sc as (select m.line, licence, round(sum(w * v) / (any_value(wn) * any_value(vn)), 6) as score from mine m join theirs using (term) join (select line, sqrt(sum(w * w)) as wn from mine group by line) a on a.line = m.line join (select template, sqrt(sum(v * v)) as vn from theirs group by template) b using (template) group by m.line, template, licence),
bl as (select line, licence, score from sc where score >= {THRESHOLD} qualify row_number() over (partition by line order by score desc, licence) = 1),
own as (select path, dir, named or len(regexp_extract_all(line, '{SPACED}')) >= n_words * {FILE_SHARE} as is_file, licence, score from said join bl using (line) qualify row_number() over (partition by path order by kind, score desc, licence) = 1),
dl as (select dir, licence from (select dir, licence, count(*) as n from own where is_file group by all) qualify row_number() over (partition by dir order by n desc, licence) = 1),
near as (select g.dir, dl.licence, dl.dir as source_dir from (select distinct dir from g) g join dl on g.dir = dl.dir or starts_with(g.dir, dl.dir || '/') qualify row_number() over (partition by g.dir order by length(dl.dir) desc) = 1)
select doc_id, g.path, own.licence as own_licence, own.score as own_score, coalesce(own.licence, near.licence) as licence, case when own.licence is null then near.source_dir end as inherited_from from g left join own using (path) left join near on near.dir = g.dir"""


def crc32(text: str) -> str:
    """The unsigned checksum of a text that isn't empty, four bits at a time."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = 0xEDB88320 ^ i >> 1 if i & 1 else i >> 1
        table.append(str(i))
    step = f"xor(a // 16, ([{','.join(table)}]::bigint[])[cast(xor(a & 15, x) as integer) + 1])"
    digits = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: cast(instr('0123456789ABCDEF', x) - 1 as bigint))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {digits}), lambda a, x: {step}))"


def manifest() -> str:
    field = lambda v: f"coalesce(strlen(cast({v} as varchar)) || ':' || cast({v} as varchar), '-')"
    leaf = lambda t: f"sha256(concat({field('doc_id')}, {field('source')}, {field('lang')}, {field('n_chars')}, {field(t)}))"
    shown = f"case when {crc32('cast(doc_id as varchar)')} % 3 = 0 then translate(text, {LOWER}) else text end"
    tree = lambda name, start: f"""{name}(t, l, i, c, h) as (select * from ({start}) union all
 select t, l + 1, i // 8, (any_value(c) + 7) // 8, sha256(string_agg(h, '' order by i)) from {name} where c > 1 group by t, l, i // 8)"""  # noqa: E731
    climb = lambda name, start, nodes: f"""{name}(r, t, l, i, c, h, proof) as (select * from ({start}) union all
 select w.r, w.t, w.l + 1, w.i // 8, (any_value(w.c) + 7) // 8, sha256(string_agg(case when n.i = w.i then w.h else n.h end, '' order by n.i)), any_value(w.proof) || coalesce(string_agg(n.h, '' order by n.i) filter (n.i <> w.i), '')
 from {name} w join {nodes} n on n.t = w.t and n.l = w.l and n.i // 8 = w.i // 8 where w.c > 1 group by w.r, w.t, w.l, w.i // 8)"""  # noqa: E731
    return f"""with recursive a as materialized (select row_number() over () as r, doc_id, lang, {leaf('text')} as leaf, {leaf('shown')} as shown from (select *, {shown} as shown from documents)),
d as materialized (select *, dense_rank() over (order by lang nulls first) - 1 as t, row_number() over (partition by lang order by doc_id nulls first, leaf, shown) - 1 as i, count(*) over (partition by lang) as c from a),
{tree('n', 'select t, 0 as l, i, c, leaf as h from d')},
s as materialized (select t, h, count(*) over () as g from n where c = 1),
{tree('m', 'select 0 as t, 0 as l, t as i, g as c, h from s')},
{climb('w', "select r, t, 0 as l, i, c, shown as h, '' as proof from d", 'n')},
{climb('x', 'select w.r, 0 as t, 0 as l, w.t as i, s.g as c, w.h, w.proof from w join s using (t) where w.c = 1', 'm')}
select d.doc_id, d.leaf, s.h as subroot, m.h as root, sha256(x.proof) as proof_sha256, x.h as folded_root, x.h = m.h as verified from d join s using (t) join x on x.r = d.r and x.c = 1 join m on m.c = 1"""


def ranking() -> str:
    terms = f"unnest(regexp_extract_all(translate(text, {LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term"
    return f"""with t as (select r, doc_id, term, count(*) as tf from (select r, doc_id, {terms} from (select row_number() over () as r, doc_id, text from documents)) group by all),
d as (select r, any_value(doc_id) as doc_id, cast(sum(tf) as bigint) as n from t group by r),
c as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from d),
df as (select term, cast(floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1))) as bigint) as w from t, c group by term),
i as (select distinct item_id, term from (select item_id, {terms} from benchmark)),
s as (select item_id, r, any_value(d.doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * big_n) // big_l))))) as bigint) as score from i join df using (term) join t using (term) join d using (r), c group by item_id, r)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from s where score > 0 qualify rank <= 10"""


ORACLE_SQL = {
    "op1_hierarchical_mix": mix(),
    "op4_jump_hash_shards": shards(),
    "op6_winnowing_decontamination": contamination(),
    "op10_licence_inheritance": licences(),
    "op11_ranked_search": ranking(),
    "op13_merkle_manifest": manifest(),
}
