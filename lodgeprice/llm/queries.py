"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (chattree, decontam, htmltext, minhash, mixing, pii, pqindex, prefixtrie, quality, sharding, substrings, urls,
               variants)
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqindex.near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages", "page_id", "url"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents", "doc_id", "text"),
                          read(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_report(read(spark, sf_dir, "documents", "doc_id", "text"),
                                read(spark, sf_dir, "labels", "doc_id", "quality"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_duplicate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                    "conv_id long, turn long, role string, text string")
    return chattree.format_report(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").union(planted))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefixtrie.paths(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return prefixtrie.trie(prefixtrie.rebuilt(own))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a string's UTF-8 bytes; the table follows from the polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(f"{i}")
    code = f"hex(encode({text}))"
    listed = f"[4294967295::bigint] || [('0x' || substr({code}, 2 * i + 1, 2))::bigint for i in range(0, length({code}) // 2)]"
    step = f"xor(c >> 8, ([{','.join(table)}]::bigint[])[xor(c & 255, b) + 1])"
    return f"xor(list_reduce({listed}, lambda c, b: {step}), 4294967295::bigint)"


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_personal_data": op2_personal_data,
    "op3_near_vectors": op3_near_vectors,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality_rules": op6_quality_rules,
    "op7_main_text": op7_main_text,
    "op8_duplicate_spans": op8_duplicate_spans,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_ring_shards": op10_ring_shards,
    "op11_chat_tree": op11_chat_tree,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op1_mixing": r"""
with d as (
  select doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w from s),
o as (
  select *, sum(source_size) over () * 1.5::double as total,
    coalesce(sum(source_size) over b, 0)::bigint as filled,
    (sum(w) over () - coalesce(sum(w) over b, 0))::bigint as w_left
  from w window b as (order by source_size::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (total - 2 * filled) / w_left as level from o),
f as (select (select level from l where 2 * source_size > level * w order by filled limit 1) as level),
t as (select source, source_size, least(w * f.level, (2 * source_size)::double) as target from l, f),
r as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0::double as draw
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (floor(rate)::int + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken,
  (floor(rate)::int + case when draw < rate - floor(rate) then 1 else 0 end)::int as copies
from r""",
    # roles and texts read back are those that went in; escapes add one code point each
    "op11_chat_tree": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
    len(regexp_extract_all(text, '[<[]\\*(/?s>|/?(INST|SYS|ROLE)\])')) + length(text) as chars,
    len(regexp_extract_all(role, '[<[]\\*(/?s>|/?(INST|SYS|ROLE)\])')) + length(role) as role_chars
  from c)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars + case role when 'user' then 13 when 'system' then 11 when 'assistant' then 4 else 17 + role_chars end)::bigint
    as formatted_chars
from t group by conv_id""",
    "op12_spelling_variants": rf"""
with recursive r as (
  select coalesce(doc_id::varchar, 'null') as id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run
  from documents),
g as (select id, run, count(*) as k, length(run) as size, {crc32_sql("id || ':' || run")} as h from r group by id, run),
w as (
  select case when h % 199 = 0 then substr(run, 1, (h % size)::int) || substr(run, (h % size)::int + 2) else run end as word, k
  from g),
v as (select word, sum(k)::bigint as n from w where length(word) >= 6 group by word having sum(k) >= 5),
x as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select *, unnest(range(1, length(word) + 1)) as i from v)),
p as (
  select a.word, b.word as other, b.n as m from x a join x b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select x.word, v.word, v.n from x join v on x.rest = v.word
  union select v.word, x.word, x.n from x join v on x.rest = v.word),
f as (
  select v.word, v.n, count(other)::bigint as n_near, max(m) as top, arg_min(other, (-m, other)) as best
  from v left join p on v.word = p.word group by v.word, v.n),
form as (select word, n, n_near, case when top >= 5 * n then best end as form, case when top >= 5 * n then top end as form_n from f),
walk as (
  select word, word as at, form as next from form
  union all select walk.word, walk.next, form.form from walk join form on walk.next = form.word)
select form.word, form.form, walk.at as root, form.n, form.n_near, form.form_n::bigint as form_n
from form join walk on form.word = walk.word and walk.next is null""",
    "op13_prefix_trie": rf"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as k
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 100 as base, {crc32_sql("conv_id::varchar")} % 6 as h
  from (select distinct conv_id from t)),
b as (
  select c.conv_id, t.k, role, text from c join t on t.conv_id = c.base and t.k <= c.h
  union all select c.conv_id, t.k, role, text from c join t on t.conv_id = c.conv_id and t.k > c.h),
s as (
  select c.conv_id, coalesce(list({{'d': md5(length(role)::varchar || ':' || role || text), 'c': length(text)}} order by k)
    filter (where role is not null), []) as path
  from c left join b on c.conv_id = b.conv_id group by c.conv_id),
m as (
  select conv_id, depth, len(path) = depth as is_end, path[depth].c as chars,
    md5(array_to_string([x.d for x in path[1:depth]], '')) as node,
    md5(array_to_string([x.d for x in path[1:depth - 1]], '')) as up,
    [md5(array_to_string([x.d for x in path[1:e]], '')) for e in range(0, depth + 1)] as line
  from (select *, unnest(range(0, len(path) + 1)) as depth from s)),
n as (
  select depth, node, case when depth > 0 then any_value(up) end as up, min(conv_id) as conv_id, count(*)::bigint as n_convs,
    coalesce(any_value(chars), 0) * (count(*) - 1) as saved, any_value(line) as line,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_end), '')) as ends_sha256
  from m group by depth, node),
k as (select depth - 1 as depth, up as node, count(*)::bigint as n_children from n where up is not null group by all),
l as (select n.*, coalesce(n_children, 0)::bigint as n_children from n left join k on n.depth = k.depth and n.node = k.node),
z as (
  select depth, node, sum((n_children = 0)::int)::bigint as n_leaves, sum(saved)::bigint as saved_tokens
  from (select n_children, saved, unnest(line) as node, unnest(range(0, depth + 1)) as depth from l) group by all)
select l.conv_id, l.depth::bigint as depth, q.conv_id as parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens,
  l.ends_sha256
from l join z on l.depth = z.depth and l.node = z.node left join l q on q.depth = l.depth - 1 and q.node = l.up""",
}
