"""The registered queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import ann, chat, jaccard, linededup, mixing, packing, quality, sharding, sketches, unigram
from shutterlake.llm.common import table
from shutterlake.session import ship

PROBE = "\\### Assistant: </turn> ok"


def vocabulary_file(name: str) -> str:
    """Where the installed public tokenizers keep a file; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return chat.digests(chat.format_conversations(turns.union(probe), vocabulary_file("byte_bpe_50k.json")))


def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op4_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.crc32_of_ids(packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json")))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_QUERIES = [op1_chat_masks, op2_adaptive_scan, op3_viterbi_counts, op4_flow_mix, op5_jump_shards, op6_line_templates, op7_bottom_k, op8_divide_skip, op9_cost_packing, op10_pu_quality]


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {q.__name__: _shipped(q) for q in _QUERIES}


_OP1 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped as (
  select *, replace(replace(role, '\', '\\'), '<|', '<\|') as r, replace(replace(text, '\', '\\'), '<|', '<\|') as t from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<|turn|><|text|><|end|>') + length(r) + length(t))::bigint as formatted_chars
from escaped group by conv_id
"""

_OP4 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix-1:' || coalesce(doc_id::varchar, '')) as digest from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([5, 2, 1])[((row_number() over (order by source nulls last)) - 1) % 3 + 1] as w from s),
o as (
  select *, row_number() over (order by 2 * source_size / w, source nulls last) as i,
    1.5::double * sum(source_size) over () - coalesce(sum(2 * source_size) over (order by 2 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over (order by 2 * source_size / w desc, source desc nulls first rows between unbounded preceding and current row) as rest_w from w),
f as (select min(i) as i from o where not w * (rest::double / rest_w::double) > 2 * source_size),
l as (select rest::double / rest_w::double as level from o join f using (i)),
t as (select o.source, source_size, case when o.i < coalesce((select i from f), 1e18) then (2 * source_size)::double else w * (select level from l) end as target from o),
q as (
  select d.*, source_size, target, floor(target)::bigint as amount,
    coalesce(sum(size) over (partition by d.source order by digest, doc_id, size rows between unbounded preceding and 1 preceding), 0) as upto
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  case when source_size = 0 then 0 else ((amount // source_size) * size + greatest(0, least(size, amount % source_size - upto))) end::bigint as taken
from q
"""

_OP5 = r"""
with recursive bit(i, c, k) as (
  select i, i::bigint, 0 from range(256) r(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bit where k < 8),
crc as (select list(c order by i) as t from bit where k = 8),
d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
b as (select row, doc_id, strlen(text) + 1 as size, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::bigint) as bytes from d),
c as (select b.*, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295::bigint) as text_crc32 from b, crc),
jump(row, n, k, b, j) as (
  select row, n, case when coalesce(doc_id, 0) < 0 then doc_id::hugeint + 18446744073709551616 else coalesce(doc_id, 0)::hugeint end, 0::bigint, 0::bigint
  from d, (values (16), (17)) v(n)
  union all
  select row, n, k2, j, floor((j + 1)::double * (2147483648::double / ((k2 // 8589934592)::double + 1)))::bigint
  from (select *, (k * 2862933555777941757 + 1) % 18446744073709551616 as k2 from jump where j < n)),
landed as (select row, n, max(b)::int as shard from jump where j >= n group by row, n),
rows as (
  select doc_id, size::bigint as size, text_crc32, 'key' as law, x.shard, y.shard as grown_shard
  from c join landed x on c.row = x.row and x.n = 16 join landed y on c.row = y.row and y.n = 17)
select doc_id, size, text_crc32, law, shard,
  row_number() over (partition by shard order by substr(md5(coalesce(doc_id::varchar, '')), 1, 3), doc_id, text_crc32, size) - 1 as slot, grown_shard
from rows
"""

_OP6 = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
w as (select doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as words from l),
m as (select *, list_transform(words, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as mask from w where len(words) > 0),
o as (
  select doc_id, line_no, len(words) as n, mask[1:3] as head, case when open then mask else words end as tokens, open
  from (select *, len(words) >= 4 and len(list_filter(mask, lambda c: c <> '<*>')) >= 0.7 * len(mask) as open from m)),
e as (select n, head, tokens, min(doc_id) as lo, max(doc_id) as hi from o where open group by all),
leaves as (select n, head, count(*) as texts from e group by all having count(*) > 1 and min(lo) <> max(hi)),
x as (select e.*, texts, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from e join leaves using (n, head)),
st as (select n, head, pos, token, count(*) > 0.5 * any_value(texts) as common from x where token <> '<*>' group by n, head, pos, token having min(lo) <> max(hi)),
g as (
  select x.n, x.head, x.tokens, list(case when st.token is not null then x.token else '<*>' end order by x.pos) as stays, list(case when st.common then x.token else '<*>' end order by x.pos) as common
  from x left join st on x.n = st.n and x.head = st.head and x.pos = st.pos and x.token = st.token group by all),
t as (
  select distinct tokens, cells from (select tokens, stays as cells from g union all select tokens, common from g)
  where len(list_filter(cells, lambda c: c <> '<*>')) >= 0.7 * len(cells)),
p as (
  select o.doc_id, o.line_no, case when not open then {'k': 'line', 'v': o.tokens} when t.cells is null then {'k': 'mask', 'v': o.tokens} else {'k': 'template', 'v': t.cells} end as template
  from o left join t on open and o.tokens = t.tokens),
r as (select template, min(doc_id) as keep from p group by template having min(doc_id) <> max(doc_id)),
gone as (select distinct p.doc_id, p.line_no from p join r using (template) where p.doc_id <> keep),
k as (
  select l.doc_id, count(*)::bigint as n_lines, count(gone.line_no)::bigint as n_dropped, coalesce(string_agg(line, chr(10) order by l.line_no) filter (where gone.line_no is null), '') as text
  from l left join gone on l.doc_id = gone.doc_id and l.line_no = gone.line_no group by l.doc_id)
select doc_id, n_lines, n_dropped, length(text)::bigint as n_chars, sha256(text) as text_sha256 from k
"""

_OP8 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 3 then [words]
    else list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2]) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (
  select u, v from pairs join n a on a.doc_id = u join n b on b.doc_id = v where 100 * shared >= 90 * (a.n + b.n - shared)),
edges as (select u, v from links union all select v, u from links),
reach(doc_id, other) as (select doc_id, doc_id from w union select reach.doc_id, v from reach join edges on other = u)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from w left join n using (doc_id)
join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_masks": _OP1, "op4_flow_mix": _OP4, "op5_jump_shards": _OP5, "op6_line_templates": _OP6, "op8_divide_skip": _OP8}
