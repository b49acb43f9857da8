"""One query for each operator, over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, covertree, fingerprint, hmm, licenses, manifest, minhash, mixing, packing, preferences, quality, substring, trie
from .license_rules import RULES
from .shared import documents

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary(), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


def op3_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprint.fingerprints(documents(spark, sf_dir))
    a, b, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    near = fingerprint.containment_or_resemblance
    return f.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.spelled(a).alias("fingerprint"), fingerprint.spelled(b).alias("edited_fingerprint"),
        near(a, b).alias("near_edited"), near(a, following).alias("near_next"),
        fingerprint.resemblance(a, b).alias("jaccard_edited"), fingerprint.resemblance(a, following).alias("jaccard_next"),
    )


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "labels").where(~hmm.held_out(F.col("doc_id"), fold=0))


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = quality.train(docs, training_labels(spark, sf_dir))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return quality.scored(docs, machine).select("doc_id", hmm.held_out(F.col("doc_id"), fold=0).alias("held_out"), "score", predicted)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("copies")).alias("taken"))


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(documents(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=75)


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.format_pairs(preferences.swapped_pairs(documents(spark, sf_dir, "conversations")))
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return pairs.select("conv_id", "rejected_conv_id", n("chosen"), n("rejected"), F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")


def op9_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bitplane.read_shards(bitplane.write_shards(documents(spark, sf_dir), vocabulary(), end_id=2))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.without_repeats(documents(spark, sf_dir), window=50)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.summarised(licenses.scanned(documents(spark, sf_dir)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    rows = manifest.verified(manifest.manifest(documents(spark, sf_dir), changed=tampered))
    return rows.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(trie.sequences(documents(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_retrieval_packing, op2_hmm_scores, op3_scaled_sketches, op4_factorisation_machine, op5_source_mix, op6_cover_tree, op7_tensored_minhash, op8_preference_pairs, op9_bitplane_tokens, op10_substring_dedup, op11_license_rules, op12_merkle_manifest, op13_prefix_trie)
    return {f.__name__: f for f in (*ops, pipeline)}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5_SQL = f"""
with d as (
  select doc_id, source, len({_WORDS.format("coalesce(text, '')")})::bigint as size,
         ('0x' || substr(md5(concat(coalesce(cast(doc_id as varchar), ''), '|', coalesce(text, ''))), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from s),
r as (select *, row_number() over (order by source_size / weight, source nulls last) as k,
      1.5::double * sum(source_size) over () as total from w),
l as (select *, total - coalesce(sum(2.0::double * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest,
      sum(weight) over (order by k rows between current row and unbounded following) as weights from r),
c as (select min(k) as first from l where weight * rest / weights <= 2.0::double * source_size),
t as (select source, source_size, case when k < first then 2.0::double * source_size
      else weight * (select rest from l where k = first) / (select weights from l where k = first) end as target from l, c),
b as (select *, case when target > source_size then 1 else 0 end as passes from t),
g as (select d.source, h, sum(size) as n from d group by all),
u as (select g.source, h, n, sum(n) over (partition by g.source order by h) as upto from g),
o as (select u.*, target - passes * source_size as budget, row_number() over (partition by u.source order by h) as rank
      from u join b on u.source is not distinct from b.source where upto > target - passes * source_size),
e as (select source, case when budget - (upto - n) >= upto - budget then h + 1 else h end as below from o where rank = 1)
select d.doc_id, d.size, b.source_size, b.target,
       (d.size * (passes + case when below is null or h < below then 1 else 0 end))::bigint as taken
from d join b on d.source is not distinct from b.source left join e on d.source is not distinct from e.source
"""

OP6_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from p group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join n on n.a = vec_id join c on c.a = vec_id
"""

OP7_SQL = f"""
with recursive w as (
  select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
p as (select a, b from i join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i.n >= 75 * (x.n + y.n - i.n)),
r as (select doc_id as a, doc_id as b from documents union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as component_id from r group by a)
select documents.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, documents.doc_id = component_id as kept
from documents left join n on n.doc_id = documents.doc_id join c on c.a = documents.doc_id
"""

OP8_SQL = r"""
with t as (
  select conv_id, list({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) as chosen
  from conversations group by conv_id),
a as (select *, coalesce(list_filter(chosen, lambda x: x.role = 'assistant')[-1].text, '') as answer,
      coalesce(list_max(list_filter(range(1, len(chosen) + 1), lambda k: chosen[k].role = 'assistant')), len(chosen) + 1) as last from t),
n as (select *, coalesce(lead(conv_id) over (order by conv_id), first_value(conv_id) over (order by conv_id)) as rejected_conv_id,
      coalesce(lead(answer) over (order by conv_id), first_value(answer) over (order by conv_id)) as foreign_answer from a),
p as (select *, chosen[1:last - 1] || [{'role': 'assistant', 'text': foreign_answer}] || chosen[last + 1:len(chosen)] as rejected from n),
k as (select *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] <> rejected[i])) - 1, least(len(chosen), len(rejected))) as n_common from p),
x as (select *, list_transform(chosen, lambda t: '<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10)) as c,
      list_transform(rejected, lambda t: '<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10)) as r from k),
m as (select *, list_transform(c, lambda s: length(s)) as cl, list_transform(r, lambda s: length(s)) as rl from x)
select conv_id, rejected_conv_id, len(chosen)::bigint as n_chosen, len(rejected)::bigint as n_rejected, n_common::bigint as n_common,
  coalesce(array_to_string(c[1:n_common], ''), '') as prompt,
  coalesce(array_to_string(c[n_common + 1:len(c)], ''), '') as chosen_text,
  coalesce(array_to_string(list_transform(list_filter(range(n_common + 1, len(c) + 1), lambda i: chosen[i].role = 'assistant'),
    lambda i: (coalesce(list_sum(cl[n_common + 1:i - 1]), 0) + 13 + length(replace(chosen[i].role, '<|', '< |')))::bigint || '-' || (coalesce(list_sum(cl[n_common + 1:i]), 0) - 1)::bigint), ' '), '') as chosen_mask,
  coalesce(array_to_string(r[n_common + 1:len(r)], ''), '') as rejected_text,
  coalesce(array_to_string(list_transform(list_filter(range(n_common + 1, len(r) + 1), lambda i: rejected[i].role = 'assistant'),
    lambda i: (coalesce(list_sum(rl[n_common + 1:i - 1]), 0) + 13 + length(replace(rejected[i].role, '<|', '< |')))::bigint || '-' || (coalesce(list_sum(rl[n_common + 1:i]), 0) - 1)::bigint), ' '), '') as rejected_mask
from m
"""

OP10_SQL = f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 48)) as i, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) as h from w where len(ws) >= 50),
f as (select h, min(doc_id) as lo from g group by h),
x as (select g.doc_id, i from g join f using (h) where lo < g.doc_id),
p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
m as (select p.*, max(x.i) over (partition by p.doc_id order by p.i rows between 49 preceding and current row) is not null as gone from p left join x on x.doc_id = p.doc_id and x.i = p.i),
k as (select doc_id, sum(gone::int)::bigint as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from m group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)
"""


#: CRC-32 of the ASCII text of a number, a bit at a time.
_CRC = """xor(4294967295, list_reduce([4294967295::bigint] || flatten(list_transform(string_split({}::varchar, ''), lambda c: [ascii(c) + 256, 0, 0, 0, 0, 0, 0, 0, 0])),
  lambda a, x: case when x > 0 then xor(a, x - 256) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end))"""

OP11_SQL = r"""
with d as (
  select row_number() over () as k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents),
b as (
  select k, i, label from d,
    (values (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) v(phrase, label),
    unnest(range(0, len(ws))) u(i)
  where ws[i + 1:i + len(phrase)] = phrase),
r(rule, tier, label, keyword, pattern) as (values {rules}),
m as (select *, '<' || array_to_string(ws, '><') || '>' as marked from d),
p as (
  select k, rule, tier, label, string_split(regexp_replace(marked, pattern, '#\0#', 'g'), '#') as parts
  from m join r on list_contains(ws, keyword)),
n as (select *, list_transform(parts, lambda x: len(x) - len(replace(x, '<', ''))) as words from p where len(parts) > 1),
o as (
  select k, rule, tier, label, coalesce(list_sum(words[1:2 * i - 1]), 0)::bigint as first, list_sum(words[1:2 * i])::bigint as last
  from n, unnest(range(1, len(parts) // 2 + 1)) u(i)
  union all
  select k, -1, 2, label, i, i + case label when 'cc-by' then 2 else 3 end from b),
s as (
  select o.k, o.tier, o.label from o
  where rule < 0 or not exists (
    select 1 from o e where e.k = o.k and e.first <= o.first and e.last >= o.last and e.tier <= o.tier
      and (e.last - e.first > o.last - o.first or e.tier < o.tier or e.rule < o.rule))),
g as (select k, string_agg(distinct label, ',' order by label) as labels, min(tier) as tier from s group by k),
h as (select k, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by k)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, case tier when 1 then 0.95 when 2 then 0.8 when 3 then 0.4 else 0 end::double as score
from d left join g using (k) left join h using (k)
"""


def op11_sql() -> str:
    """The base phrases are spelled out there; the method's own rules come from their table."""
    quoted = [f"({r.rule}, {r.tier}, '{r.label}', '{r.keyword}', '{r.pattern}')" for r in RULES if not r.base]
    return OP11_SQL.replace("{rules}", ",\n  ".join(quoted))


_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

OP12_SQL = f"""
with recursive l as (
  select *, coalesce('+' || lang, '') as g, {_LEAF} as leaf,
    case when {_CRC.format("doc_id")} % 7 = 0 then {_LEAF.replace("n_chars", "(n_chars + 1)")} else {_LEAF} end as start,
    row_number() over (partition by lang order by doc_id nulls first) - 1 as pos, count(*) over (partition by lang) as n
  from documents),
n as (
  select g, 0 as level, pos, leaf as h, n from l
  union all
  select g, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from n where n > 1 group by g, level, pos // 2),
s as (select g, h as subroot, row_number() over (order by g) - 1 as pos, count(*) over () as n from n where n.n = 1),
t as (
  select 0 as level, pos, subroot as h, n from s
  union all
  select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from t where n > 1 group by level, pos // 2),
levels as (select g, level, max(n) as n from n where n > 1 group by g, level),
crown as (select level, max(n) as n from t where n > 1 group by level),
p as (
  select l.doc_id, v.level, case when n.h is null then '-' when (l.pos >> v.level) % 2 = 1 then 'L' || n.h else 'R' || n.h end as e
  from l join levels v using (g) left join n on n.g = l.g and n.level = v.level and n.pos = xor(l.pos >> v.level, 1)
  union all
  select l.doc_id, 1000 + c.level, case when t.h is null then '-' when (s.pos >> c.level) % 2 = 1 then 'L' || t.h else 'R' || t.h end
  from l join s using (g) cross join crown c left join t on t.level = c.level and t.pos = xor(s.pos >> c.level, 1)),
q as (select doc_id, list(e order by level) as es from p group by doc_id),
f as (
  select l.doc_id, leaf, subroot, (select h from t where n = 1) as root, sha256(coalesce(array_to_string(list_transform(es, lambda e: e[2:]), ''), '')) as proof_sha256,
    list_reduce([start] || coalesce(es, []), lambda a, e: sha256(case when e[1] = 'L' then e[2:] || a else a || e[2:] end)) as folded_root
  from l join s using (g) left join q using (doc_id))
select *, folded_root = root as verified from f
"""

OP13_SQL = f"""
with t as (
  select conv_id, {_CRC.format("conv_id")} % 6 as h,
    list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as ts
  from conversations where conv_id is not null group by conv_id),
r as (
  select a.conv_id, coalesce(l.ts[1:a.h], []) || a.ts[a.h + 1:len(a.ts)] as ts
  from t a left join t l on l.conv_id = a.conv_id - a.conv_id % 100),
n as (
  select ts[1:d] as k, d as depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(ts) = d), '')) as ends_sha256
  from r, unnest(range(0, len(ts) + 1)) u(d) group by all),
c as (select k[1:depth - 1] as k, count(*) as n_children from n where depth > 0 group by all),
m as (select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * length(k[depth].text) end as own from n left join c using (k)),
s as (select k[1:j] as k, sum(own) as saved_tokens, sum((n_children = 0)::int) as n_leaves from m, unnest(range(0, depth + 1)) u(j) group by all)
select m.conv_id, m.depth::bigint as depth, up.conv_id as parent_conv_id, m.n_convs::bigint as n_convs, m.n_children::bigint as n_children,
  n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, m.ends_sha256
from m join s using (k) left join m up on m.depth > 0 and up.k = m.k[1:m.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_source_mix": OP5_SQL, "op6_cover_tree": OP6_SQL, "op7_tensored_minhash": OP7_SQL, "op8_preference_pairs": OP8_SQL, "op10_substring_dedup": OP10_SQL,
        "op11_license_rules": op11_sql(), "op12_merkle_manifest": OP12_SQL, "op13_prefix_trie": OP13_SQL,
    }
