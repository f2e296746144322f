"""The queries opN_<name> and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from palisand.llm import bpe_codec, exact_dedup, fill_in_middle, fm_classifier, jaccard_join, lattice_lm, line_dedup, packing, quality_rules, source_audit, token_store, topk_search, url_filter
from palisand.llm.shared import finished, new_folder, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).withColumn("broken", F.array_join("broken", ","))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(_table(spark, sf_dir, "embeddings"), 256)
    return topk_search.topk(vectors, vectors.filter("vec_id % 50 = 0"), 5)


#: The rules that the query is to apply: action, host, path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(_table(spark, sf_dir, "documents"), 10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packing.pack(staged(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), 1024)


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(_table(spark, sf_dir, "documents"), fm_classifier.remainder(7) == 2, public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-store")
    token_store.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=0)
    return token_store.checksums(spark, folder)


def quality_machine(spark: SparkSession, docs: DataFrame, sf_dir: str) -> fm_classifier.Machine:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(fm_classifier.remainder(4) != 2)
    return fm_classifier.train(docs, labels)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = fm_classifier.score(docs, quality_machine(spark, docs, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(fm_classifier.remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe_codec.decode(bpe_codec.encode(_table(spark, sf_dir, "documents"), *model), model[0])
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two deliveries, those with the larger half of the ids first, so that the second meets an index that has the first."""
    docs, folder = _table(spark, sf_dir, "documents"), new_folder(spark, "digest-index")
    index = exact_dedup.DigestIndex(spark, "palisand_" + folder.rpartition("-")[2], folder)

    def taken_in() -> DataFrame:
        rows = exact_dedup.ledger(docs, "all")
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        second = F.coalesce(F.col("doc_id") < F.lit(middle), F.lit(True))
        for batch in (rows.filter(~second), rows.filter(second)):
            index.add(batch)
        return exact_dedup.decisions(rows, index)

    try:
        return finished("exact-dedup", taken_in)
    finally:
        index.drop()


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(_table(spark, sf_dir, "documents"), seed=1)
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_exact_topk, op3_url_filter, op4_best_fit_packing, op5_line_dedup, op6_lattice_lm, op7_token_store, op8_quality_classifier, op9_jaccard_join, op10_byte_bpe, op11_exact_dedup, op12_source_audit, op13_fill_in_middle)
}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_NAMES = ", ".join(f"'{x}'" for x in quality_rules.RULES)


def _levels(side: int) -> str:
    return " ".join(f"when '{m}' then {x[side] or 0}" for m, x in quality_rules.RULES.items())


_SLACKS = ", ".join(f"{quality_rules.SLACK[m][1] * 1000} // greatest({quality_rules.SLACK[m][0]}, 1)" if m in quality_rules.SLACK else "0" for m in quality_rules.RULES)


def _leaning(own: str, larger: str) -> str:
    return ", ".join(f"({own}.n * {own}.{x} + {quality_rules.PRIOR} * {larger}.{x}) // ({own}.n + {quality_rules.PRIOR}) as {x}" for x in ("lo", "mid", "hi"))


_OP1 = rf"""
with w as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t, {_WORDS} as w from documents),
l as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from w),
g as (select rid, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) > 2),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from g) where n > 1),
covered as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2]) as j from twice) group by rid),
base as (
  select w.rid, doc_id, lang, source, len(w)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    length(regexp_replace(t, '[^A-Z]+', '', 'g'))::bigint as upper_chars,
    length(regexp_replace(t, '[^!?]+', '', 'g'))::bigint as marks_chars,
    len(l.l)::bigint as n_lines, (len(l.l) - len(list_distinct(l.l)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words
  from w join l using (rid) left join covered c on c.rid = w.rid),
m as (select *,
    word_chars * 1000 // greatest(n_words, 1) as word_len, n_symbols * 1000 // greatest(n_words, 1) as symbols,
    n_dup_lines * 1000 // greatest(n_lines, 1) as dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) as repeats,
    upper_chars * 1000 // greatest(word_chars, 1) as shouting, marks_chars * 1000 // greatest(n_words, 1) as marks,
    (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed
  from base),
v as (select lang, source, unnest([{_NAMES}]) as measure, unnest([{", ".join(quality_rules.RULES)}]) as v from m where not base_failed),
sk as (select lang, source, measure, (v >> greatest(length(bin(v)) - {quality_rules.BITS}, 0)) << greatest(length(bin(v)) - {quality_rules.BITS}, 0) as bucket, count(*)::bigint as n from v group by all),
q as (
  select lvl, lang, source, measure, sum(n)::bigint as n,
    min(case when upto * 100 >= total * case measure {_levels(0)} end then bucket end)::bigint as lo,
    min(case when upto * 100 >= total * 50 then bucket end)::bigint as mid,
    min(case when upto * 100 >= total * case measure {_levels(1)} end then bucket end)::bigint as hi
  from (select *, sum(n) over (partition by lvl, lang, source, measure order by bucket) as upto, sum(n) over (partition by lvl, lang, source, measure) as total
        from (select 1 as lvl, lang, source, measure, bucket, n from sk
              union all select 2, lang, null, measure, bucket, sum(n) from sk group by all
              union all select 3, null, null, measure, bucket, sum(n) from sk group by all)) group by all),
q2 as (select b.lang, measure, {_leaning("b", "c")} from q b join q c using (measure) where b.lvl = 2 and c.lvl = 3),
q1 as (select a.lang, a.source, a.measure, {_leaning("a", "b")} from q a join q2 b on b.lang is not distinct from a.lang and b.measure = a.measure where a.lvl = 1),
t as (select *, case measure {" ".join(f"when '{m}' then lo - {quality_rules.spread(x[0])} * (mid - lo)" for m, x in quality_rules.RULES.items() if x[0])} end as least,
    case measure {" ".join(f"when '{m}' then hi + {quality_rules.spread(x[1])} * (hi - mid)" for m, x in quality_rules.RULES.items())} end as most from q1),
mv as (select rid, lang, source, measure, slack, (v >> greatest(length(bin(v)) - {quality_rules.BITS}, 0)) << greatest(length(bin(v)) - {quality_rules.BITS}, 0) as v
  from (select rid, lang, source, unnest([{_NAMES}]) as measure, unnest([{", ".join(quality_rules.RULES)}]) as v, unnest([{_SLACKS}]) as slack from m)),
broken as (select mv.rid, list(mv.measure order by list_position([{_NAMES}], mv.measure)) as b
  from mv join t on mv.lang is not distinct from t.lang and mv.source is not distinct from t.source and mv.measure = t.measure where v > most + slack or v < least group by mv.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and b is null) as kept, array_to_string(coalesce(b, []), ',') as broken
from m left join broken using (rid)
"""

_OP2 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

_OP3 = rf"""
with rules as (select * from (values {", ".join(str(x) for x in URL_RULES)}) r(action, rhost, rpath)),
u as (select row_number() over () as rid, page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages),
p as (select rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select rid, rhost || rpath as rule, action, row_number() over (partition by rid order by length(rhost || rpath) desc, length(rhost) desc, action desc) as k
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, f.rule, coalesce(action, 'allow') as verdict from p left join f on p.rid = f.rid and k = 1
"""

_OP5 = r"""
with l as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
k as (select rid, doc_id, i, l[i] as line, translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select rid, doc_id, l, unnest(range(1, len(l) + 1)) as i from l)),
f as (select key from k where key <> '' group by key having count(distinct rid) >= 10)
select doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by rid, doc_id
"""

_OP11 = """
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc nulls last, rid) = 1 as kept, sha256(t) as text_sha256 from d
"""

_OP12 = r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
once as (select lang, source, term, rid, count(*) as c from w group by all),
kept as (select lang, term from once group by all having count(*) >= 10),
v as (select lang, count(*) as v from kept group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, sum(c) as c from once join kept using (lang, term) group by all),
n as (select lang, source, coalesce(sum(c), 0) as n from g left join c using (lang, source) group by all),
p as (select lang, source, term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 2) // (n + 2 * v)) as p from n join v using (lang) join kept using (lang) left join c using (lang, source, term)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(c) + 2) // (any_value(l.n) + 2 * any_value(v))) as q from p join v using (lang) join (select lang, sum(n) as n from n group by 1) l using (lang) group by lang, term),
f as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
    on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p join q using (lang, term) where c > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from f) where part = 'pair' or rank <= 10
"""

_OP13 = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select doc_id, t, length(t)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
x as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(p || m || s) as restored_sha256 from x
"""

ORACLES: dict[str, str] = {"op1_quality_rules": _OP1, "op2_exact_topk": _OP2, "op3_url_filter": _OP3, "op5_line_dedup": _OP5, "op11_exact_dedup": _OP11, "op12_source_audit": _OP12, "op13_fill_in_middle": _OP13}
