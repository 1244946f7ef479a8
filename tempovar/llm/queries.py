"""Thin queries over the operators of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, linededup, lm, packing, paradedup, rules, search, setjoin, sharding, simhash, tokencount, variants
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradedup.repeats(table(spark, sf_dir, "documents"))  # every line that has a shingle, and passages inside lines


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_packing, op2_decontamination, op3_substring_dedup, op4_quality_rules, op5_token_counts, op6_line_dedup, op7_simhash, op8_lm_scoring,
        op9_sharding, op10_language_id, op11_lexical_search, op12_spelling_variants, op13_jaccard_join)}


#: Words of a text: lower-cased A-Z, then runs of 0-9, a-z and anything beyond ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
with item as (select coalesce(cast(item_id as varchar), 'null') as item, {_WORDS} as w from benchmark),
win as (
  select distinct item, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as t
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item where len(w) > 0)),
doc as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
pos as (
  select r, k, i, array_to_string(w[i:i + k - 1], ' ') as t
  from (select r, w, k, unnest(range(1, cast(len(w) - k + 2 as bigint))) as i
        from doc, (select distinct k from win) where len(w) >= k)),
hit as (select pos.r, pos.k, pos.i, win.item from pos join win on pos.k = win.k and pos.t = win.t),
word as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hit) group by r),
found as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join word using (r) left join found using (r)
"""

#: Runs of worded lines from a line on, or up to a line, of 50 words or more, as strings.
OP6 = r"""
with doc as (select doc_id, text, row_number() over () as r from documents),
line as (select doc_id, r, unnest(range(1, len(x) + 1)) as p, unnest(x) as t from (select doc_id, r, string_split(text, chr(10)) as x from doc)),
worded as (select doc_id, r, p, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as n from line),
upto as (select *, sum(n) over (partition by r order by p rows unbounded preceding) as upto from worded where n > 0),
run as (
  select doc_id, r, sum(n) over w as n, min(p) over w as a, max(p) over w as b, list(t) over w as t
  from (select *, upto - n as before from upto) window w as (partition by r order by before range between current row and 49 following)
  union
  select doc_id, r, sum(n) over w as n, min(p) over w as a, max(p) over w as b, list(t) over w as t
  from upto window w as (partition by r order by upto range between 49 preceding and current row)),
numbered as (select r, a, b, row_number() over (partition by t order by doc_id, a) as k from run where n >= 50),
gone as (select distinct r, unnest(range(a, b + 1)) as p from numbered where k > 1),
kept as (select r, string_agg(t, chr(10) order by p) as t, count(*) as n from line anti join gone using (r, p) group by r),
total as (select r, count(*) as n from line group by r)
select doc_id, cast(coalesce(total.n, 0) as bigint) as n_lines, cast(coalesce(total.n, 0) - coalesce(kept.n, 0) as bigint) as n_removed,
  sha256(case when text is null then null else coalesce(kept.t, '') end) as text_sha256
from doc left join total using (r) left join kept using (r)
"""


#: Terms of a text: runs of digits, letters and anything beyond ASCII, A-Z lower-cased.
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
with doc as (select doc_id, row_number() over () as r, {_TERMS} as w from documents),
counted as (select *, len(w) as n from doc where len(w) > 0),
total as (select count(*) as docs, cast(sum(n) as bigint) as length from counted),
want as (select item_id, t, count(*) as q from (select item_id, unnest({_TERMS}) as t from benchmark) group by item_id, t),
posting as (select r, t, count(*) as tf from (select r, unnest(w) as t from counted) where t in (select t from want) group by r, t),
weight as (select t, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as w
           from (select t, count(*) as df from posting group by t), total),
part as (select r, t, weight.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))) as s
         from posting join weight using (t) join counted using (r), total),
score as (select item_id, r, sum(q * s) as score from part join want using (t) group by item_id, r having sum(q * s) > 0),
best as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id, r) as rank from score join doc using (r))
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from best where rank <= 20
"""


OP13 = r"""
with recursive doc as (
  select doc_id, row_number() over () as r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
gram as (select distinct r, array_to_string(w[i:i + 2], ' ') as g
         from (select r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from doc where len(w) > 0)),
size as (select r, count(*) as n from gram group by r),
shared as (select x.r as a, y.r as b, count(*) as n from gram x join gram y on x.g = y.g and x.r < y.r group by x.r, y.r),
near as (select a, b from shared join size x on x.r = a join size y on y.r = b where 100 * shared.n >= 90 * (x.n + y.n - shared.n)),
link as (select a, b from near union all select b, a from near),
reach as (select r, r as s from doc union select reach.r, link.b from reach join link on reach.s = link.a),
least as (select reach.r, min(doc.doc_id) as c from reach join doc on doc.r = reach.s group by reach.r)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, c as component_id from doc join least using (r) left join size using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op6_line_dedup": OP6, "op11_lexical_search": OP11, "op13_jaccard_join": OP13}
