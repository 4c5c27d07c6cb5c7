"""The thirteen operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, exact_dedup, filter_audit, language_id, lm, near_dup, packing, pii, quality, quality_rules, substring_dedup, toxicity
from .common import crc_mod, table

#: Key of the pseudonyms in the queries; a user passes their own.
DEMO_KEY = "verdance demonstration key"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    scored = quality.classify(docs, labels.where(~held), ["doc_id"], "quality")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), 0.8)
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~held), "toxic"), ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    scored = lm.score_documents(table(spark, sf_dir, "documents"), ~held, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"), 20)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    order = quality_rules.order_rules(quality_rules.measure(docs, quality_rules.RULES))
    judged = quality_rules.cascade(quality_rules.with_base(docs), order)
    failed = F.expr(f"({quality_rules.RULES['too_few_words']}) or ({quality_rules.RULES['repeated_words']})")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(3, 1)
    model = language_id.train(docs.where(~held))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "lang_set")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_pii": op7_pii,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_SQL5 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, w, least(10, len(w)) l from (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark) where len(w) > 0),
iw as (select distinct item_id, l, array_to_string(w[s + 1 : s + l], ' ') p from (select item_id, w, l, unnest(range(len(w) - l + 1)) s from i)),
dw as (select doc_id, l, s, array_to_string(w[s + 1 : s + l], ' ') p from (select doc_id, w, l, unnest(range(len(w) - l + 1)) s from d, (select distinct l from iw) where len(w) >= l)),
hit as (select distinct doc_id, item_id, s, dw.l from dw join iw on dw.p = iw.p and dw.l = iw.l),
n as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(s, s + l)) k from (select distinct doc_id, s, l from hit)) group by 1),
t as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) ids from (select distinct doc_id, item_id::varchar x from hit) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""

_SQL8 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') x from (select doc_id, w, unnest(range(len(w) - 19)) i from d where len(w) >= 20)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) n from s) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) k from late),
word as (select doc_id, unnest(range(len(w))) k, unnest(w) x from d),
kept as (select doc_id, string_agg(x, ' ' order by k) t from word anti join gone using (doc_id, k) group by 1),
n as (select doc_id, count(*) n from gone group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""

_SQL9 = r"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, array_to_string(w[i + 1 : i + 3], ' ') x from (select doc_id, w, unnest(range(len(w) - 2)) i from d where len(w) >= 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) n from g) where n > 1),
r as (select doc_id, count(*) n from (select distinct doc_id, unnest(range(i, i + 3)) k from twice) group by 1),
l as (select doc_id, count(*) - count(distinct x) n from (select doc_id, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1),
b as (select d.doc_id, t, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, coalesce(l.n, 0)::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words from d left join r using (doc_id) left join l using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * (len(string_split(t, chr(10)))) or 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > word_chars or 10 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < 6 * word_chars) kept
from f
"""

_SQL11 = r"""
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
row_number() over (partition by t order by doc_id desc) = 1 kept, sha256(t) text_sha256
from d
"""

_SQL12 = r"""
with w as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
first as (select t, min(doc_id) doc_id from w group by t),
f as (select w.doc_id, part, case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
+ case when 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 10 * length(w.t) then 4 else 0 end + case when regexp_matches(w.t, '[#$%&*|]') then 8 else 0 end
+ case when first.doc_id < w.doc_id then 16 else 0 end bits from w join first using (t)),
c as (select part, bits, count(*) n, sum(case when quality = 1 then 1 else 0 end) good, sum(case when toxic = 1 then 1 else 0 end) toxic from f left join labels using (doc_id) group by all),
l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(l, b)),
o as (select p.l || q.l || r.l || s.l || t.l filter_order, [p.b, q.b, r.b, s.b, t.b] b from l p, l q, l r, l s, l t where p.b + q.b + r.b + s.b + t.b = 31 and p.b | q.b | r.b | s.b | t.b = 31),
s as (select filter_order, i step, b[i] bit, list_sum(list_concat([0], b[1 : i - 1]))::integer before from o, (select unnest(range(1, 6)) i)),
r as (select part, filter_order, step, bit, sum(case when bits & before = 0 and bits & bit = 0 then n else 0 end)::bigint kept, sum(case when bits & before = 0 and bits & bit <> 0 then n else 0 end)::bigint removed,
sum(case when bits & before <> 0 and bits & bit <> 0 then n else 0 end)::bigint redundant, sum(case when bits = bit then n else 0 end)::bigint unique_fails,
sum(case when bits & before = 0 and bits & bit <> 0 then good else 0 end)::bigint good_lost, sum(case when bits & before = 0 and bits & bit <> 0 then toxic else 0 end)::bigint toxic_lost
from c, s group by all)
select part, filter_order, step::integer step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint shapley from r
"""


def _sql13(k: int = 40, rounds: int = 5) -> str:
    """The rounds written out; a component is a row. Distances are whole numbers."""
    parts = [
        "v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        "x as (select vec_id, unnest(range(64)) d, unnest(e) x from v)",
        f"c0 as (select n, unnest(range(64)) d, unnest(e) y from (select row_number() over (order by sha256('2:' || vec_id)) - 1 n, e from v) where n < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as (select vec_id, n, s from (select vec_id, n, sum((x - y) * (x - y))::bigint s, row_number() over (partition by vec_id order by sum((x - y) * (x - y)), n) r from x join c{i} using (d) group by vec_id, n) where r = 1)")
        if i < rounds:
            parts.append(f"m{i} as (select n, d, sum(x)::bigint s, count(*) m from x join a{i} using (vec_id) group by n, d)")
            exact = "case when m.s >= 0 then m.s // m.m else -((m.m - 1 - m.s) // m.m) end"
            parts.append(f"c{i + 1} as (select n, d, coalesce({exact}, y) y from c{i} left join m{i} m using (n, d))")
    last = f"h as (select n, sha256(string_agg(y::bigint::varchar, ',' order by d)) centroid_sha256 from c{rounds} group by n)"
    return f"with {', '.join([*parts, last])} select vec_id, n::integer as cluster, s distance, (sum(s) over (partition by n))::bigint cluster_inertia, (sum(s) over ())::bigint inertia, centroid_sha256 from a{rounds} join h using (n)"


ORACLE_SQL: dict[str, str] = {"op5_decontamination": _SQL5, "op8_substring_dedup": _SQL8, "op9_quality_rules": _SQL9, "op11_exact_dedup": _SQL11, "op12_filter_audit": _SQL12, "op13_centroid_clustering": _sql13()}
