"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, gif, licenses, mixing, ngram_join, pii, secrets, substring, tokens, toxicity
from ._store import read


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_back(tokens.write(read(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(read(spark, sf_dir, "documents")))


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.features(gif.to_media(read(spark, sf_dir, "documents"))).withColumn("histogram", F.array_join("histogram", "-"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup(read(spark, sf_dir, "documents")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find(read(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"))))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_decontamination, op3_token_output, op4_pii, op5_gif_media, op6_substring_dedup, op7_licenses, op8_toxicity, op9_secrets, op10_mixing, pipeline)
}

_SPACED = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": f"""
    with recursive w as (select doc_id, {_SPACED.replace("coalesce(text, '')", _LOWERED)} a from documents),
    s as (select doc_id, array_to_string(a[i:i + 4], ' ') k from (select doc_id, a, unnest(generate_series(1, greatest(len(a) - 4, least(len(a), 1)))) i from w) group by all),
    n as (select doc_id, count(*) n from s group by 1),
    p as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.k = y.k and x.doc_id <> y.doc_id group by all),
    e as (select a, b from p join n u on u.doc_id = a join n v on v.doc_id = b where 100 * c >= 75 * (u.n + v.n - c)),
    r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
    select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, r.c component_id from documents d left join n using (doc_id) join (select a, min(b) c from r group by 1) r on r.a = d.doc_id
    """,
    "op2_decontamination": f"""
    with d as (select doc_id, {_ALNUM} a from documents), i as (select item_id, {_ALNUM} a from benchmark),
    v as (select distinct item_id, least(len(a), 10) n, array_to_string(a[j:j + 9], ' ') k from (select item_id, a, unnest(generate_series(1, greatest(len(a) - 9, least(len(a), 1)))) j from i)),
    z as (select distinct n from v where n > 0),
    x as (select doc_id, n, j, array_to_string(a[j:j + n - 1], ' ') k from (select doc_id, a, n, unnest(generate_series(1, len(a) - n + 1)) j from d, z)),
    h as (select x.doc_id, x.j, x.n, v.item_id from x join v on x.n = v.n and x.k = v.k),
    c as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(generate_series(j, j + n - 1)) q from h) group by 1),
    t as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id::varchar item_id from h) group by 1)
    select d.doc_id, len(d.a)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    from d left join c using (doc_id) left join t using (doc_id)
    """,
    "op6_substring_dedup": f"""
    with w as (select doc_id, {_SPACED} a from documents),
    x as (select doc_id, i, array_to_string(a[i:i + 12], ' ') k from (select doc_id, a, unnest(generate_series(1, len(a) - 12)) i from w)),
    f as (select doc_id, i, min(doc_id) over (partition by k) m from x),
    g as (select distinct doc_id, unnest(generate_series(i, i + 12)) p from f where m < doc_id),
    o as (select doc_id, unnest(a) word, unnest(generate_series(1, len(a))) p from w),
    k as (select o.doc_id, count(g.p) gone, string_agg(word, ' ' order by p) filter (g.p is null) kept from o left join g using (doc_id, p) group by 1)
    select w.doc_id, len(w.a)::bigint n_words, coalesce(gone, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join k using (doc_id)
    """,
    "op10_mixing": f"""
    with d as (select doc_id, source, len({_SPACED})::bigint size, substr(md5(coalesce(doc_id::varchar, 'null')), 1, 12) h from documents),
    s as (select source, sum(size)::bigint n, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double w from d group by 1),
    k as (select *, row_number() over o i, coalesce(sum(3 * n) over (o rows between unbounded preceding and 1 preceding), 0)::double capped, (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0))::double rest_w, (sum(n) over ())::double total from s window o as (order by 3.0 * n / w, source nulls last)),
    c as (select coalesce(min(i), 1000000000) i from k where (total - capped) * w / rest_w <= 3 * n),
    t as (select k.source, k.n, case when k.i < c.i then 3.0 * k.n else (select (total - capped) from k q where q.i = c.i) * k.w / (select rest_w from k q where q.i = c.i) end::double target from k, c),
    u as (select *, case when n > 0 then least(3, floor(target / n)) else 0 end::bigint full_ from t),
    b as (select source, h, sum(sum(size)) over (partition by source order by h) upto from d group by 1, 2),
    e as (select u.source, min(b.h) edge from u join b on b.source is not distinct from u.source where b.upto > u.target - u.full_ * u.n group by 1)
    select d.doc_id, d.size, u.n source_size, u.target, d.size * (u.full_ + case when e.edge is null then (u.full_ < 3 and u.target > u.full_ * u.n)::bigint else (d.h < e.edge)::bigint end) taken
    from d join u on u.source is not distinct from d.source left join e on e.source is not distinct from d.source
    """,
}
