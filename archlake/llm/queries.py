"""The registered queries of the numbered operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.llm import audio, codebooks, divergence, gam, jaccard, langid, licenses, maxent, mixing, packing, radix, sharding, topk
from archlake.llm.store import table


def fold(parts: int):
    """The remainder of crc32(doc_id as text) that the contracts split rows by."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op1_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of recordings, so that each text's UTF-8 bytes are played as 8-bit samples."""
    recordings = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("media"))
    return audio.align(recordings, F.pmod(F.col("doc_id"), F.lit(50)) == 0, "doc_id", "media")


def op2_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold(5) == 1, F.lit(False))
    return maxent.score(table(spark, sf_dir, "documents"), ~held, {"doc_id": F.col("doc_id"), "held_out": held})


def op3_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return gam.score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_dictionary_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0, k=5)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
"""


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered_weights(docs))


def op8_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(4) != 2)
    found = langid.identify(docs, model, ["doc_id"])
    return found.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), jaccard.Rule(words=4, num=85, den=100))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


def op11_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.mark_copies(table(spark, sf_dir, "documents"))


OP11_SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from d
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_documents=30, top=50)


OP12_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), w as (
  select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
  select lang, term, count(*) as c from w group by 1, 2 having count(distinct r) >= 30
), g as (select distinct lang, source from d
), v as (select g.lang, count(term) as v from (select distinct lang from g) g left join kept using (lang) group by 1
), n as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by 1, 2, 3
), sizes as (select g.lang, g.source, v, coalesce(sum(n.c), 0) as total from g join v using (lang) left join n using (lang, source) group by 1, 2, 3
), whole as (select lang, sum(c) as total from kept group by 1
), p as (
  select s.lang, s.source, k.term, coalesce(n.c, 0) as c,
         1 + (1000000000::hugeint * (coalesce(n.c, 0) + 5)) // (s.total + 5 * v)::hugeint as p,
         1 + (1000000000::hugeint * (k.c + 5)) // (whole.total + 5 * v)::hugeint as q
  from sizes s join kept k using (lang) join whole using (lang) left join n on n.lang = s.lang and n.source = s.source and n.term = k.term
), x as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang as l, x.source as s1, y.source as s2, sum(abs(x.p - y.p)) as f from p x join p y on x.lang = y.lang and x.term = y.term group by 1, 2, 3) on l = a.lang and s1 = a.source and s2 = b.source
  union all
  select lang, source, 'term', term, p - q from p where c > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from x)
where part = 'pair' or rank <= 50
"""


def op13_adaptive_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codec = codebooks.compress(table(spark, sf_dir, "embeddings"), rounds=4, scale=1024)
    return rows.withColumn("codebooks_sha256", F.lit(codec.sha256()))


def _op13_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round's assignment and new entries as tables of their own, by plain distances."""
    sql = f"""with v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), n as (
  select row_number() over (order by vec_id nulls last, q) as r, vec_id, label, q, len(q) // {parts} as w from v
), p as (
  select r, vec_id, label, part, q[part * w + 1 : (part + 1) * w] as x from n, (select unnest(range({parts})) as part)
), c0 as (
  select part, cast(r - 1 as int) as entry, x as c from p where r <= {entries}
)"""
    distance = "cast(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    for t in range(rounds + 1):
        sql += f""", a{t} as materialized (
  select r, part, min(d)[2] as entry, min(d)[1] as d
  from (select r, p.part, [{distance}, cast(entry as bigint)] as d from p join c{t} on p.part = c{t}.part)
  group by r, part
)"""
        if t < rounds:
            sql += f""", m{t} as (
  select part, entry, pos, cast(floor(sum(val)::hugeint // count(*) - case when sum(val) < 0 and sum(val)::hugeint % count(*) <> 0 then 1 else 0 end) as bigint) as val
  from (select part, entry, unnest(x) as val, generate_subscripts(x, 1) as pos from p join a{t} using (r, part)) group by part, entry, pos
), c{t + 1} as materialized (
  select c{t}.part, c{t}.entry, coalesce(new.c, c{t}.c) as c
  from c{t} left join (select part, entry, list(val order by pos) as c from m{t} group by part, entry) new on new.part = c{t}.part and new.entry = c{t}.entry
)"""
    return sql + f"""
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from c{rounds}) as codebooks_sha256
from (
  select n.r, any_value(vec_id) as vec_id, any_value(label) as label, cast(sum(d) as bigint) as error,
         string_agg(printf('%02x', entry), '' order by part) as code
  from n join a{rounds} on n.r = a{rounds}.r group by n.r
)"""


QUERIES = {
    "op1_chroma_alignment": op1_chroma_alignment,
    "op2_hashed_maxent": op2_hashed_maxent,
    "op3_gam_quality": op3_gam_quality,
    "op4_dictionary_licenses": op4_dictionary_licenses,
    "op5_jump_sharding": op5_jump_sharding,
    "op6_impact_topk": op6_impact_topk,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_subword_langid": op8_subword_langid,
    "op9_group_jaccard": op9_group_jaccard,
    "op10_nnls_packing": op10_nnls_packing,
    "op11_radix_dedup": op11_radix_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_adaptive_codebooks": op13_adaptive_codebooks,
}

ORACLE: dict[str, str] = {
    "op6_impact_topk": OP6_SQL,
    "op11_radix_dedup": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_adaptive_codebooks": _op13_sql(),
}
