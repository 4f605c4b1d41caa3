"""Retrieval queries. Ids are joined by convention: chunk_id is doc_id or vec_id, query q is item_id with the vector of vec_id q."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions.stem import stem
from tessera.functions.text import QUERY_STOP_WORDS
from tessera.operators import claims as C
from tessera.operators import postings as P
from tessera.operators import retrieval as R
from tessera.operators import vector_index as I
from tessera.plans.registry import query, table
from tessera.plans.text_queries import located
from tessera.sources.tables import new_path

LOW = 0.1
_VECTOR = """
q as (select b.item_id query_id, e.embedding v from benchmark b join embeddings e on e.vec_id = b.item_id),
vs as (select query_id, label collection, vec_id chunk_id, list_sum(list_transform(list_zip(q.v, e.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double))) score from q, embeddings e),
vr as (select *, row_number() over (partition by query_id, collection order by round(score, 12) desc, chunk_id) rank from vs where score >= {t} qualify rank <= 8)"""
_KEYWORD = r"""
kt as (select item_id query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3 and w not in (""" + ", ".join(f"'{w}'" for w in QUERY_STOP_WORDS) + r""")))) token from benchmark),
dt as (select doc_id chunk_id, token, count(*) n from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) token from documents) group by 1, 2),
ks as (select query_id, chunk_id, sum(n * 0.4) score from kt join dt using (token) group by 1, 2),
kr as (select *, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) rank from ks qualify rank <= 8)"""


def _queries(spark, d):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return vec.join(items, "query_id")


def _passages(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("collection"), F.col("embedding").alias("vector"))


def _vectors(spark, d, threshold=LOW):
    return R.vector_top_k(_queries(spark, d).select("query_id", "vector"), _passages(spark, d), threshold=threshold)


def _keywords(spark, d, stemmer=None, k=R.TOP):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("snippet"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = P.kept_index(chunks, f"{d}/documents.parquet", {"snippet": P.FIELD_WEIGHT["snippet"]}, stemmer)
    return R.keyword_top_k(items, index, k, stemmer)


@query("with " + _VECTOR.format(t=-2) + " select query_id, collection, chunk_id, round(score, 6) as score, rank from vr")
def vector_topk(spark, d):
    return _vectors(spark, d, None).select("query_id", "collection", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("with " + _VECTOR.format(t=R.THRESHOLD) + " select query_id, collection, chunk_id, round(score, 6) as score, rank from vr")
def vector_topk_threshold(spark, d):
    return _vectors(spark, d, R.THRESHOLD).select("query_id", "collection", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def vector_topk_indexed(spark, d):
    """For every vector whose id is divisible by 20 the first eight of all, by the approximate index (its recall is tested)."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(0).alias("collection"), F.col("embedding").alias("vector"))
    book = I.fit(vectors)
    index = I.write_index(vectors, book, new_path(spark, "vectors"))
    queries = vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return I.search(index, book, queries).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("with " + _KEYWORD + " select query_id, chunk_id, round(score, 4) as score, rank from kr")
def keyword_rank_unstemmed(spark, d):
    return _keywords(spark, d).select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def keyword_rank_stemmed(spark, d):
    return _keywords(spark, d, stem).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query(r"""
with kt as (select item_id query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3 and w not in (""" + ", ".join(f"'{w}'" for w in QUERY_STOP_WORDS) + r""")))) token from benchmark),
w as (select page_id chunk_id, unnest(regexp_extract_all(lower(url), '[\p{L}\p{N}_]+')) token, 1.0 w from pages
      union all select page_id, unnest(regexp_extract_all(lower(html), '[\p{L}\p{N}_]+')), 0.4 from pages),
s as (select query_id, chunk_id, sum(w) score from kt join w using (token) group by 1, 2)
select query_id, chunk_id, cast(round(score, 4) as double) as score, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank from s qualify rank <= 8""")
def keyword_rank_two_fields(spark, d):
    """Pages by keywords of benchmark items: a word in the address weighs 1.0, one in the page 0.4."""
    chunks = table(spark, d, "pages").select(F.col("page_id").alias("chunk_id"), F.col("url").alias("reference"), F.col("html").alias("snippet"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = R.keyword_top_k(items, P.kept_index(chunks, f"{d}/pages.parquet"))
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _rankings(spark, d):
    return R.rankings(_vectors(spark, d), _keywords(spark, d))


_RRF = f"""
with {_VECTOR.format(t=LOW)}, {_KEYWORD},
a as (select query_id, chunk_id, score, rank, dense_rank() over (order by collection) - 1 ranking from vr
      union all select query_id, chunk_id, score, rank, (select count(distinct label) from embeddings) from kr),
f as (select query_id, chunk_id, sum(1.0 / (60 + rank)) rrf, max(score) raw_score, min(ranking * 1000 + rank) first_seen from a group by 1, 2),
r as (select *, row_number() over (partition by query_id order by round(rrf, 9) desc, first_seen, chunk_id) rank from f qualify rank <= 3)"""


@query(_RRF + " select query_id, chunk_id, round(rrf, 9) as rrf, round(raw_score, 5) as raw_score, rank from r")
def rrf_fusion(spark, d):
    found = R.fused_top_k(_rankings(spark, d))
    return found.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), F.round("raw_score", 5).alias("raw_score"), F.col("rank").cast("long").alias("rank"))


@query(_RRF + " select query_id, chunk_id, round(rrf / max(rrf) over (partition by query_id), 6) as rrf_share, format('{:.3f}', round(rrf, 9)) as rrf_text from r")
def rrf_normalised(spark, d):
    found = R.fused_top_k(_rankings(spark, d))
    return found.select("query_id", "chunk_id", F.round(R.share_of_best(found, "rrf"), 6).alias("rrf_share"), F.format_string("%.3f", F.round("rrf", 9)).alias("rrf_text"))


@query(_RRF + """ select b.item_id as query_id, coalesce(len(l.ids), 0) as n_evidence, coalesce(array_to_string(l.ids, ','), '') as chunk_ids
from benchmark b left join (select query_id, list(chunk_id order by rank) ids from r group by 1) l on l.query_id = b.item_id""")
def evidence_lists(spark, d):
    found = R.fused_top_k(_rankings(spark, d)).select("query_id", "chunk_id", "rank", F.col("raw_score").alias("score"))
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    lists = R.evidence_lists(claims, found)
    return lists.select("query_id", F.size("evidence").cast("long").alias("n_evidence"), F.array_join(F.transform("evidence", lambda e: e["chunk_id"].cast("string")), ",").alias("chunk_ids"))


@query(_RRF + """, h as (select query_id claim_id, chunk_id + case when rank = 2 then 1000000 else 0 end chunk_id, rank from r)
select h.claim_id, h.rank as hint, case when e.chunk_id is not null then h.chunk_id end as chunk_id, e.chunk_id is not null as verified
from h left join r e on e.query_id = h.claim_id and e.chunk_id = h.chunk_id where h.rank <> 3""")
def hint_verification(spark, d):
    """Hints made from the evidence: the second names a chunk that isn't there, the third has no rationale."""
    found = R.fused_top_k(_rankings(spark, d))
    evidence = found.select(F.col("query_id").alias("claim_id"), "chunk_id", F.lit("").alias("url"))
    hints = found.select(F.col("query_id").alias("claim_id"), (F.col("chunk_id") + F.when(F.col("rank") == 2, 1_000_000).otherwise(0)).alias("chunk_id"), F.col("rank").cast("long").alias("hint"), F.lit("r").alias("reference"), F.when(F.col("rank") != 3, "x").alias("rationale"))
    return C.verified_hints(hints, evidence).select("claim_id", "hint", "chunk_id", "verified")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r]+'), lambda w: w <> ''))"


@query("with " + _KEYWORD.replace("rank <= 8", "rank <= 16") + f""",
s as (select kr.query_id, kr.chunk_id, len(list_intersect({_WORDS.format('b.text')}, {_WORDS.format('d.text')})) * 1.0 / greatest(1, len({_WORDS.format('b.text')})) - 0.05 score
      from kr join benchmark b on b.item_id = kr.query_id join documents d on d.doc_id = kr.chunk_id)
select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s where score >= 0""")
def rerank_stub(spark, d):
    """The first 16 candidates of a query re-scored by shared words: the hook that a cross-encoder takes."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    candidates = _keywords(spark, d, k=16).join(items, "query_id").join(docs, "chunk_id")

    def shared(queries, chunks):
        words = lambda t: set(re.split(r"[ \t\n\r]+", t.lower())) - {""}
        pairs = ((words(q), words(c)) for q, c in zip(queries, chunks))
        return [len(a & b) / max(1, len(a)) - 0.05 for a, b in pairs]

    return R.rerank(candidates, shared).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("with " + _KEYWORD + """, g as (select b.item_id query_id, d.doc_id chunk_id from benchmark b, documents d where trim(b.text) <> '' and contains(d.text, trim(b.text))),
h as (select query_id, max(case when kr.chunk_id is not null then 1.0 else 0.0 end) hit from g left join kr using (query_id, chunk_id) group by 1)
select avg(hit) as recall from h""")
def recall_at_8(spark, d):
    """Share of benchmark items, of those that documents hold word for word, with such a document among the first eight by keywords."""
    relevant = C.locate(*located(spark, d)).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    return C.recall_at(_keywords(spark, d).select("query_id", "chunk_id", "rank"), relevant)


@query("with " + _KEYWORD + """
select query_id, kr.rank, cast(chunk_id as varchar) as chunk_id, coalesce(d.source, '') as source_type, coalesce(d.lang, '') as reference, '' as url, substring(d.text, 1, 600) as snippet, 'n_chars=' || d.n_chars as metadata
from kr join documents d on d.doc_id = kr.chunk_id""")
def hit_projection(spark, d):
    """What a caller sees of the keyword ranking."""
    metadata = F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("snippet"), F.col("source").alias("source_type"), F.col("lang").alias("reference"), F.lit(None).cast("string").alias("url"), metadata.alias("metadata"))
    seen = R.hits(_keywords(spark, d).join(docs, "chunk_id")).withColumn("rank", F.col("rank").cast("long")).drop("score")
    return seen.withColumn("metadata", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query("""
select item_id, text || case item_id % 3 when 0 then ' — Zinc' when 1 then ' — Zinc — Copper' else ' — Copper' end as search_text from benchmark""")
def query_expansion(spark, d):
    """Search texts of claims: wording, nutrient, substance."""
    nutrient = F.when(F.col("item_id") % 3 < 2, "Zinc")
    substance = F.when(F.col("item_id") % 3 == 0, "Zinc").otherwise("Copper")
    return table(spark, d, "benchmark").select("item_id", R.expanded_query(F.col("text"), nutrient, substance).alias("search_text"))
