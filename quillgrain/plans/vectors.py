"""Queries on embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.functions import vectors as V
from quillgrain.operators import search as R
from quillgrain.session import table

from .registry import query

VEC = "vecs as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null)"
DOT = lambda a, b: f"list_sum([{a}[i] * {b}[i] for i in range(1, len({a}) + 1)])"
DIST = "sqrt(list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) for i in range(1, len(q.v) + 1)]))"
NEAR = f"near as (select q.vec_id as query_key, c.vec_id as key, {DIST} as d, row_number() over (partition by q.vec_id order by round({DIST}, 9), c.vec_id) as rank from vecs q, vecs c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _asked(spark, sf_dir):
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0")


def _near(spark, sf_dir, k):
    return R.top_k(_asked(spark, sf_dir), _vectors(spark, sf_dir), "vec_id", "embedding", k)


@query(f"with {VEC} select vec_id, round({DOT('v', 'v')}, 6) as squared_norm, round(v[1] / sqrt({DOT('v', 'v')}), 6) as first, round(v[len(v)] / sqrt({DOT('v', 'v')}), 6) as last from vecs")
def q_l2_normalize(spark, sf_dir):
    rows = _vectors(spark, sf_dir).where("embedding is not null").select("vec_id", V.dot(F.col("embedding"), F.col("embedding")).alias("n"), V.unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round("n", 6).alias("squared_norm"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"))


@query(f"with {VEC} select a.vec_id, round({DOT('a.v', 'b.v')} / sqrt({DOT('a.v', 'a.v')} * {DOT('b.v', 'b.v')}), 6) as cosine from vecs a join vecs b on b.vec_id = a.vec_id + 1")
def q_cosine_pairs(spark, sf_dir):
    """Each vector with its successor: an equi-join on the shifted id."""
    a, b = _vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("x")), _vectors(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").where("x is not null and y is not null").select("vec_id", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(f"with {VEC}, {NEAR} select query_key, key, round(d, 6) as distance, rank from near where rank <= 5")
def q_topk_per_query(spark, sf_dir):
    return _near(spark, sf_dir, 5).withColumn("distance", F.round("distance", 6))


@query(f"with {VEC}, {NEAR} select query_key, count(*)::bigint as n, round(min(d), 6) as nearest, round(max(d), 6) as farthest from near where rank <= 20 group by 1")
def q_query_corpus_distance(spark, sf_dir):
    return _near(spark, sf_dir, 20).groupBy("query_key").agg(F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.max("distance"), 6).alias("farthest"))


@query(f"""with {VEC}, {NEAR}, s as (select n.query_key, n.key, n.d, {DOT('q.v', 'c.v')} / sqrt({DOT('q.v', 'q.v')} * {DOT('c.v', 'c.v')}) as again from near n join vecs q on q.vec_id = n.query_key join vecs c on c.vec_id = n.key where n.rank <= 6)
select query_key, key, round(again, 6) as score, row_number() over (partition by query_key order by round(again, 9) desc, key) as place from s qualify place = 1""")
def q_topk_rerank(spark, sf_dir):
    """Six nearest by distance, then the best by a second score (a cosine stands in for the reranker)."""
    from pyspark.sql import Window

    v = _vectors(spark, sf_dir)
    found = _near(spark, sf_dir, 6).join(v.select(F.col("vec_id").alias("query_key"), F.col("embedding").alias("q")), "query_key").join(v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("c")), "key")
    scored = found.select("query_key", "key", V.cosine(F.col("q"), F.col("c")).alias("again"))
    place = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc(F.round("again", 9)), "key")).cast("long")
    return scored.withColumn("place", place).where("place = 1").select("query_key", "key", F.round("again", 6).alias("score"), "place")


CENTRAL = f"central as (select a.vec_id, a.label, round(sum({DOT('a.v', 'b.v')}), 6) as centrality from vecs a join vecs b using (label) group by 1, 2), placed as (select *, row_number() over (partition by label order by centrality desc, vec_id) as place from central)"


@query(f"with {VEC}, {CENTRAL} select vec_id, label, centrality, place from placed")
def q_cluster_centrality(spark, sf_dir):
    return R.centrality(_vectors(spark, sf_dir), "vec_id", "label", "embedding")


@query(f"with {VEC}, {CENTRAL}, n as (select label, count(*)::bigint as n_members from vecs group by 1) select label, 'cluster_' || (label + 1)::varchar || '_' || vec_id::varchar as cluster_name, n_members from placed join n using (label) where place = 1")
def q_cluster_representative(spark, sf_dir):
    rows = R.centrality(_vectors(spark, sf_dir), "vec_id", "label", "embedding")
    best = rows.groupBy("label").agg(F.count("*").alias("n_members"), F.min_by("vec_id", "place").alias("title"))
    return best.select("label", F.concat(F.lit("cluster_"), (F.col("label") + 1).cast("string"), F.lit("_"), F.col("title").cast("string")).alias("cluster_name"), "n_members")


@query(f"with {VEC} select label, count(*)::bigint as n, round(avg(v[1]), 6) as mean_first, round(avg({DOT('v', 'v')}), 6) as mean_square from vecs group by 1")
def q_cluster_stats(spark, sf_dir):
    v = F.col("embedding")
    return _vectors(spark, sf_dir).where("embedding is not null").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.element_at(v, 1).cast("double")), 6).alias("mean_first"), F.round(F.avg(V.dot(v, v)), 6).alias("mean_square"))


@query(f"""with {VEC}, p as (select a.vec_id, a.label, b.label as other, count(*) as n, sum({DIST.replace('q.', 'a.').replace('c.', 'b.')}) as s from vecs a, vecs b where a.vec_id % 100 = 0 group by 1, 2, 3),
w as (select vec_id, label, max(case when label = other then s / greatest(1, n - 1) end) as a, min(case when label <> other then s / n end) as b, max(case when label = other then n end) as n from p group by 1, 2)
select vec_id, label, round(case when n <= 1 or b is null then 0 when greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end, 6) as silhouette from w""")
def q_silhouette(spark, sf_dir):
    return R.silhouette(_asked(spark, sf_dir), _vectors(spark, sf_dir), "vec_id", "label", "embedding")


@query(f"""with {VEC}, p as (select a.vec_id, a.label, b.label as other, count(*) as n, sum({DIST.replace('q.', 'a.').replace('c.', 'b.')} ** 2) as s from vecs a, vecs b group by 1, 2, 3),
w as (select vec_id, label, max(case when label = other then s / greatest(1, n - 1) end) as a, min(case when label <> other then s / n end) as b, max(case when label = other then n end) as n from p group by 1, 2)
select vec_id, label, round(case when n <= 1 or b is null then 0 when greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end, 6) as silhouette from w""")
def q_silhouette_squared(spark, sf_dir):
    return R.squared_silhouette(_vectors(spark, sf_dir), "vec_id", "label", "embedding")


@query()
def q_kmeans_assign(spark, sf_dir):
    return R.kmeans(_vectors(spark, sf_dir), "vec_id", "embedding")


@query(f"with {VEC}, near as (select q.vec_id as query_key, q.label, c.vec_id as key, row_number() over (partition by q.vec_id order by round({DIST}, 9), c.vec_id) as rank from vecs q join vecs c using (label) where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id) select query_key, label, key, rank from near where rank <= 4")
def q_partitioned_index(spark, sf_dir):
    """Each query asks only the index of its own scenario; the label names the partition."""
    v, asked = _vectors(spark, sf_dir), _asked(spark, sf_dir)
    out = None
    for r in asked.select("label").distinct().orderBy("label").collect():  # scenarios are a fixed catalogue
        own = F.col("label") == F.lit(r["label"])
        part = R.top_k(asked.where(own), v.where(own), "vec_id", "embedding", 4).select("query_key", F.lit(r["label"]).alias("label"), "key", "rank")
        out = part if out is None else out.unionByName(part)
    return out


@query("select doc_id, md5(replace(text, chr(10), ' ')) as cleaned_md5 from documents where text is not null")
def q_embed_preclean(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.clean_for_embedding(F.col("text"))).alias("cleaned_md5"))


@query(r"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents where text is not null), n as (select doc_id, ('0x' || substr(md5(w), 1, 8))::bigint % 16 as i, count(*) as c from w group by 1, 2)
select doc_id, coalesce(sum(c), 0)::double as total, coalesce(sum(c * c), 0)::double as squares, coalesce(max(case when i = 3 then c end), 0)::double as fourth from documents left join n using (doc_id) where text is not null group by 1""")
def q_embed_texts(spark, sf_dir):
    """Texts embedded over Arrow batches; the hashed word counts stand in for a hosted model."""
    docs = R.embed_texts(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"), "text", R.hashed_vectors(16))
    v = F.col("embedding")
    return docs.select("doc_id", F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"), V.dot(v, v).alias("squares"), F.get(v, F.lit(3)).alias("fourth"))


@query(f"""with {VEC}, {NEAR}, c as (select query_key, string_agg('item ' || key::varchar, chr(10) || chr(10) order by rank) as context from near where rank <= 4 group by 1)
select query_key, context, 'Context:' || chr(10) || context || chr(10) || 'Question: what is like ' || query_key::varchar || '?' as prompt, 'ITEM ' || split_part(split_part(context, chr(10), 1), ' ', 2) as answer from c""")
def q_retrieval_chain(spark, sf_dir):
    """Retriever, context, prompt, model and parser in one plan; the model stand-in repeats its prompt in capitals."""
    rows = _vectors(spark, sf_dir).withColumn("passage", F.concat(F.lit("item "), F.col("vec_id").cast("string")))
    asked = _asked(spark, sf_dir).withColumn("question", F.concat(F.lit("what is like "), F.col("vec_id").cast("string"), F.lit("?")))
    prompt = lambda context, question: F.concat(F.lit("Context:\n"), context, F.lit("\nQuestion: "), question)
    return R.retrieval_chain(asked, rows, "vec_id", "embedding", "passage", prompt, F.upper, lambda a: F.regexp_extract(a, r"(ITEM \d+)", 1))
