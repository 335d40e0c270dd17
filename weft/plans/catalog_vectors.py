"""Queries on vectors, similarities and alignments, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import registry as Y
from weft.operators import lookup as L
from weft.operators import metrics as M
from weft.operators import vectors as X
from weft.plans import views as V

E = "(SELECT vec_id AS id, v, label, sqrt(list_dot_product(v, v)) + 1e-9 AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings))"
#: The cosine of two rows of E, with the small number that both norms are raised by.
COS = "list_dot_product({0}.v, {1}.v) / ({0}.n * {1}.n)"
XY = COS.format("x", "y")
AB = f"a AS (SELECT * FROM {E} WHERE id % 2 = 0), b AS (SELECT * FROM {E} WHERE id % 2 = 1), s AS (SELECT a.id AS l, b.id AS r, a.label = b.label AS gold, {COS.format('a', 'b')} AS score FROM a, b), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS rank FROM s) WHERE rank <= 5)"


def vectors(spark, d, where="true"):
    return V.table(spark, d, "embeddings").where(where).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def sides(spark, d):
    return vectors(spark, d, "vec_id % 2 = 0"), vectors(spark, d, "vec_id % 2 = 1")


def gold(spark, d):
    a, b = sides(spark, d)
    return a.select(F.col("id").alias("left"), "label").join(b.select(F.col("id").alias("right"), "label"), "label").select("left", "right")


def matches(spark, d, k=5):
    return X.best_matches(*sides(spark, d), k)


def words(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("term"))


def vocabulary(spark, d):
    """All terms, and in how many documents each stands."""
    return words(spark, d).groupBy("term").agg(F.count("*").alias("n"))


WORDS = "(SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)"
NGD = f"""w AS (SELECT * FROM {WORDS}), f AS (SELECT term, count(*) AS n FROM w GROUP BY term), q AS (SELECT term FROM f ORDER BY n DESC, term LIMIT 10),
p AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.term <> y.term WHERE x.term IN (SELECT term FROM q) GROUP BY ALL),
g AS (SELECT a, b, CASE WHEN ln((SELECT count(*) FROM documents)) - ln(least(x.n, y.n)) <= 0 THEN 1 ELSE greatest(0, least(1, (ln(greatest(x.n, y.n)) - ln(p.n)) / (ln((SELECT count(*) FROM documents)) - ln(least(x.n, y.n))))) END AS d FROM p JOIN f x ON x.term = a JOIN f y ON y.term = b)"""


def ngd_pairs(spark, d):
    """The ten commonest terms against all terms that stand with them in a document; counts are made once and cut."""
    docs = V.table(spark, d, "documents")
    return X.corpus_distances(words(spark, d), vocabulary(spark, d).orderBy(F.desc("n"), "term").limit(10), docs.count())


def three_scores(spark, d):
    pairs = X.best_pairs(*sides(spark, d), 200).withColumn("corpus", (F.col("left") * 7 + F.col("right") * 13) % 101 / 100)
    return X.all_scores(pairs).withColumn("seq", F.col("left") * 1000000 + F.col("right"))


THREE = f"{AB}, t AS (SELECT l, r, greatest(0, least(1, score)) AS cosine, least(1, (l * 7 + r * 13) % 101 / 100) AS corpus FROM (SELECT * FROM s ORDER BY score DESC, l, r LIMIT 200)), h AS (SELECT *, cosine * 0.5 + corpus * 0.5 AS hybrid, l * 1000000 + r AS seq FROM t)"
TOP = "round(score, 6) AS score"


def rounded(df, *names, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in names else c for c in df.columns))


def queries(spark, d):
    """Every vector whose id is divisible by 20; weighted by its label."""
    return vectors(spark, d, "vec_id % 20 = 0").withColumn("weight", F.col("label") + 1.0)


def many(how, k=20):
    return lambda s, d: rounded(X.fused_search(vectors(s, d).select("id", "vector"), queries(s, d), k, how), "score")


def many_sql(score, k=20):
    return f"WITH c AS (SELECT x.id, {score} AS score FROM {E} x, {E} y WHERE y.id % 20 = 0 GROUP BY x.id) SELECT id, round(score, 6) AS score FROM c ORDER BY c.score DESC, id LIMIT {k}"


TOP5 = f"SELECT \"left\", \"right\", round(score, 6) AS score, rank FROM (SELECT x.id AS \"left\", y.id AS \"right\", {XY} AS score, row_number() OVER (PARTITION BY x.id ORDER BY {XY} DESC, y.id) AS rank FROM {E} x, {E} y WHERE x.id % 20 = 0"


QUERIES = {
    "T1_search": (
        lambda s, d: rounded(X.best_matches(queries(s, d), vectors(s, d), 5), "score"),
        f"{TOP5}) WHERE rank <= 5",
    ),
    "T1_search_one": (
        lambda s, d: rounded(X.search(vectors(s, d), list(vectors(s, d, "vec_id = 0").first().vector), 10), "score"),
        f"SELECT id, round(x, 6) AS score FROM (SELECT x.id, {XY} AS x FROM {E} x, {E} y WHERE y.id = 0) ORDER BY x DESC, id LIMIT 10",
    ),
    "T2_search_many_max": (many("max", 1 << 30), many_sql(f"max({XY})", 1 << 30)),  # the queries themselves all score 1: a cut would be among ties
    "A7_search_many_mean": (many("mean"), many_sql(f"avg({XY})")),
    "A7_search_many_sum": (many("sum"), many_sql(f"sum({XY})")),
    "A7_search_many_weighted": (many("weighted"), many_sql(f"sum({XY} * (y.label + 1)) / (sum(y.label + 1) + 1e-9)")),
    "T3_filtered_search": (
        lambda s, d: rounded(X.best_matches(queries(s, d), vectors(s, d).where(L.has_prefix(F.array(F.concat(F.lit("urn:"), "label"), F.concat(F.lit("urn:x"), "label")), ["urn:3", "urn:4"])), 5), "score"),
        f"{TOP5} AND y.label IN (3, 4)) WHERE rank <= 5",
    ),
    "T4_upsert": (
        lambda s, d: X.upserted(vectors(s, d).select("id", "vector"), vectors(s, d, "label = 3").select((F.col("id") + 475).alias("id"), "vector"), 64).select("id", F.round(F.get("vector", F.lit(0)), 5).alias("x")),
        f"SELECT id, round(CAST(v[1] AS FLOAT), 5) AS x FROM {E} WHERE id NOT IN (SELECT id + 475 FROM {E} WHERE label = 3) UNION ALL SELECT id + 475, round(CAST(v[1] AS FLOAT), 5) FROM {E} WHERE label = 3",
    ),
    "T5_top_similar_pairs": (
        lambda s, d: rounded(X.best_pairs(vectors(s, d), vectors(s, d), 25, upper=True), "score"),
        f"SELECT x.id AS \"left\", y.id AS \"right\", round({XY}, 6) AS score FROM {E} x JOIN {E} y ON x.id < y.id ORDER BY {XY} DESC, x.id, y.id LIMIT 25",
    ),
    "T7_pairwise_similarity": (
        lambda s, d: X.pair_scores(vectors(s, d), vectors(s, d), upper=True, digits=6),
        f"SELECT x.id AS \"left\", y.id AS \"right\", round({XY}, 6) AS score FROM {E} x JOIN {E} y ON x.id < y.id",
    ),
    "T6_nearest_of_each": (
        lambda s, d: rounded(matches(s, d, 1), "score"),
        f"WITH {AB} SELECT l AS \"left\", r AS \"right\", {TOP}, rank FROM m WHERE rank = 1",
    ),
    "J6_cross_graph_pairs": (
        lambda s, d: rounded(X.best_pairs(*sides(s, d), 50, least=0.2), "score"),
        f"WITH {AB} SELECT l AS \"left\", r AS \"right\", {TOP} FROM s WHERE score >= 0.2 ORDER BY s.score DESC, l, r LIMIT 50",
    ),
    "J7_upper_triangle": (
        lambda s, d: X.best_matches(vectors(s, d), vectors(s, d), 3, least=0.3, upper=True).select("left", "right", "rank"),
        f"SELECT * FROM (SELECT x.id AS \"left\", y.id AS \"right\", row_number() OVER (PARTITION BY x.id ORDER BY {XY} DESC, y.id) AS rank FROM {E} x JOIN {E} y ON x.id < y.id WHERE {XY} >= 0.3) WHERE rank <= 3",
    ),
    "A8_alignment_prf": (
        lambda s, d: rounded(M.overlap(matches(s, d).selectExpr("left AS l", "right AS r"), gold(s, d).selectExpr("left AS l", "right AS r")), "precision", "recall", "f1"),
        f"WITH {AB}, c AS (SELECT (SELECT count(*) FROM m WHERE gold) AS tp, (SELECT count(*) FROM m WHERE NOT gold) AS fp, (SELECT count(*) FROM s WHERE gold) - (SELECT count(*) FROM m WHERE gold) AS fn) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c",
    ),
    "A9_ranking_metrics": (
        lambda s, d: rounded(M.ranking(matches(s, d), gold(s, d), sides(s, d)[0].select(F.col("id").alias("left")), (1, 5)), "hits_1", "hits_5", "mrr"),
        f"WITH {AB}, b0 AS (SELECT a.id, (SELECT min(rank) FROM m WHERE m.l = a.id AND gold) AS best FROM a) SELECT round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 6) AS hits_1, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 6) AS hits_5, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr FROM b0",
    ),
    "A9_binary_metrics": (
        lambda s, d: rounded(M.confusion(V.table(s, d, "labels").selectExpr("quality AS label", "CAST(doc_id % 7 <> 0 AS INT) AS predicted")), "accuracy", "specificity", "balanced_accuracy", "mcc", "precision", "recall"),
        "WITH c AS (SELECT CAST(count(*) FILTER (quality = 1 AND doc_id % 7 <> 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (quality = 0 AND doc_id % 7 = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (quality = 0 AND doc_id % 7 <> 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (quality = 1 AND doc_id % 7 = 0) AS DOUBLE) AS fn FROM labels) SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c",
    ),
    "A10_method_statistics": (
        lambda s, d: (lambda m: rounded(m, *(c for c in m.columns if c != "n")))(M.methods(three_scores(s, d))),
        f"WITH {THREE} SELECT count(*) AS n, round(avg(cosine), 6) AS cosine_mean, round(stddev_pop(cosine), 6) AS cosine_std, round(min(cosine), 6) AS cosine_least, round(max(cosine), 6) AS cosine_most, round(avg(corpus), 6) AS corpus_mean, round(stddev_pop(corpus), 6) AS corpus_std, round(min(corpus), 6) AS corpus_least, round(max(corpus), 6) AS corpus_most, round(avg(hybrid), 6) AS hybrid_mean, round(stddev_pop(hybrid), 6) AS hybrid_std, round(min(hybrid), 6) AS hybrid_least, round(max(hybrid), 6) AS hybrid_most, round(corr(cosine, corpus), 6) AS cosine_corpus, round(corr(cosine, hybrid), 6) AS cosine_hybrid, round(corr(corpus, hybrid), 6) AS corpus_hybrid FROM h",
    ),
    "A11_cross_graph_summary": (
        lambda s, d: rounded(M.score_bins(matches(s, d)), "mean", "std", "least", "most", "median"),
        f"WITH {AB} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS least, round(max(score), 6) AS most, round(quantile_cont(score, 0.5), 6) AS median, count(*) FILTER (score >= 0.8) AS high, count(*) FILTER (score >= 0.4 AND score < 0.8) AS middle, count(*) FILTER (score < 0.4) AS low FROM m",
    ),
    "A12_alignment_similarity": (
        lambda s, d: rounded(M.aligned_means(three_scores(s, d), gold(s, d)), "cosine", "corpus", "hybrid"),
        f"WITH {THREE} SELECT count(*) AS n, round(avg(cosine), 6) AS cosine, round(avg(corpus), 6) AS corpus, round(avg(hybrid), 6) AS hybrid FROM h JOIN a ON a.id = l JOIN b ON b.id = r WHERE a.label = b.label",
    ),
    "A13_embedding_stats": (
        lambda s, d: rounded(M.embedding_stats(vectors(s, d)), "mean_norm", "std_norm"),
        f"SELECT count(*) AS n, CAST(max(len(v)) AS INTEGER) AS dim, round(avg(sqrt(list_dot_product(v, v))), 6) AS mean_norm, round(stddev_pop(sqrt(list_dot_product(v, v))), 6) AS std_norm FROM {E}",
    ),
    "A20_label_vocabulary": (
        lambda s, d: M.vocabulary(V.table(s, d, "part").select(F.col("p_type").alias("name"), F.array("p_name").alias("labels"), F.when(F.col("p_size") > 25, F.array("p_brand", "p_name")).alias("exact_synonyms"))),
        "SELECT term, count(*) AS n FROM (SELECT lower(p_type) AS term FROM part UNION ALL SELECT lower(p_name) FROM part UNION ALL SELECT unnest([lower(p_brand), lower(p_name)]) FROM part WHERE p_size > 25) GROUP BY term",
    ),
    "N6_google_index": (
        lambda s, d: ngd_pairs(s, d).groupBy("a").agg(F.round(F.avg(X.google_index(F.col("distance"))), 6).alias("mean"), F.count("*").alias("n")),
        f"WITH {NGD} SELECT a, round(avg(1 - d), 6) AS mean, count(*) AS n FROM g GROUP BY a",
    ),
    "J14_overlap_counts": (
        lambda s, d: M.overlap(V.table(s, d, "customer").selectExpr("c_nationkey AS l", "c_mktsegment AS r").where("c_acctbal > 9000"), V.table(s, d, "customer").selectExpr("c_nationkey AS l", "c_mktsegment AS r").where("c_acctbal < -500")).select("tp", "fp", "fn"),
        "WITH p AS (SELECT DISTINCT c_nationkey AS l, c_mktsegment AS r FROM customer WHERE c_acctbal > 9000), g AS (SELECT DISTINCT c_nationkey AS l, c_mktsegment AS r FROM customer WHERE c_acctbal < -500) SELECT (SELECT count(*) FROM p SEMI JOIN g USING (l, r)) AS tp, (SELECT count(*) FROM p ANTI JOIN g USING (l, r)) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (l, r)) AS fn",
    ),
    "U3_intersect_except": (
        lambda s, d: V.table(s, d, "customer").select("c_nationkey").where("c_acctbal > 9000").intersect(V.table(s, d, "supplier").select("s_nationkey")).withColumn("side", F.lit("both")).union(V.table(s, d, "nation").select("n_nationkey").exceptAll(V.table(s, d, "supplier").select("s_nationkey").distinct()).withColumn("side", F.lit("gold only"))),
        "SELECT c_nationkey, 'both' AS side FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT n_nationkey, 'gold only' FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)",
    ),
    "N1_corpus_distance": (lambda s, d: rounded(ngd_pairs(s, d), "distance"), f"WITH {NGD} SELECT a, b, round(d, 6) AS distance FROM g"),
    "N2_corpus_similarity": (lambda s, d: ngd_pairs(s, d).select("a", "b", F.round(1 - F.col("distance"), 6).alias("score")), f"WITH {NGD} SELECT a, b, round(1 - d, 6) AS score FROM g"),
    "T8_top_corpus_pairs": (
        lambda s, d: ngd_pairs(s, d).select("a", "b", F.round(1 - F.col("distance"), 6).alias("score")).orderBy(F.desc("score"), "a", "b").limit(20),
        f"WITH {NGD} SELECT a, b, round(1 - d, 6) AS score FROM g ORDER BY score DESC, a, b LIMIT 20",
    ),
    "A20_vocabulary": (lambda s, d: vocabulary(s, d), f"SELECT term, count(*) AS n FROM {WORDS} GROUP BY term"),
    "N5_clamped_cosine": (
        lambda s, d: X.all_scores(matches(s, d).withColumn("corpus", F.lit(0.0)), 0.0).select("left", "right", F.round("cosine", 6).alias("score")),
        f"WITH {AB} SELECT l AS \"left\", r AS \"right\", round(greatest(0, least(1, score)), 6) AS score FROM m",
    ),
    "N7_hybrid_scores": (lambda s, d: rounded(three_scores(s, d).select("left", "right", "cosine", "corpus", "hybrid"), "cosine", "corpus", "hybrid"), f"WITH {THREE} SELECT l AS \"left\", r AS \"right\", round(cosine, 6) AS cosine, round(corpus, 6) AS corpus, round(hybrid, 6) AS hybrid FROM h"),
    "N8_fused_embeddings": (
        lambda s, d: vectors(s, d).select("id", F.round(F.aggregate(X.fuse(F.col("vector"), F.reverse("vector"), 0.25), F.lit(0.0), lambda a, x: a + x * x), 6).alias("square")),
        f"SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: (v[i] * 0.25 + v[65 - i] * 0.75) ** 2)), 6) AS square FROM {E}",
    ),
    "N10_static_counts": (
        lambda s, d: Y.COUNTS.create("static", V.table(s, d, "region").select(F.col("r_name").alias("term"), (F.col("r_regionkey") * 10 + 5).alias("n")), V.table(s, d, "nation").select(F.col("n_name").alias("term")).union(V.table(s, d, "region").select("r_name"))),
        "SELECT r_name AS term, r_regionkey * 10 + 5 AS n FROM region UNION ALL SELECT n_name, 1000 FROM nation",
    ),
    "N11_generated_counts": (
        lambda s, d: X.positions(vocabulary(s, d), [F.desc("n"), F.col("term")], "rank").select("term", F.greatest(F.lit(1), F.floor(10000 * F.pow(F.lit(0.9), F.col("rank") - 1)).cast("int")).alias("n")),
        f"SELECT term, CAST(greatest(1, floor(10000 * pow(0.9, row_number() OVER (ORDER BY count(*) DESC, term) - 1))) AS INTEGER) AS n FROM {WORDS} GROUP BY term",
    ),
    "W1_rank_comparison": (
        lambda s, d: X.ranked(three_scores(s, d)).select("left", "right", "cosine_rank", "corpus_rank", "hybrid_rank"),
        f"WITH {THREE}, r1 AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, seq) AS cosine_rank FROM h), r2 AS (SELECT *, row_number() OVER (ORDER BY corpus DESC, cosine_rank) AS corpus_rank FROM r1) SELECT l AS \"left\", r AS \"right\", cosine_rank, corpus_rank, row_number() OVER (ORDER BY hybrid DESC, corpus_rank) AS hybrid_rank FROM r2",
    ),
}
