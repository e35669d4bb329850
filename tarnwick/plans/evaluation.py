"""Evaluation of ``embeddings``: even ids train, odd ids test; ten classes of 64-dimensional vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.arrays import rounded
from ..operators import backbones as B
from ..operators import evaluation as E
from ..operators import probes as P
from ..operators import sampling as S
from .registry import query, table

DIM, CLASSES = 64, 10

LONG = """long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"""
SCORES = f"""WITH {LONG}, c AS (SELECT label AS class_id, i, avg(x) AS m FROM long WHERE vec_id % 2 = 0 GROUP BY ALL),
own AS (SELECT vec_id, any_value(label) AS label, greatest(sqrt(sum(x * x)), 1e-8) AS n FROM long WHERE vec_id % 2 = 1 GROUP BY vec_id),
cn AS (SELECT class_id, greatest(sqrt(sum(m * m)), 1e-8) AS n FROM c GROUP BY class_id),
d AS (SELECT l.vec_id, c.class_id, sum(l.x * c.m) AS d FROM long l JOIN c ON l.i = c.i WHERE l.vec_id % 2 = 1 GROUP BY ALL),
scores AS (SELECT d.vec_id, d.class_id, own.label, 10 * d / (own.n * cn.n) AS score FROM d JOIN own USING (vec_id) JOIN cn USING (class_id))"""
AP = f"""{SCORES}, thr AS (SELECT class_id, round(score, 9) AS score, sum((label = class_id)::INT) AS tp, count(*) AS n FROM scores GROUP BY ALL),
run AS (SELECT class_id, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM thr WINDOW w AS (PARTITION BY class_id ORDER BY score DESC)),
ap AS (SELECT class_id, sum(tp * ctp / cn) / sum(tp) AS ap, CAST(sum(tp) AS BIGINT) AS n_positive FROM run GROUP BY class_id HAVING sum(tp) > 0)"""


def scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    means = E.centroids(e.where("vec_id % 2 = 0"), DIM)
    return E.class_scores(e.where("vec_id % 2 = 1"), means).withColumn("score", rounded("score", 9)).withColumn("truth", F.col("label") == F.col("class_id"))


@query(f"WITH {LONG} SELECT label AS class_id, i - 1 AS dim, round(avg(x), 6) AS m FROM long WHERE vec_id % 2 = 0 GROUP BY ALL")
def class_centroids(spark, sf_dir):
    means = E.centroids(table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0"), DIM)
    return means.select("class_id", F.posexplode("centroid").alias("dim", "m")).select("class_id", F.col("dim").cast("bigint").alias("dim"), rounded("m", 6).alias("m"))


@query(AP + " SELECT class_id, round(ap, 6) AS ap, n_positive FROM ap")
def centroid_ap_per_class(spark, sf_dir):
    ap = E.average_precision(scores(spark, sf_dir))
    return ap.select("class_id", F.round("ap", 6).alias("ap"), "n_positive")


@query(AP + " SELECT round(coalesce(avg(ap), 0), 6) AS cmap, count(ap) AS n_classes FROM ap")
def centroid_cmap(spark, sf_dir):
    return E.mean_average_precision(E.average_precision(scores(spark, sf_dir))).withColumn("cmap", F.round("cmap", 6))


@query(SCORES + " SELECT vec_id, list(class_id ORDER BY class_id) FILTER (1 / (1 + exp(-score)) > 0.6) AS predicted, arg_max(class_id, round(score, 9) - class_id * 1e-12) AS best FROM scores GROUP BY vec_id")
def predictions(spark, sf_dir):
    lists = scores(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("class_id", "score"))).alias("s"))
    p = F.transform("s", lambda x: E.sigmoid(x["score"]))
    hit = E.above(p, 0.6)
    return lists.select("vec_id", F.when(F.size(hit) > 0, F.transform(hit, lambda i: F.col("s")[i]["class_id"])).alias("predicted"), E.arg_max(p).alias("best"))


@query(f"SELECT c::INT AS class_id, CAST(sum((label = c)::INT) AS BIGINT) AS n FROM embeddings, (SELECT unnest(range({CLASSES})) AS c) GROUP BY c")
def multihot_counts(spark, sf_dir):
    hot = table(spark, sf_dir, "embeddings").select(F.posexplode(E.multi_hot(F.array("label"), CLASSES)).alias("class_id", "hot"))
    return hot.groupBy("class_id").agg(F.sum("hot").alias("n"))


@query("SELECT label, CAST(least(count(*), 20) AS BIGINT) AS n FROM embeddings GROUP BY label")
def stratified_sample_counts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return e.join(S.stratified_sample(e, 20, 42), "id", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


@query()
def stratified_sample(spark, sf_dir):
    return S.stratified_sample(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), 20, 42)


@query()
def uniform_sample_n(spark, sf_dir):
    return S.uniform_sample(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), 100, 7).select("id")


@query("""WITH o AS (SELECT label, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, 0.01::DOUBLE + 0.98 * ((o_orderkey * 37) % 101) / 101.0 AS p FROM (SELECT o_orderkey, o_orderstatus, o_orderkey % 5 AS label FROM orders)),
l AS (SELECT label, CASE WHEN y = 1 THEN p ELSE least(1 - p + 0.05::DOUBLE, 1.0) END AS pt, y FROM o)
SELECT label, round(avg(-power(1 - pt, CASE WHEN y = 1 THEN 1.0 ELSE 4.0 END) * ln(greatest(pt, 1e-8::DOUBLE))), 6) AS loss FROM l GROUP BY label""")
def asymmetric_loss(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = 0.01 + 0.98 * F.pmod(F.col("o_orderkey") * 37, F.lit(101)) / 101.0
    y = (F.col("o_orderstatus") == "F").cast("int")
    return o.groupBy((F.col("o_orderkey") % 5).alias("label")).agg(F.round(F.avg(E.asymmetric_loss(p, y)), 6).alias("loss"))


@query("""SELECT label, round(avg(ln(list_sum(list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)))) - embedding[label + 1]::DOUBLE), 6) AS loss FROM embeddings GROUP BY label""")
def cross_entropy(spark, sf_dir):
    logits = F.transform(F.slice("embedding", 1, CLASSES), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(E.cross_entropy(logits, F.col("label"))), 6).alias("loss"))


@query(f"WITH {LONG} SELECT label AS component, round(sqrt(sum(x * x)), 6) AS l2 FROM long GROUP BY label")
def l2_norms(spark, sf_dir):
    leaves = table(spark, sf_dir, "embeddings").select(F.col("label").alias("component"), F.col("embedding").alias("values"))
    return E.l2_norms(leaves).withColumn("l2", F.round("l2", 6))


@query(f"WITH {LONG} SELECT round(sqrt(sum(x * x)), 6) AS l2, round(avg(abs(x)), 6) AS abs_mean, round(max(abs(x)), 6) AS abs_max FROM long")
def opt_stats(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x")).select(F.col("x").cast("double").alias("x"))
    return x.agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("l2"), F.round(F.avg(F.abs("x")), 6).alias("abs_mean"), F.round(F.max(F.abs("x")), 6).alias("abs_max"))


@query(f"""WITH {LONG}, f AS (SELECT label % 4 AS state, sqrt(sum(x * x)) AS l2, avg(abs(x)) AS m, max(abs(x)) AS t FROM long WHERE label % 4 < 3 GROUP BY 1),
c AS (SELECT r_regionkey % 5 AS state, list(CAST(r_regionkey AS BIGINT) * 7 ORDER BY r_regionkey) AS counts FROM (SELECT r_regionkey FROM region WHERE r_regionkey > 1 UNION ALL SELECT r_regionkey + 5 FROM region WHERE r_regionkey > 1) GROUP BY 1)
SELECT CAST(state AS BIGINT) AS state, round(l2, 6) AS l2, round(m, 6) AS abs_mean, round(t, 6) AS abs_max, coalesce(counts, []) AS counts FROM f FULL JOIN c USING (state)""")
def optimizer_stats(spark, sf_dir):
    """States 0 to 2 hold vectors, 2 to 4 whole numbers."""
    none = F.lit(None)
    e = table(spark, sf_dir, "embeddings").where("label % 4 < 3").select((F.col("label") % 4).cast("bigint").alias("state"), F.col("vec_id").alias("component"), F.col("embedding").alias("values"), none.cast("bigint").alias("count"))
    r = table(spark, sf_dir, "region").where("r_regionkey > 1").select(F.explode(F.array(F.col("r_regionkey").cast("bigint"), F.col("r_regionkey").cast("bigint") + 5)).alias("k"))
    out = E.optimizer_stats(e.unionByName(r.select((F.col("k") % 5).alias("state"), F.col("k").alias("component"), none.cast("array<float>").alias("values"), (F.col("k") * 7).alias("count"))))
    return out.select("state", *(F.round(c, 6).alias(c) for c in ("l2", "abs_mean", "abs_max")), "counts")


_KNOTS = ", ".join(str(3.0 * k / 16) for k in range(17))


@query(f"""WITH {LONG}, dirs AS (SELECT p::INT AS projection, i, sin((p + 1) * i)::DOUBLE AS w FROM (SELECT unnest(range(4)) AS p), (SELECT unnest(range(1, 65)) AS i)),
n AS (SELECT projection, sqrt(sum(w * w)) AS n FROM dirs GROUP BY projection),
x AS (SELECT vec_id, projection, sum(x * w / n) AS x FROM long JOIN dirs USING (i) JOIN n USING (projection) GROUP BY ALL),
k AS (SELECT unnest([{_KNOTS}])::DOUBLE AS t),
m AS (SELECT projection, t, avg(cos(x * t)) AS c, avg(sin(x * t)) AS s FROM x, k GROUP BY ALL)
SELECT projection, round(sum(0.1875::DOUBLE * (CASE WHEN t = 0 OR t = 3 THEN 0.5 ELSE 1 END) * exp(-t * t / 2) * (power(c - exp(-t * t / 2), 2) + power(s, 2))), 6) AS statistic FROM m GROUP BY projection""")
def sigreg(spark, sf_dir):
    i = F.sequence(F.lit(1), F.lit(DIM))
    raw = spark.range(4).select(F.col("id").cast("int").alias("projection"), F.transform(i, lambda k: F.sin(((F.col("id") + 1) * k).cast("double"))).alias("w"))
    unit = raw.select("projection", F.transform("w", lambda w: w / F.sqrt(E.dot(F.col("w"), F.col("w")))).alias("direction"))
    return E.sigreg(table(spark, sf_dir, "embeddings"), unit).withColumn("statistic", F.round("statistic", 6))


@query("""WITH b AS (SELECT o_orderkey // 64 AS batch, count(*) FILTER (o_orderstatus = 'F') AS correct, count(*) AS total, avg(o_totalprice) AS loss FROM orders GROUP BY 1)
SELECT round(sum(correct) / greatest(sum(total), 1), 6) AS accuracy, round(sum(loss) / greatest(count(*), 1), 3) AS loss FROM b""")
def eval_accuracy(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    b = o.groupBy(F.expr("o_orderkey div 64").alias("batch")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("correct"), F.count("*").alias("total"), F.avg("o_totalprice").alias("loss"))
    return E.accuracy(b).select(F.round("accuracy", 6).alias("accuracy"), F.round("loss", 3).alias("loss"))


@query()
def linear_probe_cmap(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    weights = B.fit_linear(e.where("vec_id % 2 = 0"), DIM, CLASSES, rounds=15)
    scored = B.linear_scores(e.where("vec_id % 2 = 1"), weights).withColumn("truth", F.col("label") == F.col("class_id"))
    return E.mean_average_precision(E.average_precision(scored))


@query()
def mlp_probe_cmap(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    weights = B.fit_mlp(e.where("vec_id % 2 = 0"), DIM, CLASSES, rounds=15)
    scored = B.mlp_scores(e.where("vec_id % 2 = 1"), weights).withColumn("truth", F.col("label") == F.col("class_id"))
    return E.mean_average_precision(E.average_precision(scored))


_NORMAL = """v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
s AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS d FROM v GROUP BY vec_id), x AS (SELECT vec_id, i, (x - m) / sqrt(d + 1e-6::DOUBLE) * (1 + i / 128.0::DOUBLE) + i / 640.0::DOUBLE AS x FROM v JOIN s USING (vec_id))"""


@query(f"""WITH {_NORMAL} SELECT vec_id, CAST(c AS INTEGER) AS class_id, round(sum(x * sin(c * 64 + i) / 8) + c / 10.0::DOUBLE, 6) AS score FROM x, (SELECT unnest(range({CLASSES})) AS c) GROUP BY vec_id, c""")
def linear_probe_scores(spark, sf_dir):
    """A linear probe's logits under fixed weights."""
    i, c = np.arange(DIM), np.arange(CLASSES)
    w = {"scale": 1 + i / 128, "shift": i / 640, "w": np.sin(c[:, None] * 64 + i) / 8, "b": c / 10}
    out = P.scores(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), w)
    return out.select("vec_id", "class_id", rounded("score", 6).alias("score"))


@query(f"""WITH {_NORMAL}, h AS (SELECT vec_id, k, sum(x * cos(k * 64 + i) / 8) + k / 64.0::DOUBLE AS z FROM x, (SELECT unnest(range(8)) AS k) GROUP BY vec_id, k),
a AS (SELECT vec_id, k, 0.5::DOUBLE * z * (1 + (1 - 2 / (exp(2 * sqrt(2 / pi()) * (z + 0.044715::DOUBLE * z * z * z)) + 1))) AS a FROM h)
SELECT vec_id, CAST(c AS INTEGER) AS class_id, round(sum(a * sin(c * 8 + k)) + c / 10.0::DOUBLE, 6) AS score FROM a, (SELECT unnest(range({CLASSES})) AS c) GROUP BY vec_id, c""")
def mlp_probe_scores(spark, sf_dir):
    """A probe's logits with one hidden layer of eight under fixed weights."""
    i, c, k = np.arange(DIM), np.arange(CLASSES), np.arange(8)
    w = {"scale": 1 + i / 128, "shift": i / 640, "w1": np.cos(k[:, None] * 64 + i) / 8, "b1": k / 64, "w": np.sin(c[:, None] * 8 + k), "b": c / 10}
    out = P.scores(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), w)
    return out.select("vec_id", "class_id", rounded("score", 6).alias("score"))


@query()
def probe_by_batches_cmap(spark, sf_dir):
    """A linear probe after one epoch of mini-batches, judged on the other half of the vectors."""
    e = table(spark, sf_dir, "embeddings")
    weights = P.fit(e.where("vec_id % 2 = 0"), P.linear_probe(DIM, CLASSES), "vec_id", epochs=1, batch=128, rate=0.02)
    scored = P.scores(e.where("vec_id % 2 = 1"), weights).withColumn("truth", F.col("label") == F.col("class_id"))
    return E.mean_average_precision(E.average_precision(scored))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1) % 16 AS i FROM embeddings), m AS (SELECT vec_id, i, avg(x) AS x FROM v GROUP BY ALL),
o AS (SELECT vec_id, j, round(sum(x * cos(i * 8 + j)) + 0.0, 6) AS x FROM m, (SELECT unnest(range(8)) AS j) GROUP BY ALL) SELECT vec_id, list(x ORDER BY j) AS encoded FROM o GROUP BY vec_id""")
def backbone_values(spark, sf_dir):
    """An encoder with fixed weights, by name: patches of 16 values projected to 8 and averaged."""
    if "waves" not in B.names():
        B.register("waves", B.patch_projection(lambda checkpoint: np.cos(np.arange(16)[:, None] * 8 + np.arange(8))))
    out = table(spark, sf_dir, "embeddings").select("vec_id", B.encoded("waves", "any", "embedding").alias("e"))
    return out.select("vec_id", F.transform("e", lambda x: rounded(x + F.lit(0.0), 6)).alias("encoded"))


@query("SELECT vec_id, 32 AS size FROM embeddings")
def backbone_sizes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(B.encoded("patch_mean", "small", "embedding")).alias("size"))
