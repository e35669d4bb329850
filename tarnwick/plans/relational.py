"""Relational queries on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import sampling as S
from ..sources import shards
from .registry import query, table


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 10 OR o_orderpriority = '1-URGENT' AND o_totalprice > 1000")
def predicates(spark, sf_dir):
    c = F.col
    keep = (c("o_orderstatus") == "F") & (c("o_custkey") == 10) | (c("o_orderpriority") == "1-URGENT") & (c("o_totalprice") > 1000)
    return table(spark, sf_dir, "orders").where(keep).agg(F.count("*").alias("n"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.com') AND page_id % 2 = 0")
def substring_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.lower("url").contains("example.com") & (F.col("page_id") % 2 == 0)).select("page_id", "url")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def is_in(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT event_id, value FROM events WHERE event_id BETWEEN greatest(500 - 50, 0) AND 500 + 50")
def between_window(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_id").between(max(500 - 50, 0), 500 + 50)).select("event_id", "value")


@query("SELECT o_orderkey, v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) WHERE v IS NOT NULL")
def drop_nulls(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("v")).dropna(subset=["v"])


@query("SELECT bool_or(a IS NOT NULL) AS a, bool_or(b IS NOT NULL) AS b FROM (SELECT CASE WHEN event_id < 10 THEN value END AS a, CASE WHEN event_id < 0 THEN value END AS b FROM events)")
def any_not_null(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") < 10, F.col("value")).alias("a"), F.when(F.col("event_id") < 0, F.col("value")).alias("b"))
    return e.agg(*(F.bool_or(F.col(c).isNotNull()).alias(c) for c in "ab"))


@query("""SELECT event_id, coalesce(a, event_id) AS null_only, coalesce(nullif(a, 0), event_id) AS falsy
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0::BIGINT ELSE user_id END AS a FROM events)""")
def coalesce_step(spark, sf_dir):
    a = F.when(F.col("event_id") % 3 == 1, F.lit(0).cast("bigint")).when(F.col("event_id") % 3 == 2, F.col("user_id"))
    e = table(spark, sf_dir, "events").select("event_id", a.alias("a"))
    i = F.col("event_id")
    return e.select("event_id", R.coalesced_step(F.col("a"), i).alias("null_only"), R.coalesced_step(F.col("a"), i, True).alias("falsy"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 255 AS quantity_norm, CAST(floor(l_extendedprice) AS BIGINT) AS price FROM lineitem")
def derived_columns(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 255).alias("quantity_norm"), F.floor("l_extendedprice").alias("price"))


@query("SELECT page_id, split_part(url, '/', -1) AS last FROM pages")
def split_last(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.last_part(F.col("url")).alias("last"))


@query("SELECT n_nationkey, regexp_extract(n_name, '^(.*)_([^_]*)$', 1) AS head, regexp_extract(n_name, '^(.*)_([^_]*)$', 2) AS tail FROM nation")
def rsplit(spark, sf_dir):
    head, tail = R.split_right(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", head.alias("head"), tail.alias("tail"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT o_orderkey AS \"id\", o_custkey AS \"who.customer\", o_orderstatus AS \"what.status.code\", '[' || o_custkey || ',' || o_orderkey || ']' AS \"what.keys\" FROM orders")
def flatten_struct(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    nested = o.select(
        F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("customer")).alias("who"),
        F.struct(F.struct(F.col("o_orderstatus").alias("code")).alias("status"), F.array("o_custkey", "o_orderkey").alias("keys"), F.lit(1).alias("gone")).alias("what"),
    )
    return R.flatten(nested, drop=("what.gone",))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_join_runs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").drop("o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def anti_join_pending(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.pending(table(spark, sf_dir, "customer").select("c_custkey"), done, ("c_custkey",))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi_join_selected(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


_RESULTS = """results AS (SELECT 'task' || (o_orderkey % 8) AS task_name, 'org' || (o_custkey % 2) AS model_org, 'ckpt' || (o_custkey % 3) AS model_ckpt,
  CASE o_orderstatus WHEN 'F' THEN 'centroid' WHEN 'O' THEN 'linear' ELSE 'mlp' END AS clf, CASE WHEN o_custkey % 4 = 3 THEN -1 ELSE o_custkey % 4 END AS n_train,
  o_totalprice / 1000000 AS cmap, o_orderkey AS file_name FROM orders)"""


def results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    clf = F.when(F.col("o_orderstatus") == "F", "centroid").when(F.col("o_orderstatus") == "O", "linear").otherwise("mlp")
    return o.select(
        F.concat(F.lit("task"), k % 8).alias("task_name"), F.concat(F.lit("org"), u % 2).alias("model_org"), F.concat(F.lit("ckpt"), u % 3).alias("model_ckpt"),
        clf.alias("clf"), F.when(u % 4 == 3, F.lit(-1).cast("bigint")).otherwise(u % 4).alias("n_train"), (F.col("o_totalprice") / 1000000).alias("cmap"), k.alias("file_name"),
    )


_TASKS = [f"task{k}" for k in range(8)]
_CELL = ", ".join(f"""coalesce(printf('%.2f', arg_max(cmap, file_name) FILTER (task_name = '{t}') * 100), '-') AS "{t}\"""" for t in _TASKS)


@query(f"WITH {_RESULTS} SELECT model_ckpt, clf, CASE WHEN n_train = -1 THEN 'all' ELSE CAST(n_train AS VARCHAR) END AS n_train, {_CELL} FROM results GROUP BY model_ckpt, clf, n_train")
def results_pivot(spark, sf_dir):
    return R.report(results(spark, sf_dir), _TASKS)


@query(f"""WITH {_RESULTS}, d AS (SELECT task_name, model_ckpt, clf, n_train, arg_max(cmap, file_name) AS cmap FROM results GROUP BY ALL),
g AS (SELECT 'task' || t AS task_name, 'ckpt' || m AS model_ckpt, c AS clf, n AS n_train FROM (SELECT unnest(range(8)) AS t), (SELECT unnest(range(3)) AS m), (SELECT unnest(['centroid', 'linear', 'mlp']) AS c), (SELECT unnest([0, 1, 2, -1]::BIGINT[]) AS n))
SELECT task_name, model_ckpt, clf, n_train, round(cmap, 6) AS cmap FROM g LEFT JOIN d USING (task_name, model_ckpt, clf, n_train)""")
def grid_left_join(spark, sf_dir):
    g = R.grid(spark, task_name=_TASKS, model_ckpt=[f"ckpt{k}" for k in range(3)], clf=["centroid", "linear", "mlp"], n_train=[0, 1, 2, -1])
    key = ("task_name", "model_ckpt", "clf", "n_train")
    return g.join(R.latest(results(spark, sf_dir), key, "file_name", "cmap"), list(key), "left").withColumn("cmap", F.round("cmap", 6))


@query("SELECT r_name, n_name FROM region, nation")
def cross_grid(spark, sf_dir):
    small = table(spark, sf_dir, "region").select("r_name")
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(F.broadcast(small)).select("r_name", "n_name")


@query("""SELECT o_orderpriority AS run, o_orderstatus AS n_train, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, count(o_totalprice) AS n, arg_min(o_custkey, o_orderkey) AS lr FROM orders GROUP BY ALL""")
def group_mean_std(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("n_train"))
    p = "o_totalprice"
    return g.agg(F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("std"), F.count(p).alias("n"), F.min_by("o_custkey", "o_orderkey").alias("lr"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY ALL")
def group_min_max(spark, sf_dir):
    keys = ("l_returnflag", "l_linestatus", "l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count("*").alias("n")).orderBy(*keys)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) = 8")
def having_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n = 8")


@query("SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS best, min(o_totalprice) AS price FROM orders GROUP BY o_custkey")
def best_per_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_totalprice").alias("best"), F.min("o_totalprice").alias("price"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def sorted_head(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(25)


@query("SELECT o_orderpriority AS run, CAST(CASE WHEN max(o_custkey % 7) > 0 THEN max(o_custkey % 7) * count(DISTINCT o_orderstatus) ELSE count(*) END AS BIGINT) AS size FROM orders GROUP BY 1")
def training_size(spark, sf_dir):
    n = F.max(F.col("o_custkey") % 7)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.when(n > 0, n * F.countDistinct("o_orderstatus")).otherwise(F.count("*")).alias("size"))


@query("""WITH c AS (SELECT l_orderkey AS step, sum(l_quantity) AS norm FROM lineitem GROUP BY 1),
l AS (SELECT l_orderkey AS step, list(l_quantity ORDER BY l_partkey, l_suppkey, l_extendedprice) AS logged FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT c.step, norm, logged[1] AS first_logged, norm - logged[1] AS delta, logged FROM c LEFT JOIN l ON c.step = l.step""")
def ckpt_vs_log_delta(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    checkpoints = x.groupBy(F.col("l_orderkey").alias("step")).agg(F.sum("l_quantity").alias("norm"))
    log = x.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("step"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("line"), F.col("l_quantity").alias("value"))
    return R.checkpoint_deltas(checkpoints, log)


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS DOUBLE) AS x, p_brand AS brand, NULL::VARCHAR AS name FROM part
UNION ALL SELECT n_name, n_nationkey + 0.5::DOUBLE, NULL, n_name FROM nation""")
def union_relaxed(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("x"), F.col("p_brand").alias("brand"))
    return R.relaxed_union(a, table(spark, sf_dir, "nation").select(F.col("n_name").alias("k"), (F.col("n_nationkey") + 0.5).alias("x"), F.col("n_name").alias("name")))


_IDS = "SELECT {} AS id FROM {}"


@query("SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def set_union(spark, sf_dir):
    return _ids(spark, sf_dir, "orders", "o_custkey").union(_ids(spark, sf_dir, "customer", "c_custkey")).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_difference(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))
    return _ids(spark, sf_dir, "customer", "c_custkey").subtract(large)


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, sf_dir):
    return _ids(spark, sf_dir, "customer", "c_custkey").intersect(_ids(spark, sf_dir, "orders", "o_custkey"))


def _ids(spark, sf_dir, name, column):
    return table(spark, sf_dir, name).select(F.col(column).alias("id"))


@query("SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1")
def distinct_sorted(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment")


@query("SELECT shard, n, CAST(coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index FROM (SELECT event_id // 1000 AS shard, count(*) AS n FROM events GROUP BY 1)")
def shard_offsets(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 1000").alias("shard")).agg(F.count("*").alias("n"))
    return S.shard_offsets(counts)


@query("SELECT event_id, (row_number() OVER (ORDER BY user_id, event_id) - 1) // 64 AS batch_id, (row_number() OVER (ORDER BY user_id, event_id) - 1) % 64 AS slot FROM events")
def batch_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return S.assign_batches(rows, 64, ("user_id", "event_id")).select("event_id", "batch_id", "slot")


@query("SELECT event_id FROM events WHERE event_id NOT IN (3, 17, 500, 9000)")
def exclude_bad(spark, sf_dir):
    bad = spark.createDataFrame([(3,), (17,), (500,), (9000,)], "event_id bigint")
    return table(spark, sf_dir, "events").select("event_id").join(F.broadcast(bad), "event_id", "left_anti")


@query("SELECT event_id, epoch, view FROM events, (SELECT unnest(range(2))::INT AS epoch), (SELECT unnest(range(3))::INT AS view)")
def epochs_and_views(spark, sf_dir):
    return S.views(S.epoch_rows(table(spark, sf_dir, "events").select("event_id"), 2), 3)


def _permuted_once(source: str, seed: int, epoch: int) -> str:
    """SQL of one pass of the permutation over ``source`` (id, n, a, b, place), as nested selects."""
    p = S.PRIME
    sql = f"(SELECT *, place // b AS l, place % b AS r FROM {source})"
    for k, (x, y, z) in enumerate(S._round_keys(seed, epoch)):
        side, other, m = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        sql = f"(SELECT *, ({other} + {x}) % {p} AS t FROM {sql})"
        sql = f"(SELECT * REPLACE ((t * t % {p} * {y} + {z}) % {p} AS t) FROM {sql})"
        sql = f"(SELECT * EXCLUDE (t) REPLACE (({side} + t * t % {p}) % {m} AS {side}) FROM {sql})"
    return f"SELECT id, n, a, b, l * b + r AS place FROM {sql}"


@query(f"""WITH RECURSIVE s AS (SELECT n, a, CAST((n + a - 1) // a AS BIGINT) AS b FROM (SELECT n, CAST(floor(sqrt(n - 1)) + 1 AS BIGINT) AS a FROM (SELECT count(*) AS n FROM events))),
e AS (SELECT event_id AS id, n, a, b, event_id AS place FROM events, s),
w AS ({_permuted_once('e', 7, 2)} UNION ALL {_permuted_once('(SELECT * FROM w WHERE place >= n)', 7, 2)})
SELECT id AS event_id, place // 64 AS batch_id, place % 64 AS slot FROM w WHERE place < n""")
def epoch_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return S.mini_batches(rows, "event_id", rows.count(), 64, 7, 2)


@query("SELECT vec_id, n_name FROM (SELECT vec_id, CASE WHEN label > 2 THEN label END AS label FROM embeddings) LEFT JOIN nation ON label = n_nationkey")
def label_names(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") > 2, F.col("label")).cast("bigint").alias("label"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("label"), "n_name")
    return R.with_names(rows, names, "label", "n_name").select("vec_id", "n_name")


@query("SELECT o_orderstatus AS split, count(*) AS n, count(DISTINCT o_orderpriority) AS n_classes FROM orders GROUP BY 1")
def split_sizes(spark, sf_dir):
    return shards.split_sizes(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").withColumnRenamed("o_orderstatus", "split")


@query("""SELECT s_suppkey, CASE WHEN path <> '' THEN 'local' ELSE 'org' END AS organisation, CASE WHEN path <> '' THEN s_name ELSE 'base' END AS model
FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'runs/a/' || s_name || '/' ELSE 'runs/' || s_name END AS path FROM supplier)""")
def experiment_keys(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    path = F.when(k == 0, "").when(k == 1, F.concat(F.lit("runs/a/"), "s_name", F.lit("/"))).otherwise(F.concat(F.lit("runs/"), "s_name"))
    organisation, model = R.experiment_key(path, F.lit("org"), F.lit("base"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", organisation.alias("organisation"), model.alias("model"))


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS config FROM nation""")
def config_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("gone"))
    return n.select("n_nationkey", R.as_json(n).alias("config"))
