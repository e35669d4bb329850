"""The operators' queries and the pipeline on the small tables, against SQL where it can express them."""

import pytest
from compare import same_rows
from conftest import DATA

import corpus_pipeline
from tarnwick.llm.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, duck):
    same_rows(QUERIES[name](spark, str(DATA)), duck, ORACLE_SQL[name])


def test_checksums_of_sql():
    import zlib

    import duckdb

    from tarnwick.llm.oracles import CRC32

    got = duckdb.sql(f"SELECT doc_id, {CRC32} AS c FROM (SELECT unnest([0, 7, 12, 123456789, 9999999999]) AS doc_id)").fetchall()
    assert all(c == zlib.crc32(str(i).encode()) for i, c in got)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA)).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert 0 < docs.count() <= left
        left = docs.count()
    packed = corpus_pipeline.run(spark, str(DATA)).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id")
    first = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{DATA}/documents.parquet"), str(DATA))
    lost = spark.read.parquet(f"{DATA}/documents.parquet").join(good, "doc_id", "left_semi").join(first.select("doc_id"), "doc_id", "left_anti")
    assert lost.count() <= 0.03 * good.count()


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, row int, kept int"


def test_stages_of_odd_rows(spark):
    good = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1"), "doc_id", "left_semi")
    one, two = [r["text"] for r in good.where("length(text) > 500 and lang = 'en'").orderBy("doc_id").limit(2).collect()]
    rows = [(1, None, None, None), (2, "", "a", "s"), (3, one, "en", "s"), (3, one, "en", "s"), (None, one, "en", None), (4, two * 40, None, "s"), (5, "3 4 5", "en", "s")]
    docs = spark.createDataFrame([(i, t, g, x, None, "x", 1, 2) for i, t, g, x in rows], ODD)
    labelled = docs.unionByName(good.selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "'x' AS score", "1 AS row", "2 AS kept"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() <= len(rows), name
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0, name
    found = corpus_pipeline.language_stage(spark, labelled, str(DATA))
    assert sorted(r["doc_id"] or 0 for r in found.where("doc_id is null or doc_id < 100").collect()) == [0, 3, 3, 4]
    kept = corpus_pipeline.near_dup_stage(spark, docs, str(DATA))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5]
    packed = corpus_pipeline.packing_stage(spark, docs, str(DATA)).toPandas()
    assert packed.groupby(packed.doc_id.fillna(0)).start.apply(lambda x: (x == 0).sum()).to_dict() == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1}
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), str(DATA)).count() == 0


def test_language_stage_rejects_what_is_in_no_language(spark):
    good = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(900001, "xq9Zk 7f3a9c 0Zz8Qw " * 20), (900002, "9f8e7d6c5b4a39281706 " * 9)], "doc_id bigint, text string")
    docs = good.unionByName(odd.selectExpr("doc_id", "text", "cast(null as string) AS lang", "'s' AS source", "1L AS n_chars"))
    left = corpus_pipeline.language_stage(spark, docs, str(DATA))
    assert left.where("doc_id > 900000").count() == 0 and left.count() > 0.9 * good.count()
