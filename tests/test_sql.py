from frames import plan, rows
from pyspark.sql import functions as F

from veritally import label_summary, rate_by, register_sql, register_views, replicate, score_summary
from veritally.plans import sql


def test_texts_agree_with_the_operators(spark, tables):
    scored, labels, attributes = tables
    assert rows(sql.run(spark, sql.SCORE_SUMMARY, scored=scored)) == rows(score_summary(scored))
    flags = labels.withColumnRenamed("isfraud", "flag")
    assert rows(sql.run(spark, sql.LABEL_SUMMARY, labels=flags)) == rows(label_summary(labels, "isfraud"))
    for n in (1, 3):
        holes = {
            "scored": replicate(scored.withColumnRenamed("name", "id"), n),
            "labels": replicate(labels, n),
            "attributes": replicate(attributes.withColumn("grp", F.col("ethnicity")), n),
        }
        by_sql = sql.run(spark, sql.RATE_BY, top=10, **holes)
        by_operator = rate_by(holes["scored"], holes["labels"], holes["attributes"], "ethnicity")
        assert rows(by_sql) == rows(by_operator)
        assert by_sql.columns == ["grp", "total", "predicted", "rate_pct"]


def test_texts_over_empty_tables(spark, tables):
    assert rows(sql.run(spark, sql.SCORE_SUMMARY, scored=tables[0].limit(0))) == [(0, None, None)]


def test_scoring_in_sql_stays_below_the_joins(spark, tables, no_broadcast):
    register_sql(spark, "vector_flag", "linear")
    vectors = spark.range(4).select("id", F.array_repeat(F.col("id").cast("float"), 64).alias("v"))
    scored = sql.scored_in_sql(vectors, "id", "v", "vector_flag")
    side = vectors.select("id", F.lit("g").alias("grp"))
    result = sql.run(spark, sql.RATE_BY, scored=scored, labels=side, attributes=side, top=10)
    text = plan(result)
    assert text.count("ArrowEvalPython") == 1
    assert text.index("ArrowEvalPython") > text.index("Join")
    assert rows(result)[0][1] == 4


def test_user_written_sql_over_views(spark, tables):
    scored, labels, attributes = tables
    register_views({"people": attributes, "marks": labels, "photos": scored})
    result = spark.sql(
        "SELECT p.is_veteran, count(*) AS n FROM photos f JOIN marks m ON f.name = m.id "
        "JOIN people p ON m.id = p.id GROUP BY p.is_veteran ORDER BY n DESC"
    )
    assert rows(result) == [("no", 2), ("yes", 1)]
