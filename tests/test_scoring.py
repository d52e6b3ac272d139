import numpy as np
import pyarrow as pa
import pytest
from frames import plan, rows
from pyspark.sql import functions as F

from veritally import get_scorer, rate_by, register_scorer, register_sql, replicate, score, score_summary
from veritally.functions.columns import label_flag, payload_bytes
from veritally.operators.scoring import ModelScorer, SqlScorer, linear_file_scorer, partitions_for


def length_scorer(counter=None, threshold=2.0, rows_per_pass=2, name="length", load=lambda: 1.0):
    """Score of a text: its length; the text 'bad' has none."""

    def decode(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return np.array([[len(text)] for text in texts], dtype=float)

    def forward(model, lengths):
        if counter is not None:
            counter.add(len(lengths))
        return lengths[:, 0] * model

    return ModelScorer(
        name, "1", load=load, decode=decode, forward=forward, threshold=threshold, rows_per_pass=rows_per_pass
    )


@pytest.fixture
def payloads(spark):
    data = [("a", "xx"), ("b", "yyyy"), ("c", None), ("d", "bad"), ("e", "")]
    return spark.createDataFrame(data, "name string, payload string")


def test_a_row_without_score_is_false_with_a_reason(payloads):
    result = score(payloads, "payload", length_scorer())
    assert result.columns == ["name", "score", "pred", "score_error"]
    assert sorted(rows(result)) == [
        ("a", 2.0, False, None),
        ("b", 4.0, True, None),
        ("c", None, False, "no payload"),
        ("d", None, False, "ValueError: bad text"),
        ("e", 0.0, False, None),
    ]


def test_the_threshold_is_strict_and_can_be_set(payloads):
    flags = {n: p for n, _, p, _ in rows(score(payloads, "payload", length_scorer(), threshold=1.9))}
    assert flags == {"a": True, "b": True, "c": False, "d": False, "e": False}


def test_a_failing_pass_only_loses_the_rows_at_fault(payloads):
    def forward(model, lengths):
        if (lengths == 4).any():
            raise RuntimeError("four")
        return lengths[:, 0]

    base = length_scorer()
    scorer = ModelScorer("picky", "1", load=base.load, decode=base.decode, forward=forward, rows_per_pass=100)
    result = {n: (s, e) for n, s, _, e in rows(score(payloads.coalesce(1), "payload", scorer))}
    assert result["a"] == (2.0, None) and result["e"] == (0.0, None)
    assert result["b"] == (None, "RuntimeError: four")


def test_a_score_that_is_no_number_is_an_error(payloads):
    base = length_scorer()
    scorer = ModelScorer(
        "nan", "1", load=base.load, decode=base.decode, forward=lambda m, x: np.where(x[:, 0] > 3, np.nan, x[:, 0])
    )
    result = {n: (s, e) for n, s, _, e in rows(score(payloads, "payload", scorer))}
    assert result["b"] == (None, "no finite score")


def test_a_missing_model_fails_on_the_driver_unless_told_otherwise(payloads):
    def load():
        raise FileNotFoundError("weights")

    scorer = length_scorer(load=load, name="absent")
    with pytest.raises(FileNotFoundError):
        score(payloads, "payload", scorer)
    result = score(payloads, "payload", scorer, on_missing_model="false")
    assert {(s, p, e) for _, s, p, e in rows(result)} == {(None, False, "no model")}
    with pytest.raises(ValueError):
        score(payloads, "payload", scorer, on_missing_model="perhaps")


def test_every_payload_row_is_scored_once_whatever_the_joins_multiply(spark):
    img = spark.createDataFrame([("a", "xx"), ("b", "yyyy"), ("c", "z")], "id string, payload string")
    side = img.select("id", F.lit("g").alias("g"))
    counter = spark.sparkContext.accumulator(0)
    scored = score(img, "payload", length_scorer(counter))
    result = rate_by(replicate(scored, 3), replicate(side, 3), replicate(side, 3), "g")
    assert rows(result) == [("g", 81, 27, pytest.approx(100 / 3))]
    assert counter.value == 3


def test_rows_without_a_needed_key_are_not_scored(spark, payloads):
    keys = spark.createDataFrame([("b",), ("b",), ("z",), (None,)], "name string")
    counter = spark.sparkContext.accumulator(0)
    result = score(payloads, "payload", length_scorer(counter), only_keys=keys)
    assert rows(result) == [("b", 4.0, True, None)]
    assert counter.value == 1


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_the_keys_decide_whatever_the_broadcast_limit(spark, payloads, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    keys = spark.createDataFrame([("b",)], "name string")
    result = rows(score(payloads, "payload", length_scorer(), only_keys=keys))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert result == [("b", 4.0, True, None)]


def test_the_model_is_called_on_batches_and_once_per_query(spark, payloads):
    counter = spark.sparkContext.accumulator(0)
    summary = score_summary(score(payloads.coalesce(1), "payload", length_scorer(counter)))
    assert plan(summary).count("ArrowEvalPython") == 1
    assert rows(summary) == [(5, 1, 20.0)]
    assert counter.value == 3


def test_a_model_is_loaded_once_per_name_and_version(spark, payloads):
    loads = []

    def load():
        loads.append(1)
        return 10.0

    for _ in range(3):
        result = score(payloads.repartition(8), "payload", length_scorer(name="loaded_once", load=lambda: load()))
        assert {n: s for n, s, _, _ in rows(result)}["b"] == 40.0
    assert len(loads) == 1


def test_weights_come_from_a_table(spark, tmp_path):
    path = str(tmp_path / "weights")
    spark.range(64).select(F.col("id").alias("position"), F.lit(0.5).alias("weight")).write.parquet(path)
    df = spark.createDataFrame([(0, [2.0] * 64), (1, [1.0])], "id int, v array<float>")
    result = {i: (s, e) for i, s, _, e in rows(score(df, "v", linear_file_scorer(spark, path, version=path)))}
    assert result[0] == (64.0, None) and result[1][1].startswith("ValueError")
    spark.range(3).select(F.col("id").alias("position"), F.lit(0.5).alias("weight")).write.parquet(path + "2")
    with pytest.raises(ValueError):
        score(df, "v", linear_file_scorer(spark, path + "2", version=path + "2"))


def test_a_sql_score_that_is_not_finite_is_an_error(spark):
    odd = SqlScorer("odd", "1", "CASE {x} WHEN 'a' THEN double('NaN') WHEN 'b' THEN double('Infinity') ELSE 1D END", "STRING")
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "p string")
    result = {p: (s, f, e) for p, s, f, e in rows(score(df.withColumn("k", F.col("p")), "p", odd))}
    assert result["a"] == result["b"] == (None, False, "no finite score")
    assert result["c"] == (1.0, True, None)
    register_sql(spark, "odd_flag", odd)
    assert {r[0]: r[1] for r in rows(spark.sql("SELECT p, odd_flag(p) FROM {t}", t=df))}["a"] is False


def test_a_kept_column_must_not_clash(payloads):
    with pytest.raises(ValueError, match="score"):
        score(payloads.withColumn("score", F.lit(1)), "payload", "lines")


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", F.repeat(F.lit("x"), (F.col("id") % 17).cast("int")).alias("payload"))
    results = [
        sorted(rows(score(df.repartition(n), "payload", length_scorer(rows_per_pass=7)))) for n in (1, 3, 16)
    ]
    assert results[0] == results[1] == results[2]


def test_spreading_keeps_all_rows(spark, tmp_path):
    spark.range(100).select("id", F.lit("abc").alias("payload")).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    spread = score(df, "payload", length_scorer(), partitions=partitions_for(df))
    assert "RoundRobinPartitioning" in plan(spread)
    assert spread.where("pred").count() == 100
    assert partitions_for(spark.range(0, 100, 1, 64)) is None


def test_registry(payloads):
    scorer = register_scorer(SqlScorer("shout", "1", "CAST(length({x}) - length(lower({x})) AS DOUBLE)", "STRING"))
    assert get_scorer("shout") is scorer and get_scorer(scorer) is scorer
    assert score(payloads, "payload", "shout").where("pred").count() == 0
    with pytest.raises(KeyError):
        get_scorer("nobody")


def test_lines_scorer_stays_in_the_jvm(spark):
    text = ["", "a\n", "x" * 120 + "\n", "x" * 118 + "\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "id int, text string")
    result = score(df, "text", "lines")
    assert "Python" not in plan(result)
    assert rows(result.orderBy("id")) == [
        (0, 0.0, False, None),
        (1, 118.0, True, None),
        (2, -1.0, False, None),
        (3, 1.0, True, None),
        (4, None, False, "no payload"),
    ]


def test_linear_scorer_reports_vectors_of_the_wrong_length(spark):
    data = [(0, [1.0] * 64), (1, [1.0] * 3), (2, None), (3, [1.0] * 63 + [None])]
    df = spark.createDataFrame(data, "id int, v array<float>")
    result = {i: (s, e) for i, s, _, e in rows(score(df, "v", "linear"))}
    assert result[0] == (float(sum((j * 7) % 11 - 5 for j in range(64))), None)
    assert result[1][0] is None and result[1][1].startswith("ValueError")
    assert result[2] == (None, "no payload")
    assert result[3] == (None, "no finite score")


@pytest.mark.parametrize("scorer", ["lines", length_scorer(threshold=0.0)], ids=["sql", "model"])
def test_registered_functions_agree_with_the_operator(spark, scorer):
    texts = spark.createDataFrame([("a\n",), ("x" * 500,), (None,), ("",)], "payload string")
    register_sql(spark, "flag_it", scorer)
    by_sql = spark.sql("SELECT payload, flag_it(payload) AS pred FROM {t}", t=texts)
    by_operator = score(texts, "payload", scorer, keep=["payload"]).select("payload", "pred")
    assert sorted(map(str, rows(by_sql))) == sorted(map(str, rows(by_operator)))


def test_a_registered_function_named_twice_is_called_once(spark, payloads):
    counter = spark.sparkContext.accumulator(0)
    register_sql(spark, "flag_once", length_scorer(counter), threshold=1)
    summary = spark.sql(
        "SELECT sum(if(flag_once(payload), 1, 0)) a, 100.0 * sum(if(flag_once(payload), 1, 0)) b FROM {t}",
        t=payloads,
    )
    assert summary.first()["a"] == 2
    assert counter.value == 3


def test_label_text(spark):
    texts = ["True", "1", "yes", "t", " true ", "False", "no", "0", "maybe", "1.0", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "label string")
    assert [r[0] for r in rows(df.select(label_flag("label")))] == [True] * 5 + [False] * 3 + [None] * 4


def test_base64_payloads(spark):
    texts = ["eHg=", "%%%", "abc", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    decoded = [None if r[0] is None else bytes(r[0]) for r in rows(df.select(payload_bytes("p")))]
    assert decoded == [b"xx", None, b"\x69\xb7", None, None]


def test_one_base64_rule_in_plans_and_in_sql(spark):
    texts = ["eHg=", " eHg=\n", "\u00a0eHg=", "eHg\u00a0=", "eH g=", "%%%", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "p string")

    def decode(values):
        return np.array([[len(v)] for v in values], dtype=float)

    of_bytes = ModelScorer("of_bytes", "1", load=lambda: 0, decode=decode, forward=lambda m, x: x[:, 0], base64_text=True)
    register_sql(spark, "of_payload", of_bytes)
    by_sql = {r[0]: r[1] for r in rows(spark.sql("SELECT p, of_payload(p) FROM {t}", t=df))}
    by_operator = {r[0]: r[2] for r in rows(score(df.withColumn("k", F.col("p")), "p", of_bytes))}
    assert by_sql == by_operator
    assert by_sql["eHg="] and by_sql[" eHg=\n"] and not by_sql["\u00a0eHg="] and not by_sql["%%%"]


def test_arrow_payloads_reach_the_model_without_python_rows(spark):
    """`decode` gets Arrow slices; rows that fail are found by halves all the same."""

    def decode(lists):
        assert isinstance(lists, pa.ListArray)
        if (lists.value_lengths().to_numpy() != 2).any():
            raise ValueError("not two")
        return lists.flatten().to_numpy().reshape(-1, 2)

    scorer = ModelScorer("pairs", "1", load=lambda: 0, decode=decode, forward=lambda m, x: x.sum(axis=1), rows_per_pass=3, arrow=True)
    data = [(i, [float(i), 1.0] if i % 4 else [1.0], ) for i in range(20)] + [(99, None)]
    df = spark.createDataFrame(data, "id int, payload array<double>").coalesce(1)
    found = {i: (s, e) for i, s, _, e in rows(score(df, "payload", scorer))}
    assert found == {99: (None, "no payload")} | {i: (i + 1.0, None) if i % 4 else (None, "ValueError: not two") for i in range(20)}


def test_elements_that_are_missing_are_no_number(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [None] + [1.0] * 63), (3, [1.0] * 65)], "id int, v array<float>").coalesce(1)
    found = {i: e for i, _, _, e in rows(score(df, "v", "linear"))}
    assert found == {1: None, 2: "no finite score", 3: "ValueError: expected 64 values, found shape (65,)"}
