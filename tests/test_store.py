from types import SimpleNamespace

import numpy as np
import pytest
from frames import plan, rows

from veritally import ScoreStore, rate_by, score, score_summary
from veritally.operators.scoring import ModelScorer
from veritally.session import shared_folder


def counting_scorer(counter, version="1"):
    def forward(model, lengths):
        counter.add(len(lengths))
        return lengths[:, 0]

    return ModelScorer(
        "counting", version, load=lambda: 0, decode=lambda ts: np.array([[float(len(t))] for t in ts]), forward=forward, threshold=2.0
    )


@pytest.fixture
def store(spark, tmp_path):
    return ScoreStore(spark, str(tmp_path / "scores"))


@pytest.fixture
def payloads(spark):
    return spark.createDataFrame([("a", "xx"), ("b", "yyyy"), ("b", "y"), (None, "zzz")], "id string, t string")


def test_stored_scores_answer_without_the_model(spark, store, payloads):
    counter = spark.sparkContext.accumulator(0)
    scorer = counting_scorer(counter)
    assert not store.exists(scorer)
    stored = store.write(payloads, "id", "t", scorer)
    assert store.exists(scorer) and counter.value == 4
    assert stored.columns == ["id", "score", "pred", "score_error"]
    assert rows(score_summary(stored)) == [(4, 2, 50.0)]
    assert rows(rate_by(stored, payloads, payloads, "id")) == [("b", 8, 4, 50.0), ("a", 1, 0, 0.0)]
    assert counter.value == 4
    assert "Python" not in plan(score_summary(stored))
    assert sorted(map(str, rows(stored))) == sorted(map(str, rows(score(payloads, "t", scorer))))


def test_only_new_keys_are_scored(spark, store, payloads):
    counter = spark.sparkContext.accumulator(0)
    scorer = counting_scorer(counter)
    store.append_new(payloads, "id", "t", scorer)
    assert counter.value == 4
    more = payloads.union(spark.createDataFrame([("c", "1"), ("d", "22222"), ("d", "2")], payloads.schema))
    stored = store.append_new(more, "id", "t", scorer)
    assert counter.value == 7
    assert sorted(map(str, rows(stored))) == sorted(map(str, rows(score(more, "t", scorer))))
    before = counter.value
    assert store.append_new(more, "id", "t", scorer).count() == 7
    assert counter.value == before


def test_new_keys_beyond_the_broadcast_limit(spark, store, payloads, no_broadcast):
    scorer = counting_scorer(spark.sparkContext.accumulator(0))
    store.append_new(payloads.where("id = 'a'"), "id", "t", scorer)
    stored = store.append_new(payloads, "id", "t", scorer)
    assert sorted(map(str, rows(stored))) == sorted(map(str, rows(score(payloads, "t", scorer))))


def test_another_table_gets_its_own_rows(spark, store):
    table = lambda *ids: spark.createDataFrame([(i, i * 3) for i in ids], "id string, t string")
    store.append_new(table("a", "b"), "id", "t", "lines")
    assert [r["id"] for r in store.append_new(table("c"), "id", "t", "lines").collect()] == ["c"]
    assert store.read("lines").count() == 3


def test_changed_payloads_are_scored_again(spark, store, payloads):
    counter = spark.sparkContext.accumulator(0)
    scorer = counting_scorer(counter)
    store.append_new(payloads, "id", "t", scorer)
    late = spark.createDataFrame([("a", "longer"), ("b", "yyyy"), ("b", "y"), ("b", "new"), (None, "zzz")], payloads.schema)
    stored = store.append_new(late, "id", "t", scorer)
    assert sorted(map(str, rows(stored))) == sorted(map(str, rows(score(late, "t", scorer))))
    assert counter.value == 4 + 4 + 5 and store.read(scorer).count() == 5


def test_write_replaces_and_takes_no_key_filter(spark, store, payloads):
    store.write(payloads, "id", "t", "lines")
    with pytest.raises(ValueError, match="every row"):
        store.write(payloads, "id", "t", "lines", only_keys=payloads.select("id").limit(0))
    assert store.write(payloads.limit(1), "id", "t", "lines").count() == 1


@pytest.mark.parametrize("version", ["2024-05-01 10:00", "a/b", "v=1", "50%", "ä"])
def test_any_version_name(spark, store, payloads, version):
    scorer = counting_scorer(spark.sparkContext.accumulator(0), version)
    store.write(payloads, "id", "t", scorer)
    assert store.exists(scorer) and store.read(scorer).count() == 4
    store.drop()
    assert not store.exists(scorer)


def test_versions_are_kept_apart_and_rewritten_alone(spark, store, payloads):
    counter = spark.sparkContext.accumulator(0)
    store.write(payloads, "id", "t", counting_scorer(counter, "1"))
    store.write(payloads.where("id = 'a'"), "id", "t", counting_scorer(counter, "2"))
    store.write(payloads, "id", "t", "lines")
    store.write(payloads.where("id = 'a'"), "id", "t", "lines")
    assert store.read(counting_scorer(counter, "1")).count() == 4
    assert store.read(counting_scorer(counter, "2")).count() == 1
    assert store.read("lines").count() == 1


def test_a_failed_rewrite_keeps_the_old_scores(spark, store, payloads):
    counter = spark.sparkContext.accumulator(0)
    store.write(payloads, "id", "t", counting_scorer(counter))

    def exhausted(model, lengths):
        raise MemoryError("too much")

    sound = counting_scorer(counter)
    broken = ModelScorer("counting", "1", load=sound.load, decode=sound.decode, forward=exhausted)
    with pytest.raises(Exception, match="too much"):
        store.write(payloads.limit(1), "id", "t", broken)
    assert store.read(sound).count() == 4


def test_an_empty_table(store, payloads):
    store.write(payloads, "id", "t", "lines")
    assert store.write(payloads.limit(0), "id", "t", "lines").count() == 0
    assert store.append_new(payloads, "id", "t", "lines").count() == 4


def test_the_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_without_a_named_folder_a_cluster_is_refused(tmp_path):
    def session(master):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}")
        return SimpleNamespace(conf={}, sparkContext=context)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))
    local = session("local[2]")
    assert shared_folder(local) == shared_folder(local)
