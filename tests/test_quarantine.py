import numpy as np
import pytest
from frames import rows

from veritally import score
from veritally.operators.quarantine import quarantine
from veritally.operators.scoring import ModelScorer


def length_scorer(counter):
    def decode(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return np.array([[float(len(t))] for t in texts])

    def forward(model, lengths):
        counter.add(len(lengths))
        return lengths[:, 0]

    return ModelScorer("length_set_apart", "1", load=lambda: 0, decode=decode, forward=forward, threshold=2.0)


@pytest.fixture
def payloads(spark):
    return spark.createDataFrame([("a", "xx"), ("b", "yyyy"), ("c", None), ("d", "bad"), ("e", "")], "name string, payload string")


def test_rows_are_counted_and_set_apart_in_one_pass(spark, payloads, tmp_path):
    counter = spark.sparkContext.accumulator(0)
    apart = quarantine(score(payloads, "payload", length_scorer(counter)), str(tmp_path / "q"))
    assert (apart.n_rows, apart.n_failed, apart.n_positive) == (5, 2, 1)
    assert sorted(rows(apart.scored)) == [("a", 2.0, False, None), ("b", 4.0, True, None), ("e", 0.0, False, None)]
    assert sorted(rows(apart.failed)) == [("c", None, False, "no payload"), ("d", None, False, "ValueError: bad text")]
    assert apart.scored.count() + apart.failed.count() == 5
    assert counter.value == 3  # each sound payload once, whatever is read afterwards


@pytest.mark.parametrize("condition, sides", [("payload IS NULL", (0, 1)), ("payload = 'xx'", (1, 0)), ("false", (0, 0))])
def test_a_side_without_rows_is_an_empty_table(payloads, tmp_path, condition, sides):
    apart = quarantine(score(payloads.where(condition), "payload", "lines"), str(tmp_path / "q"))
    assert (apart.scored.count(), apart.failed.count()) == sides
    assert (apart.n_rows, apart.n_failed) == (sum(sides), sides[1])
    assert apart.failed.columns == ["name", "score", "pred", "score_error"]


def test_a_column_of_that_name_is_refused(spark, tmp_path):
    odd = spark.createDataFrame([(1, "x")], "failed int, payload string")
    with pytest.raises(ValueError, match="exists"):
        quarantine(score(odd, "payload", "lines"), str(tmp_path / "q"))
