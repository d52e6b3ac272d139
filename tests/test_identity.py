import base64

import numpy as np
import pytest
from frames import plan, rows

from veritally import IdentityTables, ScoreStore, score
from veritally.operators.scoring import ModelScorer
from veritally.sources.tables import read_csv


def photo_scorer():
    """Brightness of a photo."""

    def decode(photos):
        if any(not p.startswith(b"P6") for p in photos):
            raise ValueError("no photo")
        return np.array([[np.frombuffer(p, np.uint8)[13:].mean()] for p in photos])

    return ModelScorer("photo", "1", load=lambda: 0, decode=decode, forward=lambda m, x: x[:, 0], threshold=127.0, base64_text=True)


@pytest.fixture
def files(tmp_path):
    """Ten people; one photo cannot be read, one person has no label, one no attributes."""
    rng = np.random.default_rng(5)
    photos = ["name,imageData"]
    for i in range(10):
        pixels = np.full((20, 20, 3), rng.integers(0, 256, 3), np.uint8).tobytes()
        payload = base64.b64encode(b"P6\n20 20\n255\n" + pixels).decode() if i != 3 else "broken"
        photos.append(f"{i:03},{payload}")
    labels = ["id,isfraud"] + [f"{i:03},{('True', 'False', '', 'maybe')[i % 4]}" for i in range(9)]
    people = ["id,ethnicity,is_veteran"] + [f"{i:03},{'ABC'[i % 3]},{('yes', 'no')[i % 2]}" for i in range(1, 10)]
    paths = []
    for name, lines in (("image", photos), ("label", labels), ("meta", people)):
        paths.append(str(tmp_path / f"{name}.csv"))
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return paths


@pytest.fixture
def predictions(spark, files):
    scored = score(read_csv(spark, files[0]), "imageData", photo_scorer())
    return {name: pred for name, _, pred, _ in rows(scored)}


def expected_groups(predictions, key):
    groups = {}
    for i in range(1, 9):  # photo, label and attributes present
        total, hits = groups.get(key(i), (0, 0))
        groups[key(i)] = (total + 1, hits + predictions[f"{i:03}"])
    rated = [(g, total, hits, 100.0 * hits / total) for g, (total, hits) in groups.items()]
    return sorted(rated, key=lambda row: (-row[3], row[0]))


def test_the_four_questions(spark, files, predictions):
    report = IdentityTables.from_csv(spark, *files, photo_scorer())
    hits = sum(predictions.values())
    assert 0 < hits < 10 and predictions["003"] is False
    assert rows(report.fraud_predicted()) == [(10, hits, 10.0 * hits)]
    assert rows(report.fraud_ground_truth()) == [(9, 3, 2, pytest.approx(100 / 3))]
    assert rows(report.fraud_pattern_ethnicity_wise()) == expected_groups(predictions, lambda i: "ABC"[i % 3])
    assert rows(report.fraud_rate_by_veteran_status()) == expected_groups(predictions, lambda i: ("yes", "no")[i % 2])


def test_column_names(spark, files):
    report = IdentityTables.from_csv(spark, *files, photo_scorer())
    assert report.fraud_predicted().columns == ["total_ids", "fraud_predicted", "fraud_rate_percentage"]
    assert report.fraud_ground_truth().columns == ["total_ids", "total_fraud", "total_nonfraud", "fraud_percentage"]
    assert report.fraud_pattern_ethnicity_wise().columns == [
        "ethnicity", "total_customers", "predicted_fraud", "fraud_rate_pct",
    ]
    assert report.fraud_rate_by_veteran_status().columns == [
        "is_veteran", "total_individuals", "predicted_fraud", "fraud_rate_pct",
    ]


def test_scaling(spark, files):
    report = IdentityTables.from_csv(spark, *files, photo_scorer())
    scaled = report.scaled(3)
    assert rows(scaled.fraud_predicted())[0][0] == 30
    assert rows(scaled.fraud_ground_truth())[0][:3] == (27, 9, 6)
    base, large = (rows(r.fraud_pattern_ethnicity_wise()) for r in (report, scaled))
    assert large == [(g, 27 * n, 27 * hits, rate) for g, n, hits, rate in base]


def test_stored_scores_serve_every_question(spark, files, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "scores"))
    direct = IdentityTables.from_csv(spark, *files, photo_scorer())
    stored = IdentityTables.from_csv(spark, *files, photo_scorer(), store=store)
    for question in ("fraud_predicted", "fraud_pattern_ethnicity_wise", "fraud_rate_by_veteran_status"):
        result = getattr(stored, question)()
        assert "Python" not in plan(result) and "imageData" not in plan(result)
        assert rows(result) == rows(getattr(direct, question)())


def test_all_questions_at_several_scales(spark, files, tmp_path):
    """Counts grow with the factor, or its cube where three tables meet; rates stay."""
    store = ScoreStore(spark, str(tmp_path / "scores"))
    report = IdentityTables.from_csv(spark, *files, photo_scorer(), store=store)
    base = {name: rows(df) for name, df in report.questions().items()}
    for factor in (1, 5):
        for name, df in report.scaled(factor).questions().items():
            first = 1 if name.startswith(("fraud_pattern", "fraud_rate")) else 0
            times = factor**3 if first else factor
            assert rows(df) == [
                (*row[:first], *(count * times for count in row[first:-1]), row[-1]) for row in base[name]
            ]


def test_views(spark, files):
    IdentityTables.from_csv(spark, *files, photo_scorer()).scaled(2).views("_2x")
    assert spark.sql("SELECT count(*) FROM idlabel_2x WHERE dup_batch = 1").first()[0] == 9
