"""The identity-photo report: three tables, four questions, any scale."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from veritally.functions.columns import label_flag
from veritally.operators.rates import label_summary, rate_by, score_summary
from veritally.operators.replicate import replicate
from veritally.operators.scoring import Scorer, partitions_for, score
from veritally.sources.store import ScoreStore
from veritally.sources.tables import read_csv


@dataclass(frozen=True)
class IdentityTables:
    """images(name, pred), labels(id, isfraud), attributes(id, ...).

    `images` is scored already; scaling replicates scored rows, so a model call is never
    repeated for a copy.
    """

    images: DataFrame
    labels: DataFrame
    attributes: DataFrame

    @classmethod
    def from_csv(
        cls,
        spark: SparkSession,
        image_path: str,
        label_path: str,
        attribute_path: str,
        scorer: str | Scorer,
        *,
        store: ScoreStore | None = None,
        **options,
    ) -> IdentityTables:
        """Read the three CSV files and add the score column (base64 images in `imageData`).

        With a store the scores are computed once, new images apart, and every query reads
        them as an ordinary column; without one, every query that needs them scores again.
        """
        images = read_csv(spark, image_path).select("name", "imageData")
        labels = read_csv(spark, label_path).withColumn("isfraud", label_flag("isfraud"))
        options.setdefault("partitions", partitions_for(images))
        if store is None:
            scored = score(images, "imageData", scorer, **options)
        else:
            scored = store.append_new(images, "name", "imageData", scorer, **options)
        return cls(scored, labels, read_csv(spark, attribute_path))

    def scaled(self, factor: int) -> IdentityTables:
        """Every table `factor` times; the joins ignore the copy number."""
        return replace(
            self,
            images=replicate(self.images, factor),
            labels=replicate(self.labels, factor),
            attributes=replicate(self.attributes, factor),
        )

    def fraud_predicted(self) -> DataFrame:
        return score_summary(
            self.images, total="total_ids", positive="fraud_predicted", rate="fraud_rate_percentage"
        )

    def fraud_ground_truth(self) -> DataFrame:
        return label_summary(
            self.labels,
            "isfraud",
            total="total_ids",
            positive="total_fraud",
            negative="total_nonfraud",
            rate="fraud_percentage",
        )

    def fraud_pattern_ethnicity_wise(self, top: int | None = 10) -> DataFrame:
        return self._rate_by("ethnicity", "total_customers", top)

    def fraud_rate_by_veteran_status(self, top: int | None = 10) -> DataFrame:
        return self._rate_by("is_veteran", "total_individuals", top)

    def _rate_by(self, by: str, total: str, top: int | None) -> DataFrame:
        return rate_by(
            self.images,
            self.labels,
            self.attributes,
            by,
            on="id",
            scored_on="name",
            total=total,
            positive="predicted_fraud",
            rate="fraud_rate_pct",
            top=top,
        )

    def questions(self) -> dict[str, DataFrame]:
        """All four, by name."""
        asked = (
            self.fraud_predicted,
            self.fraud_ground_truth,
            self.fraud_pattern_ethnicity_wise,
            self.fraud_rate_by_veteran_status,
        )
        return {question.__name__: question() for question in asked}

    def views(self, suffix: str = "") -> None:
        """Name the tables in the session: idimage, idlabel and idmeta plus the suffix."""
        for name, df in (("idimage", self.images), ("idlabel", self.labels), ("idmeta", self.attributes)):
            df.createOrReplaceTempView(name + suffix)
