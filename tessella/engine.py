"""One object over the tables of a deployment: ingest, search, report, change tracking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import quality
from tessella.lexicons import ZH_FINANCE, Lexicon
from tessella.operators import fulltext, vectors
from tessella.plans import ingest, report, search
from tessella.schemas import PROCESSED, ddl
from tessella.sources.store import Table
from tessella.streaming.incremental import ChangeDetector, SyncManager


class Engine:
    def __init__(self, spark: SparkSession, path: str, lexicon: Lexicon = ZH_FINANCE):
        self.spark, self.lexicon = spark, lexicon
        self.documents = Table(spark, f"{path}/documents", PROCESSED, "id")
        self.vectors = Table(spark, f"{path}/vectors", _vector_schema(), "id")
        self.changes = ChangeDetector(spark, f"{path}/changes")
        self.sync = SyncManager(spark)

    def process(self, docs: DataFrame, **options) -> ingest.Result:
        return ingest.process(docs, ingest.Options(lexicon=self.lexicon, **options))

    def ingest(self, docs: DataFrame, **options) -> dict[str, int]:
        result = self.process(docs, **options)
        result.marked.persist()  # documents, vectors and counts come from it; near duplicates are found once
        try:
            return self._store(result)
        finally:
            result.marked.unpersist()

    def _store(self, result: ingest.Result) -> dict[str, int]:
        self.documents.upsert(result.final)
        embedded = result.final.select(F.col("id"), vectors.hashed_embedding(F.concat_ws(" ", "title", "content")).cast("array<float>").alias("embedding"), "title", "content", "category", "source", "publish_time", "importance_score")
        self.vectors.upsert(embedded)
        return result.counts()

    def search(self, spec: search.SearchSpec, now: datetime) -> DataFrame:
        if spec.mode == "keyword":
            return search.search(self.documents.read(), spec, now, lexicon=self.lexicon)
        return search.search(self._with_vectors(), spec, now, query_vector=self._vector(spec.query), lexicon=self.lexicon)

    def _vector(self, text: str) -> list[float]:
        return list(self.spark.range(1).select(vectors.hashed_embedding(F.lit(text)).alias("v")).first()[0])

    def _with_vectors(self) -> DataFrame:
        return self.documents.read().join(self.vectors.read().select("id", "embedding"), "id")

    def suggest(self, prefix: str, size: int = 5) -> DataFrame:
        return search.suggestions(self.documents.read(), prefix, size)

    def similar(self, doc_id: str, k: int = 10, threshold: float = 0.7) -> DataFrame:
        return vectors.similar_to(self.vectors.read(), "id", "embedding", doc_id, k, threshold)

    def more_like(self, doc_id: str, k: int = 10) -> DataFrame:
        return fulltext.more_like_this(self.documents.read(), "id", doc_id, F.concat_ws(" ", "title", "content"), self.lexicon, k)

    def report(self, spec: report.ReportSpec, now: datetime) -> report.Report:
        return report.generate(self._with_vectors(), spec, now, lexicon=self.lexicon, query_vector=self._vector(" ".join([spec.topic, *spec.keywords])))

    def detect_changes(self, docs: DataFrame, now: Column, full: bool = True) -> DataFrame:
        return self.changes.detect(docs, now, full)

    def statistics(self) -> dict:
        return {"documents": self.documents.stats(), "vectors": self.vectors.stats(), "quality": {r["quality_label"]: r["n"] for r in quality.label_distribution(self.documents.read()).collect()}, "sync": self.sync.status()}


def _vector_schema():
    return ddl("id string, embedding array<float>, title string, content string, category string, source string, publish_time timestamp, importance_score double")
