"""The dealt operators as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import (
    exact_dedup,
    html_text,
    language_id,
    mixing,
    pii,
    piece_sampling,
    quality,
    resampling,
    secret_scan,
    simhash,
    spelling,
    topk,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _span_digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, all spans as a string."""
    spans = F.col("spans")
    kept = F.filter(spans, lambda s: s["kind"].isin(*base))

    def count(kind: str) -> Column:
        of_kind = F.filter(spans, lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("bigint").alias(f"n_{kind}")

    sha = F.sha2(_listed(kept).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, base), sha, _listed(spans).alias("spans"))


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out("doc_id")
    learned = language_id.language_dictionaries(docs.where(~held), "text", "lang", "doc_id")
    found = language_id.identify(docs, learned, "doc_id", "text")
    return found.select(
        "doc_id",
        held.alias("held_out"),
        F.col("lang_best").alias("lang_pred"),
        "score",
        "margin",
        F.col("lang_pred").isNull().alias("rejected"),
    )


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = secret_scan.labelled_strings(docs, "doc_id", "text")
    model = secret_scan.fit(samples, "value", "random")
    found = secret_scan.scan(docs, model, "doc_id", "text")
    return _span_digest(found, secret_scan.KINDS[:3])


@query
def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_sampling.encode(docs, "doc_id", "text", check=True)


def graded(labels: DataFrame) -> DataFrame:
    """Graded ratings of the label table: 0 poor, 1 good but toxic, 2 good."""
    quality_ = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.col("toxic"))
    return labels.select("doc_id", quality_.alias("grade"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, graded(table(spark, sf_dir, "labels")), "doc_id", "text", "grade")
    return quality.rate_texts(docs, model, "doc_id", "text", least=1)


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, "page_id", "html", carry=("url",))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _span_digest(pii.find_personal_data(docs, "doc_id", "text"), pii.KINDS[:4])


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target, "doc_id", "text", "text")


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = toxicity.held_out("doc_id")
    model = toxicity.fit(docs.where(~held), labels.where(~held), "doc_id", "text", "toxic")
    found = toxicity.score(docs, model, "doc_id", "text")
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
