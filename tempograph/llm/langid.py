"""Language identification by Bayesian evidence fusion.

    P(language | page)  ~  P(text | language)^TEMPER * P(declared | language) * P(suffix | language) * P(language | host)

Text: a naive Bayes model over hashed byte trigrams (BUCKETS of them, add-one smoothing), counted over all labelled
documents; TEMPER discounts trigrams that overlap.  The model has LANGUAGES * BUCKETS numbers, whatever the data.
Declared markup language (the lang attribute of <html>) and address suffix (the last label of the host): their likelihoods
are counted over all other pages, each page weighing by its posterior from the text alone.
Host prior: the same soft counts of the host's other pages, smoothed towards its domain's (last two labels), these towards
those of all pages:  p_host = (n_host + STRENGTH * p_domain) / (N_host + STRENGTH), without the page itself.

Counts are integers (millionths of a page), so results don't depend on the order of tasks.  All are grouped aggregations
with partial sums, joined back by key; a host with a third of all pages is one row of counts, and adaptive execution splits
its side of the join.

Nulls: a page without markup language, address or text simply lacks that evidence (a page without any gets the overall
prior); documents without a language of LANGUAGES are not used for training; null ids stay null; repeated rows are pages each.
Very long pages are scored in pieces.  Empty tables give empty results; ties go to the earlier of LANGUAGES; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable
from .common import stored, table
from .textbytes import LOWER, column_bytes, parts, tidy

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS, TEMPER, STRENGTH, SMOOTH, UNIT = 1 << 16, 0.25, 5.0, 0.5, 1_000_000


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams (white space as one blank, digits as 0), and the offsets of the rows' bytes."""
    data, offsets = column_bytes(texts)
    data = LOWER[data]
    data = np.where(data < 0x21, 0x20, np.where((data >= 0x30) & (data <= 0x39), 0x30, data)).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    key = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), offsets


def inside(offsets: np.ndarray, row: int, n: int) -> slice:
    """A row's trigrams."""
    return slice(int(offsets[row]), max(int(offsets[row]), min(n, int(offsets[row + 1]) - 2)))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", languages=LANGUAGES) -> np.ndarray:
    """log P(bucket | language), languages down and buckets across."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(languages), BUCKETS), np.int64)
        for whole in batches:
            for batch in parts(whole, text_col):
                keys, offsets = trigrams(batch.column(text_col))
                row = np.searchsorted(offsets, np.arange(len(keys)), "right") - 1  # trigrams over a row's end are no row's
                own = np.array([languages.index(lang) for lang in batch.column(lang_col).to_pylist()], np.int64)
                whole_ = np.arange(len(keys)) + 2 < offsets[row + 1]
                n += np.bincount(own[row[whole_]] * BUCKETS + keys[whole_], minlength=n.size).reshape(n.shape)
        lang, bucket = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n[lang, bucket])], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_col).isin(*languages) & F.col(text_col).isNotNull()).select(lang_col, text_col)
    n = np.ones((len(languages), BUCKETS))
    for lang, bucket, k in rows.mapInArrow(tidy(run), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n")).toLocalIterator():
        n[lang, bucket] += k
    return np.log(n / n.sum(1, keepdims=True))


def plain_text(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*+>", " ")
    return F.regexp_replace(out, r"&(?:amp|lt|gt|quot|nbsp|#[0-9]{1,6});", " ")


def evidence(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.col(html_col), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    df = pages.select(F.col(id_col).alias("id"), F.nullif(host, F.lit("")).alias("host"), F.nullif(declared, F.lit("")).alias("declared"), plain_text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    labels = F.split("host", r"\.")
    return df.withColumns({"suffix": F.element_at(labels, -1), "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")})


def likelihood(model: np.ndarray, keys: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """Sums of the model's rows over keys, piece by piece, so that a very long page takes no more memory than its bytes."""
    out = np.zeros(len(model))
    for i in range(0, len(keys), piece):
        out += model[:, keys[i : i + piece]].sum(1)
    return out


def text_scores(df: DataFrame, model: np.ndarray, temper: float) -> DataFrame:
    """df, text replaced by loglik: tempered log-likelihoods, the highest being 0."""
    keep = [f for f in df.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                keys, offsets = trigrams(batch.column("text"))
                out = np.array([likelihood(model, keys[inside(offsets, row, len(keys))]) for row in range(len(batch))]) * temper
                out = np.round(out - out.max(1, keepdims=True), 6)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), out.shape[1]).cast(pa.list_(pa.float64()))], names=[*[f.name for f in keep], "loglik"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", loglik array<double>"
    return df.select(*[f.name for f in keep], "text").mapInArrow(tidy(run), schema)


def identify(pages: DataFrame, model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", languages=LANGUAGES, temper: float = TEMPER, strength: float = STRENGTH) -> DataFrame:
    """id, host, declared, text_language, language, probability of each page."""
    importable(pages.sparkSession)
    k = range(len(languages))
    df = text_scores(evidence(pages, id_col, url_col, html_col), model, temper)
    weight = [F.exp(F.col("loglik")[i]) for i in k]
    total = sum(weight, F.lit(0.0))
    df = stored(df.withColumns({f"r{i}": F.round(weight[i] / total * UNIT).cast("long") for i in k}), "langid_pages")

    def counts(col: str, name: str) -> DataFrame:
        return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(f"_{name}")).agg(*[F.sum(f"r{i}").alias(f"{name}{i}") for i in k])

    everywhere = df.agg(*[F.coalesce(F.sum(f"r{i}"), F.lit(0)) for i in k], F.count_distinct("declared"), F.count_distinct("suffix")).first()
    n, kinds = [float(everywhere[i]) / UNIT for i in k], {"declared": everywhere[len(languages)], "suffix": everywhere[len(languages) + 1]}
    prior = [(x + strength / len(languages)) / (sum(n) + strength) for x in n]
    for col in ("declared", "suffix", "host", "domain"):
        df = df.join(counts(col, f"{col}_n"), F.col(col) == F.col(f"_{col}_n"), "left").drop(f"_{col}_n")
    # what a page says of itself doesn't count as evidence about its host, its declared language or its suffix
    other = lambda col, i: (F.coalesce(F.col(f"{col}_n{i}"), F.col(f"r{i}")) - F.col(f"r{i}")) / UNIT
    logs = []
    for i in k:
        likely = lambda col, i=i: F.when(F.col(col).isNull(), 0.0).otherwise(F.log(((F.col(f"{col}_n{i}") - F.col(f"r{i}")) / UNIT + SMOOTH) / (n[i] - F.col(f"r{i}") / UNIT + SMOOTH * (kinds[col] + 1))))
        domain = (other("domain", i) + strength * prior[i]) / (sum((other("domain", j) for j in k), F.lit(0.0)) + strength)
        host = (other("host", i) + strength * domain) / (sum((other("host", j) for j in k), F.lit(0.0)) + strength)
        logs.append(F.round(F.col("loglik")[i] + likely("declared") + likely("suffix") + F.log(host), 6))
    df = df.withColumns({f"z{i}": logs[i] for i in k})
    top = F.greatest(*[F.col(f"z{i}") for i in k])
    named = lambda p, best: F.coalesce(*[F.when(p(i) == best, F.lit(languages[i])) for i in k])
    return df.select(
        "id", "host", "declared", named(lambda i: F.col(f"r{i}"), F.greatest(*[F.col(f"r{i}") for i in k])).alias("text_language"),
        named(lambda i: F.col(f"z{i}"), top).alias("language"), F.round(1 / sum((F.exp(F.col(f"z{i}") - top) for i in k), F.lit(0.0)), 6).alias("probability"),
    )


def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(table(spark, sf_dir, "documents").select("lang", "text"))
    return identify(table(spark, sf_dir, "pages"), model).withColumnRenamed("id", "page_id")
