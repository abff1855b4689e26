"""Quality classifier: a document model shrunk by what its site is like.

A logistic model on text counts gives each document's evidence. Sites form two levels,
host and path; their mean quality is estimated from all documents (the label where there
is one, else the model's probability) by hierarchical empirical Bayes: the global rate is
the prior of a host, the host's posterior mean the prior of its paths, and the strength
of each prior is fitted by moments to how much true rates differ, so a sparse site stays
near its prior and a well observed one speaks for itself. A document's own share is
taken out of its site before its posterior odds are formed:

    odds(document) * odds(path without it) / odds(global)

Sites are grouped sums, combined before the shuffle; joins back move no texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.divergence import count_texts
from civicpulse.llm.fixed_lists import CHAR_CLASSES
from civicpulse.llm.rowkeys import MARK, key_columns, without
from civicpulse.session import broadcast_within, via_table


@dataclass(frozen=True)
class SiteQuality:
    """``training_rows`` bounds the labelled sample the document model is fitted on."""

    training_rows: int = 200_000
    keep_from: float = 0.25
    max_strength: float = 1000.0
    clip: float = 1e-4


def features(counts: Column) -> dict[str, Column]:
    """Columns of the document model."""
    n = F.greatest(counts["n_words"], F.lit(1))
    chars = F.greatest(F.aggregate(counts["char_hist"], F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1))
    share = {name: counts["char_hist"][i] / chars for i, name in enumerate(CHAR_CLASSES)}
    common = F.size(counts["word_hist"]) - 1
    return {
        "log_words": F.log1p(counts["n_words"]),
        "word_length": counts["word_chars"] / n,
        "symbols": F.least(counts["n_symbols"] / n, F.lit(3.0)),
        "distinct": counts["n_distinct"] / n,
        "repeats": counts["n_repeat_words"] / n,
        "dup_lines": counts["n_dup_lines"] / F.greatest(counts["n_lines"], F.lit(1)),
        "uncommon": F.when(common > 0, counts["word_hist"][common] / n).otherwise(0.0),
        **{f"share_{name}": share[name] for name in ("upper", "blank", "stop", "symbol", "beyond_ascii")},
    }


def _logit(p: Column, clip: float) -> Column:
    held = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(held / (1 - held))


def document_model(rows: DataFrame, labels: DataFrame, settings: SiteQuality):
    """Fitted model, or None if the labels hold fewer than two classes.

    ``labels`` has ``id`` and ``label`` (0 or 1; rows with nulls are left out, several
    labels of one id are averaged and cut at one half).
    """
    one = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(
        F.when(F.avg("label") >= 0.5, 1.0).otherwise(0.0).alias("label")
    )
    labelled = via_table(
        rows.select("id", "features").join(one, "id").select("id", "label", "features"), "labelled"
    )
    seen = labelled.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).first()
    if seen.k < 2:
        return None
    share = min(1.0, settings.training_rows / seen.n)
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return LogisticRegression(regParam=1e-3, maxIter=60).fit(sample)


def _strength(groups: DataFrame, prior: Column, most: float) -> Column:
    """Beta strength by moments: the spread of site rates beyond binomial noise.

    With rate r, prior mean m and n documents, E(n (r - m)^2) = m (1 - m) (1 + (n - 1) rho),
    so rho follows from sums over sites, and the strength is 1 / rho - 1.
    """
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - prior, 2) - prior * (1 - prior))
    room = F.sum((F.col("n") - 1) * prior * (1 - prior))
    rho = F.when(room > 0, spread / room).otherwise(0.0)
    rho = F.least(F.greatest(rho, F.lit(1 / (1 + most))), F.lit(0.5))
    return 1 / rho - 1


def site_posteriors(rows: DataFrame, settings: SiteQuality) -> tuple[DataFrame, float, float, float]:
    """``(host, path, n, s, host_n, host_s)`` of each path, global rate, host and path strength.

    ``rows`` has ``host``, ``path`` (no nulls) and ``q``, the quality of a document.
    """
    paths = via_table(
        rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("q").alias("s")), "paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = min(max((total.s or 0.0) / total.n, settings.clip), 1 - settings.clip) if total.n else 0.5
    top = hosts.agg(_strength(hosts, F.lit(rate), settings.max_strength).alias("v")).first().v or settings.max_strength
    joined = paths.join(
        broadcast_within(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))), "host"
    )
    prior = (F.col("host_s") + top * rate) / (F.col("host_n") + top)
    low = joined.agg(_strength(joined, prior, settings.max_strength).alias("v")).first().v or settings.max_strength
    return joined, rate, top, low


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_id: str = "doc_id",
    label_col: str = "quality",
    carry: list[str] | None = None,
    settings: SiteQuality = SiteQuality(),
) -> DataFrame:
    """One row per row of ``docs``: ``carry`` columns as ``c_<name>``, evidence, posterior, ``kept``.

    Without labels of both classes every document has evidence one half and is kept.
    Null texts count as empty, null hosts and paths are sites of their own, null ids have
    no label, repeated rows each come back, no documents give an empty table.
    """
    counted = docs.select(
        *[F.col(c).alias(f"c_{c}") for c in (docs.columns if carry is None else carry)],
        F.col(id_col).alias("id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        count_texts(F.col(text_col)).alias("counts"),
    )
    columns = features(F.col("counts"))
    numbered = counted.withColumns({f"f_{k}": v.cast("double") for k, v in columns.items()}).drop("counts")
    numbered = via_table(numbered, "features")
    assembler = VectorAssembler(inputCols=[f"f_{k}" for k in columns], outputCol="features")
    rows = assembler.transform(numbered)
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("double").alias("label"))
    model = document_model(rows, known, settings)
    drop = ["features", *[f"f_{k}" for k in columns]]
    if model is None:
        rows = rows.withColumn("evidence", F.lit(0.5))
    else:
        rows = model.transform(rows).withColumn("evidence", vector_to_array("probability")[1])
        drop += ["rawPrediction", "probability", "prediction"]
    rows = rows.drop(*drop)
    own = known.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.avg("label").alias("label"))
    rows = rows.join(broadcast_within(own), "id", "left")
    rows = rows.withColumn("q", F.coalesce("label", "evidence")).drop("label")
    sites, rate, top, low = site_posteriors(rows, settings)
    joined = rows.join(broadcast_within(sites), ["host", "path"])
    host = (F.col("host_s") - F.col("q") + top * rate) / (F.col("host_n") - 1 + top)
    path = (F.col("s") - F.col("q") + low * F.col("host_posterior")) / (F.col("n") - 1 + low)
    clip = settings.clip
    odds = _logit(F.col("evidence"), clip) + _logit(F.col("path_posterior"), clip) - _logit(F.lit(rate), clip)
    return (
        joined.withColumn("host_posterior", host)
        .withColumn("path_posterior", path)
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", F.lit(True) if model is None else F.col("posterior") >= settings.keep_from)
        .drop("q", "n", "s", "host_n", "host_s")
    )


def keep_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    **options,
) -> DataFrame:
    """``docs`` without rejected rows; columns stay as they are.

    Rows of one id, site and text have one verdict, so they are dropped by these.
    """
    names = list(dict.fromkeys([id_col, host_col, path_col]))
    keyed = docs.select(
        *key_columns(names, text_col), F.col(text_col).alias("__text"), F.col(id_col).alias("__id"),
        F.col(host_col).alias("__host"), F.col(path_col).alias("__path"),
    )
    carry = [*[f"key_{n}" for n in names], MARK]
    judged = classify_quality(keyed, labels, "__id", "__text", "__host", "__path", carry=carry, **options)
    rejected = judged.where("NOT kept").select(*[F.col(f"c_{c}").alias(c) for c in carry])
    return without(docs, rejected, text_col)
