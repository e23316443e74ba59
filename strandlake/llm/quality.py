"""Quality by an interpolated modified Kneser-Ney model.

The model is over the bytes of texts, in n-grams of ORDER. Partitions count n-grams of trusted texts before the
shuffle; counts are sharded by n-gram, lower orders count distinct left extensions, and discounts, back-off weights
and probabilities come from joins of these tables. The distinct n-grams of all texts are joined with them too, so
every one has a probability, seen or not. A document's perplexity is that of its bytes; it is kept if this does not
exceed, by more than SLACK, a quantile of its language's trusted documents that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, among, column, staged, text_steps

ORDER = 4
#: Quantile of held-out trusted perplexities, and the slack over it that small languages' samples need.
QUANTILE, SLACK = 0.995, 1.25
#: One in so many trusted texts, by hash, is held out of the model and sets the thresholds.
FOLDS = 5
#: Rows of the probability table that are broadcast (16 bytes each); a larger one is joined document by document.
MOST_BROADCAST = 4_000_000
#: Distinct n-grams a task holds before it passes its counts on.
HELD = 1 << 20


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram of every byte with the ORDER - 1 before it (a line feed before the text), and its text."""
    size = np.diff(offsets)
    shift = np.arange(len(size)) * (ORDER - 1)
    spread = np.full(len(data) + (ORDER - 1) * len(size), 10, U64)
    owner = np.repeat(np.arange(len(size)), size)
    spot = np.arange(len(data)) + shift[owner] + ORDER - 1
    spread[spot] = data
    codes = np.zeros(len(data), U64)
    for k in range(ORDER):
        codes = codes << U64(8) | spread[spot - (ORDER - 1 - k)]
    return codes, owner


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n): n-grams added up in the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

    def rows() -> pa.RecordBatch:
        codes, n = merged()
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"]
        )

    for batch in batches:
        for _, _, data, offsets in text_steps(column(batch, "text")):
            found, n = np.unique(_codes(data, offsets)[0], return_counts=True)
            held.append((found, n))
            if sum(len(c) for c, _ in held) > HELD:
                held[:] = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield rows()
    if held:
        yield rows()


def _discounts(table: DataFrame) -> list[float]:
    """D1, D2 and D3 of modified Kneser-Ney from the counts of counts."""
    row = table.agg(*(F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = ((row[f"n{k}"] or 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05 * (k + 1)), 0.95 * (k + 1)) for k, d in enumerate(raw)]


def kneser_ney(grams: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Probability tables (code, p) and back-off tables (context, g) of orders 1 to ORDER, from (code, n) of ORDER."""
    tables = {ORDER: grams.select("code", "n")}
    for k in range(ORDER - 1, 0, -1):
        lower = tables[k + 1].groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count("*").alias("n"))
        tables[k] = staged(lower, "grams")
    probabilities, backoffs = [], []
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(tables[k])
        n = F.col("n")
        discount = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        seen = tables[k].withColumn("context", F.shiftright("code", 8))
        context = seen.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("freed"))
        backoffs.append(staged(context.select("context", (F.col("freed") / F.col("total")).alias("g"), "total"), "contexts"))
        joined = seen.join(backoffs[-1], "context")
        if k == 1:
            lower_p = F.lit(1 / 256)
        else:
            joined = joined.withColumn("lower", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            joined = joined.join(probabilities[-1].select(F.col("code").alias("lower"), F.col("p").alias("lower_p")), "lower")
            lower_p = F.col("lower_p")
        p = (n - discount) / F.col("total") + F.col("g") * lower_p
        probabilities.append(staged(joined.select("code", p.alias("p")), "probabilities"))
    return probabilities, [b.select("context", "g") for b in backoffs]


def gram_costs(asked: DataFrame, probabilities: list[DataFrame], backoffs: list[DataFrame]) -> DataFrame:
    """(code, cost): minus the logarithm of each asked n-gram's probability, backing off where it is unseen."""
    p = F.lit(1 / 256)
    out = asked.select("code")
    for k in range(1, ORDER + 1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1))
        out = out.withColumn(f"c{k}", suffix).withColumn(f"h{k}", F.shiftright(suffix, 8))
        out = out.join(probabilities[k - 1].select(F.col("code").alias(f"c{k}"), F.col("p").alias(f"p{k}")), f"c{k}", "left")
        out = out.join(backoffs[k - 1].select(F.col("context").alias(f"h{k}"), F.col("g").alias(f"g{k}")), f"h{k}", "left")
        p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"g{k}"), F.lit(1.0)) * p)
    return out.select("code", (-F.log(p)).alias("cost"))


def _sums(costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, cost = costs.value
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            for i, j, data, offsets in text_steps(column(batch, "text")):
                mine, owner = _codes(data, offsets)
                found, back = np.unique(mine, return_inverse=True)
                each = cost[np.searchsorted(codes, found.view(np.int64))] if len(found) else np.zeros(0)
                total = np.bincount(owner, each[back], minlength=j - i)
                size = np.diff(offsets)
                mean = total / np.maximum(size, 1)
                value = pa.array(np.exp(mean), mask=size == 0)
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(i, j - i) for c in rest), value], names=[*rest, "perplexity"])

    return run


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = column(batch, "key")
        for i, _, data, offsets in text_steps(column(batch, "text")):
            codes, owner = _codes(data, offsets)
            order = np.lexsort((codes, owner))
            codes, owner = codes[order], owner[order]
            fresh = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])) if len(codes) else order
            n = np.diff(np.append(fresh, len(codes)))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(owner[fresh] + i)), pa.array(codes[fresh].view(np.int64)), pa.array(n.astype(np.int64))],
                names=["key", "code", "n"],
            )


def perplexities(docs: DataFrame, costs: DataFrame) -> DataFrame:
    """(doc_id, lang, held, perplexity) of rows (doc_id, text, lang, held); null for empty texts."""
    kinds = "doc_id long, lang string, held boolean, perplexity double"
    if costs.count() <= MOST_BROADCAST:
        table = costs.toPandas().sort_values("code")  # at most MOST_BROADCAST rows
        sent = docs.sparkSession.sparkContext.broadcast((table["code"].to_numpy(), table["cost"].to_numpy()))
        return docs.select("doc_id", "lang", "held", "text").mapInArrow(_sums(sent), kinds)
    keyed = docs.withColumn("key", F.xxhash64("text"))
    sums = keyed.select("key", "text").groupBy("key").agg(F.first("text").alias("text")).mapInArrow(_grams_of, "key long, code long, n long")
    sums = sums.join(costs, "code").groupBy("key").agg((F.sum(F.col("cost") * F.col("n")) / F.sum("n")).alias("mean"))
    return keyed.join(sums, "key", "left").select("doc_id", "lang", "held", F.exp("mean").alias("perplexity"))


def score(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept: one row for each row of docs (doc_id long, text, lang string).

    Trusted texts are those that labels (doc_id, quality) mark 1 and never 0. The threshold of a language is SLACK
    times that quantile of its held-out trusted texts' perplexities, and of all these for languages without any. A null or
    empty text has no perplexity and is not kept; with nothing trusted there is no threshold and every other text
    is kept. Rows that repeat a doc_id are scored one by one. Other columns are ignored.
    """
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    good = good.where("quality = 1").select("doc_id")
    # equal texts share a fold, so no copy of a held-out text is learned from
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        (F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0).alias("held"),
    )
    learned = among(source.where("not held").select("doc_id", "text"), good)
    grams = staged(learned.select("text").mapInArrow(_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "counts")
    asked = source.select("text").mapInArrow(_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    costs = staged(gram_costs(asked, *kneser_ney(grams)), "costs")
    scored = perplexities(source, costs).join(good.withColumn("good", F.lit(True)), "doc_id", "left")
    scored = staged(scored.withColumn("trusted", F.col("held") & F.col("good").isNotNull()), "scored")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("threshold")
    limits = scored.where("trusted").groupBy("lang").agg(at)
    overall = scored.where("trusted").agg(at.alias("overall"))
    out = scored.join(limits.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(overall))
    threshold = F.coalesce("threshold", "overall") * SLACK
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
