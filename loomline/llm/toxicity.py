"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of pairs of neighbours and of pairs with one word between, in a table of
2**bits coordinates. The learner keeps two numbers per coordinate, has a learning rate of its own for each, and its L1 term
leaves most weights at zero, so the weights that are broadcast are few and at most 2**bits.

Learning is sequential and so uses a bounded sample of the labelled rows (`max_docs`, a parameter, drawn by a hash): one task learns
it from sorted rows, or `shards` tasks learn a part each and their weights are averaged, which is faster and less exact.
Scoring is one pass over whole texts where they are read, without a shuffle.

Defined results: null and empty texts have only the intercept's score; no labelled rows: every score is 0.5; rows with no label are
not learned; label rows that say the same of an id count once; rows that repeat an id are scored one by one; an empty table gives no
rows; no column of `docs` is overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, pin, release
from .wordhash import U64, Words, mix64

BITS = 20
SHARDS = 1
MAX_DOCS = 12_000
MAX_FEATURES = 50_000_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
THRESHOLD = 0.3
#: A-Z become a-z; ASCII other than letters and digits separates; other bytes are of words.
TABLE = Words(bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)))


def features(words: np.ndarray, bits: int) -> np.ndarray:
    """Distinct coordinates of one text."""
    parts = [mix64(words + U64(1))]
    for gap in (1, 2):
        if words.size > gap:
            parts.append(mix64(words[:-gap] * U64(0x9FB21C651E98DF25) + words[gap:] + U64(gap * 7 + 3)))
    return np.unique((np.concatenate(parts) >> U64(64 - bits)).astype(np.int32))


def feature_sets(texts, bits: int):
    return (features(TABLE.hashes(t), bits) for t in texts)


@dataclass
class Model:
    bits: int
    intercept: float
    at: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << self.bits)
        table[self.at] = self.weight
        return table


def learn(sets: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal over rows in a seeded order; returns (weights, intercept). The intercept is not regularised."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    order = np.random.RandomState(seed)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for i in order.permutation(len(sets)):
            at = sets[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            b = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - labels[i]
            root = np.sqrt(ns + g * g)
            z[at] = zs + g - (root - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * b
            nb += g * g
    return weights(z, n), -zb / ((BETA + np.sqrt(nb)) / ALPHA)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    bits: int = BITS,
    max_docs: int = MAX_DOCS,
    shards: int = SHARDS,
    epochs: int = EPOCHS,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Learn from the documents that `labels` marks 0 or 1. About `max_docs` of the labels are used, drawn by a hash, and fewer, by
    the same hash, where these have more than `max_features` features in all (4 bytes each for the task that learns)."""
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(
        "id is not null and label in (0, 1)"
    ).distinct()  # what the draw leaves, and is broadcast, is so bound by max_docs
    rows = marks.count()
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id").cast("string")), F.lit(1 << 20))
    marks = marks.withColumn("draw", draw).where(F.col("draw") < int((1 << 20) * min(1.0, max_docs / max(1, rows))))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sample = texts.join(F.broadcast(marks), "id").select("draw", F.col("id").cast("string").alias("id"), "text", "label")

    def featured(frames):
        for frame in frames:
            for i in range(0, len(frame), 512):
                part = frame[i : i + 512]
                yield pd.DataFrame(
                    {"draw": part["draw"], "id": part["id"], "label": part["label"], "features": list(feature_sets(part["text"], bits))}
                )

    # what is shuffled to the task that learns are features, at most 2**bits a text however long that is
    made = table = pin(sample.mapInPandas(featured, "draw long, id string, label int, features array<int>"), "features")
    total = made.agg(F.sum(F.size("features"))).first()[0] or 0
    if total > max_features:
        made = made.where(F.col("draw") < int((1 << 20) * min(1.0, max_docs / max(1, rows)) * max_features / total))

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [x.tobytes() for x in frame["features"]]
        frame = frame.assign(key=keys).sort_values(["id", "label", "key"], kind="stable")
        w, b = learn(list(frame["features"]), frame["label"].to_numpy(float), bits, epochs, int(frame["shard"].iloc[0]))
        at = np.flatnonzero(w)
        return pd.DataFrame({"rows": len(frame), "at": np.append(at, -1), "weight": np.append(w[at], b)})

    sample = made.withColumn("shard", F.col("draw") % shards)
    learned = sample.groupBy("shard").applyInPandas(train, "rows long, at long, weight double").toPandas()
    release(table)
    if learned.empty:
        return Model(bits, 0.0, np.empty(0, np.int64), np.empty(0))
    shard_rows = learned.loc[learned["at"] == -1, "rows"].sum()
    learned["weight"] *= learned["rows"] / shard_rows
    summed = learned.groupby("at")["weight"].sum()
    return Model(bits, float(summed[-1]), summed.index[summed.index >= 0].to_numpy(), summed[summed.index >= 0].to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with a score, 0 to 1, in a column named `toxicity` or, beside such a column, `toxicity_`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, np.ndarray] = {}

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        if "w" not in state:
            state["w"] = held.value.dense()
        w, bits, out = state["w"], held.value.bits, []
        for i in range(0, len(texts), 512):
            out += [w[at].sum() for at in feature_sets(texts[i : i + 512], bits)]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float) + held.value.intercept, -35, 35))))

    return docs.withColumn(free_name(docs, "toxicity"), rate(F.col(f"`{text_col}`")))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's score, learned from the labels of three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
