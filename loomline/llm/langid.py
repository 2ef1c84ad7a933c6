"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter of its frequent character n-grams; the filters are stored bit-sliced: one row of `m` cells, in
which bit l of a cell is that cell's bit in the filter of language l. One look at an n-gram's cells and an AND give the mask of all
languages that contain it. A text's counts per language are popcounts of the masks' slices, each corrected for its filter's
false positives; the largest decides, and its share of the text's n-grams is the score.

Fitting uses a bounded sample: at most about `max_docs` documents of each language, chosen by a hash. A language keeps the n-grams
that make up at least `min_share` of its sample, which are 1 / min_share at most, so what is gathered and broadcast is bound by
the number of languages (128 KB each), whatever the size of the corpus. Predicting is one pass over whole texts where they are read, without a shuffle.

Defined results: null texts and texts without letters are `und` with score 0, as is every text when no language was
learned; a text of which no language knows an n-gram gets the first language with score 0; ties go to the first language
by code point; rows that repeat an id are predicted one by one; an empty table gives no rows; no column of `docs` is overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, pin, release, small_batches
from .wordhash import U64, mix64

ORDERS = (3, 4)
PROBES = 3
CELLS_PER_GRAM = 16
MAX_DOCS = 4000
MIN_SHARE = 2e-5
MAX_LANGUAGES = 1024
BLOCK = 1 << 18
REACH = max(ORDERS) - 1
UNKNOWN = "und"
FACTORS = (0xD6E8FEB86659FD93, 0xA3AAACAA5D7E4F1B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_hashes(texts: list[str]):
    """Yields, for runs of texts: (hashes of all n-grams, the index of each one's text). A text longer than a block comes in
    several runs, with the n-grams that it has as a whole. An n-gram lies in one word, whose ends count as a mark."""
    run: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        text = text.lower()
        if len(text) > BLOCK:
            for start in range(0, len(text), BLOCK):
                yield _grams(*_codes("".join(_around(text, start))), start > 0, i)
            continue
        if run and size + len(text) > BLOCK:
            yield _run(run)
            run, size = [], 0
        run.append((i, text))
        size += len(text)
    if run:
        yield _run(run)


def _around(text: str, start: int):
    """A block of a long text, with the n-gram's length less one before it; text ends are marks."""
    yield "" if start else "\0"
    yield text[max(0, start - REACH) : start + BLOCK]
    yield "" if start + BLOCK < len(text) else "\0"


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, letter_table()[codes]


def _run(run: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    codes, letter = _codes("\0" + "\0".join(t for _, t in run) + "\0")
    owner = np.repeat(np.array([i for i, _ in run]), [len(t) + 1 for _, t in run])
    return _grams(codes, letter, False, np.concatenate((owner[:1], owner)))


def _grams(codes: np.ndarray, letter: np.ndarray, open_left: bool, owner) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end after the REACH characters that an open left end repeats. Every character that is no letter is a mark."""
    marks = np.where(letter, codes, 0).astype(U64)
    hashes, owners = [], []
    for n in ORDERS:
        begin = REACH - n + 1 if open_left else 0
        count = marks.size - n + 1 - begin
        if count <= 0:
            continue
        at = lambda j: marks[begin + j : begin + j + count]  # noqa: B023, E731
        inner = np.ones(count, bool)
        for j in range(1, n - 1):
            inner &= at(j) != 0
        total = np.full(count, n, U64)
        for j in range(n):
            total = total * U64(FACTORS[0]) + at(j) * U64(FACTORS[1 + j % 3])
        hashes.append(mix64(total[inner]))
        owners.append(np.full(hashes[-1].size, owner) if np.ndim(owner) == 0 else owner[begin + 1 : begin + 1 + count][inner])
    if not hashes:
        return np.empty(0, U64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class LanguageFilters:
    languages: list[str]
    cells: np.ndarray  # (m, words of 64 languages)
    false_positive: np.ndarray

    @classmethod
    def of(cls, grams: dict[str, np.ndarray]) -> LanguageFilters:
        languages = sorted(grams)
        largest = max([1, *(g.size for g in grams.values())])
        bits = max(12, int(np.ceil(np.log2(largest * CELLS_PER_GRAM))))
        kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
        width = max(1, -(-len(languages) // 64))
        cells = np.zeros((1 << bits, width), kind)
        fills = []
        for i, language in enumerate(languages):
            at = cls.probes(grams[language], 1 << bits).ravel()
            cells[at, i // 64] |= kind(1 << (i % 64))
            fills.append(np.unique(at).size / (1 << bits))
        return cls(languages, cells, np.array(fills) ** PROBES)

    @staticmethod
    def probes(hashes: np.ndarray, size: int) -> np.ndarray:
        step = (hashes >> U64(32)) | U64(1)
        return np.stack([((hashes + U64(i) * step) & U64(size - 1)).astype(np.int64) for i in range(PROBES)])

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bit masks."""
        first, *rest = self.probes(hashes, len(self.cells))
        found = self.cells[first]
        for at in rest:
            found &= self.cells[at]
        return found

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected counts, a row per text; n-grams of each text)."""
        raw = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for hashes, owners in gram_hashes(texts):
            if not hashes.size:
                continue
            masks = self.masks(hashes)
            total += np.bincount(owners, minlength=len(texts))
            for i in range(len(self.languages)):
                hit = (masks[:, i // 64] >> (i % 64)) & 1
                raw[:, i] += np.bincount(owners, weights=hit, minlength=len(texts))
        return np.maximum(0.0, (raw - total[:, None] * self.false_positive) / (1 - self.false_positive)), total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        corrected, total = self.counts([t or "" for t in texts])
        best = corrected.argmax(axis=1)
        score = np.clip(corrected[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0, 1.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)], np.where(total > 0, score, 0.0)


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = MAX_DOCS,
    min_share: float = MIN_SHARE,
    max_languages: int = MAX_LANGUAGES,
) -> LanguageFilters:
    """Learn from rows with a text and a language. At most about `max_docs` of each language are read, by a hash of the id.
    More than `max_languages` values are taken for a column that doesn't hold languages, and refused; none is dropped."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")
    ).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages if they are; the filters grow with their number")
    if not sizes:
        return LanguageFilters.of({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_docs / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col("lang")])

    def count(frames):
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                for hashes, _ in gram_hashes(part["text"].to_list()):
                    grams, times = np.unique(hashes.view(np.int64), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams, "n": times})

    counted = pin(
        sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "grams",
    )
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        release(counted)
        return LanguageFilters.of({})
    need = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, n * min_share)])
    frequent = counted.where(F.col("n") >= need[F.col("lang")]).select("lang", "gram").toPandas()
    release(counted)
    return LanguageFilters.of({k: g["gram"].to_numpy().view(U64) for k, g in frequent.groupby("lang")})


def predict(docs: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """`docs` with a struct of (lang_pred, score), named `language` or, beside such a column, `language_`."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def guess(texts: pd.Series) -> pd.DataFrame:
        parts = [held.value.predict(texts[i : i + 512].to_list()) for i in range(0, len(texts), 512)]
        return pd.DataFrame(
            {"lang_pred": [x for names, _ in parts for x in names], "score": [float(x) for _, scores in parts for x in scores]}
        )

    return docs.withColumn(free_name(docs, "language"), guess(F.col(f"`{text_col}`")))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that a model may learn from: those whose crc32 of the id, modulo 3, is not 1."""
    return docs.where(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 != 1)


def keep_identified(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", least: float = 0.05) -> DataFrame:
    """`docs` without those that are `und` or whose best language knows less than `least` of their n-grams: other
    scripts and noise. Texts of unlearned languages in the script of a learned one share more n-grams than that and stay."""
    named = predict(docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("__row", F.col(f"`{text_col}`").alias("text")), filters)
    return named.where((F.col("language.lang_pred") != UNKNOWN) & (F.col("language.score") >= least)).select("__row.*")


def op3_langid(spark, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document, learned from two thirds of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = fit(learnable(docs))
    return predict(docs.select("doc_id", "text"), filters).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.col("language.lang_pred").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )
