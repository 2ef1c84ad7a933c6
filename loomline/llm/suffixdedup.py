"""Repeated passages by sparse suffixes, grouped by hash: nothing is sorted and no neighbours are compared.

A word of a document is repeated if it lies in a run of `min_words` words that occurs elsewhere in the corpus, in this document or another.

1. Of all suffixes only those are kept that begin at a minimiser: the smallest k-word hash of some window of min_words words. What is
   smallest depends on the window's words alone, so two equal windows keep suffixes at the same place in them. A suffix
   is represented by two hashes: of its first k words, and of its context, which are the words of all windows that chose it.
2. Suffixes whose first k words occur once share them with none and go. The rest are grouped by both hashes. Equal contexts agree
   as far as any window reaches, and are handled as one from here on, however many copies there are.
3. Where suffixes share k words but not the context, exact window hashes take the place of an extension left and right: of one
   suffix per distinct context, every window that chose it (so many words to the left, the rest to the right) is hashed from the text and met with its equals.
   This finds each match of min_words words exactly, also one that a nearer neighbour in suffix order would hide.
4. The windows found go back to all suffixes of their context as bit masks, and to spans per document.

Counts and minima are taken before every shuffle; a passage that very many documents share is one key with many rows only in
equi-joins, which adaptive execution can split. What is gathered into one row is bound by one document or one suffix.

Defined results: words are split at ASCII white space, A-Z as a-z; null texts and texts of fewer than `min_words` words have no repeated
words; of equal windows the one with the smallest id, then position, is the first and the others are later ones; rows that
repeat id and text are repeated, and later than none of each other; a null id is smaller than any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, pin, release
from .wordhash import SPACED, U64, mix64

MIN_WORDS, K = 50, 8
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(max(n, 4096) * 2, base, dtype=U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def range_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words[start:end], alike wherever they stand."""
    up, down = powers(words.size + 1)
    sums = np.zeros(words.size + 1, U64)
    np.cumsum(words * up[: words.size], dtype=U64, out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def sparse_suffixes(words: np.ndarray, min_words: int, k: int):
    """(first window, last window, k-word hash, context hash) of the suffixes kept; windows by their first word."""
    n = words.size - min_words + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    at = np.arange(words.size - k + 1)
    grams = range_hashes(words, at, at + k)
    width = min_words - k + 1
    chosen = np.empty(n, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    for a in range(0, n, 1 << 16):
        chosen[a : a + (1 << 16)] = views[a : a + (1 << 16)].argmin(axis=1)
    chosen += np.arange(n)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], n) - 1
    place = chosen[first]
    context = mix64(range_hashes(words, first, last + min_words) + (place - first).astype(U64) * U64(0x9E3779B97F4A7C15))
    return first, last, grams[place].view(np.int64), context.view(np.int64)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = K
) -> DataFrame:
    """A row per document: (doc_id, text_hash, n_words, spans, later_spans), spans as arrays of [start, end) in words: those
    of all repeated words, and of those that an earlier occurrence already has."""
    if not 0 <= min_words - k < 63:
        raise ValueError("min_words - k must be 0 to 62: the windows of a suffix are bits of a long")
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("text")
    )

    def suffixes(frames):
        for frame in frames:
            for i in range(0, len(frame), 512):
                part = frame[i : i + 512]
                found = [(w.size, sparse_suffixes(w, min_words, k)) for w in map(SPACED.hashes, part["text"])]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "text_hash": part["text_hash"].to_numpy(),
                        "n_words": [n for n, _ in found],
                        "a": [s[0].astype(np.int32) for _, s in found],
                        "b": [s[1].astype(np.int32) for _, s in found],
                        "gram": [s[2] for _, s in found],
                        "context": [s[3] for _, s in found],
                    }
                )

    made = pin(
        base.select(F.col("doc_id").cast("string"), F.col("text_hash").cast("string"), "text")  # exact beside nulls
        .mapInPandas(
            suffixes, "doc_id string, text_hash string, n_words long, a array<int>, b array<int>, gram array<long>, context array<long>"
        )
        .withColumns({c: F.col(c).cast("long") for c in ("doc_id", "text_hash")}),
        "suffixes",
    )
    flat = made.select("doc_id", "text_hash", F.explode(F.arrays_zip("a", "b", "gram", "context")).alias("s")).select(
        "doc_id", "text_hash", "s.a", "s.b", "s.gram", "s.context"
    )
    # tables, so that a hot key's join has an exchange on either side and can be split
    shared = pin(flat.groupBy("gram").count().where("count > 1").select("gram"), "shared")
    seeds = pin(flat.join(shared, "gram", "left_semi"), "seeds")
    contexts = pin(
        seeds.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "a", "b", "text_hash")).alias("first")),
        "contexts",
    )
    kinds = pin(contexts.groupBy("gram").agg(F.count("*").alias("kinds")), "kinds")
    met = contexts.join(kinds, "gram")
    bit_at = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    every = bit_at(F.col("first.b") - F.col("first.a") + 1) - 1
    settled = met.where("kinds = 1").select(
        "gram", "context", "first", every.alias("repeated"), F.lit(0).cast("long").alias("later")
    )

    columns = ("gram", "context", "n", "a", "b")
    wanted = (
        met.where("kinds > 1")
        .groupBy("first.doc_id", "first.text_hash")
        .agg(F.collect_list(F.struct("gram", "context", "n", F.col("first.a").alias("a"), F.col("first.b").alias("b"))).alias("asked"))
        .select("doc_id", "text_hash", *[F.col(f"asked.{c}").alias(f"asked_{c}") for c in columns])
    )

    def windows(frames):
        for frame in frames:
            for i in range(0, len(frame), 64):
                part = frame[i : i + 64]
                asked = [part[f"asked_{c}"] for c in columns]
                out = []
                for doc_id, text, gram, context, n, a, b in zip(part["doc_id"], part["text"], *asked, strict=True):
                    times = b - a + 1
                    which = np.repeat(np.arange(a.size), times)
                    offset = np.arange(which.size) - np.repeat(np.cumsum(times) - times, times)
                    at = a[which] + offset
                    window = range_hashes(SPACED.hashes(text), at, at + min_words).view(np.int64)
                    who = np.full(which.size, 0 if doc_id is None else int(doc_id)), np.full(which.size, doc_id is None)
                    out.append((window, gram[which], context[which], offset.astype(np.int32), n[which], at.astype(np.int32), *who))
                made = [np.concatenate(x) for x in zip(*out, strict=True)]
                frame_out = pd.DataFrame(dict(zip(("window", "gram", "context", "offset", "n", "at"), made, strict=False)))
                frame_out["doc_id"] = pd.arrays.IntegerArray(made[6], made[7])
                yield frame_out

    asking = wanted.withColumnsRenamed({"doc_id": "w_id", "text_hash": "w_hash"})
    texts = base.join(asking, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
    seen = pin(
        texts.select(F.col("doc_id").cast("string"), "text", *[f"asked_{c}" for c in columns]).mapInPandas(
            windows, "window long, gram long, context long, offset int, n long, at int, doc_id long"
        ),
        "windows",
    )
    equal = pin(
        seen.groupBy("window")
        .agg(F.sum("n").alias("total"), F.min(F.struct("doc_id", "at")).alias("earliest"))
        .where("total > 1")
        .select("window", "earliest"),
        "equal",
    )
    bit = bit_at(F.col("offset"))
    extended = (
        seen.join(equal, "window")
        .groupBy("gram", "context")
        .agg(
            F.bit_or(bit).alias("repeated"),
            F.bit_or(F.when(F.struct("doc_id", "at") > F.col("earliest"), bit).otherwise(F.lit(0).cast("long"))).alias("later"),
        )
        .join(contexts.select("gram", "context", "first"), ["gram", "context"])
        .select("gram", "context", "first", "repeated", "later")
    )
    verdicts = pin(settled.unionByName(extended), "verdicts")
    release(shared, contexts, kinds, seen, equal)

    is_first = F.struct("doc_id", "a") == F.struct("first.doc_id", "first.a")
    placed = seeds.join(verdicts, ["gram", "context"]).select(
        "doc_id", "text_hash", "a", "repeated", F.when(is_first, F.col("later")).otherwise(F.col("repeated")).alias("later")
    )
    per_doc = placed.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "repeated", "later")).alias("found"))

    @F.pandas_udf("struct<spans: array<struct<start: long, end: long>>, later_spans: array<struct<start: long, end: long>>>")
    def spans(found: pd.Series) -> pd.DataFrame:
        def union(rows, name):
            out: list[list[int]] = []
            for a, mask in sorted((r["a"], r[name]) for r in rows):
                for i in range(mask.bit_length()):
                    if mask >> i & 1:
                        if out and a + i <= out[-1][1]:
                            out[-1][1] = max(out[-1][1], a + i + min_words)
                        else:
                            out.append([a + i, a + i + min_words])
            return [{"start": s, "end": e} for s, e in out]

        return pd.DataFrame({"spans": [union(r, "repeated") for r in found], "later_spans": [union(r, "later") for r in found]})

    none = F.array().cast("array<struct<start: long, end: long>>")
    resolved = per_doc.select("doc_id", "text_hash", spans("found").alias("f")).select("doc_id", "text_hash", "f.*")
    left = made.select("doc_id", "text_hash", "n_words").withColumnsRenamed({"doc_id": "l_id", "text_hash": "l_hash"})
    return left.join(
        resolved, F.col("l_id").eqNullSafe(F.col("doc_id")) & (F.col("l_hash") == F.col("text_hash")), "left"
    ).select(
        F.col("l_id").alias("doc_id"),
        F.col("l_hash").alias("text_hash"),
        "n_words",
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("later_spans", none).alias("later_spans"),
    )


def remove_later(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """`docs` without the words that an earlier occurrence already has; the space before each goes with it."""
    found = repeated_passages(docs, id_col, text_col, min_words, k).where(F.size("later_spans") > 0)
    by_id, by_hash, cut = (free_name(docs, n) for n in ("__id", "__hash", "__cuts"))
    cuts = found.select(F.col("doc_id").alias(by_id), F.col("text_hash").alias(by_hash), F.col("later_spans").alias(cut))
    cuts = cuts.dropDuplicates([by_id, by_hash])
    pieces = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    kept = F.filter(
        F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.cast("long").alias("i"))),
        lambda s: ~F.exists(cut, lambda c: (c["start"] <= s["i"]) & (s["i"] < c["end"])),
    )
    joined = docs.join(
        cuts, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(by_id)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(by_hash)), "left"
    )
    text = F.when(F.col(cut).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(kept, lambda s: s["p"]), ""))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's repeated passages of 50 words or more: how many words are repeated, how many of them some earlier
    occurrence already has, and both as `start-end` spans of words, end exclusive."""
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        words("spans").alias("n_repeated"),
        words("later_spans").alias("n_later"),
        shown("spans").alias("spans"),
        shown("later_spans").alias("later_spans"),
    )


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w
  FROM documents),
win AS (
  SELECT doc_id, i - 1 AS p, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
ranked AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM win),
marked AS (
  SELECT doc_id, p, kind FROM (SELECT doc_id, p, n, r, unnest(['a', 'l']) AS kind FROM ranked WHERE n > 1) WHERE kind = 'a' OR r > 1),
steps AS (
  SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, kind ORDER BY p) + 50 THEN 0 ELSE 1 END AS opens FROM marked),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, kind ORDER BY p) AS g FROM steps),
spans AS (SELECT doc_id, kind, min(p) AS s, max(p) + 50 AS e FROM grouped GROUP BY doc_id, kind, g),
per_doc AS (
  SELECT doc_id, kind, sum(e - s)::BIGINT AS n, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM spans GROUP BY doc_id, kind)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(a.n, 0)::BIGINT AS n_repeated, coalesce(l.n, 0)::BIGINT AS n_later,
       coalesce(a.spans, '') AS spans, coalesce(l.spans, '') AS later_spans
FROM w LEFT JOIN per_doc a ON a.doc_id = w.doc_id AND a.kind = 'a' LEFT JOIN per_doc l ON l.doc_id = w.doc_id AND l.kind = 'l'
"""
