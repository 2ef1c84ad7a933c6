"""Alignment of the tokens of two vocabularies over the same texts.

A text's bytes are cut where a token of either vocabulary ends; each stretch between cuts is one link between a token of A and a token of B. A
group ends where both end. Most groups are one token of each with the same bytes: those whose ids the identity map (A's id -> B's id of the same
bytes, made once from the vocabularies) pairs are counted in a vector as long as A's vocabulary, one a task, and never leave it as rows. The
links of all other groups are pairs of ids that are counted by a shuffle, summed per document and per task before it.

How a document's links are counted over the whole corpus is then looked up. The counts of identity pairs and of the commonest others, at most
`held` of them, are broadcast; links of rarer pairs meet their counts in a join, so that a pair of ids that every document holds is no
key of that join.

Defined results: texts that are null or empty, or whose tokens' bytes aren't a space and the text (a character that B writes as a space), have no
tokens: zeros and ''; rows that repeat an id or a text are documents of their own and count each time; an empty table gives no row; texts of
any length are encoded whole, their tokens aligned at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import pin
from .vocabulary import byte_level, pieces, public_path, same_bytes

#: A pair of ids is one number: A's id, then B's in this many bits.
B_BITS = 20
B_MASK = (1 << B_BITS) - 1
#: The most pairs whose counts are broadcast beside those of the identity map, 16 bytes each.
HELD = 1 << 19
#: Tokens that are aligned at once, but for longer texts.
TOKENS = 1 << 18
ALIGNED = (
    "row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
    "same array<int>, same_n array<int>, pairs array<long>, pair_n array<long>"
)


def linked(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each link, in order: its end, its tokens' places in A and B, and whether a group ends with it."""
    ends = np.union1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, at_a, at_b, (ends_a[at_a] == ends) & (ends_b[at_b] == ends)


class _Writer:
    """Group texts `a1,a2|b1;a3|b2,b3` of many documents at once: every token has a text for inside a group and one for its end."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        self.said = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in ",;"]

    def write(self, ids_a, ids_b, ends_a, ends_b, group_ends) -> list[str]:
        group_a, group_b = np.searchsorted(group_ends, ends_a), np.searchsorted(group_ends, ends_b)
        until_a = np.searchsorted(ends_a, group_ends, side="right")
        until_b = np.concatenate([[0], np.searchsorted(ends_b, group_ends, side="right")])
        told = np.empty(len(ids_a) + len(ids_b), np.int64)
        told[np.arange(len(ids_a)) + until_b[group_a]] = 2 * ids_a + (ends_a == group_ends[group_a])
        told[np.arange(len(ids_b)) + until_a[group_b]] = 2 * (self.n_a + ids_b) + (ends_b == group_ends[group_b])
        return list(map(self.said.__getitem__, told.tolist()))


def _counted(keys: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each document, their counts, and where each document's begin."""
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))), np.searchsorted(docs[first], np.arange(n + 1))


def _lists(values: np.ndarray, starts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _aligner(path_a: str, path_b: str, texts_too: bool):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        same, writer = same_bytes(a, b), _Writer(len(a.bytes), len(b.bytes))
        vector = np.zeros(len(a.bytes), np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(1).type
            at, texts = 0, batch.column(2)
            while at < len(texts):
                rows, tokens_a, tokens_b, size = [], [], [], 0
                while at < len(texts) and size < TOKENS:
                    text = texts[at].as_py()
                    ids_a, ids_b = _both(a, b, text) if text else ((), ())
                    rows.append(at)
                    tokens_a.append(ids_a)
                    tokens_b.append(ids_b)
                    size += len(ids_a) + len(ids_b)
                    at += 1
                yield _aligned(batch, rows, tokens_a, tokens_b, a, b, same, writer, vector, texts_too)
        if vector.any():
            has = np.flatnonzero(vector)
            keys = has << B_BITS | same[has]
            yield _batch({"row": [None], "doc_id": pa.nulls(1, kind), "pairs": _lists(keys, [0, len(has)], pa.int64()), "pair_n": _lists(vector[has], [0, len(has)], pa.int64())}, 1)

    return align


def _both(a, b, text: str) -> tuple[list[int], list[int]]:
    ids_a, ids_b, data = a.ids(" " + text), b.ids([text])[0], (" " + text).encode()
    fits = b"".join([a.bytes[i] for i in ids_a]) == data and b"".join([b.bytes[i] for i in ids_b]) == data
    return (ids_a, ids_b) if fits else ((), ())


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    kinds = {
        "row": pa.int64(), "doc_id": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "groups_sha256": pa.string(),
        "same": pa.list_(pa.int32()), "same_n": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()), "pair_n": pa.list_(pa.int64()),
    }
    made = {k: columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], kind) if k in columns else pa.nulls(n, kind) for k, kind in kinds.items()}
    return pa.RecordBatch.from_pydict(made)


def _aligned(batch, rows, tokens_a, tokens_b, a, b, same, writer, vector, texts_too) -> pa.RecordBatch:
    n = len(rows)
    n_a, n_b = np.array([len(x) for x in tokens_a]), np.array([len(x) for x in tokens_b])
    ids_a, ids_b = (np.fromiter((i for x in t for i in x), np.int64, int(c.sum())) for t, c in ((tokens_a, n_a), (tokens_b, n_b)))
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    ends, at_a, at_b, closes = linked(ids_a, ids_b, ends_a, ends_b)
    doc = np.repeat(np.arange(n), n_a)[at_a]
    alone = closes & np.concatenate([[True], closes[:-1]])[: len(closes)]
    link_a, link_b = ids_a[at_a], ids_b[at_b]
    plain = alone & (same[link_a] == link_b)
    vector += np.bincount(link_a[plain], minlength=len(vector))
    same_ids, same_n, same_at = _counted(link_a[plain], doc[plain], n)
    keys, key_n, key_at = _counted(link_a[~plain] << B_BITS | link_b[~plain], doc[~plain], n)
    told, at = writer.write(ids_a, ids_b, ends_a, ends_b, ends[closes]), 0
    groups, digests = [], []
    for size in (n_a + n_b).tolist():
        said = "".join(told[at : at + size])[:-1]
        at += size
        groups.append(said if texts_too else None)
        digests.append(hashlib.sha256(said.encode()).hexdigest() if size else "")
    return _batch(
        {
            "row": batch.column(0).take(pa.array(rows)),
            "doc_id": batch.column(1).take(pa.array(rows)),
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(doc[closes], minlength=n),
            "n_links": np.bincount(doc, minlength=n),
            "groups": groups,
            "groups_sha256": digests,
            "same": _lists(same_ids, same_at, pa.int32()),
            "same_n": _lists(same_n, same_at, pa.int32()),
            "pairs": _lists(keys, key_at, pa.int64()),
            "pair_n": _lists(key_n, key_at, pa.int64()),
        },
        n,
    )


class Alignment:
    """documents: a row per document with its groups' text, if asked for, and digest, its identity tokens (`same`, `same_n`) and other pairs (`pairs`,
    `pair_n`); counts: (pair, n, identity), a row per pair of ids over the corpus, `pair` A's id then B's in B_BITS bits."""

    def __init__(self, documents: DataFrame, counts: DataFrame, path_a: str, path_b: str):
        self.documents, self.counts, self.path_a, self.path_b = documents, counts, path_a, path_b


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = False) -> Alignment:
    path_a, path_b = path_a or public_path("byte_bpe_50k.json"), path_b or public_path("piece_bpe_32k.model")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    made = pin(base.mapInArrow(_aligner(path_a, path_b, texts_too), ALIGNED.format(kind)), "aligned")
    links = made.select(F.col("row").isNull().alias("identity"), F.inline(F.arrays_zip("pairs", "pair_n")))
    counts = pin(links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_n").alias("n"), F.max("identity").alias("identity")), "pair_counts")
    return Alignment(made.where(F.col("row").isNotNull()), counts, path_a, path_b)


def _looked_up(path_a: str, path_b: str, known):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = same_bytes(byte_level(path_a), pieces(path_b))
        keys, counts, best = known.value
        for batch in batches:
            n = batch.num_rows
            total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
            rest = None
            for ids, times in ((batch.column(1), batch.column(2)), (batch.column(3), batch.column(4))):
                doc = np.repeat(np.arange(n), ids.value_lengths().to_numpy())
                key, own = ids.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
                if rest is None:
                    key = key << B_BITS | same[key]
                at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                found = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                count = counts[at[found]] if len(keys) else np.empty(0, np.int64)
                np.add.at(total, doc[found], own[found] * count)
                np.add.at(top, doc[found], own[found] * (count == best[key[found] & B_MASK]))
                starts = np.concatenate([[0], np.cumsum(np.bincount(doc[~found], minlength=n))])
                rest = _lists(key[~found], starts, pa.int64()), _lists(own[~found], starts, pa.int64())
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "n_best": pa.array(top), "count_sum": pa.array(total), "rare": rest[0], "rare_n": rest[1]})

    return look_up


def held_from(sizes: dict[int, int], held: int) -> int:
    """The least power of two such that at most `held` pairs are counted as often. `sizes`: how many pairs have a count of k bits."""
    bits, room = 64, held
    while bits > 1 and sizes.get(bits - 1, 0) <= room:
        bits -= 1
        room -= sizes.get(bits, 0)
    return 1 << (bits - 1)


def link_counts(of: Alignment, held: int = HELD) -> DataFrame:
    """(row, n_best, count_sum) of every document: links whose pair is its B id's most counted, and the corpus-wide counts of all links."""
    spark: SparkSession = of.documents.sparkSession
    bits = F.length(F.bin("n"))
    sizes = {r[0]: r[1] for r in of.counts.where("NOT identity").groupBy(bits).count().collect()}  # 64 rows at most
    least = held_from(sizes, held)
    near = of.counts.where((F.col("n") >= least) | F.col("identity")).select("pair", "n").toArrow()  # at most `held` and A's vocabulary
    order = np.argsort(near["pair"].to_numpy())
    keys, counts = near["pair"].to_numpy()[order], near["n"].to_numpy()[order]
    best = np.zeros(len(pieces(of.path_b).bytes), np.int64)
    tops = of.counts.groupBy(F.col("pair").bitwiseAND(B_MASK).alias("b")).agg(F.max("n").alias("n"))  # a row per id of B's vocabulary
    for r in tops.collect():
        best[r["b"]] = r["n"]
    known = spark.sparkContext.broadcast((keys, counts, best))
    kept = of.documents.select("row", "same", "same_n", "pairs", "pair_n")
    found = kept.mapInArrow(_looked_up(of.path_a, of.path_b, known), "row long, n_best long, count_sum long, rare array<long>, rare_n array<long>")
    if not any(n for k, n in sizes.items() if 1 << (k - 1) < least):  # no pair is rarer than those held
        return found.select("row", "n_best", "count_sum")
    found = pin(found, "looked_up")
    b_tops = tops.select(F.col("b"), F.col("n").alias("most"))
    far = of.counts.where((F.col("n") < least) & ~F.col("identity")).withColumn("b", F.col("pair").bitwiseAND(B_MASK)).join(F.broadcast(b_tops), "b")
    rare = found.select("row", F.inline(F.arrays_zip("rare", "rare_n"))).join(far, F.col("rare") == F.col("pair"))
    summed = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("rare_n")).otherwise(0)).alias("more_best"), F.sum(F.col("rare_n") * F.col("n")).alias("more_sum"))
    both = found.join(summed, "row", "left")
    return both.select("row", *[(F.col(k) + F.coalesce(F.col(m), F.lit(0))).alias(k) for k, m in (("n_best", "more_best"), ("count_sum", "more_sum"))])


def op11_align(spark, sf_dir: str) -> DataFrame:
    """Contract query: the tokens, groups and links of all documents, with the links' counts over the corpus."""
    made = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = made.documents.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return told.join(link_counts(made), "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
