"""MinHash near-duplicates with HyperMinHash sketches.

1. Each document's set of word shingles is hashed to 64 bits. The first bits name a bucket; of the smallest hash in each bucket the
   sketch keeps the number of leading zeros (6 bits) and the bits after them (10 bits). An empty bucket borrows that of a
   seeded sequence of other buckets, so small sets have whole sketches too.
2. Documents with equal sets are one node; what is compared for that is a 128-bit BLAKE2 digest of the sorted shingles' words. Bands
   of four registers are compared exactly: at similarity 0.85 a pair misses all 32 bands with a chance of 6e-11.
3. In each bucket of a band every node is compared with the smallest (a star, no pairs). The estimate of the Jaccard similarity
   from the registers, corrected for registers that agree by chance, drops pairs that are six standard errors below the
   threshold; the rest are confirmed on the words of their full sets, not on hashes. Links give components.
4. What may still be linked are nodes that share a bucket and are in different components. An exact prefix filter over the sets
   of these nodes alone, and an exact bound from 512 parities of each set (what differs in parity differs in the sets), give
   the pairs of them that can reach the threshold; these are confirmed too, and so no pair of a bucket that could
   change the result stays untested. Two passes over one drawn pair per shingle and node come before the pass over all of them:
   a crowd that the stars left in several components is one by then, and has few pairs between components.

Equal sets are merged and minima taken before shuffles; hot buckets meet only in equi-joins that adaptive execution can split.
Nodes have numbers of their own, so repeated ids meet no more than others do.

Defined results: null texts and texts without words have no set, are linked with nothing and kept; a text of fewer words than a
shingle is one shingle; rows that repeat an id are documents of their own, kept where their group's smallest id is theirs; rows
with a null id are in no component and kept; a set of very many shingles is compared in parts.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import free_name, pin, release, small_batches
from .wordhash import SPACED, U64, hashes_of, mix64

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ROWS_PER_BAND = 4
BANDS = BUCKETS // ROWS_PER_BAND
ATTEMPTS = 1024
ORDER = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)
_TRIES = mix64(np.arange(ATTEMPTS * BUCKETS, dtype=U64) + U64(77)).reshape(ATTEMPTS, BUCKETS) % U64(BUCKETS)
#: Shingles that a task holds of one set at a time, and bytes of text that have about as many.
PART, PART_BYTES = 1 << 20, 8 << 20
PARITIES = tuple(f"p{i}" for i in range(8))
OWN = ("node", "n", *PARITIES)
#: Shingles ahead of one that its row has with it, and passes over sampled pairs before that over all. The result is the same for any.
BEFORE, SAMPLES = 8, 2


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The shingles of one document in their order, from the hashes of its words."""
    if words.size == 0:
        return words
    size = min(k, words.size)
    total = np.full(words.size - size + 1, size, dtype=U64)
    for i in range(size):
        total = total * U64(ORDER[0]) + mix64(words[i : words.size - size + 1 + i] + U64(ORDER[1 + i % 4]))
    return mix64(total)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct shingles of one document."""
    return np.unique(gram_hashes(words, k))


def shingles(text: str | None, k: int, part: int = 0, parts: int = 1) -> set[bytes]:
    """The distinct shingles themselves, or a part of them by their CRC."""
    found: set[bytes] = set()
    run: list[bytes] = []
    whole = False
    for words in SPACED.blocks(text):
        run = run + words if run else words
        if len(run) >= k:
            whole = True
            some = set(map(b" ".join, zip(*(run[i:] for i in range(k)), strict=False)))
            found |= some if parts == 1 else {s for s in some if crc32(s) % parts == part}
            run = run[len(run) - k + 1 :]
    if not whole and run and (parts == 1 or crc32(b" ".join(run)) % parts == part):
        found.add(b" ".join(run))
    return found


def exact_set(text: str | None, k: int) -> tuple[np.ndarray, int, bytes]:
    """(sorted hashes of the distinct shingles, how many shingles are distinct, digest of their set). The digest is of the
    shingles themselves, in the order of their hashes if these tell them apart, else in their own."""
    digest, blocks = hashlib.blake2b(digest_size=16), list(islice(SPACED.blocks(text), 2))
    if not blocks:
        return np.empty(0, U64), 0, digest.digest()
    if len(blocks) == 1:
        words = blocks[0]
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(min(k, len(words)))), strict=False)))
        hashes, first = np.unique(gram_hashes(hashes_of(words), k), return_index=True)
        if len(set(grams)) == hashes.size:
            digest.update(b"\n".join(map(grams.__getitem__, first.tolist())))
            return hashes, hashes.size, digest.digest()
    else:
        hashes = shingle_hashes(SPACED.hashes(text), k)
    # in parts of a number that equal sets have in common; each is put in the order of its hashes, then bytes
    n, parts = 0, 1 + hashes.size // PART
    found: list[tuple[int, bytes]] = []
    for low, high in zip(bounds := hashes[:: -(-hashes.size // parts)].tolist(), [*bounds[1:], 1 << 64], strict=True):
        found = sorted(shingles_between(text, k, low, high))
        n += len(found)
        digest.update((b"\n" if low != bounds[0] else b"") + b"\n".join(gram for _, gram in found))
    return hashes, n, digest.digest()


def shingles_between(text: str | None, k: int, low: int, high: int) -> set[tuple[int, bytes]]:
    """(hash, shingle) of those whose hashes lie in [low, high)."""
    found: set[tuple[int, bytes]] = set()
    run: list[bytes] = []
    whole = False
    for words in SPACED.blocks(text):
        run = run + words
        if len(run) >= k:
            whole = True
            hashes = gram_hashes(hashes_of(run), k).tolist()
            found.update((h, b" ".join(run[i : i + k])) for i, h in enumerate(hashes) if low <= h < high)
            run = run[len(run) - k + 1 :]
    if run and not whole:
        h = int(gram_hashes(hashes_of(run), k)[0])
        found.update([(h, b" ".join(run))] if low <= h < high else [])
    return found


def shared_and_all(a: str, b: str, k: int, held: set[bytes] | None = None) -> tuple[int, int]:
    """Sizes of the intersection and the union of two texts' sets; `held` is a's whole set where it is at hand."""
    parts = 1 + max(len(a), len(b)) // PART_BYTES
    both = either = 0
    for part in range(parts):
        x = held if held is not None and parts == 1 else shingles(a, k, part, parts)
        y = shingles(b, k, part, parts)
        common = len(x & y)
        both += common
        either += len(x) + len(y) - common
    return both, either


def registers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, register) of the buckets of a sorted set that are not empty."""
    bucket = (hashes >> U64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = hashes[first] << U64(BUCKET_BITS)
    top = rest.copy()
    for shift in (1, 2, 4, 8, 16, 32):  # fill below the leading one
        top |= top >> U64(shift)
    zeros = 64 - np.bitwise_count(top).astype(np.int64)
    zeros = np.minimum(zeros, 63)
    mantissa = ((rest << zeros.astype(U64)) << U64(1)) >> U64(64 - MANTISSA_BITS)
    return bucket[first], (zeros << MANTISSA_BITS | mantissa.astype(np.int64)).astype(np.uint16)


def densify(values: np.ndarray, filled: np.ndarray) -> None:
    """Fill the empty registers of non-empty rows in place, each from the first filled bucket of its seeded sequence."""
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for tries in _TRIES:
        if not row.size:
            return
        source = tries[col].astype(np.int64)
        hit = filled[row, source]
        values[row[hit], col[hit]] = values[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row, col, strict=True):
        steps = (c + np.arange(1, BUCKETS)) % BUCKETS
        values[r, c] = values[r, steps[np.flatnonzero(filled[r, steps])[0]]]


def sketch_frames(frames, k: int):
    for frame in frames:
        for i in range(0, len(frame), 256):
            part = frame[i : i + 256]
            values, filled = np.zeros((len(part), BUCKETS), np.uint16), np.zeros((len(part), BUCKETS), bool)
            exact = []
            for row, text in enumerate(part["text"]):
                hashes, *known = exact_set(text, k)
                bucket, value = registers(hashes)
                values[row, bucket], filled[row, bucket] = value, True
                exact.append(known)
            densify(values, filled)
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].to_numpy(),
                    "text_hash": part["text_hash"].to_numpy(),
                    "n_shingles": [n for n, _ in exact],
                    "set_hash": [digest for _, digest in exact],
                    "bands": list(values.view(np.int64)),
                }
            )


def named_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    named = named_texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))  # exact beside nulls
    made = named.mapInPandas(
        lambda frames: sketch_frames(frames, k), "doc_id string, text_hash long, n_shingles long, set_hash binary, bands array<long>"
    )
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers: the share that agrees, less what agrees by chance."""
    chance = 2.0**-MANTISSA_BITS / 3
    agree = (a.view(np.uint16) == b.view(np.uint16)).mean(axis=1)
    return np.maximum(0.0, (agree - chance) / (1 - chance))


def promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and estimate leave."""

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        guess = estimated(np.stack(x.to_list()).astype(np.int64), np.stack(y.to_list()).astype(np.int64))
        samples = np.minimum(BUCKETS, np.minimum(n, m) / 2).clip(lower=1)
        share = percent / 100
        return pd.Series(guess >= share - 6 * np.sqrt(share * (1 - share) / samples))

    side = lambda s: nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "n_shingles", "bands")])
    joined = pairs.join(side("b"), F.col("b") == F.col("node_b")).join(side("a"), F.col("a") == F.col("node_a"))
    fits = F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * percent
    return joined.where(fits).where(likely("bands_a", "bands_b", "n_shingles_a", "n_shingles_b")).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Texts come by equi-joins; a hub's set is kept while its pairs last."""

    def compare(frames):
        held, mine = None, None
        for frame in frames:
            keep = []
            for hub, text, other in zip(frame["a"], frame["text_a"], frame["text_b"], strict=True):
                if hub != held:
                    held, mine = hub, shingles(text, k) if len(text) <= PART_BYTES else None
                both, either = shared_and_all(text, other, k, mine)
                keep.append(100 * both >= percent * either)
            yield frame.loc[keep, ["a", "b"]]

    texts_a = texts.select(F.col("node").alias("node_a"), F.col("text").alias("text_a"))
    texts_b = texts.select(F.col("node").alias("node_b"), F.col("text").alias("text_b"))
    joined = pairs.join(texts_b, F.col("b") == F.col("node_b")).join(texts_a, F.col("a") == F.col("node_a"))
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(compare, "a long, b long")


def several_components(placed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of `placed` (keys, node, component, ...) whose keys meet more than one component, with `largest`, the component
    that most of a key's rows are in; and the table behind it."""
    crowds = placed.groupBy(*keys, "component").agg(F.count("*").alias("n_rows"))
    most = (
        crowds.groupBy(*keys)
        .agg(F.count("*").alias("kinds"), F.max(F.struct("n_rows", "component")).alias("most"))
        .where("kinds > 1")
        .select(*keys, F.col("most.component").alias("largest"))
    )
    most = pin(most, "most")
    return placed.join(most, keys), most


def parities(hashes: np.ndarray) -> np.ndarray:
    """512 bits as 8 longs: how many of a set's hashes fall to each, modulo 2."""
    odd = np.bincount((hashes >> U64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (node, n, parities, at, shingle, before) of the shingles by which `nodes` may reach the threshold with each other.

    Each set is ordered by how many of these sets have a shingle, rarest first. Sets that reach the threshold share a
    shingle among the first n - ceil(t n) + 1 of both. Shingles that one set alone has only move the others' positions, so a
    document with many words of its own meets nothing, whatever crowd it was copied from. `before` is the last BEFORE shingles
    ahead of this one.
    """

    def sets(frames):
        for frame in frames:
            for i in range(0, len(frame), 512):
                part = frame[i : i + 512]
                found = [shingle_hashes(SPACED.hashes(t), k) for t in part["text"]]
                marks = np.array([parities(x) for x in found], np.int64).reshape(len(found), len(PARITIES))
                yield pd.DataFrame(
                    {
                        "node": part["node"].to_numpy(),
                        "n": [x.size for x in found],
                        **{name: marks[:, j] for j, name in enumerate(PARITIES)},
                        "shingles": [x.view(np.int64) for x in found],
                    }
                )

    made = pin(
        texts.join(nodes, "node").select("node", "text").mapInPandas(sets, ", ".join(f"{c} long" for c in OWN) + ", shingles array<long>"),
        "sets",
    )
    flat = made.select("node", "n", F.explode("shingles").alias("shingle"))
    shared = pin(flat.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1"), "shared")
    ahead = lambda x, i: F.struct(
        x["shingle"].alias("shingle"), F.slice("s", F.greatest(i - BEFORE + 1, F.lit(1)), F.least(i, F.lit(BEFORE)))["shingle"].alias("before")
    )
    ordered = (
        flat.join(shared, "shingle")
        .groupBy("node")
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("s"))
        .withColumn("alone", F.col("n") - F.size("s"))
        .withColumn("reach", F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - F.col("alone"))
        .where("reach > 0")
        .withColumn("s", F.slice("s", F.lit(1), F.col("reach").cast("int")))
        .select("node", "alone", F.posexplode(F.transform("s", ahead)).alias("i", "s"))
    )
    prefix = pin(
        ordered.join(made.select(*OWN), "node").select(*OWN, (F.col("alone") + F.col("i")).alias("at"), "s.shingle", "s.before"), "prefix"
    )
    release(made, shared)
    return prefix


def untested(prefix: DataFrame, nodes: DataFrame, percent: int, sample: int | None = None) -> DataFrame:
    """All pairs (a, b) of `nodes` (node, component) in different components that may reach the threshold: exact filters.

    A pair meets at the first shingle that both prefixes have, where what follows must be enough for the overlap asked; where
    both have one of the shingles just ahead they have met before. Sets that differ in d parities differ in d shingles at
    least, so a pair's overlap is (n + m - d) / 2 at most; the join itself tests this, so of a crowd of texts that are alike
    but not near enough no pair leaves it, and no text moves for one.

    With `sample` each row meets one other of its shingle instead, drawn by that number from the largest component: as many
    pairs as rows at most, which bring most of a crowd together before all of its pairs are asked for.
    """
    met, most = several_components(prefix.join(nodes, "node"), ["shingle"])
    side = lambda s, rows: rows.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in (*OWN, "component", "largest", "at", "before")])
    apart = met.where("component != largest")
    others = met
    if sample is not None:
        drawn = F.max_by(F.struct(*met.columns), F.xxhash64("node", "shingle", F.lit(sample)))
        others = met.where("component = largest").groupBy("shingle").agg(drawn.alias("hub")).select("hub.*")
    x, y = side("x", apart), side("y", others)
    sizes = F.col("n_x") + F.col("n_y")
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    differ = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in PARITIES[1:]), F.bit_count(F.col("p0_x").bitwiseXOR(F.col("p0_y"))))
    near = (
        (x["shingle"] == y["shingle"])
        & (F.col("component_x") != F.col("component_y"))
        & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
        & ((sizes - differ) * (100 + percent) >= sizes * (2 * percent))
    )
    once = ((F.col("component_y") == F.col("largest_y")) | (F.col("node_x") < F.col("node_y"))) & (left * (100 + percent) >= sizes * percent)
    pairs = pin(
        x.join(y, near if sample is not None else near & once & ~F.arrays_overlap("before_x", "before_y"))
        .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
        .distinct(),
        "untested",
    )
    release(most)
    return pairs


def labelled(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """A row per document: (doc_id, text_hash, n_shingles, component_id, kept)."""
    small_batches(docs.sparkSession)
    made = pin(sketches(docs, id_col, text_col, k), "sketches")
    nodes = pin(
        made.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_hash")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),  # a number of the written row
        "nodes",
    )
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # a table, so that a hot bucket's join has an exchange on either side and can be split
    hubs = pin(banded.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), "hubs")
    met = pin(banded.join(hubs, ["band", "key"]), "met")

    star = pin(promising(met.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes, percent), "star")
    wanted = nodes.join(met.select("node").distinct(), "node").select(
        "node", F.col("first.doc_id").alias("w_id"), F.col("first.text_hash").alias("w_hash")
    )
    texts = pin(
        named_texts(docs, id_col, text_col)
        .join(wanted, (F.col("doc_id") == F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
        .select("node", "text"),
        "texts",
    )
    if texts.count() > texts.select("node").distinct().count():  # rows are repeated: a node's text once
        repeated = texts
        texts = pin(repeated.groupBy("node").agg(F.first("text").alias("text")), "texts")
        release(repeated)
    links = pin(confirmed(star, texts, k, percent).distinct(), "links")
    labels = components(links)

    placed = met.join(labels.withColumnRenamed("id", "node"), "node", "left").select(
        "band", "key", "node", F.coalesce("component", "node").alias("component")
    )
    crowded, most = several_components(placed, ["band", "key"])
    open_ = pin(crowded.select("node", "component").distinct(), "open")
    prefix = prefixes(open_, texts, k, percent)
    spent = [hubs, met, most, texts, prefix, open_]
    tested, linked = [star], [links]
    all_of = lambda tables: reduce(DataFrame.union, tables)
    for sample in (*range(SAMPLES), None):
        rest = untested(prefix, open_, percent, sample)
        more = pin(confirmed(rest.join(all_of(tested), ["a", "b"], "left_anti"), texts, k, percent).distinct(), "more")
        tested.append(rest)
        linked.append(more)
        if more.isEmpty():
            continue
        labels = components(all_of(linked))
        if sample is not None:
            named = labels.withColumnRenamed("id", "node")
            open_ = pin(open_.select("node").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "open")
            spent.append(open_)
    release(*spent, *tested, *linked)
    grouped = labels.join(nodes.select(F.col("node").alias("id"), "first.doc_id"), "id")
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    merged = (
        nodes.join(labels.withColumnRenamed("id", "node"), "node", "left")
        .join(smallest, "component", "left")
        .select("set_hash", F.coalesce("component_id", "first.doc_id").alias("component_id"))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return made.join(merged, "set_hash", "left").select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """A row per document: (doc_id, n_shingles, component_id, kept)."""
    return labelled(docs, id_col, text_col, k, percent).drop("text_hash")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """`docs` with one document of each group, that with the smallest id."""
    gone = labelled(docs, id_col, text_col, k, percent).where("not kept")
    name, hashed = free_name(docs, "__gone"), free_name(docs, "__hash")
    gone = gone.select(F.col("doc_id").alias(name), F.col("text_hash").alias(hashed)).distinct()
    same = (F.col(f"`{id_col}`").cast("long") == F.col(name)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(hashed))
    return docs.join(gone, same, "left_anti")


def op5_hyperminhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: components of documents whose 3-word shingles agree to 85 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
rare AS (
  SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS p
  FROM s JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) USING (g) JOIN n USING (doc_id)),
prefix AS (SELECT doc_id, g FROM rare WHERE p <= n - ceil(0.85 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id),
inter AS (SELECT a, b, count(*) AS i FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b),
link AS (
  SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS r FROM w UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) m ON m.id = w.doc_id
"""
