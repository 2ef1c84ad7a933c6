"""Packing documents into sequences of a fixed length by cutting-stock column generation.

A document's tokens are cut at every `capacity` tokens; what is full is a sequence of its own. The rest of each document is packed by
patterns: a linear program over the histogram of rest lengths, at most `capacity - 1` rows whatever the corpus, whose columns (lengths
that share a sequence) are priced by a knapsack over the duals. Each pattern is used a whole number of times, rounded down. Rests are ranked
within their length, and a range of ranks belongs to a pattern, so a rest finds its sequence by a join with a table that the histogram bounds.

Patterns that would need padding, and what rounding leaves over (a few items a pattern), are laid end to end and cut where a sequence is
full, so that their padding becomes cuts; the program's padded length bounds how many. The very last of it is cut where powers of two are,
as such lengths need no padding.

Ranks need no shuffle of rows: a task numbers the rests of each length as it encodes them, in `capacity` counters, and the counts of a task are
summed over the tasks before it. A length that a third of all documents have is no group of rows anywhere.

Defined results: null and empty texts are the closing id alone; rows that repeat an id or a text are documents of their own; an empty table
gives no piece; texts of any length are encoded whole. Sequence ids are unique, those of full sequences from 2**62 on, and not dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import pin
from .vocabulary import byte_level, public_path

CAPACITY = 1024
END_ID = 0
#: Where the linear program may end: padding as a share of all tokens, and rounds.
GAP, MAX_ROUNDS = 2e-3, 400
#: Ids of full sequences: this, then the task, then a number in it.
FULL, TASK_SHIFT = 1 << 62, 36
ENCODED = "doc_id {}, doc_tokens long, start long, length long, ids binary, task long, task_rank long, sequence_id long"
NAMES = ["doc_id", "doc_tokens", "start", "length", "ids", "task", "task_rank", "sequence_id"]


def _encoder(path: str, capacity: int, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = byte_level(path)
        task = TaskContext.get().partitionId()
        seen, full = [0] * capacity, FULL | task << TASK_SHIFT
        for batch in batches:
            out, held = [], 0
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*vocabulary.marked_ids(text.as_py() or ""), end_id], "<u4")
                for start in range(0, len(ids), capacity):
                    own = ids[start : start + capacity]
                    n = len(own)
                    if n == capacity:
                        out.append((row, len(ids), start, n, own.tobytes(), None, full))
                        full += 1
                    else:
                        out.append((row, len(ids), start, n, own.tobytes(), seen[n], None))
                        seen[n] += 1
                    held += n
                if held >= 1 << 22:
                    yield _pieces(batch, out, task)
                    out, held = [], 0
            if out:
                yield _pieces(batch, out, task)

    return encode


def _pieces(batch: pa.RecordBatch, rows: list[tuple], task: int) -> pa.RecordBatch:
    row, tokens, start, length, ids, rank, sequence = zip(*rows)
    longs = {"doc_tokens": tokens, "start": start, "length": length, "task": [task] * len(rows), "task_rank": rank, "sequence_id": sequence}
    named = {"doc_id": batch.column(0).take(pa.array(row)), "ids": pa.array(ids, pa.binary())} | {k: pa.array(v, pa.int64()) for k, v in longs.items()}
    return pa.RecordBatch.from_pydict({k: named[k] for k in NAMES})


def padded(total: int, capacity: int) -> int:
    return total if total & (total - 1) == 0 else capacity


def solve(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, max_rounds: int = MAX_ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how often) and how many sequences each of them is used for, rounded down.

    Minimises the padded length of all sequences by the revised simplex method: the basis starts with one pattern a length, and each
    round enters a column that the knapsack prices below zero. The knapsack sees duals drawn towards the lengths themselves, which are the
    duals of a packing without padding; where its column isn't below zero by the duals proper, it is drawn less. Ends where the padded length is
    within `gap` of all tokens, or of the bound that the duals prove, or after `max_rounds`. The work is bounded by `capacity`, not by the corpus.
    """
    lengths = np.array(sorted(n for n in counts if counts[n]), np.int64)
    m = len(lengths)
    if not m:
        return []
    exact = np.array([counts[int(n)] for n in lengths], np.int64)
    need = exact + 0.01 * (np.arange(m) * 0.618 % 1)  # no two ratios tie, so a round seldom enters a column at nothing
    columns = _first_patterns(lengths, need, capacity)
    cost = np.array([padded(int(lengths @ c), capacity) for c in columns.T], float)
    inverse = _inverted(columns)
    used = np.maximum((inverse * need).sum(1), 0)
    dual = (cost[:, None] * inverse).sum(0)
    tokens = float(lengths @ need)
    for round_ in range(max_rounds):
        if cost @ used <= tokens * (1 + gap):
            break
        for drawn in (0.9, 0.5, 0.0):
            column = _priced(lengths, drawn * lengths + (1 - drawn) * dual, capacity)
            price = padded(int(lengths @ column), capacity)
            if dual @ column > price * (1 + gap):
                break
        else:
            break
        has = np.flatnonzero(column)
        step = (inverse[:, has] * column[has]).sum(1)
        rising = np.flatnonzero(step > 1e-9)
        leaving = used[rising] / step[rising]
        leave = int(rising[np.argmin(leaving)])
        amount = float(leaving.min())
        used -= amount * step
        used[leave] = amount
        np.maximum(used, 0, out=used)
        pivot = inverse[leave] / step[leave]
        dual = dual + (price - dual @ column) * pivot
        inverse -= step[:, None] * pivot
        inverse[leave] = pivot
        columns[:, leave], cost[leave] = column, price
    left, found = exact.copy(), []
    for j in np.argsort(-(lengths @ columns) / cost, kind="stable"):
        column = columns[:, j].astype(np.int64)
        has = np.flatnonzero(column)
        times = min(int(used[j] + 0.02), int((left[has] // column[has]).min()))
        if times > 0:
            left -= times * column
            found.append(({int(lengths[i]): int(column[i]) for i in has}, times))
    return found


def _inverted(columns: np.ndarray) -> np.ndarray:
    """The inverse of an upper triangular matrix of few entries, last row first; the driver's threads of a linear algebra library aren't needed."""
    out = np.zeros_like(columns)
    for i in range(len(columns) - 1, -1, -1):
        out[i, i] = 1
        for j in np.flatnonzero(columns[i, i + 1 :]) + i + 1:
            out[i] -= columns[i, j] * out[j]
        out[i] /= columns[i, i]
    return out


def _first_patterns(lengths: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """A basis to start from: for each length, longest first, a pattern of it and shorter ones of which as many remain, filled as far
    as sums of the commonest of them reach."""
    m = len(lengths)
    columns, left = np.zeros((m, m)), need.copy()
    for i in range(m - 1, -1, -1):
        own, best = int(lengths[i]), None
        for each in range(1, min(capacity // own, 8) + 1):
            room, times = capacity - each * own, left[i] / each
            others = np.flatnonzero(left[:i] >= max(times, 1e-6))
            reached, last = 1, {}
            for k in others[np.argsort(-left[others], kind="stable")][:64]:
                new = (reached << int(lengths[k])) & ((1 << (room + 1)) - 1) & ~reached
                reached |= new
                while new:
                    last[new.bit_length() - 1] = int(k)
                    new ^= 1 << (new.bit_length() - 1)
                if reached >> room & 1:
                    break
            total = reached.bit_length() - 1
            waste = 1 - (total + each * own) / padded(total + each * own, capacity)
            if best is None or waste < best[0]:
                best = waste, each, total, last
            if not waste:
                break
        _, each, total, last = best
        columns[i, i] = each
        while total:
            columns[last[total], i] += 1
            total -= int(lengths[last[total]])
        left -= columns[:, i] * (left[i] / each)
    return columns


def _priced(lengths: np.ndarray, dual: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern whose duals are worth the most for its padded length, by a knapsack over all totals."""
    gain = np.full(capacity + 1, -np.inf)
    gain[lengths] = dual
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back = np.full(capacity + 1, -1e18)  # `value`, from its end
    back[capacity] = 0
    for total in range(1, capacity + 1):
        sums = back[capacity - total + 1 :] + gain[1 : total + 1]
        best = int(np.argmax(sums))
        last[total] = best + 1
        back[capacity - total] = value[total] = max(sums[best], -1e18)
    ratios = value / np.array([1, *(padded(t, capacity) for t in range(1, capacity + 1))])
    total, column = int(np.argmax(ratios[1:])) + 1, np.zeros(len(lengths))
    while total > 0:
        column[np.searchsorted(lengths, last[total])] += 1
        total -= int(last[total])
    return column


def layout(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> tuple[list[tuple], int]:
    """Rows (rest, from_rank, to_rank, each, position, stride), and the tokens of all: where a stream cut at every `capacity` tokens
    holds the rests of a length of these ranks, `each` of them one after the other at every `stride` tokens from `position` on.

    Patterns that fill a sequence, or a power of two of it, come first and are never cut. What would need padding is laid end to end.
    """
    rows, position, next_rank = [], 0, dict.fromkeys(counts, 0)
    found = [(sum(n * k for n, k in p.items()), p, times) for p, times in solve(counts, capacity, gap)]
    for stride, pattern, times in sorted(found, key=lambda x: (capacity % x[0] != 0, -x[0])):
        at = position
        for n, each in pattern.items():
            rows.append((n, next_rank[n], next_rank[n] + each * times, each, at, stride))
            next_rank[n] += each * times
            at += n * each
        position += stride * times
    for n in sorted(counts, reverse=True):
        if rest := counts[n] - next_rank[n]:
            rows.append((n, next_rank[n], counts[n], rest, position, n * rest))
            position += n * rest
    return rows, position


def ends_of(total: int, capacity: int) -> list[int]:
    """Where the last sequences of a stream end: what the full ones leave, cut into powers of two."""
    ends, at = [], total - total % capacity
    for k in range(capacity.bit_length() - 1, -1, -1):
        if (total - at) >> k & 1:
            ends.append(at := at + (1 << k))
    return ends


LAYOUT = "rest long, from_rank long, to_rank long, each long, position long, stride long"


def pack(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    gap: float = GAP,
) -> DataFrame:
    """A row per piece: (doc_id, doc_tokens, start, length, sequence_id, offset, ids), `ids` its tokens as little-endian unsigned 32-bit numbers."""
    spark = docs.sparkSession
    path = path or public_path("byte_bpe_50k.json")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    encoded = pin(base.mapInArrow(_encoder(path, capacity, end_id), ENCODED.format(kind)), "encoded")
    held = ["doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"]
    full = encoded.where(F.col("sequence_id").isNotNull()).withColumn("offset", F.lit(0).cast("long")).select(held)

    rests = encoded.where(F.col("sequence_id").isNull()).drop("sequence_id").withColumnRenamed("length", "rest")
    by_task = pin(rests.groupBy("rest", "task").agg(F.count("*").alias("n")), "by_task")
    counts = {r["rest"]: r["n"] for r in by_task.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # fewer rows than `capacity`
    rows, total = layout(counts, capacity, gap)
    plan = spark.createDataFrame(rows, LAYOUT)  # as bounded as the histogram
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_task.select("rest", "task", F.coalesce(before, F.lit(0)).alias("ranks_before"))
    ranked = rests.join(bases, ["rest", "task"]).withColumn("rank", F.col("ranks_before") + F.col("task_rank"))
    nth = F.col("rank") - F.col("from_rank")
    spot = F.col("position") + F.floor(nth / F.col("each")) * F.col("stride") + nth % F.col("each") * F.col("rest")
    placed = ranked.join(
        F.broadcast(plan.withColumnRenamed("rest", "of_rest")),
        (F.col("rest") == F.col("of_rest")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")),
    ).withColumn("spot", spot.cast("long"))

    def piece(sequence, begins, ends):
        low, high = F.greatest(F.col("spot"), begins), F.least(F.col("spot") + F.col("rest"), ends)
        return F.struct(
            (low - F.col("spot")).alias("at"),
            (high - low).alias("length"),
            sequence.alias("sequence_id"),
            (low - begins).alias("offset"),
            F.substring(F.col("ids"), ((low - F.col("spot")) * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("ids"),
        )

    whole = total // capacity
    first, last = F.floor(F.col("spot") / capacity), F.floor((F.col("spot") + F.col("rest") - 1) / capacity)
    cuts = F.when(
        first < whole,
        F.transform(F.sequence(first, F.least(last, F.lit(whole - 1))), lambda s: piece(s, s * capacity, (s + 1) * capacity)),
    )
    ends = ends_of(total, capacity)
    tail = F.array(*[F.struct(F.lit(whole + i).alias("s"), F.lit(b).alias("b"), F.lit(e).alias("e")) for i, (b, e) in enumerate(zip([whole * capacity, *ends], ends))]) if ends else None
    if ends:
        met = F.filter(tail, lambda x: (x["b"] < F.col("spot") + F.col("rest")) & (x["e"] > F.col("spot")))
        cut_tail = F.when(last >= whole, F.transform(met, lambda x: piece(x["s"].cast("long"), x["b"].cast("long"), x["e"].cast("long"))))
        none = F.array().cast("array<struct<at:bigint,length:bigint,sequence_id:bigint,offset:bigint,ids:binary>>")
        cuts = F.concat(F.coalesce(cuts, none), F.coalesce(cut_tail, none))
    placed = (
        placed.select("doc_id", "doc_tokens", F.col("start").alias("of"), F.inline(cuts))
        .withColumn("start", F.col("of") + F.col("at"))
        .select(held)
    )
    return full.unionByName(placed)


def op13_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: the pieces of all documents."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
