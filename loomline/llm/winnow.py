"""Document fingerprints by winnowing, with DataFrame functions only.

Words are hashed, runs of `k` words give k-gram hashes at every word position, and of each window of `w` neighbouring k-grams the smallest is
kept, the rightmost of equal ones, with its position. Two texts that share w + k - 1 words in a row share a fingerprint, and its
positions say where. A hash and a position share one long: 36 bits of hash above 27 bits that fall with the position, so the
minimum of longs is the smallest hash with the rightmost tie. A window's minimum comes from doubling: each pass takes the lesser of two
neighbours that are already minima, log2(w) passes in all.

Likeness is the Jaccard similarity of the sets of hashes. Defined results: null is as an empty text; a text without words has an
empty fingerprint, alike (1.0) to another such and to nothing else (0.0); one of fewer than k words has one gram; texts
with fewer than w k-grams have one window; only texts of over 2**27 words (134 million) have positions that wrap; a null id comes
first; rows that repeat an id follow each other by text, in one task; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 5, 8
POSITION_BITS = 27
LAST = (1 << POSITION_BITS) - 1
CELL = 2048
CROWDED = 8192
BROADCAST_ROWS = 500_000
NO_ID = -(1 << 62)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once: inside a lambda, a column that another lambda uses is computed again for
    each element, a lambda's own variable is not."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """Array of longs: the kept minima, by position."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    hashes = F.transform(words, lambda x: F.xxhash64(x))

    def grams(h: Column) -> Column:
        packed = lambda g, i: F.shiftleft(F.shiftrightunsigned(g, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(
            F.lit(LAST) - i.cast("long").bitwiseAND(F.lit(LAST))
        )
        many = F.transform(h, lambda x, i: packed(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]), i))
        return F.when(F.size(h) >= k, F.slice(many, F.lit(1), F.size(h) - (k - 1))).when(
            F.size(h) > 0, F.array(packed(F.xxhash64(h), F.lit(0)))
        ).otherwise(F.array().cast("array<long>"))

    def minima(g: Column) -> Column:
        def widen(done: int, m: Column) -> Column:
            if done >= w:
                return m
            step = min(done, w - done)
            return let(F.transform(m, lambda x, i: F.least(x, F.get(m, i + step))), lambda n: widen(done + step, n))

        full = F.slice(widen(1, g), F.lit(1), F.greatest(F.size(g) - (w - 1), F.lit(1)))
        return F.when(F.size(g) == 0, g).otherwise(F.array_distinct(full))

    return let(let(hashes, grams), minima)


def hash_set(fingerprints: Column) -> Column:
    return F.array_distinct(F.transform(fingerprints, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Of two hash sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def shown(fingerprints: Column) -> Column:
    """`hash@position,...`, hashes in hexadecimal."""
    return F.array_join(
        F.transform(
            fingerprints,
            lambda x: F.concat(
                F.lower(F.hex(F.shiftrightunsigned(x, POSITION_BITS))),
                F.lit("@"),
                (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("string"),
            ),
        ),
        ",",
    )


def next_in_order(ids: DataFrame) -> DataFrame:
    """`ids`: (c), distinct longs. Returns (c, following), the last followed by the first. Windows run inside groups of CELL
    neighbouring numbers and over the groups' firsts, by the same rule, so none has more rows than that until few are left."""
    grouped = ids.select("c", F.floor(F.col("c") / CELL).alias("g"))
    tops = grouped.groupBy("g").agg(F.min("c").alias("first"))
    if tops.count() <= CELL:
        order = Window.orderBy("g")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends = tops.select("g", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("after"))
    else:
        upper = next_in_order(tops.select(F.col("g").alias("c")))
        firsts = tops.select(F.col("g").alias("following"), F.col("first").alias("after"))
        ends = upper.join(firsts, "following").select(F.col("c").alias("g"), "after")
    inside = F.lead("c").over(Window.partitionBy("g").orderBy("c"))
    return grouped.withColumn("inside", inside).join(ends, "g").select("c", F.coalesce("inside", "after").alias("following"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` (doc_id long, text, ...) with `next_<column>` of the document that follows in order of doc_id, then text; the first
    follows the last.

    Rows are dealt into cells of neighbouring ids, and the first document of each cell is also dealt to the cell before, so that one
    shuffle brings every document and its follower together. Distinct ids can't crowd a cell of CELL numbers; wider cells are
    used where ids are sparse, if a count shows that none of them is crowded.
    """
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"))
    low, high, rows = ids.where(F.col("id") != NO_ID).agg(F.min("id"), F.max("id"), F.count("*")).first()
    width = CELL
    if rows and (high - low + 1) / rows > 2:
        wide = CELL * int((high - low + 1) / rows)
        most = ids.groupBy(F.floor(F.col("id") / wide)).count().agg(F.max("count")).first()[0]
        width = wide if most <= CROWDED else CELL
    cell = lambda c: F.floor(c / width)
    firsts = ids.groupBy(cell(F.col("id")).alias("c")).agg(F.min("id").alias("first_id"))
    order = next_in_order(firsts.select("c"))
    heads = (
        firsts.join(order.select(F.col("following").alias("c"), F.col("c").alias("previous")), "c")
        .select(F.col("c").alias("h_cell"), "first_id", "previous")
    )
    if heads.count() <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    keyed = docs.withColumn("id", F.coalesce(F.col("doc_id"), F.lit(NO_ID))).withColumn("cell", cell(F.col("id")))
    dealt = keyed.join(heads, (F.col("cell") == F.col("h_cell")) & (F.col("id") == F.col("first_id")), "left").withColumn(
        "at",
        F.explode(
            F.when(
                F.col("previous").isNotNull(),
                F.array(
                    F.struct(F.col("cell").alias("cell"), F.lit(False).alias("guest")),
                    F.struct(F.col("previous").alias("cell"), F.lit(True).alias("guest")),
                ),
            ).otherwise(F.array(F.struct(F.col("cell").alias("cell"), F.lit(False).alias("guest"))))
        ),
    )
    along = Window.partitionBy("at.cell").orderBy("at.guest", "id", "text")
    followed = dealt.select("*", *[F.lead(c).over(along).alias(f"next_{c}") for c in columns])
    return followed.where("not at.guest").drop("id", "cell", "h_cell", "first_id", "previous", "at")


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    """Contract query: every text, its edited text, and the likeness of their fingerprints and of the next document's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    followed = with_next(docs.withColumn("fp", fingerprint(F.col("text"))), ["text", "fp"])
    n = F.char_length("text")
    q = F.floor(n / 4).cast("int")
    edited = followed.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q)).alias("edited"),
        "fp",
        "next_fp",
    ).withColumn("edited_fp", fingerprint(F.col("edited")))
    return (
        edited.select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            shown(F.col("fp")).alias("fingerprint"),
            shown(F.col("edited_fp")).alias("edited_fingerprint"),
            hash_set(F.col("fp")).alias("own"),
            hash_set(F.col("edited_fp")).alias("changed"),
            hash_set(F.col("next_fp")).alias("other"),
        )
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("other")).alias("near_next"),
        )
    )
