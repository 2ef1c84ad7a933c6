"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of the items is built in the driver and broadcast as flat arrays, about 100 bytes a word of the items. Items of more than
`max_item_words` words in all are taken in parts of that many, one after the other, so neither the driver nor a task ever holds more: each
part's hits are written, and a document's are united over all parts before anything is counted or cut, so the result is the same.
Documents are streamed through an automaton where they are read, without a shuffle: at each word the longest suffix of the document so far that occurs in some item is known as a state and a
length. A length of `window` words or more is a hit of the last `window` words, and the state on the suffix-link path whose strings
have that length knows the items. Items shorter than `window` count when they occur whole.

Only stretches whose neighbouring words are neighbours in some item, and which are as long as the shortest window, are walked
word by word; which stretches these are is found with arrays. Nothing else can hold a window.

Defined results: null or empty texts, and null or empty items, have no words; no items: nothing is hit; repeated items with one id
count once; null item ids are named `null`; very long texts are tokenised in blocks; rows that repeat an id are read one by one; an empty
table gives no rows; other columns are kept, and none is overwritten.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, pin, small_batches

WINDOW = 10
MAX_ITEM_WORDS = 250_000
BLOCK = 1 << 22
#: A-Z become a-z; every other ASCII character that is no digit and no a-z becomes a space; other bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_CHARS = re.compile(WORD)
SPANS = "array<struct<start: long, end: long>>"


def blocks(data: bytes, size: int = BLOCK):
    """`data` in pieces of about `size` bytes, cut where a word ends."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            cut = data.rfind(b" ", start, end)
            end = cut if cut > start else (data.find(b" ", end) if data.find(b" ", end) > 0 else len(data))
        yield data[start:end]
        start = end


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """States are numbered from the root, 0. The words that lead on from state s are `word[first[s]:first[s + 1]]`, sorted, and lead
    to the states at the same places of `to`; `owner` is the state on the suffix-link path that holds the suffix of `window` words,
    or -1; `short` lists (words, item) of the whole short items that end a state."""

    window: int
    least: int
    vocabulary: dict[bytes, int]
    pairs: np.ndarray
    first: array
    word: array
    to: array
    link: array
    length: array
    owner: array
    items: dict[int, tuple[str, ...]]
    short: dict[int, tuple[tuple[int, str], ...]]

    def step(self, state: int, w: int) -> int:
        """The state that word w leads to, or -1."""
        low, high = self.first[state], self.first[state + 1]
        i = bisect_left(self.word, w, low, high)
        return self.to[i] if i < high and self.word[i] == w else -1


def build_automaton(items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> Automaton:
    vocabulary: dict[bytes, int] = {}
    texts = [(name, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for name, words in items]
    texts = [(name, ids) for name, ids in texts if ids]
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def copy_of(p: int, w: int, q: int) -> int:
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        made = len(nxt) - 1
        link[q] = made
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = made
            p = link[p]
        return made

    def extend(last: int, w: int) -> int:
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else copy_of(last, w, q)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(nxt) - 1, last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else copy_of(p, w, q)
        return new

    for _, ids in texts:
        last = 0
        for w in ids:
            last = extend(last, w)

    owner = [-1] * len(nxt)
    for s in sorted(range(1, len(nxt)), key=length.__getitem__):
        if length[s] >= window:
            owner[s] = owner[link[s]] if length[link[s]] >= window else s
    found: dict[int, set[str]] = {}
    own_short: dict[int, set[tuple[int, str]]] = {}
    pairs = set()
    for name, ids in texts:
        pairs.update(a * len(vocabulary) + b for a, b in zip(ids, ids[1:], strict=False))
        s = 0
        for w in ids:
            s = nxt[s][w]
            if owner[s] >= 0:
                found.setdefault(owner[s], set()).add(name)
        if len(ids) < window:
            own_short.setdefault(s, set()).add((len(ids), name))
    short: dict[int, tuple[tuple[int, str], ...]] = {}
    if own_short:
        for s in sorted(range(1, len(nxt)), key=length.__getitem__):
            if ends := short.get(link[s], ()) + tuple(sorted(own_short.get(s, ()))):
                short[s] = ends
    arrows = [sorted(x.items()) for x in nxt]
    return Automaton(
        window,
        min([min(len(ids), window) for _, ids in texts], default=window),
        vocabulary,
        np.array(sorted(pairs), dtype=np.int64),
        array("q", np.cumsum([0, *map(len, arrows)])),
        array("q", (w for x in arrows for w, _ in x)),
        array("q", (q for x in arrows for _, q in x)),
        array("q", link),
        array("q", length),
        array("q", owner),
        {s: tuple(sorted(names)) for s, names in found.items()},
        short,
    )


def stretches(ids: np.ndarray, a: Automaton) -> list[tuple[int, int]]:
    """[start, end) of the maximal runs of known words whose neighbours are neighbours in an item, if long enough."""
    known = ids >= 0
    if a.least > 1:
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        if at.size and a.pairs.size:
            keys = ids[at].astype(np.int64) * len(a.vocabulary) + ids[at + 1]
            place = np.minimum(np.searchsorted(a.pairs, keys), a.pairs.size - 1)
            joined[at] = a.pairs[place] == keys
        else:
            joined[:] = False
        edge = np.diff(np.concatenate(([0], joined.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    else:
        edge = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = ends - starts >= a.least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def walk(ids: list[int], a: Automaton, base: int, spans: list[list[int]], names: set[str]) -> None:
    """Stream one stretch through the automaton; adds hit spans [start, end) in word positions and the items."""
    state = matched = 0
    step, link, length, owner, short, window = a.step, a.link, a.length, a.owner, a.short, a.window
    for i, w in enumerate(ids):
        to = step(state, w)
        while to < 0 and state:
            state = link[state]
            matched = length[state]
            to = step(state, w)
        if to < 0:
            continue
        state, matched = to, matched + 1
        back = 0
        for size, name in short.get(state, ()):
            if size <= matched:
                names.add(name)
                back = max(back, size)
        if matched >= window:
            names.update(a.items[owner[state] if length[link[state]] >= window else state])
            back = window
        if back:
            start, end = base + i + 1 - back, base + i + 1
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, end])


def match(text: str | None, a: Automaton) -> tuple[int, list[list[int]], list[str]]:
    """(words, hit spans in word positions, items) of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    get, parts = a.vocabulary.get, []
    for piece in blocks(data):
        words = piece.split()
        parts.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
    spans: list[list[int]] = []
    names: set[str] = set()
    if a.vocabulary and ids.size >= a.least:
        for start, end in stretches(ids, a):
            walk(ids[start:end].tolist(), a, start, spans, names)
    return ids.size, spans, sorted(names)


def cut(text: str, spans: list[list[int]]) -> str:
    """`text` without the characters from the first to the last word of each span; what surrounded them is kept."""
    places = [(m.start(), m.end()) for m in WORD_CHARS.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def item_parts(rows: Iterable[tuple[str, str | None]], max_words: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in lists of at most `max_words` words. An item longer than that is cut into pieces that share window - 1 words,
    so each of its windows is whole in one piece."""
    size, part = max(max_words, window), []
    left = size
    for name, text in rows:
        words = words_of(text)
        for a in range(0, max(1, len(words) - window + 1), size - window + 1) if len(words) > size else (0,):
            piece = words[a : a + size]
            if len(piece) > left and part:
                yield part
                part, left = [], size
            part.append((name, piece))
            left -= len(piece)
    if part:
        yield part


def load_items(items: DataFrame, id_col: str, text_col: str, max_item_words: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, streamed to the driver a part at a time."""
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("i"), F.col(f"`{text_col}`").alias("t"))
    return item_parts(((r.i, r.t) for r in rows.toLocalIterator()), max_item_words, window)


def found_in(
    docs: DataFrame, text_col: str, items: Iterator[list[tuple[str, list[bytes]]]], window: int, cutting: bool = False
) -> Column | DataFrame:
    """What the items hit of each text: a column struct<n, spans, items> where the items are one part, with the `text` less
    its hit spans if asked; else, written part by part, a table (key, spans, items) of the texts that are hit, `key` their SHA-256."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)

    def scan(part, cutting=False):
        held = context.broadcast(build_automaton(part, window))

        @F.pandas_udf(f"struct<n: long, spans: {SPANS}, items: array<string>{', text: string' if cutting else ''}>")
        def hits(texts: pd.Series) -> pd.DataFrame:
            rows = [match(t, held.value) for t in texts]
            made = {"n": [n for n, _, _ in rows], "spans": [as_structs(s) for _, s, _ in rows], "items": [names for _, _, names in rows]}
            if cutting:
                made["text"] = [cut(t, s) if s else None for t, (_, s, _) in zip(texts, rows, strict=True)]
            return pd.DataFrame(made)

        return hits.asNondeterministic()(F.col(f"`{text_col}`"))  # so that it is run once, not again for each use

    first, second = next(items, []), next(items, None)
    if second is None:
        return scan(first, cutting)
    tables = []
    for part in chain((first, second), items):
        seen = docs.select(F.sha2(F.col(f"`{text_col}`"), 256).alias("key"), scan(part).alias("found"))
        tables.append(pin(seen.where(F.size("found.spans") > 0).select("key", "found.spans", "found.items"), "hits"))
    table = tables[0]
    for other in tables[1:]:
        table = table.union(other)

    @F.pandas_udf(SPANS)
    def united(spans: pd.Series) -> pd.Series:
        return spans.map(lambda found: as_structs(merged(sorted((s["start"], s["end"]) for s in found))))

    gathered = table.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    return pin(gathered.select("key", united("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items")), "united")


def as_structs(spans) -> list[dict]:
    return [{"start": s, "end": e} for s, e in spans]


def merged(spans) -> list[list[int]]:
    """Sorted spans, those that touch as one."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def with_hits(docs: DataFrame, text_col: str, found: Column | DataFrame, name: str) -> DataFrame:
    """`docs` with a column `name`: struct<n, spans, items>."""
    if isinstance(found, Column):
        return docs.withColumn(name, found)
    text, none = F.col(f"`{text_col}`"), F.array()
    key, hit = free_name(docs, "__key"), free_name(docs, "__hit")
    hits = found.select(F.col("key").alias(key), F.struct("spans", "items").alias(hit))
    return docs.join(hits, F.sha2(text, 256) == F.col(key), "left").select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n"),
            F.coalesce(f"{hit}.spans", none.cast(SPANS)).alias("spans"),
            F.coalesce(f"{hit}.items", none.cast("array<string>")).alias("items"),
        ).alias(name),
    )


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_item_words: int = MAX_ITEM_WORDS,
) -> DataFrame:
    """A row per document: (doc_id, n_words, n_hit, hit_spans, item_ids), spans as [start, end) word positions."""
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = found_in(named, "text", load_items(items, item_id_col, item_text_col, max_item_words, window), window)
    return with_hits(named, "text", found, "f").select(
        "doc_id", F.col("f.n").alias("n_words"), hit_words(F.col("f.spans")).alias("n_hit"), F.col("f.spans").alias("hit_spans"), F.col("f.items").alias("item_ids")
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
    length_col: str | None = "n_chars",
    max_item_words: int = MAX_ITEM_WORDS,
) -> DataFrame:
    """`docs` with the hit spans cut from the texts and `length_col`, where there is one, set anew. A document of whose words
    more than `max_coverage` are hit goes. Rows that are not hit stay as they are, null texts included."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        cuts = ([(s["start"], s["end"]) for s in found] for found in spans)
        return pd.Series([cut(t, found) if found else None for t, found in zip(texts, cuts, strict=True)], dtype=object)

    name = free_name(docs, "__found")
    items_found = found_in(docs, text_col, load_items(items, item_id_col, item_text_col, max_item_words, window), window, cutting=True)
    made = with_hits(docs, text_col, items_found, name)
    made = made.where(hit_words(F.col(f"{name}.spans")) <= F.col(f"{name}.n") * max_coverage)
    was = F.col(f"`{text_col}`")
    hit = F.size(f"{name}.spans") > 0
    new = F.col(f"{name}.text") if isinstance(items_found, Column) else without(was, F.col(f"{name}.spans"))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.when(hit, new).otherwise(was).alias(c))
        elif c == length_col:
            columns.append(F.when(hit, F.char_length(new).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return made.select(*columns)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query: what of the benchmark each document holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
iw AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
hits AS (SELECT dg.doc_id, dg.i, dg.k, win.item_id FROM dg JOIN win ON dg.k = win.k AND dg.gram = win.gram),
hit_words AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
"""
