"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import json
import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import chat, decontaminate, langid, mixing, neardup, pii, queries, suffixdedup, toxicity, warc, winnow
from loomline.llm.components import components
from loomline.llm.scratch import new_path
from loomline.llm.wordhash import SPACED

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]


def docs_of(spark, texts, ids=None):
    """A table with columns whose names clash with those of results."""
    rows = [(i, t, "en", f"s{i % 3}" if i is not None and i % 4 else None, len(t or ""), "clash", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOC)


def said(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward():
    """Nulls, empty, blank, one word, no word ends, repeated, long, odd characters."""
    return [None, "", "   \n", "one", "x" * 3000, said(60, 1), said(60, 1), said(5000, 2), "Ünïcode ＠ 文字 ퟿\U0001f600 text", "a b", "a b c"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        text = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), "~").astype(str).replace(r"\.0$", "", regex=True).to_numpy()))
        assert text(got) == text(want)


# words and components


def test_word_hashes():
    first, again = SPACED.hashes("aa bb  cc").tolist(), SPACED.hashes(" CC\taa ").tolist()
    assert again == [first[2], first[0]] and len(set(first)) == 3 and not SPACED.hashes(None).size and not SPACED.hashes(" ").size
    for text in ("aa " * 5000, "q" * 5000 + " aa", "aa " + "q" * 5000, "é" * 3000):
        want = [w.encode() for w in text.split()]
        assert [w for words in SPACED.blocks(text, 64) for w in words] == want and SPACED.hashes(text).size == len(want)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(40)] + [(500, 500)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got[start] == min(seen)
    assert set(got) == set(near)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def brute_repeats(texts, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    where = {}
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, i))
    out = [(set(), set()) for _ in words]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                out[d][0].update(range(i, i + n))
                if (d, i) != min(places):
                    out[d][1].update(range(i, i + n))
    return out


def test_suffix_dedup(spark):
    shared, hot = said(13, 100), said(20, 101)
    texts = [said(30, i) for i in range(12)]
    texts += [f"{said(9, 200 + i)} {shared} {said(i, 300 + i)} {hot} {said(7, 400 + i)}" for i in range(9)]
    texts += [hot, f"{hot} {hot}", texts[0], texts[3][:60] + " " + texts[4], *awkward()]
    got = suffixdedup.repeated_passages(docs_of(spark, texts), min_words=12, k=4).collect()
    want = brute_repeats(texts, 12)
    spread = lambda spans: {i for s in spans for i in range(s["start"], s["end"])}
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        assert (spread(r.spans), spread(r.later_spans)) == want[r.doc_id], r.doc_id
    cut = {r.doc_id: r.text for r in suffixdedup.remove_later(docs_of(spark, texts), min_words=12, k=4).collect()}
    for d, t in enumerate(texts):
        keep = [w for i, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", t or "")) if i not in want[d][1]]
        assert (cut[d] or "").split() == " ".join(keep).split()
    assert suffixdedup.repeated_passages(docs_of(spark, []), min_words=12, k=4).count() == 0
    odd = docs_of(spark, [texts[12], texts[13], said(4, 1)], [None, 2**60 + 1, 2**60 + 3])
    odd = {r.doc_id: (spread(r.spans), spread(r.later_spans)) for r in suffixdedup.repeated_passages(odd, min_words=12, k=4).collect()}
    want = brute_repeats([texts[12], texts[13], said(4, 1)], 12)
    assert odd == {None: want[0], 2**60 + 1: want[1], 2**60 + 3: want[2]}
    with pytest.raises(ValueError):
        suffixdedup.repeated_passages(docs_of(spark, []), min_words=100, k=4)


# 2


def test_decontamination(spark):
    items = [said(25, 1), said(12, 2), said(10, 3), "Just three words", "", None, said(25, 1), said(14, 4) + " " + said(12, 2)]
    texts = [said(40, 9) + " " + items[0].upper() + " " + said(9, 8), items[1][3:], "so: just, THREE words! yes", " ".join(items[2].split()[:9]), *awkward()]
    texts += [said(20, 11) + " " + " ".join(items[7].split()[8:20]) + " " + said(5, 12)]
    idf = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, texts), idf).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    for d, t in enumerate(texts):
        w, hit, names = split(t), set(), set()
        for i, item in enumerate(items):
            iw = split(item)
            n = min(10, len(iw))
            for a in range(len(iw) - n + 1) if iw else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == iw[a : a + n]:
                        hit.update(range(b, b + n))
                        names.add(str(i))
        assert (got[d].n_words, got[d].n_hit, got[d].item_ids) == (len(w), len(hit), sorted(names)), d
    clean = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(spark, texts), idf).collect()}
    assert 1 not in clean and clean[3].text == texts[3] and clean[4].text is None
    assert clean[0].text.split() == (said(40, 9) + " " + said(9, 8)).split() and clean[0].n_chars == len(clean[0].text)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs_of(spark, texts), none).count() == len(texts)
    for bound in (1, 15, 40):  # items in parts, long ones in pieces
        parts = decontaminate.contamination(docs_of(spark, texts), idf, max_item_words=bound).collect()
        assert {r.doc_id: r for r in parts} == got
        again = decontaminate.decontaminate(docs_of(spark, texts), idf, max_item_words=bound)
        assert {r.doc_id: r for r in again.collect()} == clean and again.columns == docs_of(spark, []).columns
    repeated = docs_of(spark, [texts[0], texts[0], texts[2], None, items[2]], [7, 7, 7, None, None])
    for bound in (15, 10**6):
        rows = sorted((r.doc_id or -1, r.n_hit) for r in decontaminate.contamination(repeated, idf, max_item_words=bound).collect())
        assert rows == [(-1, 0), (-1, 10), (7, 3), (7, 25), (7, 25)]
    assert decontaminate.contamination(docs_of(spark, []), idf).count() == 0


def test_decontamination_blocks():
    a = decontaminate.build_automaton([("i", decontaminate.words_of(said(12, 5)))])
    text = said(3000, 6) + " " + said(12, 5) + " " + said(3000, 7)
    whole = decontaminate.match(text, a)
    size, decontaminate.BLOCK = decontaminate.BLOCK, 64
    decontaminate.blocks.__defaults__ = (64,)
    try:
        assert decontaminate.match(text, a) == whole and whole[1]
    finally:
        decontaminate.blocks.__defaults__ = (size,)
        decontaminate.BLOCK = size


# 3


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.QUERIES["op3_langid"](spark, sf_dir).join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_edges(spark):
    texts = [*awkward(), "123 456 !!", *["the cat and the dog " * 5] * 3]
    filters = langid.fit(docs_of(spark, texts[-3:]))
    got = [r.language for r in langid.predict(docs_of(spark, texts), filters).orderBy("doc_id").collect()]
    assert [g.lang_pred for g in got[:3]] == ["und"] * 3 and got[11].lang_pred == "und" and got[-1].lang_pred == "en" and got[-1].score > 0.9
    empty = langid.fit(docs_of(spark, []))
    assert {r.language.lang_pred for r in langid.predict(docs_of(spark, texts), empty).collect()} == {"und"}
    kept = langid.keep_identified(docs_of(spark, texts), filters)
    assert kept.columns == docs_of(spark, []).columns and kept.where("doc_id >= 12").count() == 3


def test_bloom_filters_are_bit_sliced():
    r = np.random.RandomState(1)
    grams = {f"l{i:02}": r.randint(0, 1 << 62, 2000).astype(np.uint64) for i in range(70)}
    f = langid.LanguageFilters.of(grams)
    for i, g in enumerate(grams.values()):
        assert ((f.masks(g)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = r.randint(0, 1 << 62, 20000).astype(np.uint64)
    rate = ((f.masks(other)[:, 0]) & np.uint64(1)).mean()
    assert abs(rate - f.false_positive[0]) < 0.01


def test_language_blocks():
    f = langid.LanguageFilters.of({"a": np.unique(np.concatenate([h for h, _ in langid.gram_hashes(["some words here"])]))})
    texts = [said(400, 1), "x" * 5000, "ab " * 900, "é, İ! " * 700, said(3, 2), "", "..." * 900]
    grams = lambda: [Counter((i, int(h)) for hs, owners in langid.gram_hashes(texts) for h, i in zip(hs, owners, strict=True))]
    whole, counted = f.counts(texts)[1].tolist(), grams()
    size = langid.BLOCK
    try:
        for langid.BLOCK in (7, 100, 1000):
            assert f.counts(texts)[1].tolist() == whole and grams() == counted
    finally:
        langid.BLOCK = size


def test_language_by_counting(spark):
    """Against counts of plain sets of n-grams: the filters' error, corrected, is all that may differ."""
    r = random.Random(9)
    alphabets = {"aa": "abcdefg", "bb": "efghijk", "cc": "abijxyz"}
    speak = lambda a, n: " ".join("".join(r.choice(alphabets[a]) for _ in range(r.randrange(2, 7))) for _ in range(n))
    texts = [(a, speak(a, 300)) for a in alphabets for _ in range(8)] + [(a, speak(a, r.randrange(1, 30))) for a in alphabets for _ in range(30)]
    rows = [(i, t, a) for i, (a, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(docs.where("doc_id < 24"))

    def plain(text):
        marked = [f"\0{w}\0" for w in re.findall(r"[^\W\d_]+", text.lower())]
        return [w[i : i + n] for n in langid.ORDERS for w in marked for i in range(len(w) - n + 1)]

    known = {}
    for a in alphabets:
        counted = Counter(g for x, t in texts[:24] if x == a for g in plain(t))
        known[a] = {g for g, n in counted.items() if n >= langid.MIN_SHARE * counted.total()}
    for row in langid.predict(docs, filters).collect():
        grams = plain(row.text)
        share = {a: sum(g in k for g in grams) / len(grams) for a, k in known.items()}
        best = max(share.values())
        assert abs(row.language.score - best) < 0.1, row
        if sorted(share.values())[-2] < best - 0.15:
            assert share[row.language.lang_pred] == best
    clash = docs.withColumn("language", F.lit("own"))
    got = langid.predict(clash, filters)
    assert got.columns == [*clash.columns, "language_"] and got.where("language = 'own'").count() == len(texts)
    with pytest.raises(ValueError):
        langid.fit(docs, max_languages=2)


# 4


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii_base():
    r = random.Random(5)
    parts = ["a.b@c.de", "@", "x@y", "x@y.z@w.v", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (446) 555-8962", "+123", "++49 30 1234567", "..", " ", "é", "12", "_%@a-b.c."]
    for _ in range(3000):
        text = "".join(r.choice(parts) + r.choice(["", " ", "-", "."]) for _ in range(r.randrange(12)))
        assert pii.find(text)[0] == brute_pii(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("mail john dot smith at example dot co dot uk now", "email", "john dot smith at example dot co dot uk"),
        ("mail j.smith at example.com now", "email", "j.smith at example.com"),
        ("mail jo(at)ex.com", "email", "jo(at)ex.com"),
        ("mail аlice＠example.com", "email", "аlice＠example.com"),
        ("host 10[.]0[.]0[.]1 up", "ip", "10[.]0[.]0[.]1"),
        ("host 10 dot 0 dot 0 dot 1 up", "ip", "10 dot 0 dot 0 dot 1"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("call plus one four four six five five five eight nine six two ok", "phone", "plus one four four six five five five eight nine six two"),
        ("card ４１１１１１１１１１１１１１１１ ok", "card", "４１１１１１１１１１１１１１１１"),
        ("mail a​b@ex­.com", "email", "a​b@ex­.com"),
    ],
)
def test_pii_disguises(text, kind, found):
    base, spans = pii.find(text)
    assert set(base) <= set(spans)
    assert (text.index(found), text.index(found) + len(found), pii.KINDS.index(kind)) in spans
    assert found not in pii.redact(text)


@pytest.mark.parametrize("text", ["look at example.com please", "the dot product at two or three", "one two three go", "meet at noon dot", "Привет, мир", ""])
def test_pii_leaves_prose(text):
    assert pii.find(text) == ([], []) and pii.redact(text) == text


PARTS = ["john", "a.b", "j_s", " ", "  ", "\t", " at ", " AT ", "(at)", " [ at ] ", "@", " @ ", "&#64;", "%40", ".", " dot ", "[.]", "( dot )", "&#46;", "%2E", "ex", "com", "10", "255", "0", "x-y", "(", "]", "é", "dot", "at"]


def brute_at_and_dot(text):
    """The same disguises by backtracking patterns over the whole text before each at sign."""
    blank = r"[ \t]*"
    dot = rf"(?:{blank}[(\[{{<]{blank}(?:dot|\.){blank}[)\]}}>]{blank}|[ \t]+dot[ \t]+|&#46;|%2e)"
    at = re.compile(rf"(?={blank}[(\[{{<]{blank}(?:at|@){blank}[)\]}}>]|[ \t]+(?:at|@)[ \t]+|@|&#64;|&commat;|%40)(?:{blank}[(\[{{<]{blank}(?:at|@){blank}[)\]}}>]{blank}|[ \t]+(?:at|@)[ \t]+|@|&#64;|&commat;|%40)", re.I)
    host = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{dot})[A-Za-z0-9-]+)+", re.I)
    name = re.compile(rf"(?:[A-Za-z0-9_%+-]+(?:\.|{dot}))*[A-Za-z0-9_%+-]+$", re.I)
    out, last, place = [], 0, 0
    while m := at.search(text, place):
        place = m.start() + 1
        if m.start() and text[m.start()] in " \t" and text[m.start() - 1] in " \t":
            continue
        h, n = host.match(text, m.end()), name.search(text[last : m.start()]) if m.start() >= last else None
        if not h or not n:
            continue
        hidden_name = [x.span() for x in re.finditer(dot, text[: m.start()], re.I) if x.start() >= last + n.start()]
        hidden = [x.span() for x in re.finditer(dot, text[: h.end()], re.I) if x.start() >= m.end()]
        if not hidden and not hidden_name and (m[0] == "@" or m[0].strip().lower() == "at" and not re.search("[0-9._]", n[0])):
            continue
        out += [(last + n.start(), h.end())]
        last = place = h.end()
    return out


def test_pii_disguises_by_brute_force():
    """Spans of e-mail addresses with disguised signs, against backtracking patterns; each must be found whole."""
    r, found = random.Random(11), 0
    for _ in range(6000):
        noise = lambda n: "".join(r.choice(PARTS) for _ in range(r.randrange(n)))
        sign, dot = lambda: r.choice(PARTS[6:14]), lambda: r.choice([".", *PARTS[14:19]])
        text = noise(5) + "jo" + dot() + "ex" + sign() + "ex" + dot() + "com" + noise(5) if r.random() < 0.5 else noise(14)
        if re.search(r"(?i)\b(dot|at)\s+(dot|at)\b|%2e|%40", text):
            continue  # where signs share blanks or letters, patterns and walking choose differently
        edits = pii.at_and_dot(text)
        made = pii.Edited(text, edits)
        for s, e in brute_at_and_dot(text):
            found += 1
            inside = [x for x in edits if s <= x[0] < e]
            assert inside and any(x[2] == "@" for x in inside), text
            plain = text[s:e]
            for a, b, new in reversed(inside):
                plain = plain[: a - s] + new + plain[b - s :]
            assert plain in made.text and pii.emails(plain) == [(0, len(plain))], (text, plain)
    assert found > 300


def test_pii_long_names():
    label = "b" * 330
    for text in (f"a.{label} at host.com", f"john [dot] {label} [at] host [dot] com", f"x@{label} dot {label} dot com"):
        assert pii.find(f"see {text} now")[1][-1] == (4, 4 + len(text), 0)


@pytest.mark.parametrize("piece", [" ", "\t", "( ", "(at", " at ", " dot ", "[.]", "a dot ", "a at b dot ", "x(at)y", "@", "a%40", "one ", "plus ", "1 dot ", "1[.]", "a@b.", "+1 ", "\u200b", "а", "１"])
def test_pii_linear(piece):
    text = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - began < 6
    text = "a" + piece * (1_000_000 // len(piece)) + "@b dot c"
    began = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - began < 6


def test_pii_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_pii"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = brute_pii(texts[r.doc_id])
        shown = [f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in base) for k in range(4)]


def test_pii_documents(spark):
    texts = [*awkward(), "x a@b.cd y 1.2.3.4", "+" + "1" * 200000, "a" * 200000 + "@", "@" * 50000, "1." * 100000]
    got = pii.redact_documents(docs_of(spark, texts))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.columns == docs_of(spark, []).columns and rows[0].text is None and rows[11].text == "x <EMAIL> y <IP>" and rows[11].n_chars == 16
    assert pii.personal_data(docs_of(spark, [])).count() == 0


# 5


def brute_near(texts, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sets, label


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    r = random.Random(k)
    texts = [*awkward()]
    for g in range(6):
        base = said(r.choice([8, 40, 120]), 50 + g).split()
        for _ in range(12):
            w = base.copy()
            for _ in range(r.randrange(9)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w))
    sets, label = brute_near(texts, k, percent)
    got = {x.doc_id: x for x in neardup.near_duplicates(docs_of(spark, texts), k=k, percent=percent).collect()}
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), label[i], label[i] == i), i
    kept = neardup.drop_near_duplicates(docs_of(spark, texts), k=k, percent=percent)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(label))


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0
    same = docs_of(spark, ["a b c d e f"] * 4, [7, 7, 3, None])
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(same).collect())
    assert got == [(-1, -1, True), (3, 3, True), (7, 3, False), (7, 3, False)]


def test_near_duplicates_repeated_ids(spark):
    """Rows that repeat an id are documents of their own."""
    a, b = said(60, 1), said(60, 2)
    texts, ids = [a, b, a, a + " x", b, None, b], [7, 7, 7, 9, 3, 7, None]
    got = neardup.near_duplicates(docs_of(spark, texts, ids)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, True), (3, 3, True), (7, 3, False), (7, 7, True), (7, 7, True), (7, 7, True), (9, 7, False)
    ]
    kept = neardup.drop_near_duplicates(docs_of(spark, texts, ids)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted([(-1, b), (3, b), (7, a), (7, a), (7, "")])


def test_different_words_never_link(spark):
    """Words whose polynomials modulo 2**64 agree: of the Thue-Morse sequence and its complement."""
    s = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = ["one two " + s, "one two " + s.translate(str.maketrans("ab", "ba"))]
    got = neardup.near_duplicates(docs_of(spark, texts), k=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1)]


def test_exact_sets_in_parts():
    text = said(400, 3)
    words = text.split()
    want = {" ".join(words[i : i + 3]).encode() for i in range(len(words) - 2)}
    assert neardup.shingles(text, 3) == want
    parts = [neardup.shingles(text, 3, p, 4) for p in range(4)]
    assert set().union(*parts) == want and sum(map(len, parts)) == len(want)
    hashes, n, digest = neardup.exact_set(text, 3)
    again = neardup.exact_set(f"{text} {text}".replace(" ", "\n", 3), 3)
    assert n == hashes.size == len(want) and digest == neardup.exact_set("  " + text, 3)[2] != again[2] and again[1] == n + 2
    assert neardup.exact_set("a b", 3)[1:] != neardup.exact_set("b a", 3)[1:] and neardup.exact_set(None, 3)[1] == 0
    other, size = " ".join(words[100:]), neardup.PART_BYTES
    whole = neardup.shared_and_all(text, other, 3)
    limit = neardup.SPACED.blocks.__func__.__globals__["LIMIT"]
    try:
        neardup.PART_BYTES = 500
        neardup.SPACED.blocks.__func__.__globals__["LIMIT"] = 100
        part, neardup.PART = neardup.PART, 90
        assert neardup.exact_set(text, 3)[1:] == (n, digest) and neardup.exact_set("a b", 3)[1] == 1
        assert neardup.shared_and_all(text, other, 3) == whole == (298, 398) and neardup.shingles(text, 3) == want
    finally:
        neardup.PART_BYTES, neardup.PART = size, part
        neardup.SPACED.blocks.__func__.__globals__["LIMIT"] = limit


def test_alike_but_not_linked(spark):
    """Texts made from one of 200 words by five replaced words each are about 0.74 alike; hardly a pair of them may be compared by words."""
    base, compared = said(200, 77).split(), []
    confirm = neardup.confirmed

    def counting(pairs, *more):
        compared.append(pairs.count())
        return confirm(pairs, *more)

    neardup.confirmed = counting
    try:
        for n in (60, 120):
            r, texts = random.Random(n), []
            for i in range(n):
                w = base.copy()
                for j in r.sample(range(200), 5):
                    w[j] = f"own{i}x{j}"
                texts.append(" ".join(w))
            sets, label = brute_near(texts, 5, 80)
            got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs_of(spark, texts)).collect()}
            assert [got[i] for i in range(n)] == label
    finally:
        neardup.confirmed = confirm
    assert compared[1] < 120 and compared[3] < 240, compared


def test_sketch_estimates():
    r = np.random.RandomState(2)
    for share in (0.5, 0.85):
        errors = []
        for _ in range(60):
            pool = np.unique(r.randint(0, 1 << 62, 3000).astype(np.uint64) << np.uint64(2))
            n = int(len(pool) * share)
            a, b = pool[: n + (len(pool) - n) // 2], np.concatenate((pool[:n], pool[n + (len(pool) - n) // 2 :]))
            rows = np.zeros((2, neardup.BUCKETS), np.uint16)
            filled = np.zeros((2, neardup.BUCKETS), bool)
            for i, s in enumerate((np.sort(a), np.sort(b))):
                bucket, value = neardup.registers(s)
                rows[i, bucket], filled[i, bucket] = value, True
            neardup.densify(rows, filled)
            errors.append(neardup.estimated(rows[:1].view(np.int64), rows[1:].view(np.int64))[0] - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


# 6


def test_toxicity(spark):
    bad = ["vile", "scum", "trash"]
    texts = [said(40, i) + (" " + " ".join(random.Random(i).sample(bad, 2)) if i % 4 == 0 else "") for i in range(800)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where("doc_id < 600"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in range(600, 800))
    assert right >= 190 and len(model.at) < 20000
    edges = [r.toxicity for r in toxicity.score(docs_of(spark, awkward()), model).collect()]
    assert all(0 <= x <= 1 for x in edges)
    nothing = toxicity.fit(docs, labels.where("false"))
    assert {r.toxicity for r in toxicity.score(docs_of(spark, awkward()), nothing).collect()} == {0.5}
    spread = toxicity.fit(docs, labels, shards=3)
    assert spread.at.size


def test_ftrl_by_brute_force():
    """Against a learner with dictionaries, one coordinate at a time."""
    r = random.Random(12)
    sets = [np.array(sorted(r.sample(range(64), r.randrange(1, 9))), np.int32) for _ in range(120)]
    labels = np.array([float(3 in s or 5 in s) for s in sets])
    got, bias = toxicity.learn(sets, labels, 6, 3, 5)
    z, n, zb, nb = Counter(), Counter(), 0.0, 0.0
    weight = lambda c: 0.0 if abs(z[c]) <= toxicity.L1 else -(z[c] - (1 if z[c] > 0 else -1) * toxicity.L1) / ((toxicity.BETA + n[c] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    order = np.random.RandomState(5)
    for _ in range(3):
        for i in order.permutation(len(sets)):
            w = {int(c): weight(int(c)) for c in sets[i]}
            b = -zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA)
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - labels[i]
            for c, wc in w.items():
                sigma = ((n[c] + g * g) ** 0.5 - n[c] ** 0.5) / toxicity.ALPHA
                z[c] += g - sigma * wc
                n[c] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / toxicity.ALPHA * b
            nb += g * g
    assert np.allclose(got, [weight(c) for c in range(64)]) and abs(bias + zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA)) < 1e-9
    assert (got[[3, 5]] > 0).all()


def test_toxicity_bounds(spark):
    texts = [said(40, i) + (" vile scum" if i % 4 == 0 else "") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = docs_of(spark, texts).withColumn("toxicity", F.lit("own"))
    model = toxicity.fit(docs, labels, max_features=5000)
    got = toxicity.score(docs, model)
    assert got.columns == [*docs.columns, "toxicity_"] and got.where("toxicity = 'own' and toxicity_ between 0 and 1").count() == 200
    assert toxicity.score(docs.where("false"), model).count() == 0


# 7


def test_chat_long_texts(spark):
    """Turns of 20 and 100 million characters come back whole."""
    sizes = {1: 20_000_001, 2: 100_000_000}
    rows = spark.range(1, 3).select(
        F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"),
        F.repeat(F.lit("ab[INST]"), F.when(F.col("id") == 1, sizes[1] // 8).otherwise(sizes[2] // 8).cast("int")).alias("text"),
    )
    got = {r.conv_id: r for r in chat.read_back(chat.segments(chat.column_turns(rows, "conv_id", ["turn"]))).collect()}
    for c, n in sizes.items():
        text = "ab[INST]" * (n // 8)
        assert (got[c].n_turns, got[c].loss_chars) == (1, len(text)) and got[c].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op7_keeps_turns_of_any_length(spark, tmp_path):
    n = 21_000_000  # above the longest string that Spark's JSON parser takes
    rows = spark.range(2).selectExpr("7L AS conv_id", "id AS turn", "'assistant' AS role", f"if(id = 1, repeat('a', {n}), 'b') AS text")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op7_chat(spark, str(tmp_path)).collect()}
    assert (got[7].n_turns, got[7].loss_chars, got[-1].n_turns) == (2, n + 1, 2)


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": 5, "output": "ok"},
        {"prompt": "p", "completion": "c"},
        {"question": "q", "answer": "a"},
        {"turn": 3, "role": "user", "text": None},
        {"what": "is", "this": ["?"]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "no json"), (10, None)], "id long, j string")
    turns = chat.to_turns(df, "id", "j")
    got = {}
    for r in turns.where("at is not null").orderBy("id", "at").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
    assert got == {
        0: [("user", "hi"), ("assistant", "")], 1: [("user", "q"), ("assistant", "a")], 2: [("system", "do"), ("user", "5"), ("assistant", "ok")],
        3: [("user", "p"), ("assistant", "c")], 4: [("user", "q"), ("assistant", "a")], 5: [("user", "")],
    }
    assert sorted(r.id for r in chat.unmapped(turns).collect()) == [6, 9, 10]


def test_chat_columns_by_their_fingerprint(spark):
    """Columns take the mapping of their schema, whatever layout they are in, as the same records do as JSON; unknown ones are refused."""
    said = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", None), (2, 0, "user", ""), (None, 0, None, "x")]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    want = sorted(((r.id, r.role, r.text) for r in chat.column_turns(rows, "conv_id", ["turn"]).collect()), key=str)
    assert want == sorted(((c, r or "", t or "") for c, _, r, t in said), key=str)
    one = F.array(F.struct(F.col("role"), F.col("text").alias("content")))
    other = F.array(F.struct(F.when(F.col("role") == "assistant", "gpt").when(F.col("role") == "user", "human").alias("from"), F.col("text").alias("value")))
    for moved in (rows.select("conv_id", one.alias("messages")), rows.select("conv_id", other.alias("conversations"))):
        assert sorted(((r.id, r.role, r.text) for r in chat.column_turns(moved, "conv_id").collect()), key=str) == want
    pairs = spark.createDataFrame([(1, "q", "a"), (2, None, "b")], "id long, question string, answer string")
    assert sorted((r.id, r["at"], r.role, r.text) for r in chat.column_turns(pairs, "id").collect()) == [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", ""), (2, 1, "assistant", "b")]
    with pytest.raises(ValueError, match="no layout"):
        chat.column_turns(rows.withColumnRenamed("text", "words"), "conv_id")
    for _, example, _, _ in chat.LAYOUTS:
        kind = spark.read.json(spark.sparkContext.parallelize([example])).schema
        both = spark.range(1).select((chat.fingerprint(F.parse_json(F.lit(example))) == F.xxhash64(F.lit(chat.schema_paths(kind)))).alias("same")).first()
        assert both.same, example


def test_chat_round_trip(spark):
    r = random.Random(1)
    bits = ["<|", "|>", "<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "s>", "\n", "é", "\U0001f600", " "]
    turns = [(c, t, r.choice(["user", "assistant", "sys<|tem", ""]), "".join(r.choice(bits) for _ in range(r.randrange(14)))) for c in range(30) for t in range(r.randrange(1, 6))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", "turn", F.to_json(F.struct("turn", "role", "text")).alias("j"))
    formatted = chat.segments(chat.to_turns(records, "conv_id", "j", ["turn"]))
    for s in formatted.collect():
        role, text = chat.read_segment(s.segment)
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", re.sub(r"^<\|turn\|>|<\|text\|>|<\|end\|>$", "", s.segment))
        assert (s.id, s.place.turn, role, text) in turns
    for got in chat.read_back(formatted).collect():
        mine = [(role, text) for c, _, role, text in turns if c == got.conv_id]
        loss = "".join(text for role, text in mine if role == "assistant")
        assert got.n_turns == len(mine) and got.loss_chars == len(loss)
        assert got.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(formatted.where("false")).count() == 0
    odd = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (2**60 + 1, 1, "assistant", None)]
    odd = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    odd = odd.select("conv_id", "turn", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("j"))
    got = chat.read_back(chat.segments(chat.to_turns(odd, "conv_id", "j", ["turn"]))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in got) == [(0, 2, 1), (2**60 + 1, 1, 0)]


# 8


def test_winnowing(spark):
    texts = [*awkward(), *[said(n, n) for n in (3, 5, 8, 12, 13, 40, 200)]]
    df = docs_of(spark, texts).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, w = winnow.K, winnow.W
    rows = df.select("doc_id", "text", winnow.fingerprint(F.col("text")).alias("fp"), winnow.shown(winnow.fingerprint(F.col("text"))).alias("s")).collect()
    words = spark.createDataFrame([(x,) for x in {x for t in texts for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x}], "w string")
    h = {r.w: r.h for r in words.select("w", F.xxhash64("w").alias("h")).collect()}
    for r in rows:
        seq = [h[x] for x in re.split(r"[\x20\x09-\x0D]+", r.text.lower()) if x]
        grams = [tuple(seq[i : i + k]) for i in range(len(seq) - k + 1)]
        if len(grams) == 0:
            assert len(r.fp) == (1 if seq else 0)
            continue
        g = spark.createDataFrame([(i, *x) for i, x in enumerate(grams)], "i int, " + ", ".join(f"c{j} long" for j in range(k)))
        hashed = [x.g for x in g.orderBy("i").select(F.xxhash64(*[f"c{j}" for j in range(k)]).alias("g")).collect()]
        hashed = [(x % (1 << 64)) >> (winnow.POSITION_BITS + 1) for x in hashed]
        want = []
        for i in range(max(1, len(hashed) - w + 1)):
            window = list(enumerate(hashed))[i : i + w]
            low = min(x for _, x in window)
            place = max(p for p, x in window if x == low)
            if not want or want[-1] != (low, place):
                want.append((low, place))
        assert [f"{a:x}@{p}" for a, p in dict.fromkeys(want)] == (r.s.split(",") if r.s else [])


def test_winnowing_query(spark, tmp_path):
    texts = [*awkward(), said(100, 1)]
    ids = [5, 900000, 17, 3, 4, 40, 41, 42, 6_000_000, 7, -3, 8]
    docs_of(spark, texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in winnow.op8_winnowing(spark, str(tmp_path)).collect()}
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for n, i in enumerate(order):
        t, following = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        q = len(t) // 4
        assert got[ids[i]].n_chars == len(t)
        assert got[ids[i]].edited_sha256 == hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()
        assert 0 <= got[ids[i]].near_edited <= 1 and 0 <= got[ids[i]].near_next <= 1
    assert got[40].fingerprint == got[41].fingerprint and got[40].near_next == 1.0
    hashes = lambda shown: {x.split("@")[0] for x in shown.split(",") if x}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    edits = {}
    for n, i in enumerate(order):
        t, following = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        edits[ids[i]] = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
    own = spark.createDataFrame(list(edits.items()), "id long, t string").select("id", winnow.shown(winnow.fingerprint(F.col("t"))).alias("s"))
    for r in own.collect():
        assert got[r.id].edited_fingerprint == r.s
    for n, i in enumerate(order):
        me, other = got[ids[i]], got[ids[order[(n + 1) % len(order)]]]
        assert abs(me.near_edited - alike(hashes(me.fingerprint), hashes(me.edited_fingerprint))) < 1e-12
        assert abs(me.near_next - alike(hashes(me.fingerprint), hashes(other.fingerprint))) < 1e-12


def test_winnowing_repeated_and_empty(spark, tmp_path):
    docs_of(spark, [said(30, 1), said(30, 2), said(30, 1), None, said(9, 3)], [7, 7, 7, None, None]).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = winnow.op8_winnowing(spark, str(tmp_path / "a")).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted([(7, len(said(30, 1)))] * 2 + [(7, len(said(30, 2))), (-1, 0), (-1, len(said(9, 3)))])
    docs_of(spark, []).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert winnow.op8_winnowing(spark, str(tmp_path / "b")).count() == 0


def test_next_in_order(spark):
    r = random.Random(4)
    for n, top in ((1, 5), (50, 60), (3000, 10**7)):
        ids = sorted(r.sample(range(-5, top), min(n, top)))
        got = {x.c: x.following for x in winnow.next_in_order(spark.createDataFrame([(i,) for i in ids], "c long")).collect()}
        assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


# 9


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Water-filling by repeated clamping."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    closed, total = {}, sum(sizes.values())
    while True:
        left, rest = total - sum(closed.values()), [s for s in names if s not in closed]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return closed | share
        closed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark):
    r = random.Random(6)
    texts = [said(r.randrange(1, 60), i) for i in range(300)] + awkward()
    docs = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % F.lit(5)).cast("string"))))
    docs = docs.where("source is null or source <> 's3' or doc_id < 20")
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for x in got:
        sizes[x.source] += x.size
    want, taken = fill(sizes), Counter()
    for x in got:
        assert abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source]) and x.source_size == sizes[x.source]
        assert 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = {x.doc_id: x.taken for x in mixing.mix(docs.repartition(7)).collect()}
    assert again == {x.doc_id: x.taken for x in got}
    mixed = mixing.copies(mixing.mix(docs, carry=docs.columns))
    words = Counter()
    for x in mixed.collect():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", x.text)) == x.words
        words[x.doc_id] += x.words
    assert words == Counter({x.doc_id: x.taken for x in got if x.taken})
    assert mixing.mix(docs.where("false")).count() == 0
    clash = docs.withColumn("copy", F.lit("own")).withColumn("words", F.lit("own")).withColumn("a.b", F.lit(1))
    made = mixing.copies(mixing.mix(clash, carry=clash.columns))
    assert made.columns == [*clash.columns, "copy_", "words_"] and made.agg(F.sum("words_")).first()[0] == sum(words.values())
    repeated = docs_of(spark, texts, [7] * 200 + [None] * (len(texts) - 200)).withColumn("source", F.lit("s"))
    plan = mixing.mix(repeated).collect()
    assert len(plan) == len(texts) and sum(x.taken for x in plan) == sum(x.size for x in plan)
    ranges = mixing.mix(repeated, carry=["text"]).where("doc_id = 7")
    assert sorted((x.kept_row.text, x.taken) for x in ranges.collect()) == sorted((x.kept_row.text, x.taken) for x in mixing.mix(repeated.repartition(5), carry=["text"]).where("doc_id = 7").collect())


# 10


def test_warc(spark):
    pages = [(1, "http://a/1", "<p>é</p>"), (2, None, "same"), (3, "http://b/\n x", "same"), (4, "u", None), (5, "u", ""), (6, "u", "big " * 50000), (9, "u", "same"), (9, "u", "same"), (2, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = new_path(spark, "warc-test")
    index = warc.write_archive(df, folder)
    got = warc.read_archive(index, folder, payloads=True).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == sorted(
        [(1, 9, "response", 0), (2, 4, "response", 0), (2, 4, "response", 0), (3, 4, "revisit", 2), (4, 0, "response", 0), (5, 0, "revisit", 4), (6, 200000, "response", 0), (9, 4, "revisit", 2), (9, 4, "revisit", 2)]
    )
    for r in got:
        text = dict((p, h) for p, _, h in pages)[r.page_id] or ""
        assert r.payload_digest == warc.base32_sha1(text.encode())
        assert bytes(r.payload) == (text.encode() if r.record_type == "response" else b"")
    some = warc.read_archive(index.where("page_id in (1, 6)"), folder).collect()
    assert sorted(r.page_id for r in some) == [1, 6]
    assert warc.write_archive(df.where("false"), new_path(spark, "warc-none")).count() == 0
    odd = spark.createDataFrame([(None, None, "x"), (2**60 + 3, "u", "x"), (2**60 + 1, "u", "x"), (None, "u", None)], "page_id long, url string, html string")
    odd = warc.read_archive(warc.write_archive(odd, (f := new_path(spark, "warc-null"))), f).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in odd) == [
        (0, "response", 0), (0, "response", 0), (2**60 + 1, "response", 0), (2**60 + 3, "revisit", 2**60 + 1)
    ]
    large = warc.read_archive(warc.write_archive(df, (f := new_path(spark, "warc-min")), min_bytes=5), f)
    assert large.where("record_type = 'revisit'").count() == 0


# the pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        after = out.collect()
        if name == "near_dedup":
            ids = sorted(before)
            _, label = brute_near([before[i].text for i in ids], 5, 80)
            assert sorted(r.doc_id for r in after) == sorted({ids[x] for x in label})
        if name == "decontamination":
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert decontaminate.contamination(out, items).agg(F.sum("n_hit")).first()[0] < 20
        if name == "personal_data":
            assert all(not pii.find(r.text)[0] for r in after) and len(after) == len(before)
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        if name == "mix_sources":
            assert sum(r.words for r in after) == pytest.approx(sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before.values()), rel=0.01)
        else:
            assert out.columns == columns
            docs = spark.createDataFrame(after, out.schema)
    assert cp.run(spark, sf_dir).count() == len(after)


def test_batches_keep_the_sessions_own_rows(spark):
    from loomline.llm import scratch

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    scratch.small_batches(spark)
    assert spark.conf.get(key) == str(scratch.BATCH_ROWS)
    spark.conf.set(key, 77)
    scratch.small_batches(spark)
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)
