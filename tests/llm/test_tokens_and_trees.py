"""Alignment, the Merkle manifest and packing, each against a plain version of itself."""

import hashlib
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import align, merkle, packing
from loomline.llm.vocabulary import ByteLevel, byte_level, pieces, public_path, same_bytes

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, tree string, ids string"
ODD = [
    None, "", " ", "\n\n", "one", "one\ntwo\n", "a ▁ b", "<s>[INST] x </s><unk>", "to <|endoftext|> and on", "  two  spaces ", "Ünïcode ＠ 文字 \U0001f600 ퟿", "x" * 3000, " " * 25000 + "end",
    "same text", "same text", "tab\tand\r\nreturn   　", "12345 67,89.0 it's we'll", "the the the " * 900,
]


def docs_of(spark, texts, ids=None, sources=None):
    """A table with columns whose names clash with those inside the operators."""
    rows = [(i, t, None if n % 3 else "en", s, None if t is None else len(t), 7, "clash", "clash") for n, (i, t, s) in enumerate(zip(ids or range(len(texts)), texts, sources or ["s"] * len(texts)))]
    return spark.createDataFrame(rows, DOC)


# vocabularies


def test_ids_are_those_of_the_file():
    from tokenizers import Tokenizer

    plain, marked, own = Tokenizer.from_file(A), Tokenizer.from_file(A), byte_level(A)
    plain.encode_special_tokens = True
    assert own.fast
    r = random.Random(1)
    texts = [t for t in ODD if t] + ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(160, 0x2FFF), 32, 10))) for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert own.ids(t) == plain.encode(t, add_special_tokens=False).ids
        assert own.marked_ids(t) == marked.encode(t, add_special_tokens=False).ids
        assert b"".join(own.bytes[i] for i in own.ids(t)) == t.encode()
    assert own.marked_ids("a<|endoftext|>")[-1] == 50256 and 50256 not in own.ids("a<|endoftext|>")


def test_another_file_goes_to_its_library(tmp_path):
    import json

    with open(A, encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "v.json").write_text(json.dumps(said))
    own = ByteLevel(str(tmp_path / "v.json"))
    assert own.fast is None and own.ids("the end") == own.slow.encode("the end", add_special_tokens=False).ids


def test_identity_map_takes_pieces_before_bytes():
    a, b = byte_level(A), pieces(B)
    same = same_bytes(a, b)
    assert all(b.bytes[j] == a.bytes[i] for i, j in enumerate(same.tolist()) if j >= 0)
    assert not b.is_byte[same[a.bytes.index(b"a")]] and b.is_byte[same[a.bytes.index(b"\n")]]


# 11


def brute_alignment(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    shown = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown.values())}
    bytes_a = lambda i: bytes(shown[c] for c in ta.id_to_token(i))
    bytes_b = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc_id, text in docs:
        ids_a, ids_b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        said_a, said_b = [bytes_a(i) for i in ids_a], [bytes_b(i) for i in ids_b]
        if not text or not b"".join(said_a) == b"".join(said_b) == (" " + text).encode():
            ids_a, ids_b, said_a, said_b = [], [], [], []
        i = j = end_a = end_b = 0
        links, groups, open_a, open_b = [], [], [], []
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            new_a, new_b = end_a + len(said_a[i]), end_b + len(said_b[j])
            if new_a <= new_b:
                open_a, i, end_a = [*open_a, ids_a[i]], i + 1, new_a
            if new_b <= new_a:
                open_b, j, end_b = [*open_b, ids_b[j]], j + 1, new_b
            if new_a == new_b:
                groups.append(",".join(map(str, open_a)) + "|" + ",".join(map(str, open_b)))
                open_a, open_b = [], []
        counts.update(links)
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return sorted(((d, na, nb, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha(s), s) for d, na, nb, g, ls, s in found), key=str)


@pytest.mark.parametrize("held", [align.HELD, 40, 0])
def test_alignment(spark, sf_dir, held, monkeypatch):
    monkeypatch.setattr(align, "TOKENS", 700)
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    texts = [*ODD, *real]
    ids = [None, 5, 5, *range(10, 10 + len(texts) - 3)]
    made = align.align(docs_of(spark, texts, ids).repartition(3), texts_too=True)
    got = made.documents.join(align.link_counts(made, held), "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()
    assert sorted(map(tuple, got), key=str) == brute_alignment(list(zip(ids, texts)))


def test_alignment_of_nothing(spark):
    for texts in ([], [None, ""]):
        made = align.align(docs_of(spark, texts))
        assert [tuple(r) for r in align.link_counts(made).select("n_best", "count_sum").collect()] == [(0, 0)] * len(texts)
        assert made.counts.count() == 0 and made.documents.count() == len(texts)


def test_held_pairs_are_bounded():
    sizes = {1: 100, 2: 40, 3: 20, 9: 5}
    for held in (0, 4, 5, 24, 25, 64, 65, 164, 165, 1000):
        least = align.held_from(sizes, held)
        assert sum(n for k, n in sizes.items() if 1 << (k - 1) >= least) <= held
        assert least == 1 or sum(n for k, n in sizes.items() if 1 << k >= least) > held


# 12


def brute_merkle(rows, arity=3):
    """rows: (doc_id, source, lang, n_chars, text). Per row: leaf, subroot, root, siblings."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            start = i // arity * arity
            out.append(([d for j, d in enumerate(level[start : start + arity], start) if j != i], i - start))
            i //= arity
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, x in enumerate(sorted(by[s], key=lambda x: x[:3])):
            out.append((x[3][0], x[2], trees[s][-1][0], top[-1][0], path(trees[s], i) + path(top, at)))
    return out


@pytest.mark.parametrize("height", [1, 2, 7])
def test_merkle_proofs(spark, height):
    texts = [*ODD, *(f"text {i}" for i in range(60))]
    sources = [None if i % 7 == 0 else "hot" if i % 2 else ["", "-", "=x", "é", "z", "lone"][i % 5] for i in range(len(texts))]
    sources[-1] = "only"
    ids = [None, None, 5, 5, *range(4, len(texts))]
    docs = docs_of(spark, texts, ids, sources).repartition(5)
    docs = docs.union(docs.where("doc_id = 20"))  # a row twice
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    made = merkle.manifest(docs, height=height)
    got = merkle.proofs(made, made.leaves, ["doc_id"]).collect()
    want = brute_merkle([(r[0], r[1], r[2], r[3], r[4]) for r in rows])
    shown = sorted(((r.doc_id, r.leaf, r.subroot, r.root, list(zip(r.siblings, r.before))) for r in got), key=str)
    assert shown == sorted(want, key=str)
    assert {r.root for r in got} == {made.root}
    # a few leaves of a block: fewer nodes are fetched, the proofs are the same
    some = made.leaves.where("`index` % 5 = 1")
    few = merkle.proofs(made, some, ["doc_id"])
    assert {(r.doc_id, r.leaf, str(list(zip(r.siblings, r.before)))) for r in few.collect()} <= {(w[0], w[1], str(w[4])) for w in want}
    assert few.count() == some.count()
    told = few.withColumn("again", merkle.folded(F.col("leaf"), F.col("siblings"), F.col("before")))
    assert told.where("again <> root").count() == 0
    false = few.withColumn("again", merkle.folded(F.sha2("leaf", 256), F.col("siblings"), F.col("before")))
    assert false.where("again = root").count() == 0


def test_missing_nodes_are_the_fewest():
    r = random.Random(5)
    for _ in range(200):
        size, trees = r.randrange(1, 60), r.randrange(1, 12)
        at, wanted = r.randrange(trees), sorted(r.sample(range(size), r.randrange(1, size + 1)))
        asked = merkle.missing("t", size, at, trees, wanted, 3)
        # what the wanted leaves' paths touch, without what lies below or on the paths
        need = set()
        for name, n, start in (("t", size, set(wanted)), ("", trees, {at})):
            paths = start
            for level, width in enumerate(merkle.level_sizes(n, 3)[:-1]):
                runs = {i // 3 for i in paths}
                need |= {(name, level, i) for run in runs for i in range(3 * run, min(3 * run + 3, width))} - {(name, level, i) for i in paths}
                paths = runs
        assert set(asked) == need and len(asked) == len(need)
    assert merkle.missing("t", 2187, 0, 1, list(range(2187)), 3) == []


def test_merkle_of_nothing(spark):
    made = merkle.manifest(docs_of(spark, []))
    assert made.root is None and made.nodes.count() == 0 and merkle.proofs(made, made.leaves, ["doc_id"]).count() == 0


def test_merkle_long_text_and_one_row(spark):
    long = "line\n" * 400_000
    made = merkle.manifest(docs_of(spark, [long]))
    (row,) = merkle.proofs(made, made.leaves, ["doc_id"]).collect()
    assert row.leaf == row.subroot == row.root == brute_merkle([(0, "s", "en", len(long), long)])[0][1] and row.siblings == []


# 13


def held_to_contract(got, docs, capacity=1024):
    """Every id once, sequences gapless, and how many tokens pad them."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(A)
    want = Counter()
    for doc_id, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        want.update((doc_id, i, t, len(ids)) for i, t in enumerate(ids))
    have, sequences = Counter(), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        have.update((r.doc_id, r.start + i, t, r.doc_tokens) for i, t in enumerate(ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    padding = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
        padding += packing.padded(at, capacity) - at
    return padding


@pytest.mark.parametrize("copies", [0, 1, 40])
def test_packing(spark, sf_dir, copies):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    texts = [*ODD, *real] + [real[3]] * copies  # one length that most documents have
    ids = [None, 5, 5, *range(10, 10 + len(texts) - 3)]
    got = packing.pack(docs_of(spark, texts, ids).repartition(4)).collect()
    assert held_to_contract(got, list(zip(ids, texts))) == 0


def test_packing_few_and_none(spark):
    assert packing.pack(docs_of(spark, [])).collect() == []
    for texts in ([None], [""], ["one two three"], ["word " * 1023], ["word " * 1500]):
        assert held_to_contract(packing.pack(docs_of(spark, texts)).collect(), list(enumerate(texts))) == 0


def test_packing_other_capacity(spark):
    texts = [f"{'word ' * (i % 90)}end" for i in range(150)]
    assert held_to_contract(packing.pack(docs_of(spark, texts), capacity=64).collect(), list(enumerate(texts)), 64) == 0


def test_layout_has_no_gap_and_no_overlap():
    r = np.random.default_rng(1)
    for n, top in ((1, 5), (30, 1024), (500, 1024), (3000, 300)):
        counts = {int(k): int(v) for k, v in zip(*np.unique(r.integers(1, top, n), return_counts=True))}
        rows, total = packing.layout(counts)
        spots, ranks = [], defaultdict(list)
        for rest, low, high, each, position, stride in rows:
            ranks[rest] += range(low, high)
            spots += [(position + (k - low) // each * stride + (k - low) % each * rest, rest) for k in range(low, high)]
        assert all(sorted(v) == list(range(counts[k])) for k, v in ranks.items()) and sum(map(len, ranks.values())) == n
        at = 0
        for spot, rest in sorted(spots):
            assert spot == at
            at += rest
        assert at == total


def test_columns_of_the_linear_program():
    """Lengths that fill sequences exactly are never padded, and a start that wastes a third is improved upon."""
    patterns = packing.solve({400: 300, 300: 300, 324: 300})
    assert sum(times * sum(n * k for n, k in p.items()) for p, times in patterns) >= 0.99 * 300 * 1024
    assert all(sum(n * k for n, k in p.items()) == 1024 for p, _ in patterns)
    for pattern, times in packing.solve({700: 50, 600: 40, 324: 55, 424: 41, 100: 90, 1: 7}):
        assert times > 0 and sum(n * k for n, k in pattern.items()) <= 1024


def test_ends_are_powers_of_two():
    for total in range(0, 5000, 7):
        ends = packing.ends_of(total, 1024)
        sizes = np.diff([total - total % 1024, *ends])
        assert sum(sizes) == total % 1024 and all(s & (s - 1) == 0 for s in sizes.tolist())


# the shared folder


def test_checkpoint_folder_unset(tmp_path):
    """In a session that names no folder, on one machine, the operators make one; a core setting isn't touched."""
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
from loomline.llm import queries, scratch
assert scratch.shared_dir(spark) == scratch.shared_dir(spark) == spark.sparkContext.getCheckpointDir()
for name in ("op9_mixing", "op12_merkle"):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
print("fine")
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]
