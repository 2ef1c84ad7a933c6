"""Columns named like those that the operators use inside are kept as they are."""

import pytest

from loomline.llm import decontaminate, neardup, pii, suffixdedup

INNER = ["__text", "__hash", "__gone", "__id", "__cuts", "__key", "__hit", "__found", "__row", "key", "row", "block"]
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


@pytest.fixture()
def docs(spark):
    texts = [f"{PROSE} mail me at ann@example.org", PROSE, PROSE, "quite another text of a few words only", None]
    kind = ", ".join(["doc_id long, text string, n_chars long", *(f"`{c}` string" for c in INNER)])
    return spark.createDataFrame([(i, t, len(t or ""), *(f"{c}{i}" for c in INNER)) for i, t in enumerate(texts)], kind)


def held(got, docs):
    """The rows of `got` by id; every column that isn't text or length is as it was."""
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    for i, r in rows.items():
        assert [r[c] for c in INNER] == [f"{c}{i}" for c in INNER]
    return rows


def test_redaction(docs):
    rows = held(pii.redact_documents(docs), docs)
    assert len(rows) == 5 and "ann@example.org" not in rows[0].text and rows[1].text == PROSE


def test_near_duplicates(docs):
    assert sorted(held(neardup.drop_near_duplicates(docs), docs)) == [0, 1, 3, 4] or sorted(held(neardup.drop_near_duplicates(docs), docs)) == [0, 3, 4]


def test_repeated_passages(docs):
    rows = held(suffixdedup.remove_later(docs, min_words=12, k=4), docs)
    assert len(rows) == 5 and rows[0].text.startswith("one") and (rows[2].text or "") == "" and rows[3].text.startswith("quite")


@pytest.mark.parametrize("words", [250_000, 12])
def test_decontamination(spark, docs, words):
    """In one automaton, and in parts."""
    items = spark.createDataFrame([("a", " ".join(PROSE.split()[:12])), ("b", "nothing of this text is in any of the documents of the table")], "item_id string, text string")
    rows = held(decontaminate.decontaminate(docs, items, max_item_words=words), docs)
    assert 3 in rows and rows[3].text.startswith("quite")


def test_pipeline_leaves_only_what_its_result_reads(spark, sf_dir, tmp_path):
    import os

    import corpus_pipeline
    from loomline.llm import scratch

    base = str(tmp_path)
    held, scratch.shared_dir = scratch.shared_dir, lambda spark: f"file://{base}"
    try:
        corpus_pipeline.run(spark, sf_dir)
    finally:
        scratch.shared_dir = held
    left = {n for _, names, _ in os.walk(f"{base}/loomline") for n in names}
    assert "personal_data" in left and not left & {"language_id", "near_dedup", "decontamination", "grams", "features"}
