"""Leaks near the half-passage bound are found whatever the size of the corpus."""

import duckdb
import numpy as np
import pytest
from codexlake.llm import leaks

#: Share of the passage that stands in the document, and one wrong letter in how many (0: none).
CLASSES = [(0.5, 0), (0.54, 25), (0.6, 12), (0.65, 10)]


@pytest.fixture(scope="module")
def known():
    texts = duckdb.sql("SELECT item_id, passage FROM '/root/testdata/sf0.1/eval_passages.parquet' ORDER BY 1").fetchall()
    return leaks.Passages([i for i, _ in texts], [t for _, t in texts])


@pytest.fixture(scope="module")
def shares(known):
    """Share of the documents that hold each n-gram."""
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()
    df = np.zeros(len(known.vocabulary))
    for (text,) in texts:
        df[np.unique(known.hits(leaks.grams_of(leaks.letters_of(text or "")))[1])] += 1
    return df / len(texts)


@pytest.mark.parametrize("size", [10_000, 1_000_000])
def test_parts_of_passages_are_found(spark, known, shares, monkeypatch, size):
    rng = np.random.default_rng(3)
    docs, due = [], {c: set() for c in CLASSES}
    for item, letters, keys in zip(known.ids.tolist(), known.letters, known.grams, strict=True):
        order = np.argsort(keys, kind="stable")
        for share, wrong in CLASSES * 3:
            n = int(np.ceil(len(letters) * share))
            start = rng.integers(0, len(letters) - n + 1)
            part = letters[start : start + n].copy()
            if wrong:
                part[rng.random(n) < 1 / wrong] = ord("ж")
            doc = np.concatenate([np.full(rng.integers(0, 240), ord("ж")), part, np.full(300, ord("ж"))]).astype(np.uint32)
            # Brute force: the subsequence check itself, without the candidates.
            if leaks.share_in_one_place(letters, order, keys[order], doc, leaks.grams_of(doc)) >= leaks.MIN_SHARE:
                due[share, wrong].add((len(docs), item))
            docs.append((len(docs), "".join(map(chr, doc))))
    monkeypatch.setattr(leaks, "document_frequencies", lambda *_: (shares * size, size))
    passages = spark.read.parquet("/root/testdata/sf0.1/eval_passages.parquet")
    found = {(r.doc_id, r.item_id) for r in leaks.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), passages).collect()}
    got = {c: (len(pairs & found), len(pairs)) for c, pairs in due.items()}
    print(f"size {size}: {got}")
    assert all(n > 100 and hit >= 0.995 * n for hit, n in got.values())
