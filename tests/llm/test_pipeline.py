"""Each stage of the pipeline against brute force over what its predecessor kept."""

import os

import pytest

import corpus_pipeline
from weft.llm import bpe
from weft.llm.core import cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def shingle_set(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name.replace(" ", "-"))
        kept.append(docs)
        if len(kept) < len(corpus_pipeline.STAGES):
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    scored, single, passages, clean, encoded = kept

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = texts(scored)
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in stay for d in good) >= 0.95 * len(good) and sum(d in stay for d in bad) <= 0.5 * len(bad)

    sets = {d: shingle_set(t) for d, t in stay.items()}
    root = {d: d for d in sets}
    for _ in range(len(sets)):
        before = dict(root)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    one = texts(single)
    assert set(one) == {d for d in root if root[d] == d} and all(one[d] == stay[d] for d in one)

    seen = {}
    words = {d: t.encode().split() for d, t in one.items()}
    for w in words.values():
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    rest = texts(passages)
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        assert rest[d] == (b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else one[d])

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = texts(clean)
    assert set(left) <= set(rest) and not any(i in t for t in left.values() for i in items)
    assert len(left) >= 0.85 * len(rest)

    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.vocabulary()
    known = tiktoken.Encoding("known", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {d: known.encode_ordinary(t) for d, t in left.items()}


def test_stages_on_odd_tables(spark):
    """Each stage alone on nulls, empty and repeated rows, further columns, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, chunk int"
    rows = [(1, None, None, None, None, 0.1, 1), (2, "", "en", "s", 0, 0.2, 2), (3, "b", "en", "s", 1, 0.3, 3), (3, "a longer one", None, "s", 1, 0.4, 4), (None, "lost", "en", "s", 4, 0.5, 5)]
    docs = spark.createDataFrame(rows, schema)
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF).collect()
        assert len({r.doc_id for r in found}) == len(found) and {r.doc_id for r in found} <= {1, 2, 3}
        assert at == 0 or {r.doc_id for r in found} == {1, 2, 3}
        assert stage(spark, docs.limit(0), SF).count() == 0
