"""The round's findings on operators of ``llm``: work that is done once."""

import numpy as np
import pytest

from quillspark.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_a_full_table_of_segments_keeps_what_the_texts_need(monkeypatch):
    """Beyond the bound a slice's own segments were all encoded again."""
    coder = pieces.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [" ".join(f"word{i}" for i in range(300)), " ".join(f"word{i}x" for i in range(200, 500)), "word7 word8 word450x word2"]
    want = [coder.encode([t])[0] for t in texts]
    coder.known.clear()
    monkeypatch.setattr(pieces, "_REMEMBERED", 320)
    learnt, plain = [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda segments: learnt.extend(segments) or plain(segments))
    assert coder.encode(texts[:1]) == want[:1]
    assert coder.encode([texts[0], texts[1]]) == want[:2]
    assert len(learnt) == len(set(learnt)) == 600
    assert coder.encode(texts) == want
    assert len(learnt) == 600


def test_kept_answers_are_those_of_the_rule():
    coder = pieces.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.Generator(np.random.PCG64(3))
    a, b = rng.integers(0, len(coder.id_of), (2, 30000))
    want = coder.order.valid(a, b)
    for _ in range(2):  # asked for the first time, and again
        assert (coder.order.allowed(a, b) == want).all()


def test_a_slice_of_the_quality_classifier_takes_little_memory():
    """Features of 2 MB of text at once took some 150 MB of each worker."""
    import tracemalloc

    import pyarrow as pa

    from quillspark.llm import quality
    from quillspark.llm.arrowkit import SLICE_BYTES, slices

    text = " ".join(f"word{i % 5000}" for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * (SLICE_BYTES // len(text)))], names=["text"])
    quality.Batch(batch.column(0).slice(0, 1)).features()
    tracemalloc.start()
    rows = sum(quality.Batch(part.column(0)).rows for part in slices(batch, "text", quality.SLICE) if quality.Batch(part.column(0)).features())
    assert rows == batch.num_rows and tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def _least(pairs):
    """The least node of each node's component."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return {x: find(x) for x in list(root)}


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


def _counted(spark, monkeypatch):
    """How many tables have been written, by name."""
    from quillspark.llm import components

    seen, plain = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: seen.append(name) or plain(df, name))
    return seen


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_components_are_those_of_a_plain_search(spark, most):
    from quillspark.llm.components import components, extended

    rng = np.random.Generator(np.random.PCG64(5))
    path = [(i, i + 1) for i in rng.permutation(40).tolist()]
    pairs = [*path, *((1000, 1001 + i) for i in range(50)), *(tuple(x) for x in rng.integers(2000, 2060, (30, 2)).tolist()), (7, 7), (None, 3), (3, None), (1, 0), (5001, 5000)]
    roots = components(_edges(spark, pairs), most)
    assert dict(roots.collect()) == _least(pairs) and roots.count() == len(_least(pairs))
    more = [(5000, 1017), (17, 1003), (-4, 2001), (9000, 9001), (6, 12), (None, 5), (8, 8)]
    assert dict(extended(roots, _edges(spark, more), most).collect()) == _least(pairs + more)


def test_stars_are_settled_without_a_further_round(spark, monkeypatch):
    """A round more was run to see that nothing changes: on the driver its tasks, plans and code added up."""
    from quillspark.llm.components import components

    seen = _counted(spark, monkeypatch)
    found = components(_edges(spark, [(1, 2), (1, 3), (4, 9)]))
    assert seen == ["edges", "least"]
    assert dict(found.collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 9: 4}


def test_links_within_known_components_cost_no_round(spark, monkeypatch):
    """With further links all components were worked out again from the first link on."""
    from quillspark.llm.components import components, extended

    roots = components(_edges(spark, [(i, i + 1) for i in range(12)]))
    seen = _counted(spark, monkeypatch)
    assert dict(extended(roots, _edges(spark, [(0, 9), (4, 12)])).collect()) == {i: 0 for i in range(13)}
    assert seen == ["edges", "least"]


def test_the_classifiers_sample_leaves_the_driver(spark, monkeypatch):
    """Its freed memory stayed with the driver's Python, some 110 MB."""
    from quillspark.llm import quality

    docs = spark.createDataFrame([(i, f"plain words of text number {i} and some more of them") for i in range(40)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "release", lambda: seen.append(1))
    quality.fit(docs, None)
    assert seen == [1]
