import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import ngram_join as J

from .cases import documents, edited, prose, rows


def grams(text):
    words = [w for w in re.split("[ \t\n\v\f\r]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(given, threshold=0.8):
    sets = [grams(t) for _, t in given]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i].add(j)
    out = []
    for i in range(len(given)):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        known = [given[k][0] for k in seen if given[k][0] is not None]
        name = min(known) if sets[i] and known else None if sets[i] else given[i][0]
        out.append((given[i][0], name, len(links[i]), given[i][0] == name))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in J.ngram_join(df).select("doc_id", "class_id", "n_links", "kept").collect())


def test_like_brute_force(spark):
    wanted = brute(rows())
    got = found(documents(spark))
    # A row without identifier and words is kept, as there is nothing it could be named by.
    assert +Counter({k: n for k, n in got.items() if k[0] is not None}) == +Counter({k: n for k, n in wanted.items() if k[0] is not None})
    assert (None, None, 0, True) in got and (None, 12, 1, False) in got


@pytest.mark.parametrize("members", [4, 512])
def test_one_large_group_of_near_copies(spark, monkeypatch, members):
    """Blocks of two chunks and blocks of one give the same links."""
    monkeypatch.setattr(J, "CHUNK_MEMBERS", members)
    base = prose(3, 80)
    given = [(i, edited(base, i)) for i in range(30)] + [(i, prose(i, 40)) for i in range(100, 140)]
    assert found(documents(spark, given)) == brute(given)


@pytest.mark.parametrize("n_grams", [10, 100])
def test_more_chunks_than_members(spark, monkeypatch, n_grams):
    """Long texts make many chunks, of which some get no member; no link counts once more for those."""
    monkeypatch.setattr(J, "CHUNK_GRAMS", n_grams)
    given = [(i, edited(prose(i % 5, 80), i)) for i in range(15)]
    assert found(documents(spark, given)) == brute(given)


def test_banding_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        for recall in (0.9, 0.9995):
            bands, n = J.banding(threshold, recall)
            assert bands * n <= 128 and 1 - (1 - threshold**n) ** bands >= recall
    with pytest.raises(ValueError):
        J.banding(0.01, 0.999999)


def test_sets_in_batches_are_those_of_single_texts():
    texts = [t or "" for _, t in rows()]
    together = J.gram_sets(pa.array(texts), 5).to_pylist()
    for text, one in zip(texts, together):
        assert one == J.gram_sets(pa.array([text]), 5).to_pylist()[0]
        assert len(np.frombuffer(one["set"], np.uint64)) == len(grams(text))


def test_empty_table(spark):
    assert J.ngram_join(documents(spark, [])).count() == 0
