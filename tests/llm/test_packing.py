import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from driftline.llm.packing import Slots, best_fit, pack_documents, pack_plan, reduce_by_dominance, sequences

from .cases import documents, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """The least number of sequences, by trying all ways (dynamic programming over subsets)."""
    n = len(sizes)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        for i in range(n):
            if mask >> i & 1:
                used, last = best[mask ^ 1 << i]
                new = (used, last + sizes[i]) if used and last + sizes[i] <= capacity else (used + 1, sizes[i])
                best[mask] = min(best[mask], new)
    return best[-1][0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    left = Counter(sizes)
    fixed = reduce_by_dominance(left, 20)
    rest = sorted(left.elements())
    assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)
    assert Counter(sizes) == left + Counter({s: sum(k * n for p, n in fixed for x, k in p if x == s) for s in set(sizes)})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_plan_holds_every_piece_once(sizes):
    plan = pack_plan(Counter(sizes), 30)
    assert Counter({s: sum(k * n for p, n in plan for x, k in p if x == s) for s in set(sizes)}) == Counter(sizes)
    assert all(sum(s * k for s, k in p) <= 30 for p, _ in plan)
    assert sum(n for _, n in plan) <= sum(n for _, n in best_fit(Counter(sizes), 30)) + 1
    rank, seen, lengths = [], Counter(), np.array(sizes)
    for s in sizes:
        rank.append(seen[s])
        seen[s] += 1
    sequence, offset = Slots.of(plan).find(lengths, np.array(rank))
    places = defaultdict(list)
    for q, o, s in zip(sequence, offset, sizes):
        places[q].append((o, s))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(s for _, s in held[:i]) for i in range(len(held))]


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    packed = pack_documents(documents(spark), PATH, capacity=64, ids=True)
    out = packed.collect()
    wanted = Counter()
    for i, t in rows():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        wanted.update((i, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64])) for k, a in enumerate(range(0, len(ids), 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == wanted
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for r in sequences(packed).collect():
        held = sorted(places[r["sequence_id"]])
        assert bytes(r["ids"]) == b"".join(p for _, _, p in held) and len(r["ids"]) <= 256
        assert [o for o, _, _ in held] == [sum(n for _, n, _ in held[:i]) for i in range(len(held))]


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr("driftline.llm.packing.RANKED_TOGETHER", 7)
    out = pack_documents(documents(spark, [(i, "one two three") for i in range(100)]), PATH, capacity=9).collect()
    places = {(r["sequence_id"], r["offset"]) for r in out}
    assert len(out) == len(places) == 100 and len({q for q, _ in places}) == 50
    assert all(a != b for a, b in combinations(sorted(places), 2))


def test_empty_table(spark):
    assert pack_documents(documents(spark, []), PATH).count() == 0
