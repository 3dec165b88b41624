import hashlib
import random
import zlib

import numpy as np
import pytest

from driftline.llm import prefix_trie as T
from driftline.llm.common import staged
from driftline.llm.perfect_hash import KeyTable


def brute(rows: list[tuple]) -> dict:
    """(smallest member, depth) -> everything else, from conversations rebuilt in plain Python."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        saved[p] = sum(saved[x] for x in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    ends = {p: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest() for p, m in members.items()}
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], ends[p]) for p, m in members.items()
    }


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, run long, pos string, digest string")
    turns = T.numbered_turns(df.repartition(5))
    rebuilt = staged(T.with_shared_heads(turns), "rebuilt")
    sizes = turns.select("conv_id").distinct().join(rebuilt.filter("pos = 0").select("conv_id", "n"), "conv_id", "left").fillna(0, ["n"])
    found = T.prefix_trie(rebuilt, sizes).collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found}
    assert len(got) == len(found)
    return got


def some_rows(seed=5, convs=150, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 700), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, ["user", "assistant"][t % 2], rng.choice(["hi", "hello", "Ünï🙂", "", "a" * 50]) if t < 3 else f"{rng.random():.1f}"))
    return rows


ODD = [
    (1, None, "user", "first"), (1, 0, None, "x"), (1, 1, "user", None), (2, 0, "user", "first"), (2, 0, "user", "first"), (2, 0, "user", "a"), (None, 0, "user", "lost"),
    (300, 0, "us", "erhi"), (301, 0, "user", "hi"), (5000, 7, "user", "word " * 20_000), (7, 0, "user", ""), (-7, 3, "user", "below"),
]


@pytest.mark.parametrize("band", [4096, 2, 3])
def test_like_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(T, "BAND", band)
    monkeypatch.setattr(T, "SHARD_ROWS", 40)
    rows = some_rows() + [(c + 1000, *r) for c, *r in ODD if c is not None] + [(None, 1, "user", "x")]
    assert trie_of(spark, rows) == brute(rows)


def test_odd_rows_and_empty_tables(spark):
    assert trie_of(spark, ODD) == brute(ODD)
    assert trie_of(spark, []) == {}
    assert trie_of(spark, [(None, 0, "user", "x")]) == {}


def test_one_long_conversation_and_many_equal_ones(spark, monkeypatch):
    """A third of the rows in one conversation, a third in equal ones: many partitions number them, many shards hold them."""
    monkeypatch.setattr(T, "BAND", 50)
    monkeypatch.setattr(T, "SHARD_ROWS", 100)
    monkeypatch.setattr(T, "LISTED", 7)
    rows = [(9, t, "user", str(t % 3)) for t in range(620)] + [(c, t, "user", f"same {t}") for c in range(100, 400) for t in range(2)] + some_rows(3, 60)
    rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = T.numbered_turns(df).filter("conv_id = 9").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["pos"] for r in turns) == [*range(len(turns))] and len({r["run"] for r in turns}) > 1
    assert trie_of(spark, rows) == brute(rows)


def test_members_of_a_key_table_have_slots_of_their_own_and_strangers_none():
    rng = np.random.default_rng(1)
    for n, width in ((0, 1), (1, 4), (3, 1), (5000, 1), (2000, 4)):
        keys = np.unique(rng.integers(0, 1 << 63, (n, width), dtype=np.uint64), axis=0)
        table = KeyTable(keys)
        slots = table.slots(keys)
        assert sorted(slots) == [*range(len(keys))] and (table.keys[slots] == keys).all()
        strangers = rng.integers(1 << 63, 1 << 64, (500, width), dtype=np.uint64)
        assert (table.slots(strangers) == -1).all()
    with pytest.raises(ValueError):
        KeyTable(np.array([[7], [7]], np.uint64))


def test_two_beginnings_with_one_digest_are_an_error():
    import pyarrow as pa

    same = pa.array([b"d" * 32] * 2)
    rows = pa.table({"digest": same, "parent": pa.array([b"p" * 32] * 2), "said": pa.array([b"a" * 32, b"b" * 32]), "depth": [1, 1]})
    with pytest.raises(ValueError):
        T.ShardTable(rows)
