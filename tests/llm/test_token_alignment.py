import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from driftline.llm import token_alignment as A
from driftline.llm.bpe import byte_letters
from driftline.llm.common import staged

from .cases import documents, prose, rows

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (101, "a ▁ b"), (102, " leading and  two  blanks "), (103, "tab\tline\n\nfeed\r\n"), (104, "<s> </s> <unk> <0x41> <|endoftext|>"), (105, "é́ ﬁ ① 　 x"),
    (106, "\x00 nul"), (107, "🙂🙃👩‍👩‍👧"), (108, "x"), (109, "don't we'll"), (110, "    indented\n        twice"),
]


@pytest.fixture(scope="module")
def vocabularies():
    return A.Vocabularies.read(*PATHS)


def brute(given):
    """Per row, everything the query returns, from one text at a time."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = {c: x for x, c in byte_letters().items()}
    found = []
    for doc_id, text in given:
        ids_a, ids_b, groups, links = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            pieces = [b.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
                ids_a, ids_b = [], []
        if ids_a:
            ends_a = {int(e): i for i, e in enumerate(np.cumsum([*map(len, bytes_a)]))}
            ends_b = {int(e): i for i, e in enumerate(np.cumsum([*map(len, bytes_b)]))}
            i = j = 0
            for end in sorted(ends_a.keys() & ends_b.keys()):
                groups.append((ids_a[i : ends_a[end] + 1], ids_b[j : ends_b[end] + 1]))
                links.append((ids_a[ends_a[end]], ids_b[ends_b[end]]))
                i, j = ends_a[end] + 1, ends_b[end] + 1
        text_of = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if groups else ""))
    counts = Counter(link for f in found for link in f[4])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, n, m, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for i, n, m, g, ls, sha in found], counts


def by_operator(docs, vocabularies):
    spark = docs.sparkSession
    aligned = staged(docs.select("doc_id", A.align(spark, vocabularies).alias("a")).select("doc_id", "a.*"), "aligned")
    pairs = A.pair_counts(aligned, vocabularies)
    links = aligned.withColumn("l", A.link_counts(spark, vocabularies, pairs)).select("doc_id", "n_a", "n_b", "n_groups", "l.*", "groups_sha256")
    return [tuple(r) for r in links.collect()], pairs


def test_like_brute_force(spark, vocabularies, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 100)
    given = [r for r in rows() + ODD if r[1] is None or len(r[1]) < 10**6]
    got, pairs = by_operator(documents(spark, given), vocabularies)
    want, counts = brute(given)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert dict(zip(pairs.table.keys[:, 0].tolist(), pairs.counts.tolist())) == {a * 32000 + b: n for (a, b), n in counts.items()}


def test_empty_tables(spark, vocabularies):
    assert by_operator(documents(spark, []), vocabularies)[0] == []
    got, pairs = by_operator(documents(spark, [(1, None), (2, "")]), vocabularies)
    assert sorted(got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")] and len(pairs.table) == 0


def test_long_texts_in_parts_have_the_same_tokens(vocabularies, monkeypatch):
    aligner = A.Aligner(vocabularies)
    rng = random.Random(2)
    texts = [prose(i, 400) for i in range(5)] + ["".join(rng.choice("ab 1  \n\t.é漢'") for _ in range(3000)) for _ in range(20)] + ["x" * 3000, " " * 3000]
    encode = lambda: [[list(map(int, ids)) for ids in side] for side in aligner.encode(texts)]
    whole = encode()
    monkeypatch.setattr(A, "PART", 100)
    assert aligner.may_cut and len(A._cuts(texts[0])) > 10
    assert encode() == whole


def test_the_vocabularies_bound_the_pairs(vocabularies):
    a, b = vocabularies.token_bytes()
    some_a, some_b = a[:300], b[:600]
    small = A.Vocabularies.__new__(A.Vocabularies)
    object.__setattr__(small, "token_bytes", lambda: (some_a, some_b))
    assert small.most_pairs() == sum(x.endswith(y) or y.endswith(x) for x in some_a for y in some_b if x and y)
    assert vocabularies.most_pairs() < 1_000_000


def test_both_readers_of_the_first_vocabulary_agree(vocabularies):
    """One text for each of many characters of all planes, in words, numbers, blanks and signs."""
    library, own = Tokenizer.from_str(vocabularies.a), A.Aligner(vocabularies).encoder_a
    library.encode_special_tokens = True
    texts = [f"a{c}b 1{c}2 {c}{c} x{c} {c}a .{c}. '{c}s" for c in map(chr, [*range(0x3400), *range(0x3400, 0x110000, 97)]) if not "\ud800" <= c <= "\udfff"]
    assert [e.ids for e in library.encode_batch(texts, add_special_tokens=False)] == [own.encode_ordinary(t) for t in texts]
