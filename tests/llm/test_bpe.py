import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import bpe_codec
from driftline.llm.common import slices
from driftline.llm.bpe import BatchBpe, UnitEncoder
from driftline.llm.token_counts import RULES, count_batch, section_tokens

from .cases import documents, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>  z", "don't we'll  it's", "ab\r\n\r\ncd",
    "Ünïcödé ½ ²x ٣٤ 漢字 🙂🙂   x\x1cy \x85z", "\t\tq", "'s 'S", "é x", "a\n\n\nb\n", "\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as file:
        return BatchBpe(file.read())


def agree(codec, library, texts):
    ids, at = codec.encode(pa.array(texts, pa.string()))
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == wanted
    assert codec.decode(ids, at) == [library.decode(w, skip_special_tokens=False) for w in wanted]


def test_like_the_library(codec, library):
    agree(codec, library, ODD + [t for _, t in rows() if t])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\t'sé漢🙂1²<|endoftext>  \x1c."), max_size=40), max_size=8))
def test_like_the_library_on_random_texts(codec, library, texts):
    agree(codec, library, texts)


def test_a_full_memory_changes_nothing(codec, library):
    small = BatchBpe.__new__(BatchBpe)
    small.bpe, small.units = codec.bpe, UnitEncoder(lambda units: map(codec.bpe.encode, units), most_known=2)
    agree(small, library, ODD)
    agree(small, library, ODD[::-1])


def test_documents(spark, library):
    df = bpe_codec.decoded(bpe_codec.encoded(documents(spark), PATH), PATH)
    assert "sections" in df.columns
    for r in df.select("text", "ids", "decoded", bpe_codec.n_ids(F.col("ids")).alias("n")).collect():
        wanted = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(r["ids"])).cast("I")) == wanted and r["n"] == len(wanted) and r["decoded"] == (r["text"] or "")
    assert bpe_codec.encoded(documents(spark, []), PATH).count() == 0


def brute_sections(library, text, rule):
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    ends, counts = [sum(len(x.encode()) for x in lines[: i + 1]) for i in range(len(lines))], [0] * len(lines)
    at = 0
    for i in library.encode(text, add_special_tokens=False).ids:
        token = library.id_to_token(i)
        size = len(token) if i != 50256 else len(token.encode())
        held = [max(0, min(e, at + size) - max(s, at)) for s, e in zip([0, *ends[:-1]], ends)]
        touched = [k for k, h in enumerate(held) if h]
        counts[{"first": touched[0], "last": touched[-1], "majority": max(touched, key=lambda k: (held[k], -k))}[rule]] += 1
        at += size
    return [(sum(map(len, lines[:i])), sum(map(len, lines[: i + 1])), n) for i, n in enumerate(counts)]


@pytest.mark.parametrize("rule", RULES)
def test_sections_like_brute_force(codec, library, rule):
    texts = ODD + [t for _, t in rows() if t]
    found = count_batch(codec, pa.array(texts), [[len(t.encode())] for t in texts], rule).to_pylist()
    for text, sections in zip(texts, found):
        assert [(s["char_start"], s["char_end"], s["n_tokens"]) for s in sections] == brute_sections(library, text, rule)


def test_fields(spark, library):
    df = spark.createDataFrame([(1, "a\nb", None, "c"), (2, "", "", ""), (3, None, "x\n", "y z")], "doc_id long, title string, text string, sections string")
    rows_ = {r["doc_id"]: r for r in section_tokens(df, PATH, ("title", "text", "sections"), into="found").collect()}
    for r in rows_.values():
        whole = "\n".join(r[f] or "" for f in ("title", "text", "sections"))
        assert sum(s["n_tokens"] for s in r["found"]) == len(library.encode(whole, add_special_tokens=False).ids)
        assert {s["field"] for s in r["found"]} == {0, 1, 2}
    assert section_tokens(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        section_tokens(df, PATH, rule="half")


@pytest.mark.parametrize("given", [[], [""], ["", None, ""], ["a", ""], ["", "ab", "c", ""]])
def test_slices_hold_every_row(given):
    batch = pa.array(given, pa.string())
    assert [x for s in slices([batch], 2) for x in s.to_pylist()] == given
    assert [x for s in slices([(batch, batch)], 2) for x in s[1].to_pylist()] == given
