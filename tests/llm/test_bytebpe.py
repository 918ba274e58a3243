import hashlib
import random

import pytest
import tiktoken
from tokenizers import Regex, Tokenizer, pre_tokenizers

from gleaner.llm import bytebpe, tokens
from gleaner.llm.common import read_table

ODD = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n  b \t c", "\x1c \x1d a", "\xa0 a \xa0b", "𝔘 é ﷽ 🙂🙂 a", "x" * 3000, " " * 3000 + "a", "<|endoftext|> a", "don't  we'll", "é" * 99, "\x00 \x00"]
LETTERS = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "¼", "!", "'s", "🙂", "　", "\xa0", "\x85", "\x1c", "漢", "<|endoftext|>", "​"]


def odd_texts(n):
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=bytebpe.read_ranks(bytebpe.VOCABULARY), special_tokens={})


def test_codec_is_the_librarys(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)  # turns over many times
    codec = bytebpe.Codec()
    texts = odd_texts(1500)
    for k in range(0, len(texts), 100):
        for text, ids in zip(texts[k : k + 100], codec.encode(texts[k : k + 100]), strict=True):
            assert ids.tolist() == library.encode_ordinary(text), repr(text)
            assert codec.decode(ids.tolist()) == text.encode()


def test_byte_table_is_reversed():
    assert len(bytebpe.CHAR_BYTES) == 256
    assert bytebpe.token_bytes(bytebpe.token_chars(bytes(range(256)))) == bytes(range(256))


def test_offsets_are_the_tokenizers(spark):
    """Character offsets as the library gives them for whole texts; byte offsets by lengths."""
    codec = bytebpe.Codec()
    whole: Tokenizer = codec._library.from_str(codec._library.to_str())
    whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(bytebpe.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)])
    texts = odd_texts(60)
    docs = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bytebpe.encoded(docs).collect()}
    for k, text in enumerate(texts):
        want = whole.encode(text, add_special_tokens=False)
        r = got[k]
        assert r.ids == want.ids
        assert list(zip(r.char_starts, r.char_ends, strict=True)) == want.offsets, repr(text)
        assert r.byte_ends[-1:] == ([len(text.encode())] if text else [])
    back = {r.doc_id: r.text for r in bytebpe.decoded(bytebpe.encoded(docs)).collect()}
    assert back == dict(enumerate(texts))


def test_split_characters_are_decoded_whole_or_marked(spark):
    ids = bytebpe.Codec().encode(["﷽"])[0].tolist()
    assert len(ids) > 1
    rows = [(1, ids), (2, ids[:1]), (3, None), (4, [ids[0], None, *ids[1:]])]
    got = {r.doc_id: r for r in bytebpe.decoded(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got[1].text == got[4].text == "﷽"
    assert got[2].text == "�" and bytes(got[2].data) == "﷽".encode()[: len(got[2].data)]
    assert got[3].text == "" and bytes(got[3].data) == b""


def test_query_is_brute_force(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.op13_byte_bpe(spark, sf).collect()}
    for r in read_table(spark, sf, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_awkward_rows(spark, docs, corpus, empty):
    assert bytebpe.digests(empty).collect() == []
    assert bytebpe.encoded(empty).collect() == []
    clash = docs.withColumnRenamed("lang", "data").withColumnRenamed("source", "a.b")
    assert sorted(map(str, bytebpe.digests(clash).collect())) == sorted(map(str, bytebpe.digests(docs).collect()))
    assert bytebpe.digests(docs).count() == len(corpus)
    bad = spark.sql("SELECT CAST(1 AS long) doc_id, CAST(X'61FF62' AS string) text")
    assert bytebpe.decoded(bytebpe.encoded(bad)).first().text == "a�b"
