import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gleaner.llm import crosstok
from gleaner.llm.bytebpe import token_bytes
from gleaner.llm.common import read_table
from tests.llm.test_bytebpe import odd_texts

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(crosstok.A_PATH)
    a.encode_special_tokens = True
    names = {i: c for c, i in a.get_vocab().items()}
    return a, names, sentencepiece.SentencePieceProcessor(model_file=crosstok.B_PATH)


def whole(text, libraries):
    """(A ids, their bytes, B ids, their bytes) of a whole text, or None."""
    a, names, b = libraries
    if not text:
        return None
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [token_bytes(names[i]) for i in a_ids]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    b_bytes = [piece(i) for i in b_ids]
    return (a_ids, a_bytes, b_ids, b_bytes) if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode() else None


def brute(texts, libraries):
    found, counts = [], Counter()
    for t in texts:
        w = whole(t, libraries)
        if w is None:
            found.append(None)
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in side]).tolist(), ids, strict=True)) for ids, side in ((w[0], w[1]), (w[2], w[3]))]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for e, i in side.items() if last < e <= c) for side in ends))
            last = c
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        counts.update(links)
        found.append((len(w[0]), len(w[2]), groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest()
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), digest(f[2])) for f in found]


def of(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_odd_texts_are_brute_force(spark, libraries, monkeypatch):
    texts = [*odd_texts(800), "a▁b", "x ▁ y", "①", " ", "<s> </s>", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = dict(enumerate(brute(texts, libraries)))
    got = of(crosstok.digests(df))
    assert [t for k, t in enumerate(texts) if got[k] != want[k]] == []
    assert want[len(texts) - 6][0] == 0 and want[len(texts) - 4][0] > 0


def test_memory_turns_over(libraries, monkeypatch):
    monkeypatch.setattr(crosstok, "CHUNKS", 40)
    own = crosstok.Aligner()
    texts = odd_texts(300)
    for k in range(0, len(texts), 50):
        for text, chunks in zip(texts[k : k + 50], own.align(texts[k : k + 50], True), strict=True):
            w = whole(text, libraries)
            assert (w is None) == (not chunks)
            assert w is None or np.frombuffer(b"".join(c.a for c in chunks), np.int32).tolist() == w[0]


def test_query_is_brute_force(spark, libraries):
    d = "/root/testdata/sf0.001"
    rows = read_table(spark, d, "documents").select("doc_id", "text").collect()
    assert of(crosstok.op11_crosstok(spark, d)) == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], libraries), strict=True))


def test_groups_and_overlaps(spark, libraries):
    """Groups are the finest runs that share both ends; pairs are all that share a byte."""
    texts = odd_texts(60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in crosstok.alignments(df).collect():
        w = whole(texts[r.doc_id], libraries)
        if w is None:
            assert r.a_ids == r.b_sizes == r.a_at == []
            continue
        assert (r.a_ids, r.b_ids, sum(r.a_sizes), sum(r.b_sizes)) == (w[0], w[2], len(w[0]), len(w[2]))
        spans = [[(e - len(x), e) for x, e in zip(side, np.cumsum([len(x) for x in side]).tolist(), strict=True)] for side in (w[1], w[3])]
        want = {(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]}
        assert set(zip(r.a_at, r.b_at, strict=True)) == want and len(r.a_at) == len(want)


def test_coalescing_of_any_intervals():
    starts, ends = np.array([5, 0, 2, 9, 7, 9]), np.array([7, 3, 5, 10, 9, 12])
    groups = crosstok.coalesced(starts, ends, np.array([0, 0, 1, 0, 1, 1]))
    assert groups.tolist() == [1, 0, 0, 3, 2, 3]
    assert crosstok.coalesced(np.array([], int), np.array([], int), np.array([], int)).tolist() == []


def test_table_of_counts_is_bounded():
    assert crosstok.Aligner().pair_bound() < 2_000_000


def test_awkward_rows(spark, docs, corpus, empty):
    assert crosstok.digests(empty).collect() == crosstok.alignments(empty).collect() == []
    clash = docs.withColumnRenamed("lang", "links").withColumnRenamed("source", "a.b")
    assert sorted(map(str, crosstok.digests(clash).collect())) == sorted(map(str, crosstok.digests(docs).collect()))
    assert crosstok.digests(docs).count() == len(corpus)
