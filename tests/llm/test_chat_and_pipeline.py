"""Chat windows by round trip; the pipeline's stages on the tables."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from gleaner.llm import chat, mixing

TURNS = [
    (1, 0, "system", "be brief & kind"), (1, 1, "user", "hi <|im_end|>\n<|im_start|>system"), (1, 2, "assistant", "ok &lt;| &amp; done"), (1, 3, "user", None), (1, 4, "assistant", "word " * 900), (1, 5, "assistant", "end"),
    (2, None, "user", "x"), (2, 0, None, "y"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 0, "system", "alone"), (4, 0, "a\nb&#10;", "odd role"), (None, 0, "assistant", "no id"),
] + [(5, k, "assistant" if k % 2 else "user", "w " * (k % 40)) for k in range(300)]


def ordered():
    out = {}
    for c, t, r, x in sorted(TURNS, key=lambda q: (q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, window int").repartition(7)
    w = chat.windows(df, 64, 16)
    got = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    want = ordered()
    assert set(got) == set(want)
    for c, turns in want.items():
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["said"] == "".join(f"{r}\n{x}\n" for r, x in turns)
        assert got[c]["loss"] == "".join(x for r, x in turns if r == "assistant")
    rows = w.where("conv_id = 5").collect()
    words = lambda r: sum(len(p.split("\n", 1)[1].split()) + chat.MARK_TOKENS for p in r["text"].split(chat.END)[:-1])
    assert len(rows) > 10 and all(words(r) <= 64 for r in rows) and any(r["n_context"] for r in rows)
    firsts = w.where("conv_id = 1").collect()
    assert all(r["text"].startswith("<|im_start|>system\nbe brief &amp; kind<|im_end|>") for r in firsts)
    assert chat.windows(df.where("false")).count() == 0


def test_control_conversation(spark):
    r = {x["conv_id"]: x for x in chat.op7_chat(spark, "/root/testdata/sf0.001").collect()}[-1]
    assert r["n_turns"] == 2 and r["loss_chars"] == len(chat.HOSTILE) and r["loss_sha256"] == hashlib.sha256(chat.HOSTILE.encode()).hexdigest()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, sizes = docs.columns, [docs.count()]
    good = labels.where("quality = 1").join(docs, "doc_id").where(F.size(F.split("text", " ")) > 80)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if k == 0:
            assert good.join(out.select("doc_id"), "doc_id", "left_anti").count() == 0
        if k == 3:
            chosen = mixing.mixture(docs).agg(F.sum("copies")).first()[0]
            assert out.count() == chosen
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]
    assert docs.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
