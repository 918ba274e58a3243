"""Operators on documents against brute force, and their edge cases."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import bytescan, common, decontaminate, language, licenses, linededup, mixing, quality, sharding, simhash, toxicity
from gleaner.llm.graph import components
from tests import oracle
from tests.llm.conftest import SCHEMA, crc

SPACE = "[\x20\x09-\x0d]+"


def words(t):
    return [w for w in re.split(SPACE, t or "") if w]


# --- words as bytes


def test_bytescan_words_and_hashes():
    texts = ["Ab, cd\n ef", None, "", "ÉA éa ÉA!", "x" * 3000 + " y", " lead"]
    for p in bytescan.pieces(pa.array(texts), 16):
        w = bytescan.words(p)
        raw = p.buf.tobytes()
        got = [[raw[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.bounds, w.bounds[1:], strict=False)]
        assert got == [words(t) for t in texts[p.first : p.first + p.rows]]
    p = next(bytescan.pieces(pa.array(["Éa, éA b"])))
    h = bytescan.folded_hashes(p, bytescan.words(p))
    assert h[0] == h[1] != h[2]


# --- 10: quality


def brute_measures(t):
    t = t or ""
    w = words(t)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_matches_brute_force(spark, docs, corpus):
    slots = 512
    trusted = spark.createDataFrame([(k,) for k in range(0, 120, 2)] + [(0,), (None,)], "doc_id long")
    got = quality.quality(docs, trusted, slots, -0.05).collect()
    slot = lambda *w: _xx(*w) % slots
    grams = lambda w: [slot(x) for x in w] + [slot(*p) for p in zip(w, w[1:], strict=False)]
    raw, target = collections.Counter(), collections.Counter()
    for i, t, *_ in corpus:
        raw.update(grams(words(t)))
        if i is not None and i < 120 and i % 2 == 0:
            target.update(grams(words(t)))
    weight = [float(np.float32(math.log((target[k] + 0.5) / (target.total() + 0.5 * slots)) - math.log((raw[k] + 0.5) / (raw.total() + 0.5 * slots)))) for k in range(slots)]
    want = []
    for i, t, *_ in corpus:
        m, g = brute_measures(t), grams(words(t))
        llr = sum(weight[k] for k in g) / len(g) if g else 0.0
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((i, *m, failed, round(llr, 9), not failed and llr >= -0.05))
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter((*(r[c] for c in cols), round(r["llr"], 9), r["kept"]) for r in got) == collections.Counter(want)
    kept = quality.kept_rows(docs, trusted, slots, -0.05)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[-1])


def _xx(*ws):
    h = 42
    for w in ws:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def test_quality_repeats(spark):
    t = "a b c a b c d " * 10 + "\nx y\nx y\n \n"
    r = quality.quality(spark.createDataFrame([(1, t, True)], "doc_id long, text string, kept boolean"), spark.createDataFrame([], "doc_id long"), 64).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(t)


# --- 5: SimHash


def brute_print(t):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) > 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, docs, corpus):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_print(t) for _, t, *_ in corpus]
    parent = list(range(len(corpus)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(corpus)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(corpus):
        if i is not None:
            least[root(k)] = min(least.get(root(k), 10**9), i)
    want = collections.Counter((i, prints[k], least.get(root(k))) for k, (i, *_) in enumerate(corpus))
    assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    stays = simhash.deduplicated(docs.withColumn("_text_hash", F.lit(7)).withColumn("row", F.lit(1)))
    assert stays.columns == [*docs.columns, "_text_hash", "row"] and stays.select("_text_hash").distinct().first()[0] == 7
    ids = [r["doc_id"] for r in stays.collect()]
    assert len(ids) == len({root(k) for k in range(len(corpus))})
    assert {i for i in ids if i is not None} == set(least.values())


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = set()
    for b in base.tolist():
        for _ in range(12):
            v = b
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    want = {v: v for v in values}
    changed = True
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    while changed:
        changed = False
        for a, b in near:
            m = min(signed[want[a]], signed[want[b]])
            for x in (a, b):
                if signed[want[x]] != m:
                    want[x] = m % (1 << 64)
                    changed = True
    df = spark.createDataFrame([(signed[v],) for v in values], "fp long")
    for block in (8, 2048):
        found = {r["node"]: r["root"] for r in components(simhash.links(df, block=block)).collect()}
        assert all(found.get(signed[v], signed[v]) == signed[want[v]] for v in values)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# --- 2: decontamination


def test_leaks_are_found(spark):
    item = "A train leaves Paris with 120 people and 35 leave at the next stop, how many people are on the train when 120 more board it"
    other = item.replace("120", "77").replace("35", "9")
    mixed = item.replace("120 people", "77 people").replace("35", "9")
    rows = [(1, f"Before this. {item} after that."), (2, f"Intro\n{other}"), (3, "nothing of the kind here at all"), (4, None), (5, ""), (6, item.upper()), (7, item[: len(item) // 2]), (8, mixed)]
    rows += [(1, rows[0][1])]
    items = spark.createDataFrame([(10, item), (11, "two words"), (12, None), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items).collect()}
    # 8 uses 77 for one of the item's two 120s only: its slots do not agree.
    assert {k[0] for k in got} >= {1, 2} and 8 not in {k[0] for k in got} and not {3, 4, 5, 7} & {k[0] for k in got}
    assert all(k[1] == 10 for k in got)
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert {3, 4, 5, 7, 8} <= {r["doc_id"] for r in kept.collect()} and not {1, 2} & {r["doc_id"] for r in kept.collect()}


def test_leaks_in_other_case_and_with_other_first_names(spark):
    item = "A train leaves Paris with 120 people and 35 leave at the next stop, how many people are on the train when 120 more board it"
    story = "Maria sells her old red bicycle for 40 dollars and buys a lamp. Maria then pays the shop for a new wheel and a bell. Maria keeps what is left over in a small tin box."
    items = spark.createDataFrame([(10, item), (20, story)], "item_id long, text string")
    renamed = story.replace("Maria", "Sofia")
    rows = [(6, item.upper()), (7, f"Read this. {renamed}"), (8, renamed.replace("Sofia", "Nadia", 1).replace("Sofia", "Petra", 1)), (9, item.upper() + " " + item), (11, "Maria sells nothing at all. Maria then goes home.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items).collect()}
    # 8 has another name in each sentence: its slots do not agree.
    assert set(got) == {(6, 10), (7, 20), (9, 10)}
    assert got[(6, 10)]["n_found"] == got[(6, 10)]["n_windows"] and got[(7, 20)]["n_found"] == got[(7, 20)]["n_windows"]
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items).orderBy("doc_id").collect()] == [8, 11]


def test_leaks_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    tok = lambda t: [x for x in (re.sub(r"[^\w]|_", "", w) for w in words(t.lower())) if x]
    grams = {r["item_id"]: {tuple(w[k : k + 5]) for w in [tok(r["text"])] for k in range(len(w) - 4)} for r in items.collect()}
    want = set()
    for r in docs.collect():
        w = tok(r["text"])
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        want |= {(r["doc_id"], i) for i, g in grams.items() if g and len(g & own) >= 0.8 * len(g)}
    assert want and got == want


def brute_template(t):
    """(template words, literal words) of a text: numbers, units after them, and capitalised words that open no sentence."""
    raw, out = words(t), []
    for k, w in enumerate(raw):
        core = re.sub(r"[^\w]|_", "", w)
        if not core:
            continue
        opens = k == 0 or raw[k - 1][-1] in ".!?:"
        kind = "<n>" if core[0].isdigit() else "<u>" if out and out[-1][0] == "<n>" and core.lower() in decontaminate.UNITS else "<x>" if core[0].isupper() and len(core) > 1 and not opens else core.lower()
        out.append((kind, core.lower()))
    return out


def brute_match(item, doc):
    """(windows of the item, found in the document, slots, share that agrees), without names that open sentences."""

    def windows_of(rows):
        for k in range(len(rows) - 4):
            part = rows[k : k + 5]
            plain = sum(x[0][0] != "<" for x in part) < decontaminate.LEAST_LITERAL
            yield k, tuple(x[1] if plain else x[0] for x in part), tuple(x[1] for x in part), part

    a, b = list(windows_of(brute_template(item))), list(windows_of(brute_template(doc)))
    hits = [(i, j, x, y) for i, t, lit, x in a for j, u, lit2, y in b if t == u or lit == lit2 or t == lit2 or lit == u]
    found = {t for i, t, *_ in a if any(h[0] == i for h in hits)}
    slots = [(j - i, p[1], q[1]) for i, j, x, y in hits for p, q in zip(x, y, strict=True) if p[0][0] == "<" and p[0] == q[0]]
    agree = lambda this, other: sum(max(collections.Counter(s[other] for s in slots if (s[0], s[this]) == key).values()) for key in {(s[0], s[this]) for s in slots})
    return len({t for _, t, *_ in a}), len(found), len(slots), min(agree(1, 2), agree(2, 1)) / len(slots) if slots else 1.0


def test_templates_and_slots_match_brute_force(spark):
    rng = np.random.default_rng(8)
    item = "A tank holds 40 litres and a pump of Nora fills 5 litres in 3 minutes while another of Omar empties 2 litres in 4 minutes, so how long until 40 litres are in the tank of Nora"
    docs, numbers, names = [], ["40", "5", "3", "2", "4", "7", "90"], ["Nora", "Omar", "Lena", "Ivan"]
    for k in range(80):
        t = item.split()
        swap = {x: str(rng.choice(numbers)) for x in ("40", "5", "3", "2", "4")} if k % 2 else {}
        swap |= {x: str(rng.choice(names)) for x in ("Nora", "Omar")} if k % 3 else {}
        t = [swap.get(w, w) for w in t]
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, len(t)))] = str(rng.choice([*numbers, *names, "water", "slowly"]))
        docs.append((k, " ".join(["well", *t, "end"])))
    got = {r["doc_id"]: r for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    held = 0
    for k, t in docs:
        n, found, slots, agreement = brute_match(item, t)
        want = found >= 0.8 * n and agreement >= 0.8
        assert (k in got) == want, (t, n, found, agreement)
        if want:
            held += 1
            assert (got[k]["n_windows"], got[k]["n_found"]) == (n, found) and abs(got[k]["agreement"] - agreement) < 1e-9
    assert 5 < held < 75


def test_no_benchmark(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.contaminated(empty, none).count() == 0


# --- 3: language


def test_languages(spark):
    de, en = "der die das und nicht mit schön über", "the and of with this that would have"
    rows = [(k, " ".join(np.random.default_rng(k).choice((de if k % 2 else en).split(), 20)), "de" if k % 2 else "en") for k in range(60)]
    extra = [(100, None, "en"), (101, "", "en"), (102, "123 !!", "de"), (103, "日本語", None), (None, "das und die", "de")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + extra], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in language.language(docs, docs.where("doc_id < 40")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert got[103]["lang_pred"] in ("de", "en") and got[None]["lang_pred"] == "de" and got[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == (crc(i, 4) == 2) for i, *_ in rows)
    assert {r["lang_pred"] for r in language.language(docs, docs.where("false")).collect()} == {"und"}


def test_filters_hold_what_they_were_given(spark):
    grams = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    table = np.zeros(language.SLOTS, np.uint8)
    for s in language._slots(grams):
        table[s] |= np.uint8(1)
    assert all(table[s].all() for s in language._slots(grams))


def brute_grams(t):
    """Grams of 1 to 4 characters of a text's words, with a space before and after each."""
    words_ = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    return [g for w in words_ for s in [f" {w} "] for n in language.SIZES for k in range(len(s) - n + 1) for g in [s[k : k + n]] if g.strip()]


def test_filters_and_popcounts_match_brute_force(spark):
    rng = np.random.default_rng(6)
    taught = [(" ".join("".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(30)), lang) for lang, letters in (("de", "abcüß"), ("en", "abcdef"), ("fr", "éèbcdg")) for _ in range(12)]
    counts = {lang: collections.Counter(g for t, x in taught if x == lang for g in brute_grams(t)) for lang in ("de", "en", "fr")}
    got = collections.Counter()
    for r in language.gram_counts(spark.createDataFrame(taught, "text string, lang string").repartition(3)).collect():
        got[r["lang"]] += r["n"]
    assert got == {lang: c.total() for lang, c in counts.items()}
    has = {lang: set(c) for lang, c in counts.items()}
    f = language.fit(spark.createDataFrame(taught, "text string, lang string"))
    assert f.langs == sorted(has)
    asked = [t for t, _ in taught[::5]] + ["abc éé", "zz", "x" * 3000, "", "ü"]
    names, scores = language.decide(f, pa.array(asked))
    for t, name, score in zip(asked, names, scores, strict=True):
        grams = brute_grams(t)
        hits = np.array([sum(g in has[lang] for g in grams) for lang in f.langs], float)
        if not grams:
            assert name == "und" and score == 0
        elif hits.sum() == 0:
            assert name == f.fallback
        else:
            # No false positive is expected of so few grams; the correction takes off as many as there might be.
            true = np.maximum(hits - len(grams) * f.false, 0) / (1 - f.false)
            assert name == f.langs[int(true.argmax())] and abs(score - true.max() / true.sum()) < 1e-9


def test_language_on_the_tables(spark):
    out = language.op3_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.95


# --- 1: toxicity


def test_toxic_words_are_learnt(spark):
    rng = np.random.default_rng(2)
    common, bad = [f"w{k}" for k in range(300)], ["vile", "nasty"]
    rows = []
    for k in range(900):
        w = rng.choice(common, 60).tolist()
        if k % 4 == 0:
            for p in rng.choice(60, 6, replace=False):
                w[p] = bad[p % 2]
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame([(*r, 9) for r in [*rows, (5000, None), (5001, ""), (None, "vile nasty")]], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(900)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got if r["doc_id"] is not None)
    assert len(held) > 100 and np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    # What is held out teaches nothing.
    turned = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)


def test_one_class_only(spark):
    docs = spark.createDataFrame([(k, "a b c") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k in range(40)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, labels).collect()} == {0.0}
    assert toxicity.toxicity(docs, labels.where("false")).count() == 40


def brute_kneser_ney(texts, order, shared):
    """texts (text, toxic) -> a function: text -> mean log ratio, or None."""
    tokens = lambda t: [f" {w} " for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    grams = lambda t: [s[max(0, e - order + 1) : e + 1] for s in tokens(t) for e in range(1, len(s))]
    levels = []
    for own in (lambda y: y == 1, lambda y: y == 0, lambda y: True):
        top = collections.Counter(g for t, y in texts if own(y) for g in grams(t))
        by = {n: {g: c for g, c in top.items() if len(g) == n} for n in range(1, order + 1)}
        for n in range(order, 1, -1):
            for g, c in collections.Counter(g[1:] for g in by[n]).items():
                assert g not in by[n - 1]
                by[n - 1][g] = c
        levels.append(by)

    def probability(k, g):
        if not g:
            return 1 / len(levels[2][1])
        by = levels[2 if len(g) <= shared else k][len(g)]
        ones, twos = (sum(c == m for c in by.values()) for m in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.75
        after = [c for x, c in by.items() if x[:-1] == g[:-1]]
        low = probability(k, g[1:])
        return max(by.get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * low if after else low

    def evidence(t):
        g = grams(t)
        return sum(math.log(probability(0, x) / probability(1, x)) for x in g) / len(g) if g else None

    return evidence


@pytest.mark.parametrize("shared", [1, 2, 3])
def test_kneser_ney_matches_brute_force(spark, shared):
    rng = np.random.default_rng(4)
    parts = ["an", "be", "co", "d", "ée", "ß", "日本"]
    text = lambda n: " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))
    taught = [(text(12), int(k % 3 == 0)) for k in range(12)] + [("bedbedbed!", 1)] * 2
    asked = [*[t for t, _ in taught], text(30), "unseen wörds 42 x", None, "", "12 34", "É", "𝔸𝔹 an", text(5000), text(3), "zz"]
    want = [brute_kneser_ney(taught, 4, shared)(t or "") for t in asked]
    counts = toxicity.gram_counts(spark.createDataFrame(taught, "text string, toxic int").repartition(3))
    model = toxicity.Model(*toxicity.kneser_ney(counts, 4, shared), 4, shared)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(asked)] * 2, "i long, text string").repartition(4)
    for limit in (toxicity.MODEL_BYTES, 0):
        model.limit = limit
        got = toxicity.with_evidence(df, model).collect()
        assert len(got) == 2 * len(asked)
        for r in got:
            assert (r["evidence"] is None) == (want[r["i"]] is None)
            assert want[r["i"]] is None or abs(r["evidence"] - want[r["i"]]) < 1e-6


# --- 4, 6, 8, 9 on edge cases


def test_mixture(spark, docs, corpus, empty):
    got = mixing.mixture(docs).collect()
    units = collections.Counter()
    for i, t, lang, source, _ in corpus:
        if words(t):
            units[(i, lang or "", source or "")] += len(words(t))
    supply = collections.Counter()
    for (_, lang, source), n in units.items():
        supply[(lang, source)] += n
    taken = collections.Counter()
    for r in got:
        assert 1 <= r["copies"] <= mixing.MAX_EPOCHS and units[(r["doc_id"], r["lang"], r["source"])] == r["n_tokens"]
        taken[(r["lang"], r["source"])] += r["copies"] * r["n_tokens"]
    assert sum(taken.values()) <= mixing.BUDGET * sum(supply.values()) + 1
    assert all(taken[k] <= mixing.MAX_EPOCHS * supply[k] for k in supply)
    assert mixing.mixture(empty).count() == 0
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and rows.count() >= sum(r["copies"] for r in got)


def test_budget_goes_to_siblings_first(spark):
    leaves = [("web", "en", "src0", 100), ("web", "en", "src1", 1000), ("web", "de", "src0", 1000), ("books", "en", "src5", 1000)]
    w = {"domain": {}, "lang": {}, "source": {}}
    q = {tuple(r[c] for c in mixing.LEVELS): r["quota"] for r in mixing.quotas(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), 0.5, 1, w).collect()}
    # 1550 tokens: 775 a domain; web: 387.5 a language; src0 is short by 93.75, which its sibling takes.
    assert q == {("web", "en", "src0"): 100, ("web", "en", "src1"): 287, ("web", "de", "src0"): 387, ("books", "en", "src5"): 775}


def test_shards(spark, docs, corpus, empty):
    clash = docs.withColumn("shard", F.lit("x")).withColumn("Slot2", F.lit(1))
    runs = [sharding.external_shuffle(clash, 16, bucket_rows=17).collect() for _ in range(2)]
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["shard"], r["slot"])
    assert sorted(map(key, runs[0])) == sorted(map(key, runs[1]))
    by = collections.defaultdict(list)
    for r in runs[0]:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(16)]
    assert sum(sizes) == len(corpus) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.external_shuffle(empty).count() == 0
    few = sharding.external_shuffle(docs.limit(3), 16).collect()
    assert len(few) == 3 and all(r["slot"] == 0 for r in few)


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "s"), n_shards=3, bucket_rows=7)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3
    for k in range(3):
        slots = [r["slot"] for r in spark.read.parquet(str(tmp_path / "s" / f"shard={k}")).collect()]
        assert sorted(slots) == list(range(len(slots)))


@pytest.fixture
def settings(spark):
    """A way to set session settings for a test."""
    was = {}

    def put(**conf):
        for k, v in conf.items():
            k = k.replace("_", ".")
            was.setdefault(k, spark.conf.get(k))
            spark.conf.set(k, v)

    yield put
    for k, v in was.items():
        spark.conf.set(k, v)


def test_shards_follow_from_rows_and_seed(spark, settings):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1500).alias("text"))
    layouts = []
    for partitions, aqe, parts, seed in ((4, "true", 3, 1), (7, "false", 5, 1), (3, "true", 8, 1), (4, "true", 3, 2)):
        settings(**{"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": aqe})
        layouts.append(sorted(((r["shard"], r["slot"]), str(r["doc_id"]), r["text"]) for r in sharding.external_shuffle(rows.repartition(parts), seed=seed, bucket_rows=50, equal_rows=1).collect()))
    assert layouts[0] == layouts[1] == layouts[2] != layouts[3]
    # Neighbours in the table are not neighbours in the shards.
    at = {x[2]: k for k, x in enumerate(layouts[0])}
    assert np.corrcoef([at[f"text {k}"] for k in range(1500)], range(1500))[0, 1] < 0.1


def test_equal_rows_fill_no_bucket(spark):
    rows = spark.range(30000).select(F.when(F.col("id") >= 20000, F.col("id")).alias("doc_id"), F.when(F.col("id") >= 10000, F.lit("same")).alias("text"))
    placed = sharding.external_shuffle(rows, 16, bucket_rows=200, equal_rows=100)
    kinds = collections.Counter((r["doc_id"], r["text"]) for r in placed.select("doc_id", "text").collect())
    assert kinds[(None, "same")] == 10000 and kinds[(None, None)] == 10000 and len(kinds) == 10002
    by = placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert all(r["n"] == 1875 == r["slots"] == r["last"] + 1 and 500 < r["nulls"] < 750 for r in by)
    sizes = sharding._numbered(rows.select(F.xxhash64("doc_id", "text").alias("_h1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_h2"), F.struct("doc_id", "text").alias("_row")), rows.select(F.xxhash64("doc_id", "text").alias("_h1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_h2")), 100)
    assert sizes.groupBy("_h1", "_n").count().agg(F.max("count")).first()[0] == 1


def test_sharding_query_shuffles_texts(spark, tmp_path):
    # 20 MB of text in 20 rows: three buckets by bytes, one by rows.
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.repeat(F.chr(F.col("id") + 65), 1 << 20).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["shard"], r["slot"]): (r["size"], r["text_crc32"]) for r in sharding.op8_sharding(spark, str(tmp_path)).collect()}
    real = sharding.external_shuffle(docs, bucket_bytes=sharding.BUCKET_BYTES).collect()
    assert got == {(r["doc_id"], r["shard"], r["slot"]): (len(r["text"]) + 1, zlib.crc32(r["text"].encode())) for r in real}


def test_lines_match_brute_force(spark, corpus):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(i, t) for i, t, *_ in corpus] + [(300, "x y z w v\nnew line of its own here"), (301, "x y z w v u\nX  y z w v"), (302, long), (303, long.replace("w7 ", "other ") + "\x0bw1\t"), (304, long.replace("w2", "v2")), (305, long.upper() + "\n" + long)]
    rows += [(310 + k, f"a variant of one line that many share with number n{k} in it") for k in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string").repartition(6)
    known = [(i, t) for i, t in rows if i is not None]
    hashed = {t: _xx(t) for _, t in known if t}
    lines = sorted({(i, k, hashed[t], frozenset(words(c.lower()))) for i, t in known for k, c in enumerate((t or "").split("\n")) if words(c)}, key=lambda x: x[:3])
    want, sets = {}, {s for *_, s in lines}
    close = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    for n, (i, k, h, s) in enumerate(lines):
        want[(i, k, h)] = (any(close(s, other) for *_, other in lines[:n]), sum(close(s, o) for o in sets if o != s))
    times = collections.Counter((i, k, hashed[t]) for i, t in known for k, c in enumerate((t or "").split("\n")) if words(c))
    for slots, block in ((linededup.SLOTS, linededup.BLOCK_WORDS), (64, 50)):
        rows_got = linededup.similar_lines(df, slots, block).collect()
        got = {(r["doc_id"], r["line"], r["text_hash"]): (r["removed"], r["n_links"]) for r in rows_got}
        assert got == want and any(v[0] for v in want.values()) and any(v[1] > 30 for v in want.values())
        assert collections.Counter((r["doc_id"], r["line"], r["text_hash"]) for r in rows_got) == times
    texts = collections.defaultdict(list)
    out = linededup.deduplicated_lines(df.withColumn("_x", F.lit(1)))
    assert out.columns == ["doc_id", "text", "line", "_x"]
    for r in out.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[301] == [""] and texts[201] == [""] and texts[None] == ["no id here"] and len(texts[204]) == 2 and len(texts[0]) == 3 and len(texts[200]) == 1
    assert linededup.similar_lines(df.where("false")).count() == 0


def test_lines_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["removed"], r["n_links"]) for r in linededup.similar_lines(df).collect()) == [(1, False, 1), (1, False, 1), (2, True, 1)]


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", True, "Released under the MIT License."), (2, "a/b/x.py", False, "code without any"), (3, "a/b/c/y.py", False, "# Licensed under the Apache License, Version 2.0.\ncode"), (4, "z.py", False, None),
        (5, "a/b/LICENSE", True, "no such thing"), (6, None, False, "Licensed under CC BY-NC 4.0."), (7, "ab/x.py", False, "about licensing in general, of some other kind of thing altogether"), (2, "a/b/x.py", False, "code without any"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, path string, is_license_file boolean, text string, license string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in licenses.licenses(df).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "own", None), 4: (None, "none", None), 5: ("MIT", "inherited", "a"), 6: ("CC-BY-NC-4.0", "own", None), 7: (None, "none", None)}
    assert licenses.licenses(df.where("false")).count() == 0


def test_license_headers_without_anchors(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    rows = [(1, "a/LICENSE", True, f"Copyright\n{bsd}:\nall of them"), (2, "a/b/x.py", False, "code of some kind"), (3, "c/y.py", False, "# Released under CC BY-NC 4.0.\ncode"), (4, "c/z.py", False, "use of the source in other forms, with care")]
    df = spark.createDataFrame(rows, "doc_id long, path string, is_license_file boolean, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"], r["score"] >= licenses.THRESHOLD) for r in licenses.licenses(df).collect()}
    assert got == {1: ("BSD-3-Clause", "own", None, True), 2: ("BSD-3-Clause", "inherited", "a", False), 3: ("CC-BY-NC-4.0", "own", None, True), 4: (None, "none", None, False)}


def test_license_files_are_compared_whole(spark):
    whole = {name: text for name, text in licenses.TEMPLATES if len(text) > 400}
    assert len(whole) > 2 and len({name for name, _ in licenses.TEMPLATES}) > 18
    rows = [(k, f"{name}/LICENSE", True, "Copyright (c) 2001 Someone Else\n\n" + text.replace(" the ", "\nthe ").upper()) for k, (name, text) in enumerate(whole.items())]
    rows += [(100, "BSD-2-Clause/a.py", False, "x = 1\n" * 50000), (101, "odd/LICENSE", None, "nothing of the kind"), (102, "odd/LICENSE", True, None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, is_license_file boolean, text string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.licenses(df).collect()}
    assert got == {**{k: (name, "own") for k, name in enumerate(whole)}, 100: ("BSD-2-Clause", "inherited"), 101: (None, "none"), 102: (None, "none")}


def wrapped(text, mark):
    lines, line = [], mark
    for w in text.split():
        if len(line) + len(w) > 70:
            lines.append(line)
            line = mark
        line += " " + w
    return "\n".join([*lines, line])


def test_wrapped_headers_and_openings_of_license_texts(spark):
    gpl = "This program is free software{c} you can redistribute it and/or modify it under the terms of the GNU {k}General Public License as published by the Free Software Foundation{d} either version {v} of the License, or (at your option) any later version."
    headers = {
        "LGPL-2.1": gpl.format(c=";", k="Lesser ", d=";", v="2.1").replace("program", "library"), "LGPL-3.0": gpl.format(c=":", k="Lesser ", d=",", v="3").replace("program", "library"),
        "GPL-3.0": gpl.format(c=":", k="", d=",", v="3"), "GPL-2.0": gpl.format(c=";", k="", d=";", v="2"), "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    }
    openings = {
        "GPL-3.0": " " * 20 + "GNU GENERAL PUBLIC LICENSE\n" + " " * 23 + "Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
        "GPL-2.0": " " * 20 + "GNU GENERAL PUBLIC LICENSE\n" + " " * 23 + "Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n Everyone is permitted to copy\n",
        "LGPL-2.1": " " * 18 + "GNU LESSER GENERAL PUBLIC LICENSE\n" + " " * 23 + "Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n",
        "Apache-2.0": " " * 33 + "Apache License\n" + " " * 27 + "Version 2.0, January 2004\n" + " " * 24 + "http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n",
    }
    rows, want = [], {}
    for name, text in headers.items():
        for k, (head, mark, tail) in enumerate([("/*\n * Copyright (C) 2020 Someone\n *\n", " *", "\n */\n\nint main() { return 0; }\n"), ("#!/bin/sh\n#\n", "#", "\n#\n\necho hello world\n")]):
            want[f"{name} header {k}"] = name
            rows.append((f"{name} header {k}", f"src/{name}{k}/a", False, head + wrapped(text, mark) + tail))
    for name, text in openings.items():
        want[f"{name} opening"] = name
        rows.append((f"{name} opening", f"text/{name}/a", False, text))
    rows += [(f"plain{k}", f"plain/{k}", False, f"Nothing of that kind is said here.\nLine {k} of a program.\n\nThe end.") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, path string, is_license_file boolean, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.licenses(df).collect()}
    assert {k: got[k] for k in want} == want
    assert all(v is None for k, v in got.items() if k.startswith("plain"))


def test_license_filter_loses_nothing(spark):
    rng = np.random.default_rng(3)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["alpha", "beta", "gamma"]
    texts = sorted({" ".join(rng.choice(t.split() if k % 2 else pool, rng.integers(1, 14))) for k in range(300) for _, t in licenses.TEMPLATES})
    df = spark.createDataFrame([(t, t) for t in texts], "segment string, text string")
    idf = licenses.term_weights(df.limit(500)).cache()
    scores = licenses.similarities(df.select("segment"), idf)
    passed = licenses.can_reach(df, licenses._squares(idf), licenses.THRESHOLD).select("segment")
    reach = scores.where(F.col("score") >= licenses.THRESHOLD)
    assert reach.count() > 50 and reach.join(passed, "segment", "left_anti").count() == 0 and passed.count() < len(texts)


@pytest.mark.parametrize("op", [lambda d: toxicity.toxicity(d, d.select("doc_id", F.lit(1).alias("toxic"))), lambda d: language.language(d, d), simhash.near_duplicates, simhash.deduplicated, lambda d: quality.quality(d, d), linededup.similar_lines, mixing.mixed])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("op", [
    mixing.mixed, linededup.deduplicated_lines, lambda d: sharding.external_shuffle(d).drop("shard", "slot"), lambda d: quality.kept_rows(d, d), lambda d: quality.quality(d, d).select(*[f"`{c}`" for c in d.columns]),
    simhash.deduplicated, lambda d: decontaminate.decontaminated(d, d.sparkSession.createDataFrame([(1, "no such words stand in any text here")], "item_id long, text string")),
])
def test_names_that_clash(spark, docs, op):
    """Columns with the names that operators use themselves, and with a dot, come through unchanged."""
    names = ["copies", "_copy", "a.b", "_gone", "_g", "_weights", "weights", "row", "hash", "_id", "_row", "worded", "h", "j", "col"]
    clash = docs.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    out = op(clash)
    assert out.columns == clash.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)


def test_items_that_open_alike_bring_no_pairs_together(spark):
    """Windows that all items share are no keys: the candidates are the documents that hold an item."""
    opening = "please read the following question with care and then choose one of the answers that are given below it"
    own = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    items = spark.createDataFrame([(k, f"{opening} {own(k)}") for k in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"{opening} {own(1000 + d)} " * 5) for d in range(40)] + [(100, f"start {opening} {own(7)} end")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(100, 7)]


def test_sql(spark):
    from gleaner.llm import registry

    sf = "/root/testdata/sf0.001"
    con = oracle.connect(sf)
    for name, sql in registry.ORACLES.items():
        oracle.same(registry.QUERIES[name](spark, sf), sql, con)


def test_lines_words_in_lower_case_as_their_text(spark):
    """Case that depends on neighbours ends at white space: a word's lower case is its part of the line's."""
    odd = ["ΟΔΟΣ ΣΑΣ\tΣ ÁΣ", "İstanbul İ DŽ ẞ", "\x0bΑΣ\x0cΣΑ\r", "  ", "ΑΣ'Σ ­Σ", "x Y Z"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    by_word = F.filter(F.transform(linededup._words(F.col("text")), lambda w: F.lower(w)), lambda w: w != "")
    by_line = F.array_remove(linededup._words(F.lower("text")), "")
    by_pattern = common.words_of(F.lower("text"))
    assert df.where((by_word != by_line) | (by_word != by_pattern)).count() == 0


def test_line_bitmaps_bound_the_words_apart(spark):
    df = spark.createDataFrame([([k * 7919 << 20 | j * 31 for j in range(n)],) for k, n in ((1, 1), (2, 5), (1, 90), (3, 400))], "ids array<long>")
    r = df.select(*linededup._bits(F.col("ids")), *[linededup._toggled(F.col("ids"), k, 2).alias(f"t{k}") for k in (0, 1)]).collect()
    assert all((x["bits0"] ^ x["bits1"], x["bits1"]) == (x["t0"], x["t1"]) for x in r)


def test_line_bitmaps_of_unlike_sizes_bound_the_words_apart(spark):
    """A small set has no second half: what differs is then told by the sum, and stays a bound beside sets that have one."""
    small, large = linededup.LINE_OF_128 - 1, linededup.LINE_OF_128
    sets = [list(range(k, k + n * 31, 31)) for k, n in ((0, 4), (0, 5), (0, small), (0, large), (31, large), (0, 3 * large))]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "k int, ids array<long>").select("k", "ids", *linededup._bits(F.col("ids"), large))
    assert [r["bits1"] is None for r in df.orderBy("k").collect()] == [len(s) < large for s in sets]
    sizes = F.size("a.ids") + F.size("b.ids")
    near = linededup._bits_may_link(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), sizes)
    rows = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), near.alias("near")).collect()
    apart = {(i, j): len(set(a) ^ set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets)}
    assert all(r["near"] for r in rows if 9 * apart[r["i"], r["j"]] <= len(sets[r["i"]]) + len(sets[r["j"]]))
    assert not next(r["near"] for r in rows if (r["i"], r["j"]) == (0, 2))


def test_whole_sets_are_those_of_the_lines_at_their_places(spark):
    docs = spark.createDataFrame([(1, "A b\tc\n\x0b \nb A c d"), (1, "A b\tc\n\x0b \nb A c d"), (1, "x\ny z")], "doc_id long, text string")
    ranks = linededup.stored(linededup.slot_ranks(docs, 64))
    lines = {(r["text_hash"], r["line"]): r["ids"] for r in linededup._lines(docs, ranks, 64).collect()}
    assert sorted(len(ids) for ids in lines.values()) == [1, 2, 3, 4]
    places = sorted(lines)
    wanted = spark.createDataFrame([(c, (1, line, h)) for c, (h, line) in enumerate(places[1:])], "c long, place struct<doc_id:long,line:int,text_hash:long>")
    assert {r["c"]: r["ids"] for r in linededup._whole_sets(docs, ranks, 64, wanted).collect()} == {c: lines[p] for c, p in enumerate(places[1:])}


def test_lines_are_coded_without_patterns_and_made_sets_once(spark):
    docs = spark.createDataFrame([(1, "b  a\tB c\x0bc\x0cd\rD "), (2, "a a a a\n \na  b")], "doc_id long, text string")
    ranks = linededup.slot_ranks(docs, 64)
    lines = linededup._lines(docs, ranks, 64)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("array_distinct(") == 1
    upper = ranks.first()["ranks"]
    want = lambda line: sorted({upper[h & 63] | (h % (1 << 64)) >> 6 for h in (xxhash.xxh64_intdigest(w.encode(), 42) for w in line.split())})
    assert {(r["doc_id"], r["line"]): r["ids"] for r in lines.collect()} == {(1, 0): want("a b c d"), (2, 0): want("a"), (2, 2): want("a b")}
    assert len(upper) == 64 and all(x >> 58 << 58 == x for x in upper)


def test_copies_of_lines_meet_in_their_class_without_a_partial_sort(spark):
    """Lines go to the task of their class as they are: one sort, of what has met there."""
    docs = spark.createDataFrame([(k, "one two three\nfour five") for k in range(4)], "doc_id long, text string")
    made = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(linededup, "stored", lambda df: made.append(df) or common.stored(df))
        lines, classes = linededup._classes(docs, common.stored(linededup.slot_ranks(docs, 64)), 64)
    plan = made[-1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 == plan.count("REPARTITION_BY_COL")
    assert lines.count() == 8 and sorted((r["n"], r["place"]["doc_id"], r["place"]["line"]) for r in classes.collect()) == [(2, 0, 1), (3, 0, 0)]
