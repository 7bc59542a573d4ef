"""Periodic runs, source divergence and language ID against brute force, and on awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import language_id, periodic_runs, source_divergence
from pointloom.llm import _words as W

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_runs(w, least=24, times=3):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic_texts():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "la " * 23), (5, "la " * 24), (6, "a b " * 12), (7, "a b " * 12 + "a"), (8, "É é\n" * 40 + "日本 ☃"), (9, "x " * 30 + "y " * 30), (9, "x " * 30 + "y " * 30), (None, "z w " * 20)]
    for i in range(60):
        words = []
        while len(words) < rng.randint(0, 300):
            few = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 40))]
            words += (few * rng.randint(1, 9))[: rng.randint(1, 200)]
        rows.append((10 + i, rng.choice([" ", "\n", " \t "]).join(words)))
    long = [str(rng.randint(0, 10**6)) for _ in range(3000)]
    rows.append((99, " ".join((long[:2000] * 4)[:7000] + long)))
    return rows


def test_runs_against_all_lags():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = []
            while len(w) < rng.randint(0, 120):
                few = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, 12))]
                w += (few * rng.randint(1, 8))[: rng.randint(1, 60)] if rng.random() < 0.6 else [rng.randint(0, 300)]
            docs.append(w)
        ids, doc = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(w) for w in docs])
        least = rng.choice([24, 6, 3])
        for rounds in (0, 1, 64):
            got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(ids, doc, least, rounds=rounds)), strict=True))
            want, at = [], 0
            for w in docs:
                want += [(s + at, n, q) for s, n, q in plain_runs(w, least)]
                at += len(w)
            assert sorted(got) == sorted(want)


def test_splitting_drops_what_is_in_no_run():
    ids = np.array([1, 2] * 20 + [9] + [3, 4, 5] * 9 + [7, 8] * 5)
    place, segment = periodic_runs.segments(ids, np.zeros(len(ids), int))
    assert place.tolist() == [*range(40), *range(41, 78)] and segment.tolist() == [0] * 40 + [1] * 37
    assert len(periodic_runs.segments(np.arange(500), np.zeros(500, int))[0]) == 0


def test_periodic_runs(spark):
    rows = periodic_texts()
    docs = spark.createDataFrame([(i, t, i, "clash") for i, t in rows], "doc_id long, text string, runs long, best string")
    want = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        runs = plain_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want.append((i, len(w), runs, best, " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    kept = periodic_runs.periodic_runs(docs, carry=docs.columns).select("_carry.best").collect()
    assert len(kept) == len(rows) and {r["best"] for r in kept} == {"clash"}


def test_edit_of_the_query(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in zip(range(300), (k % 23 for k in range(300)), strict=True)] + [(300, None), (None, "a b")]
    got = {r["doc_id"]: r["text"] for r in periodic_runs.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = WORDS.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
        assert got[i] == t


def plain_divergence(rows, min_docs, scale, top):
    lower = str.maketrans(source_divergence.UPPER, source_divergence.LOWER)
    docs = [(lang or "", source or "", TERMS.findall((text or "").translate(lower))) for lang, source, text in rows]
    found, out = defaultdict(Counter), []
    for lang, _, ts in docs:
        found[lang].update(set(ts))
    for lang in {x for x, _, _ in docs}:
        kept = {t for t, k in found[lang].items() if k >= min_docs}
        count, every = defaultdict(Counter), Counter()
        for x, source, ts in docs:
            if x == lang:
                count[source].update(t for t in ts if t in kept)
                every.update(t for t in ts if t in kept)
        p = lambda c, t: 1 + scale * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = [(o, sum(f(p(count[s], t), p(count[o], t)) for t in kept)) for o in count if o != s]
            terms = [(t, f(p(count[s], t), p(every, t))) for t in kept if count[s][t] and p(count[s], t) > p(every, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked[:most], 1)]
    return out


def sourced_rows():
    rng = random.Random(8)
    rows = [(None, None, None), ("", "", "x"), ("en", "s0", None), ("en", "empty", ""), ("xx", "a", "only one"), ("xx", "b", ""), ("yy", "alone", "nothing here")]
    words = ["Word", "word,", "wörd", "Ünder", "a-b", "b.a", "foo-foo", "FOO", "éa", "12x3", "日本", "\x01ctl\x02"]
    for i in range(400):
        few = rng.sample(words, 4)
        rows.append((rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1", "s2", "Ärger"]), " ".join(rng.choice(few) for _ in range(rng.randint(0, 30))) + f" rare{i} Rare{i // 9}"))
    return rows + rows[-3:] * 2 + [("en", "s1", "long " + "tail word " * 20000)]


@pytest.mark.parametrize(("held", "slice_size"), [(1 << 22, 1 << 23), (1, 500)])
def test_source_divergence(spark, monkeypatch, held, slice_size):
    """Also with every slice of text and every language's sums handed on at once."""
    monkeypatch.setattr(source_divergence, "SLICE", slice_size)
    if held == 1:
        sums = source_divergence.pair_sums
        monkeypatch.setattr(source_divergence, "pair_sums", lambda t: sums(t, held))
    rows = sourced_rows()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "lang string, source string, text string, n long, term string").repartition(3)
    got = [tuple(r) for r in source_divergence.source_divergence(docs, min_docs=5, top=3).collect()]
    assert sorted(got) == sorted(plain_divergence(rows, 5, source_divergence.SCALE, 3))


def test_source_divergence_without_terms(spark):
    docs = spark.createDataFrame([("en", "a", "b"), ("en", "c", None)], "lang string, source string, text string")
    assert sorted(map(tuple, source_divergence.source_divergence(docs).collect())) == [("en", "a", "pair", "c", 0, 1), ("en", "c", "pair", "a", 0, 1)]
    assert source_divergence.source_divergence(docs.limit(0)).count() == 0


def test_term_counts_tell_documents_apart(spark):
    """Spellings that share documents: enough by one chunk, by several, or only if documents counted twice."""
    rows = [("en", "s", "The the, THE.")] * 9 + [("en", "t", "the")] + [("en", "t", "Rare rare, RARE. rare-rare")] * 9 + [("en", "s", "Sure, sure.")] * 10 + [("en", "s", f"odd{i}") for i in range(10)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    got = source_divergence.term_counts(docs, 10).join(docs.select("source").distinct().withColumn("h", F.xxhash64("source")).withColumnRenamed("source", "s"), F.col("source") == F.col("h"))
    got = [tuple(r) for r in got.select("lang", "s", "term", "n", "lang_n").collect()]
    assert sorted(got) == [("en", "s", "odd", 10, 10), ("en", "s", "sure", 20, 20), ("en", "s", "the", 27, 28), ("en", "t", "the", 1, 28)]


def plain_grams(text):
    plain = re.sub(rb" +", b" ", b" " + bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode()) + b" ")
    return [(n, plain[k : k + n]) for n in language_id.SIZES for k in range(len(plain) - n + 1)]


def language_rows():
    return [(1, "the cat and the dog", "en"), (2, "The end of the road", "en"), (3, "der Hund und die Katze", "de"), (4, "über die Straße", "de"), (5, "le chat et le chien été", "fr"), (6, None, "fr"), (7, "...", "en"), (8, "lost", None)]


def test_filters_hold_every_language(spark):
    """No n-gram's language is missed; counts and decisions are those of plain sets, but for chance hits."""
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = language_id.fit(docs, min_rate=0.0, relative=1e18)
    assert model.langs == ["de", "en", "fr"]
    sets = {x: {g for _, t, y in language_rows() if y == x and t for g in plain_grams(t)} for x in model.langs}
    texts = [t for _, t, _ in language_rows() if t] + ["", "a", "die the le"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    total, found = language_id.hits(model, np.frombuffer(b"".join(raw), np.uint8), at)
    for k, t in enumerate(texts):
        grams = plain_grams(t)
        assert total[k] == len(grams)
        assert found[k].tolist() == [sum(g in sets[x] for g in grams) for x in model.langs]


def test_rare_grams_are_left_out(spark):
    """A language doesn't get what is much rarer in it than elsewhere, or too rare at all."""
    docs = spark.createDataFrame([(1, "aaa " * 100 + "zz", "x"), (2, "zz " * 100, "y")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, min_rate=1e-4, relative=5.0)
    raw = b"zz"
    total, found = language_id.hits(model, np.frombuffer(raw, np.uint8), np.array([0, 2]))
    assert found[0, 1] == total[0] and found[0, 0] < total[0]


def test_chance_is_taken_off():
    model = language_id.Filters(["a", "b"], np.zeros((1, 4), np.uint64), np.array([0.9, 0.1]), 1)
    best, score = language_id.decide(model, np.array([100, 100, 0]), np.array([[80, 60], [60, 0], [0, 0]]))
    chance = np.array([0.9, 0.1]) ** language_id.HASHES
    want = (np.array([0.8, 0.6]) - chance) / (1 - chance)
    assert best.tolist() == [int(want.argmax()), 1, 1] and np.isclose(score[0], want.max()) and score[1:].tolist() == [0, 0]


def test_many_languages_and_awkward_rows(spark):
    """More languages than a slot has bits; nulls, no letters, repeated rows, clashing columns, empty tables."""
    rows = [(i, f"{chr(0x3400 + 7 * i)}{chr(0x3401 + 7 * i)} " * 5, f"l{i:03}") for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.table) == 3
    odd = [(500, None), (501, ""), (502, "12 + 3 — €"), (503, "é"), (503, "é"), (None, rows[7][1]), (504, "x " * 400_000)]
    got = language_id.identify(spark.createDataFrame([(*r, "clash") for r in [*[r[:2] for r in rows], *odd]], "doc_id long, text string, score string"), model).collect()
    assert [r["lang_pred"] for r in got[:130]] == [r[2] for r in rows]
    assert [r["lang_pred"] for r in got[130:133]] == ["und"] * 3 and [r["score"] for r in got[130:133]] == [0.0] * 3
    assert got[133] == got[134] and got[133]["lang_pred"] in model.langs and got[135]["lang_pred"] == "l007"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(docs.limit(0), model).count() == 0
    none = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.001"
    got = language_id.op13_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out")
    right, every = got.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert every > 20 and right >= 0.97 * every


def test_word_array():
    texts = ["ab  c", "", "d", "e\tf "]
    raw = [t.encode() for t in texts]
    flat = W.flatten(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), hashed=False)
    assert W.word_array(flat).to_pylist() == [b"ab", b"c", b"d", b"e", b"f"]
