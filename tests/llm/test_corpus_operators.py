"""Every operator on awkward rows, and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import (
    best_fit_packing,
    chat_formatting,
    fingerprints,
    jaccard_join,
    lm_scoring,
    piece_codec,
    quality_classifier,
    quality_rules,
    substring_dedup,
    token_counts,
)
from pointloom.llm._pieces import default_vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, h long, n_words string, score string"


def corpus():
    """Copies, near copies, shared passages, repetition, nulls, empty and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), [word() for _ in range(120)]
    rows = [(i, text(rng.randint(1, 90))) for i in range(20)]
    rows += [(20 + i, f"{text(15)} {passage} {text(20)}") for i in range(4)]
    for i in range(8):
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(120)] = word()
        rows.append((30 + i, " ".join(near)))
    rows += [(40, None), (41, ""), (42, " \t\n "), (43, "one"), (44, "one"), (45, "la " * 300), (46, text(9000)), (47, "ONE two Three four five"), (48, "one TWO three four five"), (49, "é ☃\n日本 $$$ <|x|>")]
    rows += [rows[3], rows[3], (30, text(50)), (None, text(40)), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i, "clash", "clash") for i, t in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot", [1 << 40, 400, 1])
def test_substring_dedup(docs, empty, hot):
    rows = [(i, WORDS.findall(t or "")) for i, t in corpus()]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = []
    for i, w in rows:
        stay = np.ones(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                stay[k : k + 35] = False
        want.append((i, len(w), int((~stay).sum()), " ".join(x for x, s in zip(w, stay, strict=True) if s)))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(docs, hot=hot).collect()]
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_automaton_matches_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        seqs = [[rng.choice("ab") for _ in range(rng.randint(0, 25))] for _ in range(4)]
        times = [rng.choice([1, 1, 2]) for _ in seqs]
        auto = substring_dedup.SuffixAutomaton()
        for s, n in zip(seqs, times, strict=True):
            auto.add(s, n)
        auto.settle()
        seen = Counter()
        for s, n in zip(seqs, times, strict=True):
            for k in range(len(s) - 3):
                seen[tuple(s[k : k + 4])] += n
        for s in seqs:
            want = set()
            for k in range(len(s) - 3):
                if seen[tuple(s[k : k + 4])] > 1:
                    want |= set(range(k, k + 4))
            assert {i for lo, hi in auto.repeated(s, 4) for i in range(lo, hi)} == want


def components(rows, n, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min((v for v in (least.get(g), i) if v is not None), default=None)
    return sets, [least[g] for g in group], group


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_jaccard_join(docs, empty, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [r for r in corpus() if r[0] is not None]
    sets, want, group = components(rows, 4, 85, 100)
    got = jaccard_join.jaccard_components(docs.filter("doc_id is not null")).collect()
    assert Counter((r["_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(s), w) for (i, _), s, w in zip(rows, sets, want, strict=True))
    assert jaccard_join.jaccard_components(docs).count() == len(corpus())
    kept = jaccard_join.jaccard_dedup(docs.filter("doc_id is not null"))
    assert kept.columns == docs.columns
    # one row of each group, and every row without words
    assert kept.count() == sum(not s for s in sets) + len({g for g, s in zip(group, sets, strict=True) if s})
    assert jaccard_join.jaccard_dedup(empty).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 20_000])
def test_jaccard_join_on_a_crowd(spark, block, monkeypatch):
    """5,000 near copies of one text, of which many pairs are just alike or just not."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 7), replace=False):
            words[at] = f"e{rng.integers(40)}"
        rows.append((i, " ".join(words)))
    names: dict = {}
    sets = [{names.setdefault(tuple(w[j : j + 4]), len(names)) for j in range(57)} for w in (t.split() for _, t in rows)]
    has = np.zeros((5000, len(names)), np.float32)
    for i, found in enumerate(sets):
        has[i, list(found)] = 1
    size = has.sum(1)
    common = has @ has.T
    link = 100 * common >= 85 * (size[:, None] + size[None] - common)
    want = np.arange(5000)
    while True:
        after = np.where(link, want[None], 5000).min(1)
        if (after == want).all():
            break
        want = after
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert [w for _, w in sorted((r["_id"], r["component_id"]) for r in got)] == want.tolist()
    assert len(set(want.tolist())) > 10


def test_sketch_bounds_and_levels():
    share = (85, 100)
    for n in (1, 5, 12, 60, 500, 4000):
        for _, parts, sure in jaccard_join.levels(n, share):
            assert 1 <= sure <= parts
    rng = np.random.default_rng(0)
    plans = {}
    for n in (7, 20, 100, 600):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut = int(n * 15 / 185)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                ours, theirs = ({code: (need, names) for code, need, names in jaccard_join.sketch_parts(x, share, plans)} for x in (a, b))
                met = [(len(np.intersect1d(ours[c][1], theirs[c][1])), ours[c][0], theirs[c][0]) for c in ours if c in theirs]
                assert any(m >= max(x, y) for m, x, y in met)  # as many common parts as either one needs


def test_fingerprints(docs, empty):
    out = fingerprints.fingerprints(docs.filter("doc_id is not null")).collect()
    rows = sorted({(i, t or "") for i, t in corpus() if i is not None})
    assert len(out) == len([r for r in corpus() if r[0] is not None])
    by = {}
    for r in out:
        by.setdefault(r["n_chars"], r)
        assert r["near_edited"] is not None and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = {r["fingerprint"] for r in out if r["doc_id"] in (43, 44)}
    assert len(same) == 1
    alone = [i for i in range(43, 50)]
    texts = dict(rows)
    got = {r["doc_id"]: r for r in out}
    for i in alone[:-1]:
        t, nxt = texts[i], texts[i + 1]
        q = len(t) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
    assert fingerprints.fingerprints(empty).count() == 0


def test_densified_digits(spark):
    """Bins, draws, ranks and digits by plain Python, from Spark's shingle hashes."""
    texts = [None, " ", "one", "one two three", *[" ".join(f"w{i}" for i in range(n)) for n in (5, 6, 9, 20, 60, 200, 900)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    shingles = fingerprints.shingle_hashes(fingerprints.word_hashes(F.col("t")))
    pairs = spark.range(256).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(256).select(F.col("id").cast("int").alias("j")))
    rank = {(r["i"], r["j"]): r["h"] for r in pairs.select("i", "j", F.xxhash64("i", "j").alias("h")).collect()}
    for r in df.select("t", shingles.alias("s"), fingerprints.fingerprint(F.col("t")).alias("f")).collect():
        low = {}
        for h in r["s"]:
            b = (h >> 56 & 255) ^ 128  # bins are in the order of signed hashes
            low[b] = min(h, low.get(b, h))
        want = ""
        for i in range(256 if low else 0):
            donor = next((j for j in [i, *[(a * i + b) % fingerprints.PRIME % 256 for a, b in map(fingerprints._family, range(fingerprints.TRIES))]] if j in low), None)
            if donor is None:
                donor = min(low, key=lambda j: (rank[i, j] >> 8, j))
            want += f"{(low[donor] & (1 << 64) - 1) >> i % 13 * 4 & 15:X}"
        assert r["f"] == want


def test_smallest_id_is_not_a_null(spark):
    rows = spark.createDataFrame([(-(1 << 63), "a b"), (None, "a b"), (None, None), (5, "c")], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in fingerprints.fingerprints(rows).collect()) == Counter({-(1 << 63): 1, None: 2, 5: 1})


def test_network_by_plain_loops():
    """One document's log-probabilities, from the weights by the formula."""
    m = lm_scoring
    net = m.WindowNetwork()
    ids = np.array([3, 40, 3, 1000, 7, 512])
    at = np.array([0, 6])
    flat = m.W.Flat(np.zeros(6, np.uint8), at, np.arange(6), np.arange(6) + 1, at, np.zeros(6, np.int64), ids.astype(np.uint64))
    got = net.log_probabilities(m._windows(flat, ids, 0, 6), ids)
    p = {k: v.astype(float) for k, v in net.part.items()}
    for t, word in enumerate(ids.tolist()):
        around = [ids[t + s] if 0 <= t + s < 6 else m.VOCABULARY for s in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate([p["words"][w] for w in around]) @ p["inner"] + p["bias"])
        c, w = divmod(word, m.MEMBERS)
        outer, inner = h @ p["classes"] + p["class_bias"], h @ p["members"][c] + p["member_bias"][c]
        want = outer[c] - np.log(np.exp(outer).sum()) + inner[w] - np.log(np.exp(inner).sum())
        assert abs(got[t] - want) < 1e-4


def test_training_step_by_differences():
    """One step moves each weight by its gradient (by differences of the plain loss), scaled by what it has seen."""
    m, rng = lm_scoring, np.random.default_rng(1)
    net = m.WindowNetwork()
    ids = np.array([3, 40, 3, 1000, 7, 512, 40, 3])
    context = m._around(ids, np.array([0, 5, 5, 8]), np.arange(8))
    assert context[4].tolist() == [3, 1000, m.VOCABULARY, m.VOCABULARY] and context[5].tolist() == [m.VOCABULARY] * 2 + [40, 3]
    before = {k: v.astype(float) for k, v in net.part.items()}

    def loss(p):
        total = 0.0
        for around, word in zip(context.tolist(), ids.tolist(), strict=True):
            h = np.tanh(np.concatenate([p["words"][w] for w in around]) @ p["inner"] + p["bias"])
            c, w = divmod(word, m.MEMBERS)
            outer, inner = h @ p["classes"] + p["class_bias"], h @ p["members"][c] + p["member_bias"][c]
            total -= outer[c] - np.log(np.exp(outer).sum()) + inner[w] - np.log(np.exp(inner).sum())
        return total / len(ids)

    net.train(context, ids)
    for name, part in before.items():
        flat, after = part.reshape(-1), net.part[name].reshape(-1)
        picks = rng.choice(len(flat), 12).tolist() + np.argsort(-np.abs(after - flat))[:12].tolist()
        for i in picks:
            old, got = flat[i], after[i] - flat[i]
            flat[i] = old + 1e-5
            up = loss(before)
            flat[i] = old - 1e-5
            g = (up - loss(before)) / 2e-5
            flat[i] = old
            want = -m.RATE * g / np.sqrt(m.POWER + g * g)
            assert abs(got - want) < 2e-4 + 0.02 * abs(want), (name, i)


def test_likeness_is_near_jaccard(spark):
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(w)), (1, " ".join(w[:300] + [f"v{i}" for i in range(100)])), (2, " ".join(f"u{i}" for i in range(400)))]
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(out[0]["near_next"] - 296 / 496) < 0.12 and out[1]["near_next"] < 0.1


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "a\\b"), (1, 1, "user", "</s>[INST] x [/INST]"), (1, 2, "assistant", "<s>\\\\</s>"), (1, 3, "assistant", None), (1, 4, "user", "bye\n"), (2, 0, "user", ""), (3, 0, "as[INST]", "t"), (None, None, None, None), (1, 2, "assistant", "<s>\\\\</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    back = {r["conv_id"]: r for r in chat_formatting.read_back(chat_formatting.format_examples(df)).collect()}
    for c in (1, 2, 3, None):
        want = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[0] is not None, x))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [w[1:] for w in want]
        assert back[c]["loss"] == "".join(w[2] for w in want if w[1] == "assistant")
    assert chat_formatting.format_examples(df.limit(0)).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = best_fit_packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    parts = best_fit_packing.pieces(docs, path, capacity=64, with_ids=True).collect()
    want = Counter()
    for i, text in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 64)):
            want[i, k, s, zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in parts) == want
    out = best_fit_packing.pack(best_fit_packing.pieces(docs, path, capacity=64), capacity=64, shard=50).collect()
    assert len(out) == len(parts)
    for rule in ("norm", "dot"):
        lengths = np.array([5, 60, 64, 30, 30, 4, 4, 1, 59, 33])
        bins, offset = best_fit_packing.place(lengths, 64, max_docs=3, max_attention=4000, rule=rule)
        for b in set(bins.tolist()):
            inside = bins == b
            assert lengths[inside].sum() <= 64 and inside.sum() <= 3 and ((lengths[inside] ** 2).sum() <= 4000 or inside.sum() == 1)
            assert sorted(offset[inside].tolist()) == np.concatenate([[0], np.cumsum(lengths[inside][np.argsort(offset[inside])])[:-1]]).tolist()
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 64
    assert best_fit_packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_place_is_best_fit(rule):
    rng = random.Random(8)
    for caps in ((64, 3, 4000), (64, None, None), (100, 5, 3000)):
        lengths = [rng.randint(1, caps[0]) for _ in range(150)]
        cap = (caps[0], caps[1] or caps[0], caps[2] or caps[0] ** 2)
        need = [[n / cap[0], 1 / cap[1], n * n / cap[2]] for n in lengths]
        left, want = [], [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [b for b, r in enumerate(left) if all(x >= y - 1e-12 for x, y in zip(r, need[i], strict=True))]
            if rule == "norm":
                cost = {b: sum((x - y) ** 2 for x, y in zip(left[b], need[i], strict=True)) for b in fits}
            else:
                cost = {b: -sum(x * y for x, y in zip(left[b], need[i], strict=True)) for b in fits}
            b = min((b for b in fits if cost[b] <= min(cost.values()) + 1e-12), default=len(left))
            if b == len(left):
                left.append([1.0] * 3)
            left[b] = [x - y for x, y in zip(left[b], need[i], strict=True)]
            want[i] = b
        bins, _ = best_fit_packing.place(np.array(lengths), *caps, rule=rule)
        assert bins.tolist() == want


def test_repeated_rows_are_packed_in_all_shards(spark):
    rows = spark.createDataFrame([(None, 7, 0, 3)] * 400, "doc_id long, row_key long, piece int, length long").repartition(2)
    out = best_fit_packing.pack(rows.withColumn("offset", F.lit("x")), capacity=12, shard=100).collect()
    assert len({r["sequence_id"] % 4 for r in out}) == 4
    assert max(Counter(r["sequence_id"] for r in out).values()) == 4 and len(out) == 400


def test_word_ids():
    from tokenizers import Tokenizer

    path = best_fit_packing.default_tokenizer()
    whole, words = Tokenizer.from_file(path), best_fit_packing.WordIds(path)
    for text in ("Straße ßab ÀÉÎ×÷ß don't we'll it's 'tis x,.!? 12a3 a1,b2 <|endoftext|>. <|x|> ª²µ ", "ŒUVRE ﬁ İI 日本語 e\u0301a \u0301x é\u0300 " + "long" * 60, "A.B.C. a.,;: ...! (x) \"q\" ?!"):
        assert words.encode(text.encode()) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_coverage_rejects_what_the_base_lets_pass(spark):
    short = [f"{i:02d}" for i in range(100)]
    long = [f"longestword{i:02d}" for i in range(12)]
    rows = [(0, " ".join(short[:50] + long + short[50:] + long)), (1, " ".join(short + long)), (2, "\n".join([" ".join(short), " ".join(long[:4]), " ".join(long[:4])]))]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(out[i]["base_failed"], out[i]["kept"]) for i in range(3)] == [(False, False), (False, True), (False, False)]


def test_quality_rules(docs, empty):
    got = Counter()
    for r in quality_rules.quality_rules(docs).collect():
        got[tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))] += 1
    want = Counter()
    for i, t in corpus():
        t = t or ""
        w = WORDS.findall(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)] += 1
    assert got == want
    assert quality_rules.quality_rules(empty).count() == 0


def test_repetition_verdict(spark):
    line = "alpha beta gamma delta"
    rows = [(0, "\n".join([line] * 6 + [f"w{i} x{i} y{i}" for i in range(8)])), (1, " ".join(f"w{i}" for i in range(50)))]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["dup_line_chars"] == 5 * 19 and not out[0]["kept"] and out[1]["kept"]


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality_classifier.op8_quality_classifier(spark, d).filter("held_out").join(labels, "doc_id").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95
    model = quality_classifier.fit(docs, labels.limit(0))
    assert quality_classifier.score(docs.limit(3), model).agg(F.max("score")).first()[0] == 0.5


def test_classifier_awkward_rows(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, 0), (5, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.score(docs, model).collect()
    assert len(out) == len(corpus()) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.score(empty, model).count() == 0


def test_pieces_and_counts(docs, empty):
    from tokenizers import models

    import sentencepiece

    path = default_vocabulary()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    u = models.Unigram([("<unk>", 0.0)] + [(sp.id_to_piece(i), sp.get_score(i)) for i in normal], 0, False)
    byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
    want = Counter()
    for i, t in corpus():
        ids = []
        for x in u.tokenize("▁" + t.replace(" ", "▁")) if t else []:
            ids += [normal[x.id - 1]] if x.id else [byte[b] for b in x.value.encode()]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    out = piece_codec.encode(docs, path)
    assert Counter((r["doc_id"], r["n_ids"], r["ids_crc32"]) for r in out.collect()) == want and out.filter("not round_trip").count() == 0
    back = Counter((r["doc_id"], r["text"]) for r in piece_codec.decode(out, path).collect())
    assert back == Counter((i, t or "") for i, t in corpus())
    n = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect())
    assert n == Counter((k[0], k[1]) for k in want.elements())
    assert piece_codec.encode(empty, path).count() == token_counts.token_counts(empty, path).count() == 0


def test_votes_by_plain_loops(spark):
    """Scores of a table, from the fitted space by the formula."""
    q, d = quality_classifier, "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = q.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert len(model.labels) > q.NEIGHBOURS
    got = {r["doc_id"]: r["score"] for r in q.score(docs, model).collect()}
    idf, axes, vectors = (x.astype(float) for x in (model.idf, model.axes, model.vectors))
    checked = 0
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        counts = q.term_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].astype(float)
        if not counts.sum():
            assert abs(got[r["doc_id"]] - model.labels.mean()) < 1e-6
            continue
        x = np.sqrt(counts / counts.sum()) * idf
        x = (x / np.sqrt((x * x).sum())) @ axes
        x /= np.sqrt((x * x).sum())
        near = sorted(((float(x @ v), float(y)) for v, y in zip(vectors, model.labels, strict=True)), reverse=True)
        if near[q.NEIGHBOURS - 1][0] - near[q.NEIGHBOURS][0] < 1e-5:
            continue  # equally near at the end of the list: any may vote
        votes = [(max(c, 0) ** q.POWER, y) for c, y in near[: q.NEIGHBOURS]]
        assert abs(got[r["doc_id"]] - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-4
        checked += 1
    assert checked > len(got) / 2


def test_lm_scoring_learns(docs, empty, spark):
    rows = spark.createDataFrame([(i, "the cat sat on the mat and the dog lay by the door " * 20) for i in range(30)], "doc_id long, text string")
    weights, words = lm_scoring.fit(rows)
    before = lm_scoring.score(rows, lm_scoring.WindowNetwork().weights, words).first()["mean_log_likelihood"]
    after = lm_scoring.score(rows, weights, words).first()["mean_log_likelihood"]
    assert after > before + 0.8
    out = lm_scoring.score(docs, weights, words).collect()
    assert len(out) == len(corpus()) and all((r["mean_log_likelihood"] is None) == (r["n_words"] == 0) for r in out)
    assert lm_scoring.score(empty, *lm_scoring.fit(empty)).count() == 0


def test_lm_scoring_beats_counts_on_held_out_texts_whatever_the_files(spark):
    """A network at its start is the table of word frequencies; the fitted one is better where it hasn't learned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen, held = docs.filter("doc_id % 5 != 0"), docs.filter("doc_id % 5 = 0")
    weights, words = lm_scoring.fit(seen)
    other, _ = lm_scoring.fit(seen.repartition(7, "text"))
    assert np.array_equal(weights, other)
    total = lambda w: lm_scoring.score(held, w, words).agg(F.sum("log_likelihood"), F.sum("n_words")).first()
    (plain, n), (better, _) = total(lm_scoring.start(words)), total(weights)
    counts = {r["h"]: r["n"] for r in words.counts.collect()}
    buf, at = (lambda t: (np.frombuffer("".join(t).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in t)])))([r["text"] or "" for r in held.collect()])
    h = lm_scoring.W.flatten(lm_scoring.W.lower(buf.copy()), at).word.view(np.int64).tolist()
    table = sum(np.log((counts.get(x, 0) + 0.5) / (words.n + 0.5 * (len(counts) + 1))) for x in h)
    assert len(h) == n and abs(plain - table) < 0.01 * abs(table)
    assert better > plain + 0.7 * n


def test_lm_scoring_of_words_in_buckets(spark):
    own, rare = [f"own{i}" for i in range(lm_scoring.VOCABULARY - lm_scoring.BUCKETS)], [f"rare{i}" for i in range(300)]
    texts = [" ".join(own)] * 9 + [" ".join(w for i, w in enumerate(rare) if i % 5 <= k) for k in range(5)]
    texts += [f"{w} {w} {w}" for w in rare[:3]] + ["never seen"]
    corpus, scored = ([(i, t) for i, t in enumerate(x)] for x in (texts[:-1], texts))
    weights, words = lm_scoring.fit(spark.createDataFrame(corpus, "doc_id long, text string"))
    net = lm_scoring.WindowNetwork(weights)
    flat = lambda t: lm_scoring.W.flatten(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
    ending = lambda w: int.from_bytes(w.encode()[-2:], "little")
    bucket = lambda w: int(lm_scoring.W.mix(np.array([ending(w)], np.uint64))[0] % np.uint64(lm_scoring.BUCKETS))
    seen = Counter(w for _, t in corpus for w in t.split() if w.startswith("rare"))
    a, total, distinct = lm_scoring.SMOOTH, Counter(), Counter()
    for w, n in seen.items():
        total[bucket(w)] += n
        distinct[bucket(w)] += 1
    got = {r["doc_id"]: r for r in lm_scoring.score(spark.createDataFrame(scored, "doc_id long, text string"), weights, words).collect()}
    assert len(got) == len(scored)
    for i, t in scored:
        f = flat(t)
        ids = lm_scoring._ids(f, words[0], words[1])
        want = float(net.log_probabilities(lm_scoring._windows(f, ids, 0, len(ids)), ids).astype(float).sum())
        want += sum(np.log((seen[w] + a) / (total[bucket(w)] + a * (distinct[bucket(w)] + 1))) for w in t.split() if not w.startswith("own"))
        assert abs(got[i]["log_likelihood"] - want) < 1e-3 * max(1, abs(want)) and got[i]["n_words"] == len(t.split())


def test_lm_scoring_of_large_outputs_and_of_texts_without_words(spark):
    """Sums of exponentials of large outputs don't overflow, and a table of nothing but blank texts is scored."""
    net = lm_scoring.WindowNetwork()
    for name in ("classes", "members"):
        net.part[name][:] = 0
    net.part["class_bias"][:] = net.part["member_bias"][:] = lm_scoring.LARGEST
    got = net.log_probabilities(np.full((3, 2 * lm_scoring.SIDE), lm_scoring.VOCABULARY), np.array([0, 500, 1023]))
    assert np.abs(got + np.log(lm_scoring.VOCABULARY)).max() < 1e-3
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_id long, text string")
    rows = lm_scoring.score(blank, *lm_scoring.fit(blank)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["log_likelihood"], r["mean_log_likelihood"]) for r in rows) == [(i, 0, 0.0, None) for i in (1, 2, 3)]


def test_lm_scoring_joins_only_rare_words(spark, monkeypatch):
    """Frequent words' counts are known when texts are coded; only other words wait for the join, and scores are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    weights, words = lm_scoring.fit(docs)
    counts = {r["h"]: r["n"] for r in words.counts.collect()}
    scores = []
    for most in (0, 3000, lm_scoring.FREQUENT):
        monkeypatch.setattr(lm_scoring, "FREQUENT", most)
        hashes, logs = lm_scoring._frequent(words.counts)
        known = hashes.view(np.int64).tolist()
        assert len(known) <= most and all(abs(np.exp(x) - counts[h] - lm_scoring.SMOOTH) < 1e-6 * counts[h] for h, x in zip(known, logs.tolist(), strict=True))
        if 0 < len(known) < len(counts):
            assert min(counts[h] for h in known) > max(n for h, n in counts.items() if h not in set(known))
        coded = lm_scoring.encode(docs, words._replace(frequent=hashes, log_counts=logs))
        left = {x["h"] for r in coded.select("rare").collect() for x in r["rare"]}
        own = set(words.hashes.view(np.int64).tolist())
        assert left == set(counts) - own - set(known)
        scores.append({r["doc_id"]: r["log_likelihood"] for r in lm_scoring.score_coded(coded, weights, words).collect()})
    assert len(scores[0]) == docs.count() and all(abs(s[d] - x) < 1e-6 * max(1, abs(x)) for s in scores for d, x in scores[0].items())
