import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tracemill.llm import chat, decontam, htmltext, langid, lmscore, neardup, quality

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [*enumerate(ODD), (3, "one"), (None, "no id")]


def spaced(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]


# near-duplicates


def shingles(text):
    w = spaced(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(texts, percent):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, groups=6, size=14):
    """Groups of copies of copies, each with a few words changed, and lone texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(groups):
        family = [[word() for _ in range(rnd.choice([3, 30, 90, 200]))]]
        for _ in range(size):
            copy = list(rnd.choice(family))
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = word()
            family.append(copy)
        texts += [" ".join(f) for f in family]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "percent", "most"), [(1, 85, None), (2, 80, 0)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, seed, percent, most):
    if most is not None:
        monkeypatch.setattr(neardup, "PAIRS_EACH", most)  # every round is a star first
    texts = copies(seed)
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rows_that_share_an_id_are_told_apart(spark, monkeypatch):
    a, b, c = ("alpha beta gamma delta one two three four", "no other row says any of these words here", "a third text that stands for itself alone")
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (2, c, "v"), (2, c, "v"), (3, b, "u"), (4, None, "n"), (4, None, "n"), (None, a, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).where("doc_id is not null").collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 1, False), (4, 4, True), (4, 4, True)]
    for bound in (0, neardup.BROADCAST_IDS):
        monkeypatch.setattr(neardup, "BROADCAST_IDS", bound)
        left = sorted((r.doc_id or 0, r.text or "", r.kept) for r in neardup.one_of_each(docs).collect())
        assert left == sorted([(1, a, "x"), (1, b, "y"), (2, c, "v"), (4, "", "n"), (0, a, "w")])


@pytest.mark.parametrize("n_words", [17, 29, 68])
def test_recall_of_short_sets(spark, n_words):
    """Pairs just at the threshold, by set size: one-permutation bins of short sets aren't independent, so recall is measured."""
    rnd = random.Random(n_words)
    size = n_words - 4
    swap = next(k for k in range(n_words, 0, -1) if 100 * (size - k) >= 85 * (size + k))
    rows = []
    for i in range(400):
        words = [f"w{rnd.randrange(10**9)}" for _ in range(n_words)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[: n_words - swap], *(f"v{rnd.randrange(10**9)}" for _ in range(swap))]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1 and component_id = doc_id - 1").count()
    assert got == 400


def test_near_duplicates_of_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[1].component_id == 1
    assert by[5].component_id == 4 and not by[5].kept
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(none).count() == 0
    left = neardup.one_of_each(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([i for i in range(len(ODD)) if i != 5] + [None], key=str)


def test_layouts_miss_less_than_one_in_a_million():
    for percent in (50, 80, 85, 95):
        bands, rows = neardup.layout(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1e-6 and bands * rows <= neardup.BINS


# decontamination


def test_contamination_matches_brute_force(spark):
    rnd = random.Random(7)
    words = lambda n: [rnd.choice(["the", "of", "a", "b", "c", "d"]) if rnd.random() < 0.7 else f"w{rnd.randrange(40)}" for _ in range(n)]
    items = [(i, " ".join(words(rnd.choice([3, 10, 12, 25])))) for i in range(12)] + [(12, "!!"), (13, None), (3, "the of")]
    docs = []
    for i in range(120):
        w = words(rnd.choice([0, 5, 40, 80]))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            passage = (rnd.choice(items)[1] or "").split()
            cut = passage[rnd.choice([0, 0, 1]) : len(passage) - rnd.choice([0, 0, 1])]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = cut
        docs.append((i, rnd.choice([" ", ", ", "-"]).join(w).title()))
    docs += [(200, None), (200, docs[3][1]), (None, docs[5][1])]

    def tokens(text):
        return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW)) if x]

    want = []
    for i, text in docs:
        w, hit, found = tokens(text), set(), set()
        for item, passage in items:
            p = tokens(passage)
            n = min(10, len(p))
            for s in range(len(p) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == p[s : s + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(frame, marks).drop("doc_key", "n_near_items")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    clean = decontam.clean_documents(frame, marks)
    assert sorted(map(str, [r.doc_id for r in clean.collect()])) == sorted(str(r[0]) for r in want if not r[5])


def test_proximity_is_order_free(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(0, "x " + " ".join(reversed(item.split()))), (1, item + " x"), (2, "alpha beta x gamma")], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontam.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: (0, 1), 1: (1, 1), 2: (0, 0)}


def test_contamination_of_odd_rows(odd, none, spark):
    marks = spark.createDataFrame([(1, "日本語のテキスト"), (2, "a b c d e f g")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.contamination(odd, marks).collect()}
    assert rows[0].n_words == 0 and rows[9].contaminated and rows[4].n_hit == rows[5].n_hit == 7
    assert rows[10].n_words == 30_000 and not rows[10].contaminated
    assert decontam.contamination(none, marks).count() == 0
    assert decontam.contamination(odd, marks.where("false")).where("contaminated").count() == 0
    assert decontam.clean_documents(odd, marks).columns == odd.columns


# language model


def brute_scores(texts, order):
    seqs = [["<s>", *spaced(t), "</s>"] for _, t in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    counts = Counter(tuple(s[e - k + 1 : e + 1]) for s, h in zip(seqs, held) if not h for e in range(len(s)) for k in range(1, order + 1) if e - k + 1 >= 0)
    real = {g: c for g, c in counts.items() if len(g) == 1 and g != ("<s>",)}
    total, distinct = sum(real.values()), len(real)

    def p(gram):
        if len(gram) == 1:
            return (real.get(gram, 0) + 1) / (total + distinct + 1)
        c = counts[gram[:-1]]
        if not c:
            return p(gram[1:])
        back = 1 / (1 + c ** (1 - lmscore.GROWTH))
        return (1 - back) * counts[gram] / c + back * p(gram[1:])

    out = []
    for (i, _), s, h in zip(texts, seqs, held):
        grams = [tuple(s[max(0, e - order + 1) : e + 1]) for e in range(1, len(s))]
        out.append((i, h, len(s) - 1, sum((w,) in real for w in s[1:]), total, sum(math.log10(p((w,))) for w in s[1:]), sum(math.log10(p(g)) for g in grams)))
    return out, p, {w for (w,) in real}


@pytest.mark.parametrize(("order", "fan"), [(1, 256), (3, 256), (3, 2)])
def test_scores_match_brute_force(spark, monkeypatch, order, fan):
    monkeypatch.setattr(lmscore, "FAN", fan)  # with 2, sums go up through several levels
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 900)
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 700)
    rnd = random.Random(order)
    texts = [(i, " ".join(rnd.choice("a b c d e F g".split()) for _ in range(rnd.randrange(40)))) for i in range(60)] + TEXTS
    want, p, vocabulary = brute_scores(texts, order)
    got = lmscore.score_documents(spark.createDataFrame(texts, "doc_id long, text string"), order=order).collect()
    key = lambda r: (str(r[0]), r[2], round(r[6], 3))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    for context in (("a",), ("<s>",), ("a", "b"))[:order]:
        assert sum(p((*context[-(order - 1) :], w) if order > 1 else (w,)) for w in [*vocabulary, "unknown"]) == pytest.approx(1)


def test_scores_of_no_rows(none):
    assert lmscore.score_documents(none).count() == 0


def shuffle_files(spark):
    """The names of the shuffle files that this session's block manager holds."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {os.path.basename(x) for x in held.split("\n") if os.path.basename(x).startswith("shuffle_")}


def test_each_round_of_scoring_leaves_no_shuffle_files(spark, monkeypatch):
    """Rounds' shuffle files must not add up on disk, whenever the driver collects its garbage; nor do requests and sums outlive their round."""
    monkeypatch.setattr(lmscore, "FAN", 2)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 900)
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 700)
    kept, seen, before = lmscore.materialize, [], set()

    def stored(df, tag, **how):
        if not seen:  # the size of the input has been summed
            before.update(shuffle_files(spark))
        out = kept(df, tag, **how)
        for _ in range(50):  # executors delete in their own time
            if not shuffle_files(spark) - before:
                break
            time.sleep(0.1)
        seen.append((tag, len(shuffle_files(spark) - before), out))
        return out

    monkeypatch.setattr(lmscore, "materialize", stored)
    texts = spark.createDataFrame([(i, f"a b c {i} d " * 30) for i in range(12)], "doc_id long, text string")
    scored = lmscore.score_documents(texts)
    assert {"requests", "upper", "answers"} <= {tag for tag, _, _ in seen} and not [(tag, n) for tag, n, _ in seen if n]
    left = [tag for tag, _, out in seen if os.path.exists(out._scratch_path.removeprefix("file:").replace("///", "/"))]
    assert left == ["blocks", "answers", "answers"] and scored.count() == 12


# quality


def mixed_documents(seed):
    """Good, junk and half-and-half documents of all lengths, and labels of a third."""
    rnd = random.Random(seed)
    words = {"good": ["rain", "sun", "wind", "sea", "hill", "Fog"], "junk": ["BUY", "!!!", "$$$", "click"]}
    text = lambda share, n: " ".join(rnd.choice(words["good" if rnd.random() < share else "junk"]) for _ in range(n))
    docs = [(i, text((0.1, 1.0, 0.9, 0.75)[i % 4], rnd.choice([2, 8, 40, 120]))) for i in range(400)] + [(900, None), (901, ""), (5, "rain sun")]
    return docs, [(i, int(i % 4 > 0), 0) for i in range(0, 400, 3)] + [(None, 1, 0), (7, None, None), (9, 0, 0), (2, 1, 1)]


def brute_resample(docs, labels, noise, slack):
    """Counts over true n-grams in dictionaries, the sample by sorting."""
    grams = lambda t: (w := spaced(t)) and [*((x,) for x in w), *zip(w, w[1:])]
    good = {i for i, q, t in labels if q == 1 and not t and i is not None}
    raw, target = Counter(g for _, t in docs for g in grams(t)), Counter(g for i, t in docs if i in good for g in grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    prior = min(quality.PRIOR, n_target)
    ratio = {g: math.log((target[g] + prior * c / n_raw) / (n_target + prior) / (c / n_raw)) for g, c in raw.items()}
    sums = [(i, len(grams(t)), sum(ratio[g] for g in grams(t))) for i, t in docs]
    best = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            best[i] = max(best.get(i, 0), q)
    judged = [best[i] for i, n, _ in sums if n and i in best]
    with_words = sorted((s / n**0.5 + noise[i] for i, n, s in sums if n), reverse=True)
    k = min(len(with_words), math.ceil((sum(judged) / len(judged) + slack) * len(with_words)))
    plain = sorted((s / n**0.5 for i, n, s in sums if n), reverse=True)[k - 1]
    return [(i, n, s, bool(n) and s / n**0.5 + noise[i] >= with_words[k - 1], bool(n) and s / n**0.5 >= plain) for i, n, s in sums]


def test_resampling_matches_brute_force(spark):
    docs, labels = mixed_documents(3)
    frame = spark.createDataFrame([(i, t, "mine", 9.5) for i, t in docs], "doc_id long, text string, kept string, n_ngrams double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    noise = {r.doc_id: r.g for r in frame.select("doc_id", quality.gumbel(F.col("doc_id")).alias("g")).collect()}
    want = brute_resample(docs, labels, noise, quality.SLACK)
    got = quality.resample(frame, marks).collect()
    key = lambda r: (r[0], r[1], r[2])
    for g, w in zip(sorted(((r.doc_id, r.n_ngrams, r.log_ratio, r.kept) for r in got), key=key), sorted(want, key=key), strict=True):
        assert (g[0], g[1], g[3]) == (w[0], w[1], w[3]) and g[2] == pytest.approx(w[2], abs=1e-9)
    settled = sum(w[3] != w[4] for w in want)
    assert settled >= 10  # the draw decides, not the order of weights
    few = quality.resample(frame, marks, k=50).where("kept")
    assert few.count() == 50
    kept = quality.kept_documents(frame, marks).collect()
    assert sorted(r.doc_id for r in kept) == sorted(w[0] for w in want if w[3])
    assert all(r.kept == "mine" and r.n_ngrams == 9.5 for r in kept)


def test_resampling_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(none, labels).count() == 0 and quality.kept_documents(none, labels).count() == 0
    kept = quality.kept_documents(odd, labels.where("false"))
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i if i is not None else -1 for i, t in TEXTS if spaced(t))


def test_kth_largest(spark):
    values = [5, 1, 9, 9, -7, 10**15, 3]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in range(1, 8):
        assert quality.kth_largest(df, F.col("x"), k) == sorted(values)[-k]
    assert quality.kth_largest(df, F.col("x"), 0) is None
    assert quality.kth_largest(df.where("false"), F.col("x"), 3) is None


# language identification


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    steps = rng.integers(0, 256, (6, 4))
    d = langid.Direction(rng.normal(0, 0.5, (3 * langid.HIDDEN, 256)), rng.normal(0, 0.5, (3 * langid.HIDDEN, langid.HIDDEN)))
    weight = rng.normal(size=(6, langid.HIDDEN, 4))
    loss = lambda: float((d.run(steps)[0] * weight).sum())
    out, kept = d.run(steps, True)
    grads = d.back(steps, kept, weight)
    for w, g in ((d.by_byte, grads[0]), (d.by_state, grads[1])):
        for _ in range(12):
            i = (rng.integers(w.shape[0]), int(rng.choice(steps.reshape(-1))) if w.shape[1] == 256 else rng.integers(w.shape[1]))
            held, eps = w[i], 2e-2
            w[i] = held + eps
            up = loss()
            w[i] = held - eps
            down = loss()
            w[i] = held
            assert g[i] == pytest.approx((up - down) / (2 * eps), rel=0.1, abs=0.02)


def plain_reading(net, raw):
    """Probabilities of a whole text read byte by byte in both directions, averaged over its positions."""
    def states(d, steps):
        h, out = np.zeros(d.by_state.shape[1]), []
        for byte in steps:
            a, g, n = d.by_byte[:, byte], d.by_state @ h, len(h)
            z, r = (0.5 * (np.tanh(a[k * n : (k + 1) * n] + g[k * n : (k + 1) * n]) + 1) for k in (0, 1))
            new = np.tanh(a[2 * n :] + r * g[2 * n :])
            h = new + z * (h - new)
            out.append(h)
        return out

    ahead, behind = states(net.forward, raw), states(net.backward, raw[::-1])[::-1]
    logits = np.array([net.to_label @ np.concatenate([f, b]) + net.bias[:, 0] for f, b in zip(ahead, behind)])
    p = np.exp(logits - logits.max(1, keepdims=True))
    return (p / p.sum(1, keepdims=True)).mean(0)


def test_reading_matches_a_plain_one(monkeypatch):
    rng = np.random.default_rng(7)
    small = lambda *shape: rng.normal(0, 0.4, shape).astype(np.float32)
    net = langid.ByteGRU(["a", "b", "c"], langid.Direction(small(12, 256), small(12, 4)), langid.Direction(small(12, 256), small(12, 4)), small(3, 8), small(3, 1))
    texts = [bytes(rng.integers(32, 255, n).astype(np.uint8)) for n in (0, 1, 30, 31, 200, 64, 65)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = np.array([plain_reading(net, t) if t else np.zeros(3) for t in texts])
    assert net.documents(data, offsets) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(langid, "SEGMENT", 32)
    monkeypatch.setattr(langid, "WARM", 200)  # the whole text before and after
    assert net.documents(data, offsets) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(langid, "WARM", 24)
    assert net.documents(data, offsets) == pytest.approx(want, abs=0.02)


def test_whole_texts_are_learned_within_a_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, labels, langs: seen.append((windows, labels, langs)))
    docs = spark.createDataFrame([(i, "ab" * (500 + i), f"l{i % 3}") for i in range(60)] + [(7, "repeat", "l1"), (None, "no id", "l0"), (90, None, "l0"), (91, "x", None)], "doc_id long, text string, lang string")
    langid.fit(docs, per_lang=8)
    windows, labels, langs = seen.pop()
    assert langs == ["l0", "l1", "l2"] and set(labels.tolist()) == {0, 1, 2}
    assert 3 * 8 * 9 >= len(windows) >= 3 * 4 * 8 and (windows.reshape(-1)[: 2 * 500] > 0).all()
    monkeypatch.setattr(langid, "TRAIN_BYTES", 6000)
    langid.fit(docs, per_lang=8)
    assert 3 * 8 <= len(seen.pop()[0]) <= 7 * 9


def test_languages_held_out(spark, odd, none):
    rnd = random.Random(4)
    kinds = {"xx": ["the", "and", "thing"], "yy": ["ñandú", "que", "año"], "zz": ["ß", "über", "und"]}
    rows = [(i, " ".join(rnd.choice(kinds[k]) for _ in range(rnd.randint(8, 60))), k) for i in range(150) for k in [rnd.choice(sorted(kinds))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs.where("doc_id % 4 <> 2"))
    got = langid.identify(docs.where("doc_id % 4 = 2"), net).withColumnsRenamed({"c0": "doc_id", "c2": "lang"}).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    said = {r.c0: (r.lang_pred, r.score) for r in langid.identify(odd, net).collect()}
    assert said[0] == said[1] == said[2] == said[11] == ("und", 0.0) and said[9][0] in kinds
    assert langid.identify(none, net).count() == 0
    assert langid.fit(none) is None and langid.identify(odd, None).where("lang_pred = 'und'").count() == len(TEXTS)
    own = docs.withColumn("score", F.lit(9.5)).withColumn("lang_pred", F.lit("mine"))
    left = langid.recognised(own)
    assert left.columns == own.columns and left.where("score = 9.5 and lang_pred = 'mine'").count() == left.count() > 140


def test_all_of_many_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "UPDATES", 40)
    rnd = random.Random(6)
    kinds = {f"l{k:02}": ["".join(chr(192 + 3 * k + rnd.randrange(3)) for _ in range(rnd.randint(3, 7))) for _ in range(6)] for k in range(66)}
    rows = [(n, " ".join(rnd.choice(w) for _ in range(30)) + " a", k) for n, (k, w) in enumerate(x for x in kinds.items() for _ in range(8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs.where("doc_id % 4 <> 2"))
    assert net.langs == sorted(kinds)
    got = langid.identify(docs.where("doc_id % 4 = 2"), net).withColumnsRenamed({"c2": "lang"}).collect()
    assert {r.lang for r in got if r.lang == r.lang_pred and r.score >= 0.35} == set(kinds)


# chat


def test_layouts_by_fingerprint(spark):
    turn = lambda role, text: {"role": role, "text": text}
    cases = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', [turn("user", "a"), turn("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}', [turn("user", "hi"), turn("assistant", "yo")]),
        ('{"output":"o","instruction":"i"}', [turn("user", "i"), turn("assistant", "o")]),
        ('{"prompt":"p","completion":"5"}', [turn("user", "p"), turn("assistant", "5")]),
        ('{"prompt":null,"response":"r"}', [turn("assistant", "r")]),
        ('{"conversations":[{"from":"bot","value":"b"},{"value":"h","from":"human"}],"system":"s"}', [turn("system", "s"), turn("assistant", "b"), turn("user", "h")]),
        ('{"dialog":{"turns":[{"by":{"role":"user"},"say":{"text":"q"}}],"system":"be kind"}}', [turn("system", "be kind"), turn("user", "q")]),
        ('{"dialog":{"turns":[{"by":{"role":"user"},"say":{"words":"q"}}],"system":"be kind"}}', None),
        ('{"messages":[]}', None),
        ('{"unknown":1}', None),
        ("bad", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string")
    rows = df.select("i", chat.turns_of_json(F.col("j")).alias("t")).orderBy("i").collect()
    assert [None if r.t is None else [x.asDict() for x in r.t] for r in rows] == [c[1] for c in cases]
    prints = df.select(chat.fingerprint(chat.parsed(F.col("j"))).alias("p")).where("p is not null").distinct().count()
    assert prints == len(cases) - 2


def test_rows_come_in_many_layouts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (2, 0, "system", "s"), (2, 1, "user", "u\u0000\n"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, "assistant", "first"), (4, 0, "tool", "t"), (4, 1, None, "none"), (5, 0, None, None), (6, 0, "system", "alone"), (None, 0, "user", "long " * 60_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    records = chat.records_of_rows(df)
    names = {m.sample: m.name for m in chat.MAPPINGS}
    prints = records.select("conv_id", chat.fingerprint(chat.parsed(F.col("record"))).alias("p"))
    known = spark.createDataFrame([(s, n) for s, n in names.items()], "j string, name string").select(chat.fingerprint(chat.parsed(F.col("j"))).alias("p"), "name")
    assert {r.conv_id: r.name for r in prints.join(known, "p").collect()} == {1: "prompt_response", 2: "dialog", 3: "conversations", 4: "messages", 5: "messages", 6: "messages", None: "conversations"}
    back = chat.format_conversations(df).select("conv_id", chat.parse_turns(F.col("formatted")).alias("t")).collect()
    want = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] or -1, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.t] for r in back} == want
    assert chat.format_conversations(df.where("false")).count() == 0


def test_formatting_is_reversible(spark):
    odd = ["", "<|", "<\\|", "\\n", "a\nb", "<\\\\|im_start|>", "\\\\", "<", "|", "user<|im_start|>\n\\", "\n", "<|im_end|>"]
    df = spark.createDataFrame([(a, b) for a in odd for b in odd], "role string, text string")
    two = F.array(F.struct("role", "text"), F.struct("role", "text"))
    for r in df.select("role", "text", chat.parse_turns(chat.format_turns(two)).alias("t")).collect():
        assert [(t.role, t.text) for t in r.t] == [(r.role, r.text)] * 2


def test_digests_match_plain_python(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, None, "é"), (3, 5, "system", "x")]
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)))).collect()}
    for conv in (1, 2, 3):
        turns = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(turns) and g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    assert chat.conversation_digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# pages


def body(source):
    page = htmltext.Page(source)
    return page.text(np.zeros(len(page.lines), bool))


def test_structure_leaves_an_articles_own_parts():
    assert body('<article><div class="article-header"><h1>T</h1></div><p class="share-price">5 up</p><ul class="search-results"><li>one</li></ul><div class="notice">x</div><div class="ad-slot">x</div><div class="commentList">x</div><div class="articleHeader">y</div><div class="comments">x</div><form>x</form></article>') == "T\n\n5 up\n\none\n\ny"
    assert body('<form id="f"><div class="site-nav">m</div><main><p>a</p><math><mi>x</mi></math></main></form>') == "a\n\nx"
    assert body("<form><p>all in a form</p></form>") == "all in a form"
    assert body("<p>text</p><form><p>search</p></form><object>o</object>") == "text\n\no"


def test_differencing_decides_what_structure_cannot(spark):
    """Unmarked pages whose frame no tag or class names: with differencing off it would stay."""
    rnd = random.Random(1)
    line = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(12))
    texts = {i: [line(), line()] for i in range(12)}
    page = lambda i: "<div>Home of the news</div>" + "".join(f"<p>{t}</p>" for t in texts[i]) + "<div>All rights reserved since 1999</div>"
    pages = [(i, f"http://h.example/p/{i:02}", page(i), "t", 7) for i in range(12)] + [(99, "http://other.example/", page(0), "t", 7)]
    schema = "page_id long, url string, html string, text string, n_differenced long"
    got = {r.page_id: r for r in htmltext.main_texts(spark.createDataFrame(pages, schema)).collect()}
    assert {i: got[i].text for i in texts} == {i: "\n\n".join(t) for i, t in texts.items()}
    assert all(got[i].n_differenced == 2 and got[i].n_structural == 0 for i in texts)
    assert body(page(3)) != got[3].text and got[99].text == body(page(0))
    marked = [(i, u, h.replace("<p>", "<article><p>", 1).replace("</p><div>", "</p></article><div>"), t, n) for i, u, h, t, n in pages]
    got = {r.page_id: r for r in htmltext.main_texts(spark.createDataFrame(marked, schema)).collect()}
    assert {i: got[i].text for i in texts} == {i: "\n\n".join(t) for i, t in texts.items()}
    assert all(got[i].n_differenced == 2 for i in texts) and got[99].n_structural == 2


def test_odd_pages(spark):
    long = "<article>" + "<p>" + "word " * 60_000 + "</p>" + "<p>x</p>" * 3000 + "</article>"
    rows = [(1, None, None, 1), (2, "", "", 1), (3, "http://h/", "   ", 1), (4, "http://h/", "<nav>m</nav>", 1), (5, "http://[bad", "<p>t</p>", 1), (6, "http://h/6", long, 1), (6, "http://h/6", long, 1), (None, "http://h/7", "<p>n</p>", 1)]
    got = sorted(((r.page_id or 0, r.url or "", r.text) for r in htmltext.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, lines int")).collect()), key=str)
    want = "word " * 60_000
    assert got == sorted([(1, "", ""), (2, "", ""), (3, "http://h/", ""), (4, "http://h/", ""), (5, "http://[bad", "t"), *[(6, "http://h/6", "\n\n".join([want.strip(), *["x"] * 3000]))] * 2, (0, "http://h/7", "n")], key=str)


@pytest.mark.parametrize("bits", [0, 40, 1 << 28])
def test_split_alignments_are_as_long(monkeypatch, bits):
    rng = np.random.default_rng(bits)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(0, 40)), rng.integers(0, 6, rng.integers(0, 40))
        monkeypatch.setattr(htmltext, "ROW_BITS", 1 << 28)
        whole = htmltext.common_lines(a, b)
        monkeypatch.setattr(htmltext, "ROW_BITS", bits)
        x, y = htmltext.common_lines(a, b)
        assert x.sum() == y.sum() == whole[0].sum() and (a[x] == b[y]).all()


def test_common_lines_are_a_longest_subsequence():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 14)) for _ in range(2))
        x, y = htmltext.common_lines(a, b)
        assert x.sum() == y.sum() == lcs(a.tolist(), b.tolist()) and a[x].tolist() == b[y].tolist()


ARTICLE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; small</h1><p><b>First<br>line<p>Second&nbsp;line</p><div class="ad">Buy</div><form><input>Mail</form><section id="comments"><p>Nice post</p></section><ul><li>x<li>y</ul></article><footer>&copy; me</footer></body></html>"""


def test_article_text():
    page = htmltext.Page(ARTICLE)
    assert page.text(np.zeros(len(page.lines), bool)) == "Big & small\n\nFirst line\n\nSecond line\n\nx\n\ny"


def test_differencing_deletes_what_a_host_repeats(spark):
    frame = lambda body: f"<body><div>Welcome to our site</div><p>{body}</p><p>Second of {body}</p><div>All rights kept</div></body>"
    pages = [(i, f"https://h{i % 2}.net/a/{i}", frame(f"story {i}")) for i in range(9)] + [(20, None, None), (21, "http://[bad", "<p>x"), (22, "https://alone.net/", "<div>All rights kept</div><p>z</p>"), (20, None, None)]
    schema = "page_id long, url string, html string"
    for ranges in (3, 20_000):
        htmltext.RANGE_ROWS, before = ranges, htmltext.RANGE_ROWS
        try:
            got = htmltext.main_texts(spark.createDataFrame(pages, schema)).collect()
        finally:
            htmltext.RANGE_ROWS = before
        assert len(got) == len(pages)
        by = {r.page_id: r for r in got}
        assert all(by[i].text == f"story {i}\n\nSecond of story {i}" and by[i].n_chars == len(by[i].text) for i in range(9))
        assert by[20].text == "" and by[21].text == "x" and by[22].text == "All rights kept\n\nz"
    assert htmltext.main_texts(spark.createDataFrame([], schema)).count() == 0


def test_copies_keep_their_text(spark):
    same = "<body><p>one long story</p><p>and its end</p></body>"
    pages = spark.createDataFrame([(1, "https://h.net/1", same), (2, "https://h.net/2", same)], "page_id long, url string, html string")
    assert {r.text for r in htmltext.main_texts(pages).collect()} == {"one long story\n\nand its end"}


def test_pages_that_are_nearly_all_frame_lose_it(spark):
    frame = lambda body: "<body>" + "".join(f"<div>Menu {k}</div>" for k in range(20)) + body + "<div>All rights kept</div></body>"
    pages = [(i, f"https://h.net/{i}", frame(f"<p>story {i}</p>")) for i in range(5)] + [(9, "https://h.net/9", frame(""))]
    got = {r.page_id: r.text for r in htmltext.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i}" for i in range(5)} | {9: ""}


def test_copies_next_to_each_other_lose_their_frame(spark, monkeypatch):
    story = "".join(f"<p>part {k}</p>" for k in range(30))
    page = lambda body: f"<body><div>Welcome</div>{body}<div>All rights kept</div></body>"
    same = [(i, f"https://h.net/b/{i:02}", page(story)) for i in range(12)]
    edited = [(20 + i, f"https://h.net/c/{i}", page(story.replace("part 7<", f"part 7 of {i}<"))) for i in range(2)]
    other = [(30 + i, f"https://h.net/{x}", page(f"<p>story {x}</p>")) for i, x in enumerate("adef")]
    for rows in (2, 1000):
        monkeypatch.setattr(htmltext, "RANGE_ROWS", rows)
        got = {r.page_id: r.text for r in htmltext.main_texts(spark.createDataFrame(same + edited + other, "page_id long, url string, html string")).collect()}
        parts = [f"part {k}" for k in range(30)]
        assert {got[i] for i in range(12)} == {"\n\n".join(parts)}
        assert [got[20 + i] for i in range(2)] == ["\n\n".join([*parts[:7], f"part 7 of {i}", *parts[8:]]) for i in range(2)]
        assert [got[30 + i] for i in range(4)] == [f"story {x}" for x in "adef"]


def test_marked_articles_lose_what_a_host_repeats_in_them(spark):
    long = lambda x: f"A paragraph of some length that only {x} holds, and that no other one does."
    page = lambda body: f"<body><main><div>Share this</div>{body}<p>{long('the notice of this house')}</p><ul><li>Read on</ul></main></body>"
    pages = [(i, f"https://h.net/{i:02}", page(f"<p>{long(i)}</p><p>{long(-i)}</p>" + ("<p>quoted</p>" if i % 2 else ""))) for i in range(20)]
    story = [long(f"part {k}") for k in range(30)]
    versions = [(50 + i, f"https://v.net/{i:02}", "<article>" + "".join(f"<p>{x}</p>" for x in [*story, long(f"version {i}")]) + "</article>") for i in range(20)]
    got = {r.page_id: r.text for r in htmltext.main_texts(spark.createDataFrame(pages + versions, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join([long(i), long(-i)] + ["quoted"] * (i % 2)) for i in range(20)} | {50 + i: "\n\n".join([*story, long(f"version {i}")]) for i in range(20)}
