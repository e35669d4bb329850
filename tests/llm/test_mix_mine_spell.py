"""Mixing, hard negatives and spelling variants against brute force, and on odd tables."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import mixing, negatives, spelling

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, target string, rest int, word string, n int"


def documents(spark, rows):
    """Documents with columns named like those of the results."""
    return spark.createDataFrame([(i, t, None, s, None, 1, "x", 2, "y", 3) for i, t, s in rows], DOCS)


# 11 mixing


def shared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing again what is above, until nothing is."""
    w = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("range_rows", [1, 7, 50_000])
def test_mix_takes_each_sources_budget(spark, range_rows):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60))), [None, "b", "a", "é", "z", "a"][i % 6]) for i in range(600)] + [(1000 + i, None, "empty") for i in range(3)]
    mixed = mixing.mix(documents(spark, rows), range_rows=range_rows).toPandas()
    assert len(mixed) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = shared(sizes)
    for s, of in mixed.groupby(mixed.source.fillna("-"), dropna=False):
        s = None if s == "-" else s
        assert of.target.iloc[0] == pytest.approx(want[s]) and abs(of.taken.sum() - want[s]) <= 0.5 and (of.taken <= 2 * of["size"]).all() and (of.source_size == sizes[s]).all()
        of = of.sort_values(["key", "size"])
        assert of.before.tolist() == [0, *of["size"].cumsum().tolist()[:-1]]
    again = mixing.mix(documents(spark, rows).repartition(5), range_rows=range_rows + 3).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(mixed.doc_id, mixed.taken))


def test_mixed_copies_hold_what_is_taken(spark):
    rows = [(i, "one  two\nthree " + "x " * (i % 9), "ab"[i % 5 == 0]) for i in range(90)] + [(5, "same words", "a")] * 4 + [(None, "no id", None), (None, "no id", None)]
    mixed = mixing.mix(documents(spark, rows), keep=("doc_id", "text", "target", "rest"))
    assert "rest" in mixed.columns and mixed.schema["target"].dataType.typeName() == "double"
    copies = mixing.copies(mixed).toPandas()
    assert (copies.words == copies.text.str.split().str.len()).all() and copies.words.sum() == mixed.agg(F.sum("taken")).first()[0]
    whole = {(i, t) for i, t, _ in rows}
    assert all(any(t.startswith(c.text) for _, t in whole) for c in copies.itertuples())
    assert copies.epoch.max() == 1 and copies.drop_duplicates(["doc_id", "text"]).turn.is_unique


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    only = mixing.mix(documents(spark, [(1, None, None), (2, " ", "a")])).toPandas()
    assert only.taken.tolist() == [0, 0] and only.target.tolist() == [0.0, 0.0]


# 12 hard negatives


def mined(rows, every=100):
    """By every score, in whole numbers of any size."""
    rows = [(i, [int(np.floor(256 * x)) if abs(x) < 2**44 else int(x) * 256 for x in v], g) for i, v, g in rows if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, g in rows:
        if i % every:
            continue
        best = lambda same: sorted(((-dot(v, w), j) for j, w, h in rows if j != i and (h == g) == same))
        others = best(False)
        for s, j in best(True)[:5]:
            out += [(i, j, k + 1, m, -s, -n) for k, (n, m) in enumerate([x for x in others if 30 * -s <= 100 * -x[0] <= 90 * -s][:10])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, 1.0, "x", 5) for i, v, g in rows], "vec_id bigint, embedding array<double>, label int, score double, row string, block int")


def answer(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(map(int, x)) for x in df.select(names).toPandas().itertuples(index=False))


@pytest.mark.parametrize("tree", [{}, {"block_rows": 40, "anchor_rows": 4, "sample_rows": 300, "depth": 5}])
def test_negatives_as_by_every_score(spark, tree):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 9)) * 3
    rows = [(k, (centres[k % 12] + r.normal(size=9) * 0.4).tolist(), int(k % 12) // 3) for k in range(1500)]
    rows += [(2000 + k, rows[100][1], k % 2) for k in range(150)]  # one vector a tenth of all rows
    rows += [(5000, [0.0] * 9, 1), (5100, [0.01] * 9, 2)]
    assert answer(negatives.mine(vectors(spark, rows), **tree)) == mined(rows)


def test_search_leaves_out_what_cannot_matter(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(16, 6)) * 20
    rows = [(k, (centres[k % 16] + r.normal(size=6) * 0.1).tolist(), k % 4) for k in range(4000)]
    search = negatives.Search(negatives.whole_vectors(vectors(spark, rows)), block_rows=300, sample_rows=512)
    anchors, sample = search.rows.where("vec_id % 100 = 0"), search.sample
    needs = lambda t, ids, labels, v: negatives.floors(negatives.Needs([[(None, None)]] * len(ids), True, 5), ids, labels, v, *sample)
    found = search.best(anchors, needs, True, 5)
    met = found.groupBy("row").count().toPandas()["count"]
    assert (met >= 5).all() and met.mean() < 5 * search.candidates[1].count() / 3  # of all blocks an anchor meets a few


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [2.0, 1.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 1), (400, [], 1), (500, [1.0], None), (None, [1.0, 1.0], 2), (1, [1.0, 1.5], 1), (1, [1.0, 1.5], 1), (2, [0.5, 1.0], 2),
            (3, [0.9, 1.1, 5.0], 2), (600, [-1.0, -1.0], 1), (700, [1e200, 1.0], 3), (8, [1e120, 0.0], 3), (9, [0.5e120, 1.0], 2), (800, [1e300, -1e300], 4), (10, [1e300, 0.0], 4), (11, [7e299, 0.0], 2)]
    got = answer(negatives.mine(vectors(spark, rows)).withColumns({c: F.col(c) for c in ("positive_score", "negative_score")}))
    want = [(a, b, c, d, *(max(min(x, (1 << 63) - 1), -(1 << 63)) for x in (e, f))) for a, b, c, d, e, f in mined(rows)]
    assert got == sorted(want)
    assert negatives.mine(vectors(spark, [])).count() == 0
    assert negatives.mine(vectors(spark, [(100, [1.0], 1), (2, [1.0], 2)])).count() == 0


# 13 spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def spelled(counts, ratio=2):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: f for w, f in form.items() if counts[f] >= ratio * counts[w]}
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return sorted(out)


@pytest.mark.parametrize("key_pairs", [1, 20, 10_000])
def test_variants_as_by_every_pair(spark, key_pairs):
    r = np.random.default_rng(4)
    letters = list("abcé")
    words = {"".join(r.choice(letters, r.integers(5, 8))) for _ in range(700)} | {"aaaaa", "aaaaaa", "aaaaaaa", "ab" * 40, "ab" * 40 + "a", "ab" * 20 + "c" + "ab" * 20, "éàöüß", "éàöüßx", "éàöüx"}
    counts = {w: int(r.integers(3, 60)) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = spelling.variants(table, key_pairs=key_pairs)
    assert sorted(tuple(x) for x in got.collect()) == spelled(counts)


def test_very_many_words_with_one_segment(spark):
    """All words share their second half: no key may keep them all, and no pair is lost."""
    words = ["".join(chr(97 + (k // 26**p) % 26) for p in range(5)) + "station" for k in range(0, 26**5, 26**5 // 6000)]
    words = sorted(set(words) | {w[:2] + "q" + w[3:] for w in words[:300]})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    got = spelling.near_pairs(table, key_pairs=2000)
    slips = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            slips[i, w[:i] + w[i + 1 :]].add(w)
    want = {(a, b) for of in slips.values() for a in of for b in of if a < b}
    assert {(x["a"], x["b"]) for x in got.collect()} == want and got.count() == len(want)


def test_vocabulary_with_slips(spark):
    rows = [(i, "Straße Überfall ÜBERFALL x×y÷zabc don't naïve-naïve " * (i % 3 + 1), "s") for i in range(400)] + [(None, "Überfall " * 5, "s"), (7, None, "s"), (8, "", "s")]
    counts = collections.Counter()
    for i, t, _ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if run and h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += len(run) >= 5
            run = ""
    got = spelling.vocabulary(documents(spark, rows), slips=97)
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in counts.items() if n >= 3}
    assert any(w not in ("straße", "Überfall", "x×y÷zabc", "naïve") for w in counts)


def test_variants_of_nothing(spark):
    assert spelling.variants(spelling.vocabulary(documents(spark, []))).count() == 0
    alone = spelling.variants(spark.createDataFrame([("abcde", 4)], "word string, n bigint")).collect()
    assert [tuple(x) for x in alone] == [("abcde", None, "abcde", 4, 0, None)]
