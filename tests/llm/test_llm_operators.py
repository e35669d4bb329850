"""The ten operators against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import functools
import gzip
import hashlib
import math
import zlib

import hypothesis
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import attention, langid, lm_scores, near_dups, packing, pieces, quality, rules, sharding, storage, subwords, textbuf, topk, warc
from tarnwick.llm.components import connected_components

SYLLABLES = ["ka", "mi", "to", "re", "su", "no", "la", "pe", "di", "vo"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, key string, label int"


def prose(r, n, syllables=SYLLABLES):
    return " ".join("".join(r.choice(syllables, r.integers(1, 4))) for _ in range(n))


def documents(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, s, None, "x", "y", 3) for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated, very long and tied rows."""
    r = np.random.default_rng(5)
    base = prose(r, 80)
    rows = [(1, None, None, None), (2, "", "a", "s"), (3, " \n\t", "a", None), (4, base, "a", "s"), (4, base, "a", "s"), (5, base, "b", "s"), (None, base, "b", "s"), (6, "one two", "b", "s"),
            (7, prose(r, 30000), "a", "s"), (8, "日本語 text ▁ 😀 <|endoftext|>", "a", "s"), (9, base + " more", "a", "s")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


def split(text):
    return [w for w in (text or "").encode().lower().split()]


def test_numbers_of_hashes():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 63, 60000, dtype=np.uint64) * np.uint64(2))
    table = textbuf.Numbered()
    for a in range(0, len(keys), 7000):
        table.add(keys[a : a + 7000], np.arange(a, min(a + 7000, len(keys)), dtype=np.int32))
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()


def test_word_scan():
    texts = [b"ab  c", b"", b"d\x0be", b"ab"]
    (at, raw, off), = textbuf.blocks(pa.array(texts, pa.binary()))
    start, end, first = textbuf.words(raw, off)
    assert [bytes(raw[a:b]) for a, b in zip(start, end)] == [b"ab", b"c", b"d", b"e", b"ab"] and list(first) == [0, 2, 2, 4, 5]
    h = textbuf.hashes(raw, start, end)
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    assert [b[0] for b in textbuf.blocks(pa.array(["aaa", None, "bbbb"]), 3)] == [0, 2]


# 1 quality


def test_quality_learns_and_scores_everything(spark, odd, nothing):
    r = np.random.default_rng(0)
    rows = [(i, prose(r, 40) if i % 3 else " ".join(w.upper() + "!!" for w in prose(r, 40).split()), "a", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int")
    out = quality.classify(documents(spark, rows), labels).toPandas()
    held = out[out.held_out]
    assert len(out) == 300 and ((held.doc_id % 3 > 0) == (held.predicted == 1)).all()
    assert set(held.doc_id) == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    got = quality.classify(odd, labels).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all()
    assert quality.classify(nothing, labels).count() == 0
    none = quality.classify(odd, labels.where("false")).toPandas()
    assert (none.score == 0.5).all()


def slow_ftrl(texts, labels, bits, alpha=1.0, beta=1.0, l1=0.02, l2=0.5, epochs=3):
    """Follow the regularised leader one coordinate at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for idx, y in zip(texts, labels):
            x = {int(i): c * quality.SCALE / len(idx) for i, c in collections.Counter(idx).items()} | {1 << bits: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g, w = (p - y) * v, weight(i)
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - step * w
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_against_one_coordinate_at_a_time():
    r = np.random.default_rng(16)
    texts = [r.integers(0, 64, r.integers(1, 40)) for _ in range(60)]
    labels = np.array([int((t < 20).mean() > 0.3) for t in texts])
    model, want = quality.fit_ftrl(texts, labels, 6), slow_ftrl(texts, labels, 6)
    assert model.bias == pytest.approx(want[64]) and np.allclose(model.weights, [want.get(i, 0.0) for i in range(64)], atol=1e-6)


def test_training_bytes_are_bounded(spark):
    r = np.random.default_rng(17)
    docs = documents(spark, [(i, prose(r, 400 if i == 7 else 20), "a", "s") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    assert quality.train(docs, labels, max_bytes=0).weights.any() == False  # noqa: E712
    a, b = quality.train(docs, labels, max_bytes=1 << 14), quality.train(docs.where("doc_id <> 7"), labels, max_bytes=1 << 14)
    assert (a.weights == b.weights).all()


# 2 archives


@pytest.mark.parametrize("segment", [64, 200, 1 << 15])
def test_archives_round_trip(spark, segment):
    html = ["<p>é</p>" * 300, None, "", "x\r\n\r\nWARC/1.1\r\n", "<p>é</p>" * 300, "0\r\n\r\n", "x" * 5000]
    rows = [(i + 10, f"http://e/{i}\n", h, "extra") for i, h in enumerate(html)] + [(None, None, "x" * 5000, "extra")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    path = storage.new_path(spark, "warc")
    warc.write_archives(pages, path, segment_bytes=segment, records_per_file=3)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        h = (h or "").encode()
        first.setdefault(h, i)
        r = got[i]
        assert r["payload_bytes"] == len(h) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h] == i else ("revisit", first[h]))
        assert r["payload"] is None or bytes(r["payload"]) == h


def test_broken_archives():
    with pytest.raises(ValueError):
        warc._joined([{"number": 2, "total": None, "block": b""}])
    with pytest.raises(ValueError):
        warc._joined([{"number": 1, "total": None, "block": b"a"}, {"number": 2, "total": 9, "block": b"b"}])
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
    for broken in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n", b"WARC/1.1\r\nContent-Length: 1\r\n\r\nab\r\n\r\n", b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc._parse([broken]))
    assert warc.unchunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000


def test_inflated_in_pieces():
    data = b"".join(warc._record([("WARC-Type", "x"), ("WARC-Record-ID", f"<{k}>")], bytes([k]) * k * 40000) for k in range(60))
    data = data.replace(b"WARC/1.1", b"\r\n\r\nWARC/1.1")[4:] + b"\r\n\r\n"
    members = gzip.compress(data[:700000]) + gzip.compress(data[700000:])
    for raw in (data, gzip.compress(data), members):
        assert [(r[0], len(r[7])) for r in warc._parse(warc.inflated(raw))] == [(str(k), k * 40000) for k in range(60)]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.inflated(members[:-20]))


def test_pages_that_repeat_an_id(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (2, "u", "c"), (3, "u", "b")]
    path = storage.new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    sha = {base64.b32encode(hashlib.sha1(x.encode()).digest()).decode(): x for x in "abc"}
    got = sorted((r["page_id"], sha[r["payload_digest"]], r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.read_archives(spark, path).collect())
    assert got == [(1, "a", "response", 0, 1), (1, "a", "response", 0, 1), (1, "b", "response", 0, 1), (2, "a", "revisit", 1, 1), (2, "c", "response", 0, 1), (3, "b", "revisit", 1, 1)]


def test_no_pages(spark):
    path = storage.new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


# 3 shards


def test_shards_of_equal_bytes(spark, odd, nothing):
    r = np.random.default_rng(1)
    hot = prose(r, 60)
    rows = [(i, hot if i % 3 == 0 else prose(r, int(r.integers(0, 120))), "a", "s") for i in range(4000)]
    docs = documents(spark, rows).withColumn("slot", F.lit("clash"))
    out = sharding.histogram_sort(docs, shards=6, subranges=2, tolerance=0.01).toPandas()
    assert sorted(out.doc_id) == list(range(4000))
    size = out.text.map(len) + 8
    by = size.groupby(out.shard).sum()
    assert len(by) == 6 and by.max() - by.min() < 0.03 * by.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.groupby("text").shard.nunique().drop(hot).max() <= 2
    small = sharding.histogram_sort(odd).toPandas()
    assert len(small) == odd.count()
    for _, g in small.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.histogram_sort(nothing).count() == 0


# 4 rules


def test_base_statistics(spark, odd):
    def slow(text):
        text = text or ""
        w = [x for x in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if x]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = collections.Counter(tri)
        many = {t for t, n in times.items() if n > 1}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        cover = len({j for i, t in enumerate(tri) if t in many for j in (i, i + 1, i + 2)})
        return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), cover

    more = documents(spark, [(20, "a b c a b c d\na b\na b\n\n#x|", "a", "s"), (21, "a a a a a", "a", "s"), (22, "a b c d e f g a b c", "a", "s")])
    for r in rules.base_statistics(odd.union(more)).join(odd.union(more).select("doc_id", "text").distinct(), "doc_id").collect():
        want = slow(r["text"])
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == want
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def slow_estimate(x, prior):
    """Concentration steps in numpy, by the same bins, from both starts: mean, covariance, covariance with the least variances."""
    floor = np.diag((rules.UNIT * np.array(rules.LEAST_DEVIATION)) ** 2)
    q, r = prior

    def leaned(n, mean, cov):
        k = rules.PRIOR
        return (n * mean + k * q) / (n + k), (n * cov + k * r + n * k / (n + k) * np.outer(mean - q, mean - q)) / (n + k)

    med = np.median(x, axis=0)
    starts = [(med, np.diag((1.4826 * np.median(np.abs(x - med), axis=0)) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True).reshape(4, 4))]
    best = None
    for start in starts:
        mean, cov = leaned(len(x), *start)
        held = None
        for _ in range(rules.MOST_STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean)
            bins = np.floor(rules.FINE * np.log1p(d))
            values, counts = np.unique(bins, return_counts=True)
            inside = bins <= values[np.searchsorted(np.cumsum(counts), math.ceil(len(x) * rules.COVER))]
            if held is not None and (inside == held).all():
                break
            held, inner = inside, x[inside]
            mean, cov = leaned(len(inner), inner.mean(axis=0), np.cov(inner.T, bias=True).reshape(4, 4))
        det = np.linalg.slogdet(cov + floor)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, mean, cov, cov + floor
    return best[1:]


def slow_distances(stats):
    """Squared distances of all texts that pass the base rule: all documents, then languages, then sources within them."""
    x = stats[list(rules.STATS)].to_numpy(float)
    top = slow_estimate(x, (np.median(x, axis=0), np.diag((rules.UNIT * np.array(rules.PRIOR_DEVIATION)) ** 2)))
    out = np.zeros(len(x))
    for lang in stats.lang.unique():
        of_lang = (stats.lang == lang).to_numpy()
        middle = slow_estimate(x[of_lang], top[:2])
        for source in stats.source.unique():
            here = of_lang & (stats.source.isna() if source is None else stats.source == source).to_numpy()
            if here.any():
                mean, _, cov = slow_estimate(x[here], middle[:2])
                out[here] = np.einsum("ij,jk,ik->i", x[here] - mean, np.linalg.inv(cov), x[here] - mean) / rules.consistency(rules.COVER)
    return out


def test_outliers_against_numpy(spark, odd, nothing):
    r = np.random.default_rng(2)
    sizes = {("a", "s"): 300, ("a", None): 41, ("a", "t"): 39, ("a", "u"): 5, ("b", "s"): 150, ("b", None): 1, ("c", "s"): 2}
    rows = []
    for (lang, source), n in sizes.items():
        for k in range(n):
            rows.append((len(rows), prose(r, 60 + k % 50) + (" ###***" * 12 if k % 25 == 24 else ""), lang, source))
    docs = documents(spark, rows)
    out = rules.judge(docs).toPandas().set_index("doc_id")
    planted = np.array(["###" in t for _, t, _, _ in rows])
    kept = out.kept.sort_index().to_numpy()
    assert not kept[planted].any() and kept[~planted].mean() > 0.98
    stats = rules.vectors(rules.base_statistics(docs)).where("not base_failed").toPandas()
    stats["source"] = stats.source.where(stats.source.notna(), None)
    assert np.allclose(out.loc[stats.doc_id].distance, slow_distances(stats), rtol=1e-6, atol=1e-9)
    assert rules.judge(odd).count() == odd.count() and rules.judge(nothing).count() == 0


@pytest.mark.parametrize("kind", ["long words", "symbols", "repeated lines", "repeated words"])
def test_outlier_in_one_statistic(spark, kind):
    r = np.random.default_rng(3)

    def planted():
        words = prose(r, 120).split()
        if kind == "long words":
            return " ".join(w + "katore"[: 2 * (k % 2)] * 2 for k, w in enumerate(words))
        if kind == "symbols":
            return " ".join(w + "#" * (k % 5 == 0) for k, w in enumerate(words))
        if kind == "repeated lines":
            return "\n".join(x for k in range(0, 120, 3) for x in (" ".join(words[k : k + 3]), "kami"))
        return " ".join(words + words[:30])

    rows = [(i, prose(r, 100 + i % 50) if i < 300 else planted(), "a", "s") for i in range(304)]
    out = rules.judge(documents(spark, rows)).toPandas().set_index("doc_id").sort_index()
    assert not out.base_failed.any() and not out.loc[300:].kept.any() and out.loc[:299].kept.mean() > 0.98


# 5 language


def test_code_lengths_against_a_tree():
    r = np.random.default_rng(3)
    texts = {"x": prose(r, 200), "y": prose(r, 200, ["zu", "qa", "we"])}
    counts = {}
    for k, t in texts.items():
        g = langid.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        u, c = np.unique(g, return_counts=True)
        counts[k] = (u, c.astype(float))
    model = langid.build(counts)

    def slow(lang, context, byte):
        padded = b"\0\0\0" + texts[lang].encode()
        for order in range(3, -1, -1):
            c = context[3 - order :]
            after = [padded[i] for i in range(3, len(padded)) if padded[i - order : i] == c]
            if after and byte in after:
                return math.log2((len(after) + len(set(after))) / after.count(byte)) + slow.cost
            if after:
                slow.cost += math.log2((len(after) + len(set(after))) / len(set(after)))
        return slow.cost + 8

    probe = b"\0\0\0kamito zuqa!"
    g = langid.grams(np.frombuffer(probe[3:], np.uint8), np.array([0, len(probe) - 3]))
    bits = model.bits(g)
    for i in range(3, len(probe)):
        for k, lang in enumerate(model.langs):
            slow.cost = 0.0
            assert bits[i - 3, k] == pytest.approx(slow(lang, probe[i - 3 : i], probe[i]), rel=1e-4)


def test_language_of_everything(spark, odd, nothing):
    r = np.random.default_rng(4)
    kinds = {"x": SYLLABLES, "y": ["zu", "qa", "we", "hy"], "z": ["ör", "äl", "ün"]}
    rows = [(i, prose(r, 30, kinds["xyz"[i % 3]]), "xyz"[i % 3], "s") for i in range(150)]
    out = langid.identify(documents(spark, rows)).toPandas().set_index("doc_id")
    assert all(out.lang_pred[i] == "xyz"[i % 3] for i in range(150)) and out.held_out.sum() > 10
    got = langid.identify(odd).toPandas()
    assert len(got) == odd.count() and set(got[got.doc_id.isin([1, 2, 3])].lang_pred) == {"und"} and got.score.between(0, 1).all()
    assert langid.identify(nothing).count() == 0
    assert set(langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}


# 6 language model


def slow_model(w, voc, x, target):
    """log probability of ``target`` after the ids ``x``."""
    d = attention.WIDTH
    x = w["e"][voc.row[x]]
    q, k, v = np.split(x @ w["qkv"], 3, axis=1)
    a = np.exp(q[-1] @ k.T * d**-0.5 + w["near"][np.arange(len(x))[::-1]])
    h = x[-1] + (a @ v) / a.sum() @ w["o"]
    y = h + np.maximum(h @ w["a"] + w["a0"], 0) @ w["b"]
    group, sub = divmod(int(voc.klass[target]), attention.EACH)
    one, two = y @ w["u"] + w["u0"], y @ w["v"][group] + w["v0"][group]
    return one[group] - np.log(np.exp(one).sum()) + two[sub] - np.log(np.exp(two).sum()) + voc.log_share[target]


def test_windows_against_one_text_at_a_time():
    r = np.random.default_rng(0)
    counts = r.integers(0, 9, lm_scores.IDS)
    voc = attention.Vocabulary.of(counts, counts // 2 + r.integers(0, 2, lm_scores.IDS), counts // 2)
    assert np.isclose(np.bincount(voc.klass, weights=np.exp(voc.log_share)), 1).all()
    w = attention.views(attention.fresh(voc, 1))
    texts = [r.integers(0, 100, n).astype("<u2") for n in (0, 1, 15, 16, 17, 33, 70)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = attention.score_stream(w, voc, np.concatenate(texts), off, lm_scores.START_ID, at_once=3)
    for t, s in zip(texts, got, strict=True):
        want, whole = 0.0, np.concatenate([[lm_scores.START_ID], t]).astype(int)
        for i in range(len(t)):
            first = max(0, i // attention.STRIDE * attention.STRIDE - (attention.WINDOW - attention.STRIDE))
            want += slow_model(w, voc, whole[first : i + 1], int(t[i]))
        assert s == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_probabilities_of_all_ids_add_up():
    r = np.random.default_rng(2)
    counts = r.integers(0, 50, lm_scores.IDS)
    voc = attention.Vocabulary.of(counts, r.integers(0, 50, lm_scores.IDS), r.integers(0, 50, lm_scores.IDS))
    w = attention.views(attention.fresh(voc, 1))
    off = np.arange(0, 2 * lm_scores.IDS + 2, 2)
    ids = np.stack([np.full(lm_scores.IDS + 0, 5), np.arange(lm_scores.IDS)], axis=1).ravel().astype("<u2")
    two = attention.score_stream(w, voc, ids, off[: lm_scores.IDS + 1], lm_scores.START_ID)
    one = attention.score_stream(w, voc, ids[:1], np.array([0, 1]), lm_scores.START_ID)
    assert np.exp(two - one[0]).sum() == pytest.approx(1, abs=0.02)  # classes without ids hold the rest


def full_gradient(flat, rows, klass, real=None):
    loss, dense, seen, table = attention.gradients(attention.views(flat), rows, klass, real)
    g = np.concatenate([np.zeros(attention.SIZE - len(dense)), dense])
    attention.views(g)["e"][seen] = table
    return loss, g


def test_gradients():
    r = np.random.default_rng(0)
    flat = attention.fresh().astype(float)
    rows, klass = r.integers(0, 50, (3, attention.WINDOW)), r.integers(0, attention.CLASSES, (3, attention.WINDOW))
    _, g = full_gradient(flat, rows, klass)
    grads = attention.views(g)
    for k, x in attention.views(flat).items():
        at = (int(rows[0, 3]), 5) if k == "e" else (int(klass[0, 0]) // attention.EACH, *(0, 1)[: x.ndim - 1]) if k in ("v", "v0") else tuple(int(r.integers(0, n)) for n in x.shape)
        old, loss = x[at], []
        for d in (1e-5, -1e-5):
            x[at] = old + d
            loss.append(full_gradient(flat, rows, klass)[0])
        x[at] = old
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(grads[k][at], rel=1e-3, abs=1e-8)


def test_base_scores(spark, odd, nothing):
    out = lm_scores.score(odd).toPandas()
    docs = odd.select("doc_id", "text").toPandas()
    learn = [(i, t) for i, t in zip(docs.doc_id, docs.text) if i == i and zlib.crc32(str(int(i)).encode()) % 7 != 2]
    counts: dict = {}
    for _, t in learn:
        for w in [*split(t), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(split(t)) + 1, sum(counts.get(w, 0) > 0 for w in [*split(t), None]), round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*split(t), None]), 6)) for t in docs.text)
    assert sorted(zip(out.n_tokens, out.n_known, out.base_score.round(6))) == want
    assert (out.train_tokens == n).all() and (out.score < 0).all() and len(out) == len(docs)
    assert lm_scores.score(nothing).count() == 0


def test_gradients_leave_out_what_follows_a_window():
    r = np.random.default_rng(1)
    flat = attention.fresh().astype(float)
    rows, klass = r.integers(0, 50, (1, attention.WINDOW)), r.integers(0, attention.CLASSES, (1, attention.WINDOW))
    real = np.arange(attention.WINDOW)[None] < 9
    loss, g = full_gradient(flat, rows, klass, real)
    want, short = full_gradient(flat, rows[:, :9], klass[:, :9])
    assert loss == pytest.approx(want) and np.allclose(g, short)


@pytest.mark.parametrize("rounds", [1, 4])
def test_every_training_id_is_a_target_once(rounds):
    r = np.random.default_rng(2)
    texts = [r.integers(0, 60000, n).astype("<u2") for n in (1, 10, 31, 32, 33, 64, 500)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = [lm_scores.windows(np.concatenate(texts), off, np.arange(len(texts)) - 2, k, rounds) for k in range(rounds)]
    assert sorted(np.concatenate([targets[real] for _, targets, real in got])) == sorted(np.concatenate(texts))
    pairs = sorted((int(a), int(b)) for inputs, targets, real in got for a, b in zip(inputs[real], targets[real], strict=True))
    assert pairs == sorted((int(a), int(b)) for t in texts for a, b in zip([lm_scores.START_ID, *t[:-1]], t, strict=True))


@pytest.mark.parametrize("block_bytes", [1, 300, 1 << 25])
def test_ids_are_the_tokenizer_s(spark, odd, block_bytes):
    corpus = storage.materialise(lm_scores.read_corpus(odd, block_bytes), "corpus")
    found, ends = lm_scores.base_scores(corpus, storage.materialise(lm_scores.spelled_words(corpus), "words"))
    encoder = subwords.Encoder()
    want = [np.append(np.frombuffer(encoder.texts([(t or "").encode().lower()])[0], "<u4"), lm_scores.END_ID).tolist() for t in odd.toPandas().text]
    got = found.collect()
    assert sorted(np.frombuffer(x.ids, "<u2").tolist() for x in got) == sorted(want)
    assert ends == sum(x.learn for x in got)


def test_short_texts_are_learned(spark):
    docs = documents(spark, [(i, "ka mi to", "a", "s") for i in range(400)] + [(i, "to re ka su", "a", "s") for i in range(400, 800)])
    corpus = storage.materialise(lm_scores.read_corpus(docs), "corpus")
    spelled = lm_scores.spelled_words(corpus)
    texts, ends = lm_scores.base_scores(corpus, spelled)
    voc, _ = lm_scores.vocabulary_of(spelled, ends)
    before = lm_scores.model_scores(texts, attention.fresh(voc), voc).agg(F.sum("score")).first()[0]
    assert lm_scores.score(docs).agg(F.sum("score")).first()[0] > 0.7 * before


# 7 near duplicates


def slow_components(rows):
    sets = {}
    for i, t in rows:
        w = split(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_all_pairs(spark, odd, nothing):
    r = np.random.default_rng(6)
    rows = []
    for k in range(12):
        base = prose(r, int(r.integers(20, 120))).split()
        for _ in range(12):
            w = list(base)
            for _ in range(int(r.integers(0, 6))):
                w[int(r.integers(0, len(w)))] = prose(r, 1)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    got = {x["doc_id"]: x for x in near_dups.near_duplicates(documents(spark, [(i, t, "a", "s") for i, t in rows])).collect()}
    want = slow_components(rows)
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == want
    assert all(x["kept"] == (i == want[i][1]) for i, x in got.items())
    few = near_dups.near_duplicates(odd).collect()
    assert len(few) == odd.count()
    by = {x["doc_id"]: x for x in few}
    assert by[5]["component_id"] == 4 and by[9]["component_id"] == 4 and by[None]["component_id"] is None and by[1]["kept"] and by[2]["component_id"] == 2
    assert near_dups.near_duplicates(nothing).count() == 0


def test_ids_with_several_texts(spark):
    r = np.random.default_rng(14)
    t, u, v = (prose(r, 40) for _ in range(3))
    rows = [(1, t), (2, u), (2, t), (3, u), (4, v), (4, v), (5, v), (6, ""), (6, t), (7, None), (7, None), (None, u)]
    got = sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"] or 0, x["kept"]) for x in near_dups.near_duplicates(documents(spark, [(i, x, "a", "s") for i, x in rows])).collect())
    n = {x: len(set(zip(*(x.split()[k:] for k in range(5))))) for x in (t, u, v)}
    want = [(i or 0, n.get(x, 0), {2: 1, 3: 1, 5: 4, 6: 1}.get(i, i or 0), i in (1, 4, 7, None)) for i, x in rows]
    assert got == sorted(want)


def test_one_of_each(spark, nothing):
    r = np.random.default_rng(15)
    t, u = prose(r, 40), prose(r, 40)
    left = lambda rows: sorted((x["doc_id"] or 0, x["text"] or "") for x in near_dups.one_of_each(documents(spark, [(i, x, "a", "s") for i, x in rows])).collect())
    assert left([(3, t), (2, t), (5, u)]) == [(2, t), (5, u)]
    assert left([(1, t), (1, t), (None, t)]) == [(1, t)]
    assert left([(1, t), (1, u), (2, t), (None, u), (0, "")]) == sorted([(1, t), (1, u), (0, "")])
    assert left([(None, t), (None, t), (None, None)]) == [(0, ""), (0, t)]
    assert near_dups.one_of_each(nothing).count() == 0


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(7)
    for n in (1, 3, 40, 700):
        h = r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = h[: int(1.5 * n) or 1], h[n // 2 :]
        s = near_dups.fast_sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 1024)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert (s[0] == s[1]).mean() == pytest.approx(true, abs=0.07)


def test_links_of_blocks_join_what_all_pairs_join(monkeypatch):
    monkeypatch.setattr(near_dups, "COLUMNS", 64)
    r = np.random.default_rng(18)
    base = [r.integers(0, 1 << 40, 60).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([b[r.random(60) < 0.93], r.integers(0, 1 << 40, r.integers(0, 8)).astype(np.uint64)])) for b in base for _ in range(12)]
    n, rep = np.array([len(x) for x in sets]), np.arange(len(sets)) + 100
    exact = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    assert (near_dups.common(sets[:9], sets) == exact[:9]).all()
    for side in (np.full(48, 2), np.arange(48) % 2):
        label = np.where(np.arange(48) % 12 < 7, np.arange(48) // 12, np.arange(48) + 50)
        root = {x: x for x in label.tolist()}

        def find(x):
            return x if root[x] == x else find(root[x])

        for i in range(48):
            for j in range(48):
                if i != j and (side[i], side[j]) in ((2, 2), (0, 1)) and 100 * exact[i, j] >= 75 * (n[i] + n[j] - exact[i, j]):
                    root[find(int(label[i]))] = find(int(label[j]))
        want = len({find(x) for x in root})
        got = near_dups._links_of_block(rep, n, label, side, sets)
        assert len(root) - len(got) == want  # a forest
        for u, v in got:
            i, j = u - 100, v - 100
            assert 100 * exact[i, j] >= 75 * (n[i] + n[j] - exact[i, j]) and label[i] != label[j]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5), (None, 3)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}


# 8 pieces


def test_pieces_without_dropout_are_the_library_s():
    import sentencepiece

    model, r = pieces.Model(), np.random.default_rng(8)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    plain, dropped = pieces.Encoder(model, 0.0, 2, 1), pieces.Encoder(model, 0.3, 2, 1)
    texts = ["", " ", "  a  b\n\nc\td ", "日本語 😀 ́x", "x" * 2000, "▁a▁ ▁", prose(r, 200), "The quick brown fox's jumps."]
    for k, t in enumerate(texts):
        ids = np.frombuffer(plain.text(t.encode(), k), "<u4").tolist()
        assert "▁" in t or ids == library.encode(t)
        other = np.frombuffer(dropped.text(t.encode(), k), "<u4").tolist()
        assert model.decode(ids).decode() == t and model.decode(other).decode() == t
    assert len(other) > len(ids)


def test_lockstep_is_the_agenda():
    model, r = pieces.Model(), np.random.default_rng(9)
    chunks = [pieces.SPACE * int(r.integers(0, 2)) + "".join(r.choice(list("theindaouslr'E.,é日"), r.integers(1, 30))) for _ in range(400)]
    keys = [int(k) for k in r.integers(0, 1 << 62, len(chunks))]
    for dropout in (0.0, 0.2, 0.9):
        got = model.encode_chunks(chunks, dropout, keys)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [model.encode_chunk(c, dropout, k) for c, k in zip(chunks, keys, strict=True)]


def test_pieces_of_everything(spark, odd, nothing):
    one = pieces.decode(pieces.encode(odd.repartition(1), keep=("doc_id", "text"))).toPandas()
    two = pieces.decode(pieces.encode(odd.repartition(3), keep=("doc_id", "text"))).toPandas()
    assert all((a or "").encode() == bytes(b) for a, b in zip(one.text, one.decoded, strict=True))
    assert sorted(map(bytes, one.ids)) == sorted(map(bytes, two.ids))
    assert pieces.encode(nothing).count() == 0


def test_dropout_varies_with_document_and_occurrence(spark):
    model = pieces.Model()
    rows = spark.createDataFrame([(i, "wonderful information " * 50) for i in range(40)], "doc_id bigint, text string")
    word = pieces.SPACE + "information"
    plain = len(model.encode_chunk(word, 0.0, 0))
    seen, kept, n = set(), 0, 0
    for r in pieces.encode(rows).collect():
        spelled = b"|".join(model.bytes_of[i] for i in np.frombuffer(r.ids, "<u4"))
        for w in spelled.replace(b"| ", b"\n").split(b"\n"):
            if w.replace(b"|", b"").strip() == b"information":
                seen.add(w)
                kept += w.count(b"|") + 1 == plain
                n += 1
    assert n == 2000 and len(seen) > 10 and 0.05 < kept / n < 0.95


def test_remembered_chunks_are_the_agenda():
    model, r = pieces.Model(), np.random.default_rng(4)
    encoder, words = pieces.Encoder(model, 0.2, 3), ["the", "information", "wonderful", "日本語", "x" * 70]
    text = " ".join(r.choice(words, 400))
    chunks = pieces.CHUNKS.findall((" " + text).replace(" ", pieces.SPACE))
    keys = textbuf.mix(np.full(len(chunks), 7, np.uint64) + textbuf.mix(np.arange(len(chunks), dtype=np.uint64) + np.uint64(4)))
    want = [i for c, k in zip(chunks, keys.tolist(), strict=True) for i in model.encode_chunk(c, 0.2, k)]
    assert np.frombuffer(encoder.text(text.encode(), 7), "<u4").tolist() == want


# 9 search


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_search_against_all_products(spark, block):
    r = np.random.default_rng(9)
    v = r.normal(size=(120, 20)) * r.lognormal(size=(120, 1))
    v[40:80] = v[40]
    rows = [(i * 5, x.tolist()) for i, x in enumerate(v)] + [(10000, None), (10001, [1.0, None]), (10100, [float("nan")] * 20), (10200, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    got: dict = {}
    for x in topk.top_k(df, block_rows=block, query_rows=3, head_rows=20).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], -x["score"], x["vec_id"]))
    w = np.floor(1024 * v.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 120, 20):
        s = w @ w[q]
        want = sorted((-int(s[i]), i * 5) for i in range(120) if i != q)[:10]
        assert sorted(got[q * 5]) == [(k + 1, *x) for k, x in enumerate(want)]
    assert set(got) == {q * 5 for q in range(0, 120, 20)}
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def exact_answer(rows, k=10, every=100):
    """The k best by whole numbers, for each row of the queries' ids."""
    whole = [(i, [math.floor(1024 * x) if abs(x) < 2**42 else int(x) * 1024 for x in v]) for i, v in rows]
    out = []
    for i, q in whole:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:k]
            out += [(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("block", [16, 8192])
def test_search_with_very_long_vectors(spark, kind, block):
    r = np.random.default_rng(11)
    v = r.normal(size=(90, 8)).astype(np.float32).astype(float)
    v[3, 2], v[10, 0], v[20, 5], v[21, 5], v[30, 7], v[40] = 1e6, 1e30, -1e30, 3e38, -1e6, 0
    v[50:53, 1] = 2.0**50, 2.0**50 + 2**20, -(2.0**50)
    if kind == "double":
        v[60, 3], v[61, 3] = 1.7e308, -1.7e308
    v = v.astype(np.float32).astype(float) if kind == "float" else v
    rows = [(i * 10, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    got = sorted(tuple(x) for x in topk.top_k(df, block_rows=block, query_rows=4, head_rows=12).collect())
    assert got == exact_answer(rows)


def test_search_with_repeated_ids(spark):
    r = np.random.default_rng(12)
    rows = [(int(i), r.normal(size=5).astype(np.float32).tolist()) for i in [*range(95, 130), 120, 120, 101, 101]]
    df = spark.createDataFrame([*rows, (100, rows[9][1])], "vec_id bigint, embedding array<float>")
    got = sorted(tuple(x) for x in topk.top_k(df).collect())
    assert got == exact_answer([*rows, (100, rows[9][1])]) and len(got) == 20


def test_few_queries_meet_short_vectors(spark):
    """Blocks of vectors too short to matter are not met."""
    r = np.random.default_rng(13)
    v = r.normal(size=(4000, 16)) * np.where(np.arange(4000) < 400, 50.0, 0.01)[:, None]
    rows = [(i, x) for i, x in enumerate(v.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.top_k(df, block_rows=100, query_rows=50, head_rows=200)
    w = np.floor(1024 * v.astype(np.float32).astype(float))
    for q in (0, 300, 3900):
        s = w @ w[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(4000), -s))[:10].tolist()
        assert [x["vec_id"] for x in got.where(f"query_id = {q}").orderBy("rank").collect()] == want


# 10 packing

SMALL_MEMORY = subwords.Encoder(memory=50)


@functools.lru_cache(1)
def subwords_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(subwords.tokenizer_path())


def test_word_memory_gives_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(subwords.tokenizer_path())
    r = np.random.default_rng(1)
    texts = ["", "it's  We'll\n<|endoftext|> é É ﬁ 12a3 x y ''s ́a ½ 😀!", prose(r, 300)]
    got = subwords.Encoder(memory=50).texts([x.encode() for x in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@hypothesis.settings(max_examples=300, deadline=None)
@hypothesis.given(hypothesis.strategies.lists(hypothesis.strategies.text("abAZéßÉİıſŉǅŐκΣΐﬁß½²१٣日ー\u0307\u0301\u0300\u200d'.,;!?%#*&$|<>-_0 9\n\t\u00a0\u2003😀", max_size=12), max_size=8))
def test_any_words_get_the_tokenizer_s_ids(texts):
    whole = subwords_tokenizer()
    want = [whole.encode(x, add_special_tokens=False).ids for x in texts]
    got: list = []
    for _, ids, off in SMALL_MEMORY.column(pa.array([x.encode() for x in texts], pa.binary())):
        got += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    assert got == want


def test_words_of_a_dotted_capital_i():
    t = subwords_tokenizer()
    for x in ("İ.", "İİ;", "aİ!", "İ", "İ.a İ."):
        assert np.frombuffer(subwords.Encoder().texts([x.encode()])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_short_pieces_fill_sequences(spark):
    docs = documents(spark, [(i, ["", None, "a", "a b c d"][i % 4], "a", "s") for i in range(4000)])
    out = packing.pack_documents(docs).toPandas()
    fill = out.groupby("sequence_id").length.sum()
    assert len(out) == 4000 and len(fill) <= math.ceil(out.length.sum() / packing.CAPACITY * 1.05) and fill.max() <= packing.CAPACITY
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(np.cumsum(g.length) - g.length)


def test_packing_uses_every_id_once(spark, odd, nothing):
    r = np.random.default_rng(2)
    docs = documents(spark, [(i, prose(r, int(r.integers(0, 1500))), "a", "s") for i in range(150)]).union(odd)
    out = packing.pack_documents(docs).toPandas()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= packing.CAPACITY
    fill = out.groupby("sequence_id").length.sum()
    assert (len(fill) * packing.CAPACITY - fill.sum()) / fill.sum() < 0.03
    encoder = subwords.Encoder()
    texts = docs.select("doc_id", "text").toPandas()
    want = sorted(zlib.crc32(x[a : a + 8192]) for t in texts.text for x in [encoder.texts([(t or "").encode()])[0] + b"\1\0\0\0"] for a in range(0, len(x), 8192))
    assert sorted(out.ids_crc32) == want
    assert packing.pack_documents(nothing).count() == 0


def test_plan_covers_demand_near_the_bound():
    r = np.random.default_rng(3)
    sizes = np.unique(r.integers(1, 257, 120))
    demand = r.integers(1, 400, len(sizes))
    got = packing.plan(sizes, demand, 256)
    assert all(p @ sizes <= 256 for p, _ in got) and (sum(n * p for p, n in got) >= demand).all()
    assert sum(n for _, n in got) <= np.ceil(sizes @ demand / 256) * 1.02 + 5
