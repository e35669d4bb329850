"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

Two texts are linked when their sets of five-word shingles have a Jaccard index of at least 0.75.

Shingles are told apart by two unlike 64-bit hashes of their words' bytes.

1.  Each text gets a sketch of 128 coordinates.  In round i of the sketching every shingle is hashed
    to one bin, and fills it if it has the least value of those sent there and the bin is still
    empty; from round 128 on, all shingles go to the one bin whose turn it is, so that every
    coordinate is filled after 256 rounds at most, and a long text needs about two rounds.
2.  Texts with equal shingle sets make a class; only its smallest document goes on.
3.  32 bands of 4 coordinates put classes into buckets.  At the threshold a pair misses all 32 buckets
    with probability 5e-6, and less above it.
4.  Each bucket member is verified against the bucket's hub, the member that meets most others in
    all its buckets, on the full shingle sets (linear in the bucket's size), and components of the
    links are formed.
5.  Where a bucket still holds several components, all its pairs from different components are tested on the full shingle
    sets, in blocks bounded in rows and bytes: common shingles are counted by products of matrices over the shingles that
    both sides hold.  A block gives as few links as join its components.  Pairs within one component, or within the
    largest one of a block, need no test, as they can't change the result.

Cases: a text without words, or null, has an empty set and is linked with nothing; fewer than five
words make one shingle.  Repeated rows are answered alike.  A ``doc_id`` with several texts is linked with whatever one of
them is linked with; each row has its own text's size.  A row with a null ``doc_id`` is linked
with nothing, has a null component and is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import arrow_rows, materialise
from .textbuf import LOWER, binary, blocks, flat, hashes, mix, owners, words

WIDTH, BANDS, BAND_ROWS = 5, 32, 4
#: Rows of a block of a bucket, and bytes of their shingle sets; shingles that are counted at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 1 << 25, 2048

_ODD = np.array([0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64)


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in a row, as two unlike 64-bit hashes each, and the text that each belongs to."""
    start, end, first = words(raw, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, own = _joined(hashes(raw, start, end), first)
    two, _ = _joined(hashes(raw, start, end, second=True), first)
    key = mix(out ^ mix(own.astype(np.uint64) + np.uint64(0x51ED27)))
    order = np.argsort(key)
    key, other = key[order], two[order]
    keep = np.ones(len(out), bool)
    keep[order[1:][(key[1:] == key[:-1]) & (other[1:] == other[:-1])]] = False
    return out[keep], two[keep], own[keep]


def _joined(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles from those of their words, and the text that each belongs to."""
    counts = np.diff(first)
    total = np.full(len(h), np.uint64(WIDTH), np.uint64)
    for k in range(WIDTH):
        total[: max(0, len(h) - k)] += h[k:] * _ODD[k]
    at = np.arange(len(h)) - np.repeat(first[:-1], counts)
    full = at + WIDTH <= np.repeat(counts, counts)
    own = owners(first)
    few = np.flatnonzero((counts > 0) & (counts < WIDTH))
    for n in range(1, WIDTH):
        docs = few[counts[few] == n]
        whole = np.full(len(docs), np.uint64(n), np.uint64)
        for k in range(n):
            whole += h[first[docs] + k] * _ODD[k]
        total[first[docs]] = whole
        full[first[docs]] = True
    return mix(total[full]), own[full]


def fast_sketch(h: np.ndarray, own: np.ndarray, n_docs: int, coords: int) -> np.ndarray:
    """Fast similarity sketches [n_docs, coords] of hash sets; a row of an empty set is all ones.

    ``own``: the ascending number of the set of each hash.  ``coords``: a power of two up to 4096.  A value holds
    its round in the high bits, so that the least value of a coordinate is one of the first round that filled it.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n_docs, coords), none, np.uint64)
    flat = out.reshape(-1)
    h, base = h, own.astype(np.int64) * coords
    for k in range(2 * coords):
        if not len(h):
            break
        v = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = base + (v & np.uint64(coords - 1)).astype(np.int64) if k < coords else base + (k - coords)
        np.minimum.at(flat, place, (v >> np.uint64(13)) | np.uint64(k << 51))
        if k % 4 == 0:  # texts with all coordinates filled are done
            docs = base // coords
            new = np.concatenate([[True], docs[1:] != docs[:-1]])
            short = (out[docs[new]] == none).any(axis=1)[np.cumsum(new) - 1]
            h, base = h[short], base[short]
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): set size, sums of the set's two kinds of hashes, keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            for at, raw, off in blocks(batch["text"], max_rows=8192):
                n = len(off) - 1
                h, two, own = shingles(LOWER[raw], off)
                size = np.bincount(own, minlength=n)
                ends = np.concatenate([[0], np.cumsum(size)])
                sums = []
                for x in (h, two):
                    run_sum = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(x * np.uint64(3) + np.uint64(1)), out=run_sum[1:])
                    sums.append((run_sum[ends[1:]] - run_sum[ends[:-1]]).view(np.int64))
                coords = fast_sketch(h, own, n, BANDS * BAND_ROWS)
                keys = np.zeros((n, BANDS), np.uint64)
                for k in range(BAND_ROWS):
                    keys = mix(keys + coords[:, k::BAND_ROWS])
                keys = mix(keys + band).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, n), pa.array(size.astype(np.int64)), *map(pa.array, sums), lists],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"
    )


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(rep, shingles): the distinct shingle hashes of each text, 64 bits each, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, off in blocks(batch["text"], max_rows=2048):
                n = len(off) - 1
                h, _, own = shingles(LOWER[raw], off)
                h = h[np.lexsort((h, own))]
                sizes = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), binary(h, sizes)], names=["rep", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep bigint, shingles binary")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full shingle sets have 100 * common >= 75 * union."""
    a = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    b = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            at = 0
            for (lo, raw_u, off_u), (_, raw_v, off_v) in _side_by_side(batch["text_u"], batch["text_v"]):
                at, n = lo, len(off_u) - 1
                sides = [shingles(LOWER[raw], off) for raw, off in ((raw_u, off_u), (raw_v, off_v))]
                size = [np.bincount(own, minlength=n) for _, _, own in sides]
                key = np.concatenate([mix(h ^ mix(own.astype(np.uint64) + np.uint64(0x7A3D))) for h, _, own in sides])
                two, own = (np.concatenate(x) for x in list(zip(*sides, strict=True))[1:])
                order = np.argsort(key)
                key, other = key[order], two[order]
                same = (key[1:] == key[:-1]) & (other[1:] == other[:-1])
                common = np.bincount(own[order[1:][same]], minlength=n)
                keep[at : at + n] = (100 * common >= 75 * (size[0] + size[1] - common)) & (common > 0)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch["u"].filter(mask), batch["v"].filter(mask)], names=["u", "v"])

    return pairs.join(a, "u").join(b, "v").select("u", "v", "text_u", "text_v").mapInArrow(run, "u bigint, v bigint")


def _side_by_side(a: pa.Array, b: pa.Array, rows: int = 256) -> Iterator[tuple]:
    for at in range(0, len(a), rows):
        n = min(rows, len(a) - at)
        one = [(at, *x[1:]) for x in blocks(a.slice(at, n), 1 << 62)]
        two = [(at, *x[1:]) for x in blocks(b.slice(at, n), 1 << 62)]
        yield from zip(one, two, strict=True)


def _mixed_blocks(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, once for each pair (i, j) of blocks that needs them."""
    labelled = members.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("label")
    )
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("m"), F.sum("n").alias("size"))
    parts = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") * 8 / BLOCK_BYTES))
    mixed = mixed.where("a < b").select("key", parts.cast("int").alias("nb"))
    wide = labelled.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return wide.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "n", "label",
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    names, at_a = np.unique(np.concatenate(a), return_inverse=True)
    all_b = np.concatenate(b)
    if not len(names):
        return out
    at_b = np.minimum(np.searchsorted(names, all_b), len(names) - 1)
    shared = names[at_b] == all_b
    used = np.zeros(len(names), bool)
    used[at_b[shared]] = True
    column = np.cumsum(used) - 1
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    row_a, col_a = row_a[used[at_a]], column[at_a[used[at_a]]]
    row_b, col_b = row_b[shared], column[at_b[shared]]
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    row_a, col_a, row_b, col_b = row_a[order_a], col_a[order_a], row_b[order_b], col_b[order_b]
    for lo in range(0, int(used.sum()), COLUMNS):
        one, two = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        for m, row, col in ((one, row_a, col_a), (two, row_b, col_b)):
            part = slice(*np.searchsorted(col, [lo, lo + COLUMNS]))
            m[row[part], col[part] - lo] = 1
        out += one @ two.T
    return out


def _links_of_block(rep: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join as many of a block's components as its pairs of rows do: each between a left and a right row."""
    names, label, sizes = np.unique(label, return_inverse=True, return_counts=True)
    main = label == sizes.argmax()
    left, right = (side == 0) | (side == 2), (side == 1) | (side == 2)
    found = []
    for a, b in ((left & ~main, right), (left & main, right & ~main)):
        a, b = np.flatnonzero(a), np.flatnonzero(b)
        for lo in range(0, len(a) if len(b) else 0, 256):
            x = a[lo : lo + 256]
            fit = (label[x][:, None] != label[b]) & (4 * np.minimum(n[x][:, None], n[b]) >= 3 * np.maximum(n[x][:, None], n[b]))
            x, y = x[fit.any(axis=1)], b[fit.any(axis=0)]
            if not len(x):
                continue
            both = common([sets[k] for k in x], [sets[k] for k in y]).astype(np.int64)
            i, j = np.nonzero((100 * both >= 75 * (n[x][:, None] + n[y] - both)) & (label[x][:, None] != label[y]))
            found.append(np.stack([x[i], y[j]]))
    if not found:
        return []
    x, y = np.concatenate(found, axis=1)
    pairs, first = np.unique(np.stack([np.minimum(label[x], label[y]), np.maximum(label[x], label[y])]), axis=1, return_index=True)
    root, out = list(range(len(names))), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for (p, q), at in zip(pairs.T.tolist(), first.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(rep[x[at]]), int(rep[y[at]])))
    return out


def _cross_links(rows: DataFrame) -> DataFrame:
    """(u, v): links between the components of each block pair, from rows (key, i, j, rep, n, label, side, shingles)."""
    names = ["rep", "n", "label", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        sets: list[np.ndarray] = []
        block = None

        def links() -> pa.RecordBatch:
            out = _links_of_block(*(np.concatenate(x) for x in zip(*held, strict=True)), sets) if held else []
            u, v = np.array(out, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            of = np.stack([batch[c].to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1
            values, off = flat(batch["shingles"], "<u8")
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if block is not None and tuple(of[:, lo]) != block:
                    yield links()
                    held, sets = [], []
                block = tuple(of[:, lo])
                held.append([batch[c].to_numpy()[lo:hi] for c in names])
                sets += [values[a:b] for a, b in zip(off[lo:hi].tolist(), off[lo + 1 : hi + 1].tolist(), strict=True)]
        if held:
            yield links()

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _of_repeated_ids(docs) if _repeats(docs) else _of_different_ids(docs)


def _of_different_ids(docs: DataFrame) -> DataFrame:
    found = materialise(sketch(docs), "sketch")
    known = found.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "set_a", "set_b"]
    reps = materialise(
        known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes",
    )
    rows = reps.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = materialise(rows.join(shared, "key"), "members")
    # the member that meets most others, counted over all its buckets, is the likeliest to be near them all
    degree = members.groupBy("rep").agg(F.sum("m").alias("degree"))
    hubs = members.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", F.xxhash64("rep"), "rep", "n")).alias("hub"))
    star = members.join(hubs.select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "key")
    near = (F.col("rep") != F.col("hub")) & (4 * F.least("n", "hub_n") >= 3 * F.greatest("n", "hub_n"))
    tested = materialise(star.where(near).select(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v")).distinct(), "pairs")
    texts = docs.select("doc_id", "text").join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    final = connected_components(materialise(verify(tested, texts), "links"))
    mixed = materialise(_mixed_blocks(members, final), "mixed")
    with arrow_rows(docs.sparkSession, 256):  # a row holds a whole set
        sets = materialise(shingle_sets(texts.join(mixed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")), "sets")
        links = materialise(_cross_links(mixed.join(sets, "rep")), "crossing")
    links = materialise(verify(links, texts), "links")
    if links.take(1):
        final = connected_components(links.unionByName(final.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    of_class = reps.select(*same, "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select(*same, F.coalesce("component", "rep").alias("component"))
    answer = found.where("doc_id is not null").join(of_class, same, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    nameless = found.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return answer.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with ``row``, a number of each row."""
    return materialise(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def _of_repeated_ids(docs: DataFrame) -> DataFrame:
    """Every row is a document of its own, and those of one ``doc_id`` are linked."""
    rows = numbered(docs)
    known = rows.where("doc_id is not null").select("row", "doc_id")
    found = materialise(_of_different_ids(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part")), "parts")
    of_id = found.where("n_shingles > 0").join(known, "row")
    first = of_id.groupBy("doc_id").agg(F.min("part").alias("v"))
    joined = connected_components(of_id.join(first, "doc_id").select(F.col("part").alias("u"), "v"))
    of_id = of_id.join(joined.withColumnRenamed("node", "part"), "part", "left").select("doc_id", F.coalesce("component", "part").alias("component"))
    least = materialise(of_id.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    of_id = materialise(of_id.join(least, "component").select("doc_id", F.col("least").alias("component_id")).distinct(), "components")
    answer = found.select("row", "n_shingles").join(rows.select("row", "doc_id"), "row").drop("row").join(of_id, "doc_id", "left")
    answer = answer.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return answer.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest ``doc_id`` stays, null last.

    Every row counts as a document, rows that repeat an id or have none too: of those with equal ids one stays.  Rows without words all stay.
    """
    if not _repeats(docs) and not docs.where("doc_id is null").limit(1).count():
        gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = numbered(docs)
    found = _of_different_ids(rows.select(F.col("row").alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    of = materialise(found.join(rows.select("row", "doc_id"), "row"), "components")
    stay = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    gone = of.join(stay, "row", "left_anti").select("row")
    return rows.join(gone, "row", "left_anti").select(*docs.columns)


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id occurs in more than one row."""
    return bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))
