"""Language-model scores: corpus word counts for a unigram base, and a causal self-attention model.

1.  Texts are cut into blocks of about ``BLOCK_BYTES``.  A block numbers its words by descending count, and writes each
    text as numbers and each different word once, with its count in the block's training texts.
2.  Words are summed over blocks, and each different word of the corpus is spelled as subword ids once.
3.  Counts and ids come back to the blocks, one row for each word of a block, which gives each text its base score and its ids.
4.  Every training text is cut into windows, of which the last may be short, so that each of its ids, the end id
    included, is a target once in a pass.  Workers learn from their own windows, dealt to ``ROUNDS`` rounds by hash, from common weights
    that are averaged after each round.  A worker goes over the windows of a round once if it has ``LEAST_BATCHES`` batches of them; with fewer it begins anew until it has
    learned from as many, ``PASSES`` times at most, so that a corpus of a few hundred thousand ids is not left half learned.
    Sums of whole numbers make the average independent of the order of workers, and are added in a tree.
5.  Scoring is one pass over the ids.

Cases: a null text counts as empty, and has the end token alone.  A null ``doc_id`` is not held out and
is never learned from.  Repeated rows are scored each and all count in the statistics.  An empty table gives
an empty result; without training texts all counts are 0 and the model keeps its starting weights.  A text longer than a
block is a block of its own.  Words are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import SIZE, WINDOW, Adam, Vocabulary, fresh, keep_memory, score_stream, views
from .storage import materialise
from .subwords import Encoder
from .textbuf import LOWER, SPACE, binary, blocks, flat, mix, ragged, words

START_ID, END_ID, IDS = 49406, 49407, 49408
ROUNDS, BATCH, RATE = 4, 64, 0.02
#: Ids for each worker before there is another; batches that a worker learns from in a round, in a few passes if it has fewer.
WORKER_IDS, LEAST_BATCHES, PASSES = 2_000_000, 200, 3
#: Sums of weights that one task adds.
FAN = 16
BLOCK_BYTES, SPELL_WORDS = 1 << 25, 1 << 18
FIXED = 256.0  # weights times ids are summed in whole 256ths
TEXT, WORD = range(2)
_ROWS = "kind int, block bigint, doc_id bigint, held_out boolean, learn boolean, number bigint, n bigint, numbers binary, word binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _rows(kind: int, many: int, /, **columns: pa.Array) -> pa.RecordBatch:
    columns["kind"] = pa.array(np.full(many, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(many, t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _kinds(raw: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words that stand in ``raw`` without a gap: the bytes and lengths of the different ones, and the number of each word among these."""
    found = binary(raw, np.concatenate([[0], np.cumsum(long)])).dictionary_encode()
    raw, off = flat(found.dictionary, "u1")
    return raw, np.diff(off), found.indices.to_numpy()


class _Block:
    """Texts as numbers of the words of their part of a block, until the block's own numbers are known.

    A part keeps each different word once, so a block holds neither its texts nor its words one by one.
    """

    def __init__(self):
        self.size = 0
        self.raw, self.long, self.times, self.learned = [], [], [], []  # of each part's different words: bytes, lengths, counts, counts in training texts
        self.parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

    def add(self, texts: pa.RecordBatch, raw: np.ndarray, off: np.ndarray) -> None:
        low = LOWER[raw]
        start, end, first = words(low, off)
        long = end - start
        kinds, long, number = _kinds(low[~SPACE[low]], long)
        many, learn = np.diff(first), texts["learn"].to_numpy(zero_copy_only=False)
        self.raw.append(kinds)
        self.long.append(long)
        self.times.append(np.bincount(number, minlength=len(long)))
        self.learned.append(np.bincount(number[np.repeat(learn, many)], minlength=len(long)))
        self.parts.append((texts.select(["doc_id", "held_out", "learn"]), number, many))
        self.size += len(low)

    def close(self, number: int) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        raw, long, of = _kinds(np.concatenate(self.raw), np.concatenate(self.long))
        self.raw.clear()
        times, learned = (np.bincount(of, np.concatenate(x), len(long)).astype(np.int64) for x in (self.times, self.learned))
        rank = np.argsort(-times, kind="stable")  # the commonest word gets the least number
        place = np.empty(len(rank), "<u4")
        place[rank] = np.arange(len(rank))
        place, counts = place[of], learned[rank]  # the first: by a word's number in its part
        start, long = (np.cumsum(long) - long)[rank], long[rank]
        done = 0
        for k, (texts, numbers, many) in enumerate(self.parts):
            numbers = place[done + numbers]
            done += len(self.long[k])
            first = np.concatenate([[0], np.cumsum(many)])
            for at in range(0, len(many), 1024):
                n = min(1024, len(many) - at)
                part = texts.slice(at, n)
                spelled = [numbers[a:b].view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip(first[at : at + n].tolist(), first[at + 1 : at + n + 1].tolist(), strict=True)]
                yield _rows(TEXT, n, block=pa.array(np.full(n, number)), n=pa.array(many[at : at + n]), numbers=pa.array(spelled, pa.binary()), **{c: part[c] for c in ("doc_id", "held_out", "learn")})
        for at in range(0, len(long), 1 << 16):
            size = long[at : at + (1 << 16)]
            word = binary(raw[ragged(start[at : at + (1 << 16)], size)], np.concatenate([[0], np.cumsum(size)]))
            n = len(size)
            yield _rows(WORD, n, block=pa.array(np.full(n, number)), number=pa.array(np.arange(at, at + n)), n=pa.array(counts[at : at + n]), word=word)


def _numbers(raw: bytes) -> np.ndarray:
    """The numbers of a text's words, which are written byte by byte: all lowest bytes first."""
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def read_corpus(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds: texts as numbers of their block's words, and these words with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 33, _Block()
        for batch in batches:
            for at, raw, off in blocks(batch["text"]):
                block.add(batch.slice(at, len(off) - 1), raw, off)
                if block.size >= block_bytes:
                    yield from block.close(number)
                    number, block = number + 1, _Block()
        yield from block.close(number)

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(crc == 2, F.lit(False)).alias("held_out"),
        F.coalesce(crc != 2, F.lit(False)).alias("learn"), F.col("text").cast("binary").alias("text"),
    )
    return source.mapInArrow(run, _ROWS)


def spelled_words(corpus: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(word, n, ids): each different word, its count in training texts, its subword ids as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, memory=200_000)
        for batch in batches:
            for at, ids, off in encoder.column(batch["word"]):
                part = batch.slice(at, len(off) - 1)
                yield pa.RecordBatch.from_arrays([part["word"], part["n"], binary(ids.astype("<u2"), off)], names=["word", "n", "ids"])

    summed = corpus.where(f"kind = {WORD}").groupBy("word").agg(F.sum("n").alias("n"))
    return summed.mapInArrow(run, "word binary, n bigint, ids binary")


def id_counts(spelled: DataFrame) -> np.ndarray:
    """[3, ids]: how often each id occurs in training texts, begins a word, ends one.  Three numbers an id reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, IDS), np.int64)
        for batch in batches:
            ids, off = flat(batch["ids"], "<u2")
            n, many = batch["n"].to_numpy(), np.diff(off)
            some = many > 0
            total[0] += np.bincount(ids, np.repeat(n, many), IDS).astype(np.int64)
            total[1] += np.bincount(ids[off[:-1][some]], n[some], IDS).astype(np.int64)
            total[2] += np.bincount(ids[off[1:][some] - 1], n[some], IDS).astype(np.int64)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(x[seen]) for x in total)], names=["id", "n", "first", "last"])

    parts = spelled.where("n > 0").select("n", "ids").mapInArrow(run, "id bigint, n bigint, first bigint, last bigint")
    got = parts.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n", "first", "last"))).toArrow()
    out = np.zeros((3, IDS), np.int64)
    out[:, got["id"].to_numpy()] = [got[c].to_numpy() for c in ("n", "first", "last")]
    return out


def base_scores(corpus: DataFrame, spelled: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, held_out, learn, n_tokens, n_known, train_tokens, base_score, ids) of each text, and how many are learned from."""
    texts = corpus.where(f"kind = {TEXT}").select("block", "doc_id", "held_out", "learn", "n", "numbers")
    seen, different = spelled.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    ends = texts.where("learn").count()
    tokens, kinds = seen + ends, different + (ends > 0)
    known = corpus.where(f"kind = {WORD}").select(F.col("block").alias("of_block"), "number", "word").join(spelled, "word").drop("word")
    end_score = float(np.log10((ends + 1) / (tokens + kinds + 1)))

    def score(t: pa.Table, c: pa.Table) -> pa.Table:
        spell, first = flat(c["ids"], "<u2")
        spell = np.append(spell, np.uint16(END_ID))  # the end stands behind all words
        at, n = np.full(c.num_rows + 1, len(spell) - 1), np.zeros(c.num_rows + 1, np.int64)
        many, log = np.ones(c.num_rows + 1, np.int64), np.full(c.num_rows + 1, end_score)
        number = c["number"].to_numpy()
        at[number], many[number], n[number] = first[:-1], np.diff(first), c["n"].to_numpy()
        n[-1] = ends
        log[number] = np.log10((n[number] + 1) / (tokens + kinds + 1))
        out, size = [], np.cumsum(t["n"].to_numpy() + 1)
        lo = 0
        while lo < t.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + SPELL_WORDS)))
            part = t.slice(lo, hi - lo)
            texts = [_numbers(x) for x in part["numbers"].to_pylist()]
            end = np.array([c.num_rows], "<u4")
            every = np.concatenate([x for y in texts for x in (y, end)])
            off = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
            ids = spell[ragged(at[every], many[every])]
            base, hit = np.add.reduceat(log[every], off[:-1]), np.add.reduceat((n[every] > 0).astype(np.int64), off[:-1])
            id_off = np.concatenate([[0], np.cumsum(many[every])])[off]
            out.append(pa.table({
                "doc_id": part["doc_id"], "held_out": part["held_out"], "learn": part["learn"], "n_tokens": pa.array(np.diff(off)), "n_known": pa.array(hit),
                "train_tokens": pa.array(np.full(len(texts), tokens, np.int64)), "base_score": pa.array(base), "ids": binary(ids, id_off),
            }))
            lo = hi
        return pa.concat_tables(out)

    schema = "doc_id bigint, held_out boolean, learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, ids binary"
    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(score, schema), ends


def windows(ids: np.ndarray, off: np.ndarray, doc_id: np.ndarray, turn: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets [n, WINDOW] and which targets are real, of the windows that a hash deals to round ``turn``, in the hash's order."""
    n = np.diff(off)
    many = -(-n // WINDOW)
    of = np.repeat(np.arange(len(n)), many)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    h = mix(doc_id.astype(np.int64).view(np.uint64)[of] + mix(start.astype(np.uint64) + np.uint64(1)))
    pick = np.flatnonzero((h >> np.uint64(32)) % np.uint64(rounds) == np.uint64(turn))
    pick = pick[np.argsort(h[pick], kind="stable")]
    of, start = of[pick], start[pick]
    real = np.arange(WINDOW) < (n[of] - start)[:, None]
    at = (off[of] + start)[:, None] + np.arange(WINDOW)
    inputs = ids[np.maximum(np.minimum(at, len(ids)) - 1, 0)]
    inputs[start == 0, 0] = START_ID
    return inputs, np.where(real, ids[np.minimum(at, len(ids) - 1)], np.uint16(END_ID)), real


def train(texts: DataFrame, vocabulary: Vocabulary, ids: int, worker_ids: int = WORKER_IDS, rounds: int = ROUNDS, passes: int = 1) -> np.ndarray:
    """Average, after each round, what each task learned from its own windows of ``texts`` (doc_id, ids), ``ids`` in all; ``passes``: over all windows."""
    weights, workers = fresh(vocabulary), max(1, ids // worker_ids)
    dealt = texts.select("doc_id", "ids").coalesce(workers)  # a worker takes whole parts of the corpus: no round shuffles it
    for done in range(rounds * passes):
        turn, rate = done % rounds, RATE * (1 - done / (rounds * passes))

        def run(batches: Iterator[pa.RecordBatch], start=weights, rate=rate, turn=turn) -> Iterator[pa.RecordBatch]:
            keep_memory()
            adam, seen = Adam(start.copy(), rate), 0
            held: list[np.ndarray] = []
            first: list[list[np.ndarray]] = []

            def learn(part: list[np.ndarray]) -> None:
                inputs, targets, real = part
                adam.learn(vocabulary.row[inputs], vocabulary.klass[targets], real)

            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    new = windows(*flat(part["ids"], "<u2"), part["doc_id"].to_numpy(), turn, rounds)
                    held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else list(new)
                    whole = len(held[0]) // BATCH * BATCH
                    for a in range(0, whole, BATCH):
                        learn([x[a : a + BATCH] for x in held])
                        if len(first) < LEAST_BATCHES:
                            first.append([x[a : a + BATCH].copy() for x in held])
                    seen += int(held[2][:whole].sum())
                    held = [x[whole:] for x in held]
            if held and len(held[0]):
                learn(held)
                seen += int(held[2].sum())
                first.append(held)
            for k in range(adam.t, min(LEAST_BATCHES, PASSES * len(first))):
                learn(first[k % len(first)])
            if seen:
                whole = np.rint(adam.flat.astype(float) * (seen * FIXED)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["seen", "weights"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, total = 0, np.zeros(SIZE, np.int64)
            for batch in batches:
                for n, x in zip(batch["seen"].to_pylist(), batch["weights"], strict=True):
                    seen += n
                    total += np.frombuffer(x.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["seen", "weights"])

        schema, left = "seen bigint, weights binary", workers
        sums = dealt.mapInArrow(run, schema)
        while left > FAN:  # sums of sums: no task adds more than about FAN of them, and FAN sums of fixed size reach the driver
            left = -(-left // FAN)
            sums = sums.repartition(left).mapInArrow(add, schema)
        got = sums.toArrow()
        seen = sum(got["seen"].to_pylist())
        if not seen:
            break
        total = sum(np.frombuffer(x, np.int64) for x in got["weights"].to_pylist())
        weights = (total / (seen * FIXED)).astype(np.float32)
    return weights


def model_scores(texts: DataFrame, weights: np.ndarray, vocabulary: Vocabulary) -> DataFrame:
    """``texts`` with ``score``, the log10 probability of ``ids``, in their place."""
    keep = [c for c in texts.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        w = views(weights)
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                ids, off = flat(part["ids"], "<u2")
                score = score_stream(w, vocabulary, ids, off, START_ID) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(score)], names=[*keep, "score"])

    schema = "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in keep) + "score double"
    return texts.mapInArrow(run, schema)


def vocabulary_of(spelled: DataFrame, ends: int) -> tuple[Vocabulary, int]:
    """The vocabulary that corpus counts fix, and the number of training ids."""
    counts = id_counts(spelled)
    counts[:, END_ID] = ends
    return Vocabulary.of(*counts), int(counts[0].sum())


def score(docs: DataFrame, tokenizer: str | None = None, passes: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    corpus = materialise(read_corpus(docs), "corpus")
    spelled = materialise(spelled_words(corpus, tokenizer), "words")
    found, ends = base_scores(corpus, spelled)
    texts = materialise(found, "texts")
    vocabulary, ids = vocabulary_of(spelled, ends)
    weights = train(texts.where("learn"), vocabulary, ids, passes=passes)
    return model_scores(texts.drop("learn"), weights, vocabulary)
