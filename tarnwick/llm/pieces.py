"""SentencePiece encoding with seeded merge-dropout, and decoding.

A public byte-pair model is applied by an agenda: of all neighbouring symbols whose union is a
piece, the best-ranked and then leftmost is merged first.  Each candidate taken from the agenda is skipped
for good when a hash keyed by seed, document, occurrence, place and piece falls below ``dropout``.  Without dropout the
ids are those of the model's own library.  The hash decides, so a run repeats on any partitioning.

Texts are cut where no piece of the vocabulary can lie across (before a run of spaces, around line ends).  Tasks
remember, for a bounded number of chunks, the merges that lead to their ids.  An occurrence whose own key skips none of them
takes these ids.  Where it skips one, what follows is that of the same chunk without this merge: that is remembered too
where several occurrences need it, so that an occurrence walks from one to the next until its key skips nothing more; any other occurrence is merged by itself.
Chunks are told apart by their bytes; hashes only find them.

Decoding is lossless for every text: characters that the vocabulary lacks become bytes, and so does
the model's own space mark where a text holds it.

Cases: a null or empty text has no ids and decodes to an empty text.  Repeated rows are encoded alike.  A
null ``doc_id`` is a value like any other.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import HashTable
from .textbuf import Numbered, agree, blocks, distinct, mix, ragged, span_hashes

SPACE = "▁"
CHUNKS = regex.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
MODEL = "piece_bpe_32k.model"
DROPOUT, SEED, MEMORY = 0.1, 20, 400_000
LONG, DEPTH = 64, 5
_MASK = (1 << 64) - 1
_MARK = SPACE.encode().decode("ascii", "surrogateescape")  # a space mark of the text's own, as characters that become bytes


def model_path(name: str = MODEL) -> str:
    """The place of a public model file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _code(piece: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What stands for the merge to ``piece`` at ``place``."""
    return (piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Model:
    """Pieces of a byte-pair model and what is needed to merge and to spell them."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        n = model.get_piece_size()
        self.bytes_of = [b""] * n
        self.id_of: dict[str, int] = {}
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte_id = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id_of[piece] = i
                self.rank[piece] = (-model.get_score(i), i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        order = np.array(sorted(range(n), key=lambda i: -model.get_score(i)))
        self.order = np.empty(n, np.int64)
        self.order[order] = np.arange(n)
        merges = {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                if (a := self.id_of.get(piece[:k])) is not None and (b := self.id_of.get(piece[k:])) is not None:
                    merges[a << 16 | b] = i
        self.char_id = np.full(0x110000, -2, np.int64)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
        self.pairs = HashTable(np.array(list(merges), np.uint32))
        self.joined = np.array([*merges.values(), 0], np.int64)
        across = [p for p in self.id_of if "\n" in p or regex.search(f"[^{SPACE}]{SPACE}", p)]
        if across:
            raise ValueError(f"pieces lie across chunks: {across[:3]}")

    def encode_chunk(self, chunk: str, dropout: float, key: int, taken: list[int] | None = None) -> list[int]:
        """Ids of one chunk; ``key`` and ``dropout`` decide which merges are skipped.  Codes of the others go to ``taken``."""
        rank, n = self.rank, len(chunk)
        symbol: list[str | None] = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if (r := rank.get(chunk[i : i + 2])) is not None:
                agenda.append((r[0], i, 2, r[1]))
        heapq.heapify(agenda)
        limit = int(dropout * (1 << 32))
        while agenda:
            _, i, size, piece = heapq.heappop(agenda)
            left = symbol[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbol[j]) != size:
                continue
            if limit and ((key ^ (piece * 0x9E3779B97F4A7C15) ^ (i * 0xC2B2AE3D27D4EB4F)) * 0xD6E8FEB86659FD93 & _MASK) >> 32 < limit:
                continue
            if taken is not None:
                taken.append(((piece * 0x9E3779B97F4A7C15) ^ (i * 0xC2B2AE3D27D4EB4F)) & _MASK)
            joined = symbol[i] = left + symbol[j]
            symbol[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(joined + symbol[k])) is not None:
                    heapq.heappush(agenda, (r[0], i, size + len(symbol[k]), r[1]))
            if (h := before[i]) >= 0 and (r := rank.get(symbol[h] + joined)) is not None:
                heapq.heappush(agenda, (r[0], h, len(symbol[h]) + size, r[1]))
        out: list[int] = []
        for s in symbol:
            if s is not None:
                i = self.id_of.get(s)
                if i is None:
                    out += [self.byte_id[b] for b in s.encode("utf-8", "surrogateescape")]
                else:
                    out.append(i)
        return out

    def encode_chunks(self, chunks: list[str], dropout: float, keys: list[int], taken: list[tuple[np.ndarray, np.ndarray]] | None = None, bans: np.ndarray | None = None) -> list[bytes]:
        """What :meth:`encode_chunk` gives, for many chunks in lockstep: each merges its best pair in every round.

        Places of chunks and codes of their merges go to ``taken``.  ``bans``: a row of codes of merges that each chunk must not make;
        it needs chunks that are not :meth:`slow`.
        """
        out: list[bytes] = [b""] * len(chunks)
        if not chunks:
            return out
        many = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.cumsum(many) - many
        ids = self.char_id[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        slow = np.logical_or.reduceat(ids < 0, first) | (many > LONG)  # characters that become bytes, and long chunks
        for i in np.flatnonzero(slow):
            codes: list[int] = []
            out[i] = np.array(self.encode_chunk(chunks[i], dropout, int(keys[i]), codes), "<u4").tobytes()
            if taken is not None:
                taken.append((np.full(len(codes), i), np.array(codes, np.uint64)))
        width, all_keys = -(-many // 8), np.array(keys, np.uint64)
        for w in range(1, 9):
            at = np.flatnonzero((width == w) & ~slow)
            if not len(at):
                continue
            col = np.arange(8 * w)
            inside = col < many[at][:, None]
            s = np.where(inside, ids[np.minimum(first[at][:, None] + col, len(ids) - 1)], -1)
            merges: list[tuple[np.ndarray, np.ndarray]] | None = None if taken is None else []
            for i, done in zip(at.tolist(), self._lockstep(s, all_keys[at], int(dropout * (1 << 32)), merges, None if bans is None else bans[at]), strict=True):
                out[i] = done
            if taken is not None:
                taken += [(at[rows], codes) for rows, codes in merges]
        return out

    def slow(self, chunks: list[str]) -> np.ndarray:
        """Whether each chunk is merged by itself: it is long, or has characters that become bytes."""
        many = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ids = self.char_id[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        return np.logical_or.reduceat(ids < 0, np.cumsum(many) - many) | (many > LONG)

    def _lockstep(self, s: np.ndarray, keys: np.ndarray, limit: int, taken: list[tuple[np.ndarray, np.ndarray]] | None = None, bans: np.ndarray | None = None) -> list[bytes]:
        """Merge the rows of ``s`` (ids, filled up with -1): in each round the best pair of every row that has one left.

        Symbols stay in their places; ``after`` and ``before`` lead to the next and the last one that is alive.
        """
        n, width = s.shape
        s, final = s.ravel().copy(), np.full((n, width), -1, np.int64)
        row, never = np.arange(n), np.int64(1 << 60)
        place = np.tile(np.arange(width), n)
        after, before = place + 1, place - 1
        last = np.flatnonzero((s >= 0) & np.append(s[1:] < 0, True)) if width > 1 else np.flatnonzero(s >= 0)
        after[last] = width
        after[width - 1 :: width] = width
        order, piece_at = np.full(n * width, never), np.zeros(n * width, np.int64)

        def look(of: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """Note the pairs that begin at ``at`` in rows ``of`` if they may be merged."""
            found = self.pairs.find((left << 16 | right).astype(np.uint32))
            hit = found < self.pairs.n
            of, at, piece = of[hit], at[hit], self.joined[found[hit]]
            if limit or bans is not None:
                code = _code(piece, place[at])
                keep = np.ones(len(at), bool)
                if limit:
                    keep = ((keys[of] ^ code) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32) >= np.uint64(limit)
                if bans is not None:
                    keep &= (code[:, None] != bans[of]).all(axis=1)
                at, piece = at[keep], piece[keep]
            order[at], piece_at[at] = self.order[piece], piece

        pair = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0) & (place[:-1] < width - 1))
        look(pair // width, pair, s[pair], s[pair + 1])
        while len(row):
            at = order.reshape(-1, width).argmin(axis=1) + np.arange(len(row)) * width
            on = order[at] < never
            if on.mean() < 0.7:  # rows that are done leave
                final[row[~on]] = s.reshape(-1, width)[~on]
                s, order, piece_at, after, before, place = (x.reshape(-1, width)[on].ravel() for x in (s, order, piece_at, after, before, place))
                row, keys, bans = row[on], keys[on], None if bans is None else bans[on]
                if not len(row):
                    break
                at = order.reshape(-1, width).argmin(axis=1) + np.arange(len(row)) * width
                of = np.arange(len(row))
            else:
                of = np.flatnonzero(on)
                at = at[of]
            base, merged = of * width, piece_at[at]
            if taken is not None:
                taken.append((row[of], _code(merged, place[at])))
            gone = base + after[at]
            beyond = after[gone]
            s[at], s[gone], order[at], order[gone], after[at] = merged, -1, never, never, beyond
            has = np.flatnonzero(beyond < width)
            right = base[has] + beyond[has]
            before[right] = place[at[has]]
            look(of[has], at[has], merged[has], s[right])
            has = np.flatnonzero(before[at] >= 0)
            left = base[has] + before[at[has]]
            order[left] = never
            look(of[has], left, s[left], merged[has])
        many = (final >= 0).sum(axis=1)
        flat, ends = final[final >= 0].astype("<u4").tobytes(), np.concatenate([[0], 4 * np.cumsum(many)])
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        """The text's bytes, without the space that encoding puts before it."""
        spell = self.bytes_of
        return b"".join([spell[i] for i in ids])[1:]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, with a bounded memory of chunks.

    A node stands for a chunk and a few merges that it must not make; it holds the ids that the others lead to, the codes of these
    merges, and for each of them the node without it, if there is one yet.
    """

    def __init__(self, model: Model, dropout: float, seed: int, memory: int = MEMORY):
        self.model, self.dropout, self.seed, self.memory = model, dropout, seed, memory
        self._forget()

    def _forget(self) -> None:
        self.known, self.bans = Numbered(), []
        self.odd: dict[bytes, int] = {}  # nodes of chunks whose hash is another's
        self.raw, self.text_first, self.text_many = _Row(np.uint8), _Row(np.int64), _Row(np.int32)
        self.codes, self.child = _Row(np.uint64), _Row(np.int32)
        self.first, self.many, self.slow = _Row(np.int64), _Row(np.int64), _Row(bool)
        self.ids, self.id_first, self.id_many = _Row("<u4"), _Row(np.int64), _Row(np.int64)

    def text(self, text: bytes, key: int) -> bytes:
        """Ids of one text; ``key`` stands for its document."""
        return self.texts([text], [key])[0]

    def texts(self, texts: list[bytes], keys: list[int]) -> list[bytes]:
        """Ids of many texts."""
        if len(self.bans) > self.memory:
            self._forget()
        whole = [b" " + t if t else t for t in texts]
        off = np.concatenate([[0], np.cumsum([len(t) for t in whole])])
        raw = np.frombuffer(b"".join(whole), np.uint8)
        start = chunk_starts(raw, off)
        if not len(start):
            return [b""] * len(texts)
        end = np.append(start[1:], len(raw))
        first = np.searchsorted(start, off)
        one, number, _ = distinct(raw, start, end)
        nodes = self._nodes(raw, start[one], end[one])[number]
        many = np.diff(first)
        place = np.arange(len(start)) - np.repeat(first[:-1], many)
        own = mix(np.repeat(np.array(keys, np.uint64), many) + mix(place.astype(np.uint64) + np.uint64(self.seed + 1)))
        used = self.ids.n
        alone: list[np.ndarray] = []
        if self.dropout:
            for a in range(0, len(nodes), 1 << 16):
                nodes[a : a + (1 << 16)], lonely = self._walk(nodes[a : a + (1 << 16)], own[a : a + (1 << 16)])
                alone.append(a + lonely)
                used = self.ids.n
        at, n = self.id_first.x[nodes], self.id_many.x[nodes]
        if alone and len(places := np.concatenate(alone)):  # merged by themselves: their ids stand behind the remembered ones until the next call
            spelled: list[bytes] = []
            for a in range(0, len(places), 8192):
                part = places[a : a + 8192]
                spelled += self.model.encode_chunks(self._strings(nodes[part]), self.dropout, own[part])
            size = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
            at[places], n[places] = used + np.cumsum(size) - size, size
            self.ids.add(np.frombuffer(b"".join(spelled), "<u4"))
        ids = self.ids.x[ragged(at, n)]
        self.ids.n = used
        ends = (4 * np.concatenate([[0], np.cumsum(n)])[first]).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _nodes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The nodes of different chunks without bans, new ones where there are none."""
        h = span_hashes(raw, start, end)
        nodes = self.known.find(h)
        have = np.flatnonzero(nodes >= 0)
        first, many = self.text_first.x[nodes[have]], self.text_many.x[nodes[have]].astype(np.int64)
        ends = np.cumsum(many)
        other = have[~agree(raw, start[have], end[have], self.raw.x[ragged(first, many)], ends - many, ends)]
        _, least = np.unique(h, return_index=True)
        twice = np.setdiff1d(np.flatnonzero(nodes < 0), least)  # two new chunks of one hash
        rest = [raw[start[i] : end[i]].tobytes() for i in np.concatenate([other, twice]).tolist()]
        nodes[np.concatenate([other, twice])] = [self.odd.get(x, -1) for x in rest]
        new = np.flatnonzero(nodes < 0)
        nodes[new] = np.arange(len(self.bans), len(self.bans) + len(new))
        self.odd |= dict(zip(rest, nodes[np.concatenate([other, twice])].tolist(), strict=True))
        plain = np.setdiff1d(new, np.concatenate([other, twice]), assume_unique=True)
        self.known.add(h[plain], nodes[plain].astype(np.int32))
        self._learn(raw, start[new], end[new])
        return nodes

    def _walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For occurrences at ``nodes`` the node at which their key skips nothing more, and those that must be merged by themselves."""
        limit, times = np.uint64(int(self.dropout * (1 << 32))), np.uint64(0xD6E8FEB86659FD93)
        nodes, alone, left = nodes.copy(), [], np.arange(len(nodes))
        for depth in range(DEPTH):
            many = self.many.x[nodes[left]]
            of, at = np.repeat(np.arange(len(left)), many), ragged(self.first.x[nodes[left]], many)
            hit = np.flatnonzero(((keys[left][of] ^ self.codes.x[at]) * times >> np.uint64(32)) < limit)
            hit = hit[np.concatenate([[True], of[hit][1:] != of[hit][:-1]])] if len(hit) else hit  # the first merge that is skipped
            left, at = left[of[hit]], at[hit]
            if not len(left) or depth == DEPTH - 1:
                break
            missing = (self.child.x[at] < 0) & ~self.slow.x[nodes[left]]
            wanted, times_wanted = np.unique(np.stack([at[missing], nodes[left][missing]]), axis=1, return_counts=True)
            self._grow(*wanted[:, times_wanted > 1])
            to = self.child.x[at]
            alone.append(left[to < 0])
            left, to = left[to >= 0], to[to >= 0]
            nodes[left] = to
        return nodes, np.concatenate([*alone, left])

    def _grow(self, at: np.ndarray, parents: np.ndarray) -> None:
        """New nodes: those of ``parents`` without the merges that stand at ``at``."""
        if len(at):
            base = len(self.bans)
            bans = [(*self.bans[p], c) for p, c in zip(parents.tolist(), self.codes.x[at].tolist(), strict=True)]
            self._add(self.text_first.x[parents], self.text_many.x[parents], bans)
            self.child.x[at] = np.arange(base, base + len(at))

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        for at in range(0, len(start), 8192):
            first, many = start[at : at + 8192], (end - start)[at : at + 8192]
            base = self.raw.n
            self.raw.add(raw[ragged(first, many)])
            self._add(base + np.cumsum(many) - many, many, [()] * len(many))

    def _strings(self, nodes: np.ndarray) -> list[str]:
        return self._texts(self.text_first.x[nodes], self.text_many.x[nodes])

    def _texts(self, first: np.ndarray, many: np.ndarray) -> list[str]:
        data = self.raw.x[ragged(first, many)].tobytes()
        ends = np.cumsum(many).tolist()
        return [data[a:b].decode("utf-8", "surrogateescape").replace(SPACE, _MARK).replace(" ", SPACE) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _add(self, text_first: np.ndarray, text_many: np.ndarray, bans: list[tuple[int, ...]]) -> None:
        chunks = self._texts(text_first, text_many)
        width = max(map(len, bans))
        table = np.array([(*b, *[0] * (width - len(b))) for b in bans], np.uint64).reshape(len(bans), width) if width else None
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        spelled = self.model.encode_chunks(chunks, 0.0, [0] * len(chunks), taken, table)
        of = np.concatenate([np.empty(0, np.int64), *(x for x, _ in taken)])
        codes = np.concatenate([np.empty(0, np.uint64), *(x for _, x in taken)])[np.argsort(of, kind="stable")]
        many, size = np.bincount(of, minlength=len(chunks)), np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
        self.first.add(self.codes.n + np.cumsum(many) - many)
        self.id_first.add(self.ids.n + np.cumsum(size) - size)
        self.many.add(many)
        self.id_many.add(size)
        self.codes.add(codes)
        self.child.add(np.full(len(codes), -1))
        self.ids.add(np.frombuffer(b"".join(spelled), "<u4"))
        self.slow.add(self.model.slow(chunks))
        self.text_first.add(text_first)
        self.text_many.add(text_many)
        self.bans += bans


class _Row:
    """An array that grows at its end: the first ``n`` items of ``x``."""

    def __init__(self, kind):
        self.x, self.n = np.empty(1 << 14, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.x):
            self.x = np.concatenate([self.x[: self.n], np.empty(2 * end - self.n, self.x.dtype)])
        self.x[self.n : end] = values
        self.n = end


def chunk_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts: what ``CHUNKS`` finds, but a mark of the text's own is a chunk of its own."""
    space, line = raw == 32, raw == 10
    head = np.ones(len(raw), bool)  # no chunk goes on across what stands before
    head[1:] = line[:-1]
    head[off[:-1][np.diff(off) > 0]] = True
    mark = np.flatnonzero(raw == 0xE2)
    mark = mark[mark + 2 < len(raw)]
    mark = mark[(raw[mark + 1] == 0x96) & (raw[mark + 2] == 0x81)]
    head[np.minimum(mark + 3, len(raw) - 1)] |= mark + 3 < len(raw)
    start = line | head
    start[1:] |= space[1:] & ~space[:-1]
    start[mark] = True
    return np.flatnonzero(start)


@lru_cache(2)
def shared_encoder(model: str | None, dropout: float, seed: int) -> Encoder:
    """The encoder of this worker process: what it knows outlasts a task."""
    return Encoder(Model(model), dropout, seed)


def _slices(column: pa.Array, at_once: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``at_once`` bytes."""
    for at, _, off in blocks(column, at_once):
        yield at, at + len(off) - 1


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``: little-endian unsigned 32-bit ids of the whole ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(model, dropout, seed)
        for batch in batches:
            for at, to in _slices(batch["__text"]):
                part = batch.slice(at, to - at)
                texts = pc.fill_null(part["__text"], b"").to_pylist()
                ids = encoder.texts(texts, [xxhash.xxh64_intdigest(str(d).encode(), seed) for d in part["doc_id"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(ids, pa.binary())], names=[*keep, "ids"])

    columns = list(dict.fromkeys([*keep, "doc_id"]))
    schema = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep) + "ids binary"
    return docs.select(*columns, F.col("text").cast("binary").alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` plus ``decoded``, the bytes of the text that ``ids`` spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Model(model)
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                texts = [spell.decode(np.frombuffer(x, "<u4").tolist()) for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(run, schema)
