"""Memory and values of the steps of the language-model scores."""

import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from tarnwick.llm import attention, lm_scores, textbuf


def test_a_block_holds_its_words_once():
    r = np.random.default_rng(0)
    words = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(1000)]
    texts = [" ".join(r.choice(words, 500)) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(3000), pa.int64()), "held_out": pa.array([False] * 3000), "learn": pa.array([k % 7 > 0 for k in range(3000)]), "text": pa.array([t.encode() for t in texts]),
    })
    block = lm_scores._Block()
    tracemalloc.start()
    for at, raw, off in textbuf.blocks(batch["text"], 1 << 19):
        block.add(batch.slice(at, len(off) - 1), raw, off)
    kinds, used = [], 0
    for out in block.close(0):  # one batch at a time, as they leave the task
        used = max(used, tracemalloc.get_traced_memory()[1])
        kinds += [(r["number"], r["word"], r["n"]) for r in out.to_pylist() if r["kind"] == lm_scores.WORD] if out.num_rows else []
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert used < 3 * block.size
    want = {}
    for k, t in enumerate(texts):
        for w in t.split():
            want[w.encode()] = want.get(w.encode(), 0) + (k % 7 > 0)
    assert {w: n for _, w, n in kinds} == want and [k for k, _, _ in kinds] == list(range(len(want)))


STEPS = """
import resource
import numpy as np
from tarnwick.llm import attention, lm_scores
getattr(attention, "keep_memory", lambda: None)()
r = np.random.default_rng(0)
voc = attention.Vocabulary.of(r.integers(0, 50, lm_scores.IDS))
adam = attention.Adam(attention.fresh(voc), 0.02)
ids = r.integers(0, 2000, (2, lm_scores.BATCH, attention.WINDOW))
for k in range(30):
    if k == 10:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    adam.learn(voc.row[ids[0]], voc.klass[ids[1]])
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) // 20)
"""


def test_a_step_maps_no_memory_anew():
    faults = subprocess.run([sys.executable, "-c", STEPS], capture_output=True, text=True, check=True, timeout=120, env=os.environ | {"OMP_NUM_THREADS": "1"}).stdout
    assert int(faults) < 50  # 529 a step before


def test_tiles_hold_every_real_place_once():
    r = np.random.default_rng(1)
    for n in (1, 7, 300):
        klass, real = r.integers(0, attention.CLASSES, n).astype(np.int32), r.random(n) < 0.7
        for use in (None, real, np.zeros(n, bool)):
            tiles = attention._Tiles(klass, use)
            places = np.arange(n) if use is None else np.flatnonzero(use)
            group = np.repeat(tiles.group, attention.TILE)
            assert sorted(tiles.real.tolist()) == places.tolist() and (tiles.places[tiles.at] == tiles.real).all()
            assert sorted([*tiles.at.tolist(), *tiles.filled.tolist()]) == list(range(len(group))) and (tiles.places[tiles.filled] == n).all()
            assert (group[tiles.at] == klass[tiles.real] // attention.EACH).all()
            each, k = attention.GROUPS + attention.EACH, len(tiles.at)
            assert (tiles.right[:k] == tiles.at * each + group[tiles.at]).all()
            assert (tiles.right[k:] == tiles.at * each + attention.GROUPS + klass[tiles.real] % attention.EACH).all()
