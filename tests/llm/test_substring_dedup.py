import hashlib
import random

import numpy as np
import pytest

from alarmlens.llm.substring_dedup import BLOCK, LENGTH, contexts, deduplicated
from alarmlens.llm.suffix_order import suffix_array


def plain(rows, length=LENGTH):
    """rows in order of their ids, nulls last."""
    seen, out = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        covered = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                covered[p : p + length] = [True] * length
            seen.add(window)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(c and not (p and covered[p - 1]) for p, c in enumerate(covered))
        out[i] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(600):
        text = [rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randrange(40))]
        assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    long = np.array([1] * 3000 + [2] + [1] * 3000, np.int64)
    assert sorted(suffix_array(long).tolist()) == list(range(len(long)))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    shared = bytes(rng.randrange(256) for _ in range(LENGTH))
    seen = set()
    for n in (0, 7, 300):
        raw = np.frombuffer(bytes(rng.randrange(256) for _ in range(n)) + shared + b"tail" * n, np.uint8)
        g, first, last, anchor = contexts(raw)
        (k,) = np.flatnonzero((first <= n) & (n <= last))
        seen.add((int(g[k]), int(anchor[k]) - n))
    assert len(seen) == 1


@pytest.mark.parametrize("limit", [256, 2])
def test_removed_bytes_equal_the_plain_version(docs_of, limit):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(3)]
    rows = []
    for i in range(50):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(60)
            parts += [p[cut : cut + rng.choice([99, 100, 140, 400])], text(rng.randrange(4))]
        rows.append((i, " ".join(parts) if rng.random() < 0.9 else rows[rng.randrange(len(rows))][1] if rows else ""))
    rows += [(50, "ab" * 400), (51, "x" * 300), (52, None), (53, ""), (54, "q" * 99), (55, "q" * 99), (56, rows[3][1] + "!")]
    got = {r["doc_id"]: tuple(r)[1:5] for r in deduplicated(docs_of(rows), group_limit=limit).collect()}
    assert got == plain(rows)


def test_null_and_repeated_ids_and_no_rows(docs_of):
    text = "".join(map(chr, range(200, 330)))
    rows = [(5, text), (5, text), (None, text), (3, "short"), (None, None)]
    got = sorted(str(tuple(r)[:4]) for r in deduplicated(docs_of(rows)).collect())
    n = len(text.encode())
    assert got == sorted(map(str, [(5, n, 0, 0), (5, n, 0, 0), (None, n, n, 1), (3, 5, 0, 0), (None, 0, 0, 0)]))
    assert deduplicated(docs_of([])).count() == 0


def test_text_beyond_one_block(spark, docs_of):
    """A text is hashed in stretches of BLOCK bytes; passages that lie across the seam, and on either side of it, repeat."""
    rng = random.Random(12)
    base = "".join(rng.choices("abcdefghij", k=BLOCK + 150_000))
    passage = base[BLOCK - 160 : BLOCK + 190]
    rows = [(1, base), (2, "short " + passage + " end"), (3, base[BLOCK + 1000 : BLOCK + 1130] + "x" * 40 + base[50:260])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in deduplicated(docs_of(rows)).collect()}
    assert got == {1: (0, 0), 2: (350, 1), 3: (130 + 210, 2)}
