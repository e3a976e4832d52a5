import hashlib
import random

import pytest

from alarmlens.llm.bpe import Codec, encode_documents

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")
PARTS = [
    " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "a", "the", "é", "ß", "1", "²", "日本", "😀", "́",
    "'s", "'LL", "!!", "<|endoftext|>", "<|endo", "\x00", "zq", "aaaaaaa", "　",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_and_text_equal_the_library(library):
    rng = random.Random(4)
    coder = Codec(PATH)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(14))) for _ in range(1500)] + ["ab" * 4000, "=" * 999, "é" * 500]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_fragments_are_cut_where_no_token_reaches():
    coder = Codec(PATH)
    tokens = [t for t in coder.bytes_of.values() if len(t) > 1 and t != b"<|endoftext|>"]
    assert all(coder.fragments(t) == [t] for t in tokens[:5000])
    raw = bytes(range(256)) * 2
    assert b"".join(coder.fragments(raw)) == raw and len(coder.fragments(raw)) > 300
    pieces = coder.fragments(raw)
    for a, b in list(zip(pieces, pieces[1:]))[::20]:
        assert not any(a[-1:] + b[:1] in t for t in tokens)


def test_documents(docs_of, odd_rows, library):
    got = encode_documents(docs_of(odd_rows), PATH, with_ids=True).collect()
    assert len(got) == len(odd_rows)
    for row, (i, text) in zip(got, odd_rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (row["doc_id"], row["n_tokens"], row["ids"], row["decoded"]) == (i, len(ids), ids, text or "")
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_documents(docs_of([]), PATH).count() == 0


def test_pieces_are_read_once_and_remembered(monkeypatch):
    """Cuts and first ranks of a short piece come from one pass; 180,000 pieces met twice are merged once."""
    rng = random.Random(6)
    coder = Codec(PATH)
    for _ in range(2000):
        raw = bytes(rng.choices(b"aeinrst,!\xc3\xa9\xe3\x81\x00Z", k=rng.randrange(1, 90)))
        assert coder.piece_ids(raw) == [i for fragment in coder.fragments(raw) for i in coder.merge(fragment)]
    merged = []
    monkeypatch.setattr(coder, "piece_ids", lambda raw: merged.append(raw) or [0])
    text = " ".join("".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(180_000))
    for _ in range(2):
        assert sum(1 for _ in coder.known_pieces(text)) == 180_000
    assert len(merged) <= 180_001
