import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from alarmlens.llm.bpe import byte_symbols
from alarmlens.llm.token_alignment import alignments, tokenizers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """Both libraries, byte offsets and every link one by one."""
    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B)
    symbols = byte_symbols()
    docs = []
    for i, text in rows:
        tokens = None
        if text:
            a = left.encode(" " + text, add_special_tokens=False).ids
            b = right.encode(text)
            raw_a = [bytes(symbols[c] for c in left.id_to_token(x)) for x in a]
            pieces = [right.id_to_piece(x) for x in b]
            raw_b = [bytes([int(p[3:5], 16)]) if right.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, pieces)]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends = [set(), set()]
                for side, raws in enumerate((raw_a, raw_b)):
                    at = 0
                    for raw in raws:
                        at += len(raw)
                        ends[side].add(at)
                groups, at_a, at_b, ia, ib = [], 0, 0, 0, 0
                for end in sorted(ends[0] & ends[1]):
                    group = ([], [])
                    while at_a < end:
                        group[0].append(a[ia])
                        at_a += len(raw_a[ia])
                        ia += 1
                    while at_b < end:
                        group[1].append(b[ib])
                        at_b += len(raw_b[ib])
                        ib += 1
                    groups.append(group)
                tokens = (a, b, groups)
        docs.append((i, tokens))
    links = [[(x, y) for g in t[2] for x in g[0] for y in g[1]] if t else [] for _, t in docs]
    count = Counter(pair for own in links for pair in set(own))
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for (i, t), own in zip(docs, links):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in t[2]) if t else ""
        sha = hashlib.sha256(written.encode()).hexdigest() if t else ""
        sizes = (len(t[0]), len(t[1]), len(t[2])) if t else (0, 0, 0)
        out.append((i, *sizes, len(own), sum(count[p] == highest[p[0]] for p in own), sum(count[p] for p in own), sha))
    return sorted(map(str, out))


def check(spark, frame, rows, **bounds):
    got = [tuple(r) for r in alignments(frame, A, B, **bounds).collect()]
    assert sorted(map(str, got)) == plain(rows)


TEXTS = [
    "The cat sat on the mat.", "  two  blanks\n\nand\tmore  ", "Größe, naïve café – 12345", "<|endoftext|> and <s> </s> <unk>", "日本語のテキスト 🙂🙂",
    "a▁b", "x" * 300, " " * 50, " 　end", "Tokenization antidisestablishmentarianism, unaligned", "\x00\x01 control \x7f", "ﬁ ligature", "The cat sat",
]


@pytest.mark.parametrize("bounds", [{}, {"chunk_bytes": 40, "group_bytes": 200, "radix": 3}])
def test_against_the_libraries(spark, docs_of, bounds):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(99, None), (100, "")]
    check(spark, docs_of(rows).repartition(3), rows, **bounds)


def test_odd_rows(spark, docs_of, odd_rows):
    check(spark, docs_of(odd_rows), odd_rows)
    check(spark, docs_of([]), [])
    check(spark, docs_of([(None, None), (None, None)]), [(None, None), (None, None)])


def test_links_in_parts(spark, docs_of, monkeypatch):
    from alarmlens.llm import token_alignment

    tools = tokenizers(A, B)
    whole = token_alignment.align(tools, TEXTS)
    monkeypatch.setattr(token_alignment, "PART_LINKS", 7)
    parts = token_alignment.align(tools, TEXTS)
    assert (whole.keys == parts.keys).all() and (whole.times == parts.times).all() and whole.digests == parts.digests


def test_long_runs_of_one_character():
    tools = tokenizers(A, B)
    for text in (" " * 1_000_000 + "x", "ab" * 200_000):
        assert b"".join(tools.bytes_a[i] for i in tools.ids_a(text)) == text.encode()
