"""Cross-tokenizer alignment against a plain version by the tokenizers' own libraries."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict

import pytest

pytest.importorskip("sentencepiece")
pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pricelore.llm import alignment, queries  # noqa: E402


def byte_letters():
    """The byte of each letter in which byte-level tokens are written."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    every, count = [], Counter()
    for t in texts:
        if not t:
            every.append(None)
            continue
        ids = a_side.encode(" " + t, add_special_tokens=False).ids
        a = [(i, bytes(letters[c] for c in a_side.id_to_token(i))) for i in ids]
        b = []
        for i in b_side.encode(t):
            piece = b_side.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()))
        own = (" " + t).encode()
        if b"".join(x for _, x in a) != own or b"".join(x for _, x in b) != own:
            every.append(None)
            continue
        ends = []
        for side in (a, b):
            n, at = 0, []
            for _, x in side:
                n += len(x)
                at.append(n)
            ends.append(at)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            m, n = bisect_right(ends[0], cut), bisect_right(ends[1], cut)
            groups.append(([x for x, _ in a[i:m]], [y for y, _ in b[j:n]]))
            i, j = m, n
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        count.update(links.keys())
        every.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for e in every:
        if e is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = e
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        rows.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return rows, {(x, y, n, n == best[x]) for (x, y), n in count.items()}


def check(spark, texts, parts=3):
    rows = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, block int, pair string, at int").repartition(parts)
    found, pairs = alignment.align(rows, queries.aligned)
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    wanted, counts = plain(texts)
    assert [got[i] for i in range(len(texts))] == wanted
    assert {tuple(r) for r in pairs.collect()} == counts


TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a b", "a  b", "the theory of  everything\nnew\n\nline \t tab", "<|endoftext|> <s></s> <0x41> <unk>", "a▁b", "▁", "é é ﬁ ﾊ 中文字 日本語 한국어", "\x00\x01 \x1c x y 　z​", "x" * 3000, "ab " * 700, "12345 67,890.12 --- !!! ''s 's don't", "🙂🙂 👨‍👩‍👧", "word\nword word\nword"]


def test_equals_the_plain_alignment(spark):
    rng = random.Random(4)
    letters = ["a", "e", "the", " ", " ", " ", "\n", "\t", "é", "中", "▁", "'s", "1", "2", ",", ".", "🙂", " ", "<s>", "Ing", "tion"]
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(250)] + TEXTS[5:9]
    check(spark, texts)


def test_small_memory_and_blocks(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    encoder = alignment.Aligner(*queries.alignment_files())
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    monkeypatch.setattr(alignment, "OUTER", 1)
    whole, _ = plain(texts)
    for at in range(0, 60, 7):
        counts, hashes, _, _, _ = encoder(texts[at : at + 7])
        assert [(*c, (h or b"").hex()) for c, h in zip(counts.tolist(), hashes, strict=True)] == [(*w[:4], w[6]) for w in whole[at : at + 7]]


def test_large_groups_are_counted_by_id():
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 40), rng.integers(0, 5, 50)
    in_a, in_b, owner = np.array([10, 30]), np.array([20, 30]), np.array([0, 1])
    one = alignment.Aligner.pairs(a, b, in_a, in_b, owner)
    old, alignment.OUTER = alignment.OUTER, 10
    try:
        two = alignment.Aligner.pairs(a, b, in_a, in_b, owner)
    finally:
        alignment.OUTER = old
    assert all((x == y).all() for x, y in zip(one, two, strict=True)) and one[1].sum() == 10 * 20 + 30 * 30


def test_multiplicities_beyond_sixteen_bits():
    import numpy as np

    entries = alignment.posts(np.array([3, 5]), np.array([200_000, 7])).astype(np.int64)
    sums = {}
    for e in entries.tolist():
        sums[e >> 16] = sums.get(e >> 16, 0) + (e & 0xFFFF)
    assert sums == {3: 200_000, 5: 7}


def test_megabyte_text_and_empty_table(spark):
    check(spark, ["lorem ipsum " * 90_000 + "dolor", "lorem"], 1)
    found, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), queries.aligned)
    assert found.collect() == [] and pairs.collect() == []


def test_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    found, pairs = alignment.align(rows, queries.aligned)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_links, r.count_sum) for r in found.collect()))
    assert got == [(False, 1, 2, 6), (False, 1, 2, 6), (False, 2, 0, 0), (True, 0, 2, 6)]
    assert sorted(r["count"] for r in pairs.collect()) == [3, 3]
