"""WARC, token ORC and packing, against plain versions and round trips."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pricelore.llm import packing, queries, token_orc, warc  # noqa: E402
from pricelore.llm.common import fresh_path  # noqa: E402

TEXTS = [(0, "Hello, the World."), (1, ""), (2, None), (3, "a  b\n\nc é " * 3), (4, "x" * 5000), (5, "word " * 9000), (7, "Hello, the World."), (None, "lost id")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, part int")


def reference_ids(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoders_equal_the_tokenizers_library():
    import random

    random.seed(3)
    letters = " \n\t ab1é'.,ΣAŹ\x1c_½\x00"
    texts = ["".join(random.choice(letters) for _ in range(40)) for _ in range(300)] + [t for _, t in TEXTS] + ["<|endoftext|> <|startoftext|>x", "a <|endoftext|> b", "a <|ENDOFTEXT|> b", "<|endoftext", "x<|startoftext|>y\nz"]
    for name, encode in (("byte_bpe_50k.json", queries.byte_ids), ("word_bpe_49k.json", queries.word_ids)):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [reference_ids(name, t) for t in texts]


def test_word_encoder_forgets_and_stays_right(monkeypatch):
    from pricelore.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["a b c", "b c d e.", "a b, f", "a b c d e f g", "g a"]:
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == reference_ids("word_bpe_49k.json", text)


def test_word_encoder_remembers_rare_characters_only():
    """What a worker remembers doesn't grow with the corpus' common words (they took 1 GB and more of an executor)."""
    from pricelore.llm import tokens

    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + f" Ünique{i}, 世{i % 7}" for i in range(3000)]
    got = encoder(texts)
    assert len(encoder.young) + len(encoder.old) <= 7
    for i in (0, 1, 26, 2999):
        assert np.frombuffer(got[i], "<u4").tolist() == reference_ids("word_bpe_49k.json", texts[i])


def test_word_ranks_equal_the_tokenizer_by_character_and_token():
    """Each common character between letters, digits and marks, and each token's own text."""
    from tokenizers import Tokenizer

    from pricelore.llm import tokens

    encoder, own = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"x{c}Y {c}1{c}{c}2 ,{c}, '{c}S" for c in [*tokens.COMMON, *"\u0130\u03a3\u0301\u037e\u2028\u212a\x1c世😀"]]
    texts += [own.decode([i]) for i in range(own.get_vocab_size())] + ["", None, " ", "\n", "a" * 3000, "ʼn's It'LL''s ǅ"]
    pairs = zip(encoder(texts), own.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True)
    assert [t for t, (x, y) in zip(texts, pairs, strict=True) if np.frombuffer(x, "<u4").tolist() != y.ids] == []
    assert encoder(["", None]) == [b"", b""] and encoder([]) == []


@pytest.mark.parametrize("block", [1, 100, 10**7])
def test_packing_holds_each_id_once(spark, block):
    rows = TEXTS + [(100 + i, "ab " * (i * 7 % 1500)) for i in range(60)]
    got = packing.pack(docs(spark, rows).repartition(2), queries.byte_ids, 1, 2048, block).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert len(by_doc) == len(rows)
    for doc_id, text in rows:
        ids = b"".join(bytes(r.ids) for r in sorted(by_doc[doc_id], key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*reference_ids("byte_bpe_50k.json", text), 1]
        assert {r.doc_tokens for r in by_doc[doc_id]} == {len(ids) // 4}
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4
            at += r.length
        assert at <= 2048


def test_packing_pads_little(spark):
    rows = [(i, "ab " * (i * 7 % 1500)) for i in range(400)]
    got = packing.pack(docs(spark, rows).repartition(2), queries.byte_ids, 1, 2048).collect()
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert 1 - sum(used.values()) / (2048 * len(used)) < 0.03


def test_tightest_window_is_the_best_fit():
    import random

    random.seed(1)
    windows, rooms = packing.OpenWindows(20), {}
    for _ in range(500):
        n = random.randint(1, 20)
        best = min((r for r in rooms.values() if r >= n), default=None)
        window, offset = windows.place(n)
        room = 20 - offset
        assert room == (best if best is not None else 20)
        rooms[window] = room - n


def test_packing_of_an_empty_table(spark):
    assert packing.pack(docs(spark, []), queries.byte_ids).count() == 0


def test_orc_round_trip(spark):
    rows = TEXTS + [(4, "again"), (-5, "negative id")]
    path = fresh_path(spark, "orc-test")
    token_orc.write_tokens(docs(spark, rows), path, queries.word_ids, 2)
    got = token_orc.read_tokens(spark, path)
    found = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, list(r.ids)) for r in got.collect())
    assert [f[0] for f in found] == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for _, start, n, ids in sorted(found, key=lambda f: f[1]):
        assert start == at and n == len(ids) and ids[-1] == 2
        at += n
    by_id = {f[0][1]: f[3] for f in found if f[0] != (True, 4)}
    for i, t in TEXTS:
        if i != 4:
            assert by_id[i or 0] == [*reference_ids("word_bpe_49k.json", t), 2] or i in (0, None)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_orc.with_crc(got).collect()}
    for r in got.collect():
        assert crc[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert "doc_id" in got.where("doc_id = 3")._jdf.queryExecution().toString().split("PushedFilters")[1]
    assert [r.doc_id for r in got.where("doc_id in (3, 5)").orderBy("doc_id").collect()] == [3, 5]


def test_orc_of_an_empty_table(spark):
    path = fresh_path(spark, "orc-empty")
    token_orc.write_tokens(docs(spark, []), path, queries.word_ids)
    assert token_orc.with_crc(token_orc.read_tokens(spark, path)).count() == 0


def test_warc_round_trip(spark):
    long = "é WARC/1.1\r\n\r\n0\r\n\r\n" * 4000
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (7, "http://c", None), (8, "http://d", ""), (9, "x\r\ny", long), (5, "http://b", "same"), (None, "http://n", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "html") for r in rows], "page_id long, url string, html string, kind string")
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path, 1000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.whole for r in got)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = defaultdict(lambda: None)
    for i, _, h in rows:
        top[h or ""] = max((x for x in (i, top[h or ""]) if x is not None), default=None)
    key = lambda r: tuple(map(str, r))
    want = sorted(((i, len((h or "").encode()), sha(h), "response" if i == top[h or ""] else "revisit", None if i == top[h or ""] else top[h or ""]) for i, _, h in rows), key=key)
    assert sorted(((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got), key=key) == want
    assert {bytes(r.payload) for r in got if r.page_id == 9} == {long.encode()}
    assert warc.read_archives(spark, path).where("record_type = 'revisit' and payload is not null").count() == 0


def test_warc_references_resolve(spark):
    rows = [(1, "u", "same"), (5, "v", "same"), (5, "v", "same"), (9, "w", "x" * 3000), (None, "n", "same")]
    path = fresh_path(spark, "warc-refs")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, 1000)
    found = [x for r in spark.read.format("binaryFile").load(path).where("path like '%.gz'").collect() for x in warc.inflated(bytes(r.content)).decode().split("\r\n")]
    names = [x.split(": ")[1] for x in found if x.startswith("WARC-Record-ID")]
    assert len(names) == len(set(names))
    assert {x.split(": ")[1] for x in found if x.startswith(("WARC-Refers-To: ", "WARC-Segment-Origin-ID"))} <= set(names)
    assert sum(x.startswith("WARC-Refers-To: ") for x in found) == 2


def test_warc_reads_cut_and_foreign_archives():
    def record(kind, more="", body=b"HTTP/1.1 200 OK\r\n\r\nhello"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    whole = record("warcinfo") + record("response") + record("revisit", "WARC-Refers-To: <urn:uuid:1>\r\n")
    assert [(r[1], r[2], r[4]) for r in warc.parsed(whole)] == [("response", None, None), ("revisit", None, None)]
    assert len(list(warc.parsed(whole + b"WARC/1.0\r\nWARC-Type: resp"))) == 2
    assert len(list(warc.parsed(record("response") + b"WARC/1.0\r\nWARC-Type: response\r\n\r\nxx"))) == 1
    assert list(warc.parsed(record("response")[:-6]))[0][-1].endswith(b"hel")
    import gzip

    packed = gzip.compress(whole)
    assert warc.inflated(packed + b"junk") == whole and whole.startswith(warc.inflated(packed[:60]))


def test_warc_tells_broken_records():
    block = warc.http_message(b"abc" * 5000)
    assert warc.unframed(block) == (b"abc" * 5000, True)
    assert warc.unframed(block[:-9])[1] is False


def test_warc_of_an_empty_table(spark):
    path = fresh_path(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
