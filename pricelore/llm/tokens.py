"""Token ids of whole texts, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of rare characters in each of the two generations that a Python worker remembers; the older one is forgotten when the younger is full.
REMEMBERED = 100_000
#: Pieces that one call of the tokenizer gets at most.
AT_ONCE = 4_000
#: Latin, Greek, Cyrillic, punctuation, currencies and arrows, whose case and kind Python and the tokenizer see alike and which NFC leaves; tests try each.
RANGES = ((0x00, 0x1C), (0x20, 0x130), (0x131, 0x300), (0x370, 0x374), (0x375, 0x37E), (0x384, 0x387), (0x388, 0x3A2), (0x3A4, 0x483), (0x48A, 0x530), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0), (0x2190, 0x2200))
COMMON = [c for a, b in RANGES for c in map(chr, range(a, b)) if unicodedata.category(c) != "Cn" and any(x <= ord(c.lower()) < y for x, y in RANGES)]


class Special:
    """Finds the tokenizer's special strings, which it gives ids of their own, in texts."""

    def __init__(self, contents: list[str]):
        self.beginning = os.path.commonprefix(contents)
        self.pattern = re.compile("|".join(map(re.escape, contents)) or "(?!)")

    def inside(self, text: str) -> bool:
        return self.beginning in text and self.pattern.search(text) is not None


class WordRanks:
    """The ids of many texts of COMMON characters by the ranks of the word tokenizer's vocabulary.

    The tokenizer drops white space, and its merges begin with each word's last byte and the end of the word. Here a blank
    is that end: ids are in the order of the merges, and each token is what the merges make of its own bytes, so that
    merging by rank gives the same ids.
    """

    def __init__(self, vocabulary: dict[str, int]):
        import tiktoken

        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(of[c] for c in x.removesuffix("</w>")) + b" " * x.endswith("</w>"): i for x, i in vocabulary.items()}
        self.encoding, self.end = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), ranks[b"\n "]
        letters, numbers = (re.escape("".join(c for c in COMMON if unicodedata.category(c)[0] == kind)) for kind in "LN")
        self.words = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")
        self.other = re.compile(f"[^{re.escape(''.join(COMMON))}]")

    def __call__(self, lines: str) -> pa.LargeBinaryArray:
        """lines: texts of COMMON characters, each with a line end after it."""
        words = self.words.findall(lines.lower())
        ids = self.encoding.encode_to_numpy(" ".join([*words, ""]), disallowed_special=()).astype("<u4", copy=False)
        ends = ids == self.end
        at = np.flatnonzero(ends)
        offsets = np.concatenate([[0], 4 * (at - np.arange(len(at)))])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(ids[~ends])])


class WordEncoder:
    """Encodes texts as the ids of their blank-separated pieces, each different one once a call.

    For tokenizers that drop white space before BPE, and start anew after it: cutting there changes no id. Pieces of
    common characters go by WordRanks, others by the tokenizer, and are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = Special([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.tokenizer.encode_special_tokens = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd = re.compile(r"[\s\x00]")
        self.mark_id = self.plain("\x00")
        self.ranks = WordRanks(self.tokenizer.get_vocab(with_added_tokens=False))

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def whole(self, text: str) -> bytes:
        """Ids of a text with special strings, as the tokenizer gives them when nothing is set."""
        self.tokenizer.encode_special_tokens = False
        try:
            return self.plain(text)
        finally:
            self.tokenizer.encode_special_tokens = True

    def together(self, texts: list[str]) -> list[bytes]:
        """Ids of many texts without white space inside, by few calls: joined by a mark that always is one token."""
        found: list[bytes] = []
        mark = int(np.frombuffer(self.mark_id, dtype="<u4")[0])
        for at in range(0, len(texts), AT_ONCE):
            part = texts[at : at + AT_ONCE]
            joined = " \x00 ".join(part)
            ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) != len(part) - 1:
                found += map(self.plain, part)
                continue
            raw, begin = ids.tobytes(), 0
            for end in [*(cuts * 4).tolist(), len(raw)]:
                found.append(raw[begin:end])
                begin = end + 4
        return found

    def learn(self, used: set[str]) -> None:
        """Puts the ids of all pieces used into the young generation."""
        new = used.difference(self.young)
        if len(self.young) + len(new) > REMEMBERED:
            self.old, self.young, new = self.young, {}, used
        self.young.update((key, self.old[key]) for key in new.intersection(self.old))
        new = new.difference(self.young)
        simple = [key for key in new if not self.odd.search(key)]
        self.young.update(zip(simple, self.together(simple), strict=True))
        self.young.update((key, self.plain(key)) for key in new.difference(simple))

    def pieces(self, different: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of pieces without white space of ASCII."""
        ended = pc.binary_join_element_wise(different, pa.scalar("", different.type), pa.scalar("\n", different.type))
        lines = str(memoryview(ended.buffers()[2])[: int(np.frombuffer(ended.buffers()[1], np.int64)[len(ended)])], "utf-8")
        if not self.ranks.other.search(lines):
            return self.ranks(lines)
        texts = lines[:-1].split("\n")
        rare = np.array([self.ranks.other.search(x) is not None for x in texts])
        common, others = ([x for x, y in zip(texts, rare, strict=True) if y == kind] for kind in (False, True))
        self.learn(set(others))
        found = [self.ranks("\n".join([*common, ""])), pa.array(map(self.young.__getitem__, others), pa.large_binary())]
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.argsort(rare, kind="stable"))))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        odd = {i for i, t in enumerate(texts) if t and self.special.inside(t)}
        plain = pa.array(["" if not t or i in odd else t for i, t in enumerate(texts)], pa.large_string())
        cut = pc.ascii_split_whitespace(plain)
        all_pieces = cut.flatten().dictionary_encode()
        if not len(all_pieces):
            return []
        ids = self.pieces(all_pieces.dictionary).take(all_pieces.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[cut.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2])
        return [self.whole(texts[i]) if i in odd else bytes(raw[a:b]) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


class RankEncoder:
    """Byte-level BPE by the ranks of a .tiktoken file, as the tokenizer with the same vocabulary in `path` encodes."""

    def __init__(self, ranks_path: str, pattern: str, path: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        with open(path, encoding="utf-8") as file:
            self.special = Special([t["content"] for t in json.load(file)["added_tokens"]])
        self.path, self.tokenizer = path, None

    def whole(self, text: str) -> bytes:
        """Ids of a text with special strings, by the tokenizer itself."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        encode, inside = self.encoding.encode_to_numpy, self.special.inside
        return [b"" if not t else self.whole(t) if inside(t) else encode(t, disallowed_special=()).astype("<u4").tobytes() for t in texts]


@lru_cache(maxsize=2)
def rank_encoder(ranks_path: str, pattern: str, path: str) -> RankEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return RankEncoder(ranks_path, pattern, path)
