"""Whole texts to token ids with a public tokenizer; each distinct chunk of text is encoded once a task."""

from __future__ import annotations

import array
import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space property, which the tokenizers' patterns mean by white space (fixed values).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = re.compile(f"[{_WS}]{{2}}")
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
CHUNKS_KNOWN, SLICE = 300_000, 4_000_000
#: Stands between chunks while they are cut; texts that hold it take the longer way.
MARK = "\x1f"
#: Marks that a word may end in; with no letter or digit after them they are a pre-token of their own (the apostrophe may not be).
TAIL = ".,;:!?#*$%&|<>\"()[]{}-_+=/\\@^~`"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks_with_spaces(texts: list[str]) -> pa.ListArray:
    """Chunks that no token of a byte-level pattern crosses: a word with the space before it, or white space."""
    plain = [not _RUN.search(t) and MARK not in t for t in texts]
    cut = pc.replace_substring(pc.replace_substring(pa.array([t for t, ok in zip(texts, plain, strict=True) if ok], pa.string()), " ", MARK + " "), "\n", MARK + "\n")
    chunks = pc.split_pattern(cut, MARK)
    if all(plain):
        return chunks
    others = pa.array([_CHUNK.findall(t) for t, ok in zip(texts, plain, strict=True) if not ok], chunks.type)
    at = np.empty(len(texts), np.int64)
    at[np.flatnonzero(plain)], at[np.flatnonzero(~np.array(plain))] = np.arange(len(chunks)), np.arange(len(others)) + len(chunks)
    return pa.concat_arrays([chunks, others]).take(at)


def chunks_of_words(texts: list[str]) -> pa.ListArray:
    """Chunks between spaces and line ends, for tokenizers that drop white space; some are empty."""
    return pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")


class ChunkEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes; the chunks known are bounded, the long unused ones go."""

    def __init__(self, path: str, chunks, joint: str):
        """joint: what to put between plain chunks, so that their ids in a row are the ids of each."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # for chunks; texts with such a string in them go through `whole`
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks, self.joint, self.known, self.before = chunks, joint, {"": b""}, {}
        self.merges = self.tokenizer.model.tokenize
        #: Byte-level vocabularies spell printable bytes as themselves and the others, in order, from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.spelling = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(plain)))}
        # bytes that each id stands for; both vocabularies spell a byte as one character
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token.removesuffix("</w>"))

    def whole(self, text: str) -> bytes:
        """ids of a text in which the strings of special tokens become these."""
        self.tokenizer.encode_special_tokens = False
        try:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True

    def _plain(self, c: str) -> bool:
        """Printable, up to Latin-1 where the tokenizer normalises, and parted from the next: neither length nor limits change in a row."""
        if self.joint:
            return c.isprintable() and (c.isascii() or max(c) < "\u0100")
        return c[0] == " " and c[-1] != " " and c.isprintable()

    def _learn(self, new: list[str]) -> None:
        plain, other = [], []
        for c in new:
            (plain if self._plain(c) else other).append(c)
        for at in range(0, len(plain), 5000):
            part = plain[at : at + 5000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([self.joint.join(part)], add_special_tokens=False)[0].ids, "<u4")
            reach = np.cumsum(self.width[ids])
            goal = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in part])
            ends = np.searchsorted(reach, goal)
            if not len(reach) or reach[-1] != goal[-1] or (reach[ends] != goal).any():  # some id crosses a limit
                other += part
                continue
            self._keep(part, ids, [0, *(ends + 1).tolist()])
        for at in range(0, len(other), 5000):
            part = other[at : at + 5000]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            self._keep(part, np.asarray(e.ids, "<u4"), np.searchsorted(np.asarray(e.word_ids, np.int64), np.arange(len(part) + 1)).tolist())

    def _keep(self, part: list[str], ids: np.ndarray, ends: list[int]) -> None:
        raw = ids.tobytes()
        for c, a, b in zip(part, ends, ends[1:], strict=False):
            self.known[c] = raw[4 * a : 4 * b]

    def _word(self, word: str) -> bytes:
        """ids of letters (after a space where chunks keep theirs) from the merges alone, as there is nothing to normalise or to part."""
        spelled = word if self.joint else "Ġ" + word[1:]
        if not word.isascii():
            spelled = word.encode().decode("latin-1").translate(self.spelling)
        return array.array("I", [t.id for t in self.merges(spelled)]).tobytes()

    def _add(self, new: list[str]) -> None:
        """Makes `new` known: letters, and the marks after them, each by themselves; all else through the whole tokenizer."""
        known, before, rest = self.known, self.before, []
        for c in new:
            if c in before:
                known[c] = before[c]
                continue
            word = c.rstrip(TAIL)
            bare = word if self.joint else word[1:]
            if not bare.isalpha() or not (bare.isascii() or max(bare) < "\u0100") or not self.joint and word[0] != " ":
                rest.append(c)
                continue
            if self.joint:
                word = word.lower()
            ids = known.get(word) or before.get(word) or self._word(word)
            known[word] = ids
            if tail := c[len(word) :]:
                if tail not in known:
                    known[tail] = np.asarray(self.tokenizer.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
                ids = ids + known[tail]
            known[c] = ids
        if rest:
            self._learn(rest)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text. Chunks are cut out, told apart and put back as Arrow arrays, about SLICE characters of text at once."""
        out: list[bytes] = [b""] * len(texts)
        at, size = [], 0
        for i, t in enumerate(texts):
            if t and any(m in t for m in self.marks):
                out[i] = self.whole(t)
            elif t:
                at.append(i)
                size += len(t)
            if at and (size >= SLICE or i == len(texts) - 1):
                for k, ids in zip(at, self._slice([texts[j] for j in at]), strict=True):
                    out[k] = ids
                at, size = [], 0
        return out

    def _slice(self, texts: list[str]) -> list[bytes]:
        chunks = self.chunks(texts)
        codes = chunks.flatten().dictionary_encode()
        words = codes.dictionary.to_pylist()
        if len(self.known) >= CHUNKS_KNOWN:
            self.known, self.before = {"": b""}, self.known
        known = self.known
        if new := [c for c in words if c not in known]:
            self._add(new)
        ids = [known[c] for c in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        flat = memoryview(lists.take(codes.indices).flatten().to_numpy()).cast("B")
        ends = np.concatenate([[0], np.cumsum(size[codes.indices.to_numpy()])])[chunks.offsets.to_numpy()].tolist()
        return [bytes(flat[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]


@functools.cache  # a Python worker keeps it, with the chunks it knows, for its next task
def byte_bpe(path: str | None = None) -> ChunkEncoder:
    return ChunkEncoder(path or default_path("byte_bpe_50k.json"), chunks_with_spaces, "")


@functools.cache
def word_bpe(path: str | None = None) -> ChunkEncoder:
    return ChunkEncoder(path or default_path("word_bpe_49k.json"), chunks_of_words, " ")
