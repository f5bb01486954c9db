"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text holds every piece of the vocabulary at every place, and byte pieces for characters no
piece covers. A forward Viterbi pass gives the best score of each prefix; a backward A* search from the end
with those scores as exact estimates then yields the N best paths in order. No piece runs from another character
into a space or holds a line end (checked when the vocabulary is read), so the lattice of a text is a chain of
small ones and the N best paths of the whole text are the N least sums of losses. The forward pass of a link
keeps the best path and the score of the second; only the N - 1 links of a text where the second costs least can
take part in its N best, and only those are searched backward. Links and searches are remembered by the worker.

Scores are log probabilities of a Zipf law over the merge ranks, ln(1 / (rank + 2.7)), as a BPE vocabulary holds
ranks only, so the best path need not be the merges' own encoding; byte pieces cost BYTE_SCORE each. Text is taken
as it is: no normaliser runs, which is what makes decoding exact. Scores are held as whole multiples of 1 / UNIT:
sums are then exact, each node that the search takes out leads to a path of just its estimate, and as equal
estimates go to the node nearest the start, N paths cost N walks through the lattice, even through one letter
repeated without end.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import in_pandas, table
from barograph.llm.tokens import default_path

N_BEST, BYTE_SCORE, LINKS_KNOWN, SEARCHES_KNOWN, UNIT = 4, -14.0, 450_000, 50_000, 1 << 20
MARKS = ".,;:!?#*$%&|<>"
_LINK = re.compile(r"\n| *[^ \n]+| +")


class Lattice:
    """Vocabulary with spaces written as spaces; links of the chain and their N best paths."""

    def __init__(self, path: str | None = None, n: int = N_BEST):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path("piece_bpe_32k.model"))
        self.n = n
        #: Links known lately and before; the second goes when the first is full. The same for searches.
        self.known: dict[str, tuple[int, bytes, float]] = {}
        self.before: dict[str, tuple[int, bytes, float]] = {}
        self.searched: dict[str, list[tuple[int, bytes, int]]] = {}
        self.text: list[bytes] = []
        self.score: dict[str, tuple[int, bytes]] = {}
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                p = p.replace("▁", " ")
                if " " in p.lstrip(" ") or "\n" in p:
                    raise ValueError(f"piece {p!r} crosses the links of a chain")
                self.text.append(p.encode())
                rank = min(-sp.get_score(i), float(i))
                self.score[p] = (-round(float(np.log(max(rank, 0.0) + 2.7)) * UNIT), i.to_bytes(4, "little"))
        #: Neighbours inside some piece: between any others no piece runs, so a link falls apart there.
        self.joined = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        more = {p[:k] for p in self.score for k in range(1, len(p))}
        #: Pieces and what longer pieces start with: (score or None, ids, whether any piece goes on from here).
        self.trie: dict[str, tuple[int | None, bytes, bool]] = {w: (*(self.score.get(w) or (self.as_bytes(w) if len(w) == 1 else (None, b""))), w in more) for w in more | self.score.keys()}

    def as_bytes(self, c: str) -> tuple[int, bytes]:
        """Score and ids of a character that is no piece itself."""
        raw = c.encode()
        return round(BYTE_SCORE * UNIT) * len(raw), b"".join(self.byte[b].to_bytes(4, "little") for b in raw)

    def edges(self, s: str) -> list[list[tuple[int, int, bytes]]]:
        """For each end position: (start, score, ids) of the pieces that end there, by start."""
        n = len(s)
        out: list[list[tuple[int, int, bytes]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            for end in range(start + 1, n + 1):
                found = self.trie.get(s[start:end])
                if found is None:
                    if end > start + 1:
                        break
                    found = (*self.as_bytes(s[start]), False)
                if found[0] is not None:
                    out[end].append((start, found[0], found[1]))
                if not found[2]:
                    break
        return out

    def search(self, s: str) -> list[tuple[int, bytes, int]]:
        """The N best (score, ids as u32 bytes, pieces) of one link, best first; equal scores in the order found."""
        edges = self.edges(s)
        best = [0] * len(edges)
        for end in range(1, len(edges)):
            best[end] = max(best[start] + sc for start, sc, _ in edges[end])
        found: list[tuple[int, bytes, int]] = []
        count = itertools.count()
        # entries: -(score of what is done + best score of the prefix), position, order, score done, path
        heap: list = [(-best[-1], len(s), next(count), 0, None)]
        while heap and len(found) < self.n:
            _, at, _, done, path = heapq.heappop(heap)
            if at == 0:
                ids: list[bytes] = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                raw = b"".join(ids)
                found.append((done, raw, len(raw) // 4))
                continue
            for start, sc, one in edges[at]:
                heapq.heappush(heap, (-(done + sc + best[start]), start, next(count), done + sc, (one, path)))
        return found

    def forward(self, s: str) -> tuple[int, bytes, float]:
        """Best score, its ids, and what the second best path of one link loses (inf where there is one path).

        Of equal scores the piece that starts first counts, as in the search.
        """
        n, get = len(s), self.trie.get
        first, second, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1), [None] * (n + 1)
        first[0] = 0
        for start in range(n):
            one = first[start]
            for end in range(start + 1, n + 1):
                found = get(s[start:end])
                if found is None:
                    if end > start + 1:
                        break
                    found = (*self.as_bytes(s[start]), False)
                score, piece, more = found
                if score is not None:
                    c, old = one + score, first[end]
                    if c > old:
                        two = second[start] + score
                        second[end] = old if old > two else two
                        first[end], back[end] = c, (start, piece)
                    elif c > second[end]:
                        second[end] = c
                if not more:
                    break
        ids, at = [], n
        while at:
            at, one = back[at]
            ids.append(one)
        return first[n], b"".join(ids[::-1]), first[n] - second[n]

    def link(self, s: str) -> tuple[int, bytes, float]:
        found = self.known.get(s)
        if found is None:
            if len(self.known) >= LINKS_KNOWN:
                self.known, self.before = {}, self.known
            found = self.known[s] = self.before.get(s) or self.of_parts(s)
        return found

    def of_parts(self, s: str) -> tuple[int, bytes, float]:
        """A new link; a word and the marks after it, where no piece joins them, are searched apart and the word's path is one of many words'.

        Scores of parts add up, and the second best path differs in the one part where that costs least.
        """
        k = len(s.rstrip(MARKS))
        if not 0 < k < len(s) or s[k - 1 : k + 1] in self.joined:
            return self.forward(s)
        (score, ids, loss), (more, tail, other) = self.link(s[:k]), self.link(s[k:])
        return score + more, ids + tail, loss if loss < other else other

    def paths(self, s: str) -> list[tuple[int, bytes, int]]:
        found = self.searched.get(s)
        if found is None:
            if len(self.searched) >= SEARCHES_KNOWN:
                self.searched.clear()
            found = self.searched[s] = self.search(s)
        return found

    def encode(self, text: str | None) -> list[tuple[float, bytes]]:
        """The N best (score, ids as u32 bytes) of a whole text, best first; an empty text has none."""
        if not text:
            return []
        links = _LINK.findall(" " + text)
        chain = list(map(self.link, links))
        score, ids = sum([c[0] for c in chain]), [c[1] for c in chain]
        # only the links with the least first losses can take part in the N best
        loss = [c[2] for c in chain]
        near = [i for i in heapq.nsmallest(self.n - 1, range(len(loss)), key=loss.__getitem__) if loss[i] < math.inf]
        ways = [(0, ())]
        for i in near:
            ways = sorted(((lost + chain[i][0] - p[0], (*ks, k)) for lost, ks in ways for k, p in enumerate(self.paths(links[i]))), key=lambda w: w[0])[: self.n]
        out = []
        for lost, ks in ways:
            mine = list(ids)
            for i, k in zip(near, ks, strict=True):
                mine[i] = self.paths(links[i])[k][1]
            out.append(((score - lost) / UNIT, b"".join(mine)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text again; byte pieces join into characters, the space put in front goes."""
        text = self.text
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:].decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)  # a Python worker keeps it, with the links it knows, for its next tasks
def lattice_of(path: str | None, n: int) -> Lattice:
    return Lattice(path, n)


def encode_table(docs: DataFrame, n: int = N_BEST, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, score, nbest (score, n_pieces, ids_crc32 each), round_trip; with_ids adds the best ids.

    Null and empty texts have no pieces, score 0, no paths and a true round trip; rows that repeat are encoded
    each; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = lattice_of(tokenizer_path, n)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                paths = lattice.encode(text)
                best = paths[0][1] if paths else b""
                nbest = [{"score": s, "n_pieces": len(i) // 4, "ids_crc32": zlib.crc32(i)} for s, i in paths]
                row = (doc_id, len(best) // 4, zlib.crc32(best), paths[0][0] if paths else 0.0, nbest, lattice.decode(best) == (text or ""))
                rows.append((*row, np.frombuffer(best, "<i4")) if with_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "score", "nbest", "round_trip", *["ids"] * with_ids])

    schema = "doc_id long, n_pieces long, ids_crc32 long, score double, nbest array<struct<score:double,n_pieces:long,ids_crc32:long>>, round_trip boolean" + ", ids array<int>" * with_ids
    return in_pandas(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, ["doc_id"])


def op7_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"))


QUERIES = {"op7_nbest_segmentation": op7_nbest_segmentation}
ORACLES: dict[str, str] = {}
