"""LM scoring by online logistic context mixing over bytes.

Every byte of a text (and an end mark, 255) is coded as eight binary decisions. Four bit predictors look at
contexts of 1 to 4 preceding bytes plus the bits already known, the longer ones by hash; their stretched
probabilities are mixed by weights that a gate selects (bit position and how often the two longest contexts were
seen), and the result is refined by an adaptive probability map of stretched buckets. Bits add up to the text's
probability.

Training covers all training texts. As a decision depends on five bytes, tasks count distinct five-byte windows
and Spark sums them. The sums are dealt into parts by the two-byte context, so that each part's counters are
complete in one task, which writes them to the shared folder; workers read them there. Counters grow with the
training bytes up to 2**MOST_BITS slots an order, beyond which contexts share slots. Trained weights are the
likelihood's maximum (Newton steps on sums over all windows, each window's own occurrence taken out of the
counts), the trained map its shares; both are the same however rows are dealt.

Scoring is online: a text starts from the trained state and learns as it goes. After each run of bytes (16 at
first, longer ones later) its own weights take a gradient step and its map the outcomes, so the next run is
predicted by what the text has shown. Texts advance side by side as array operations and never see each other.

The base score needs each token's corpus count. Texts are cut into blocks; a block asks once for each of its
distinct tokens, so a word in every text is one row a block, one of the thousands that a block asks for, and the
answers meet the block's texts in a cogroup of bounded size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import held_out, materialise, new_path, open_store, table, write_atomic

ORDERS, HASHED = 4, 3
#: log2 of the slots of each hashed order: as many as there are training bytes, divided by 8, within these limits.
LEAST_BITS, MOST_BITS = 14, 23
PART_BITS = 6
LOW = 1 << 16
GATES, BUCKETS = 8 * 16, 33
STEPS, PRIOR = 2, 10.0
CHUNK = 1 << 15
#: A text's own learning: rate of the weights, trained map's strength in observations.
RATE, STRENGTH = 0.002, 48.0
#: Runs of bytes between updates: (up to this byte, run).
RUNS = [(256, 16), (1024, 32), (8192, 64), (65536, 512), (1 << 62, 4096)]
SIDE_BY_SIDE, STEP_BYTES = 512, 16_384
BLOCK_BYTES, MOST_BLOCK_ROWS, SLICE, REMEMBERED = 32 << 20, 80_000, 3_000_000, 400_000
END = 255
MOST_COUNT = 30_000.0
#: Above twice what the outcomes of a run can sum up to in a cell, 8 * 4096.
APART = float(1 << 17)
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_NODE = np.uint64(0xA0761D6478BD642F)
_J = np.arange(8)
_BITS = ((np.arange(256)[:, None] >> (7 - _J)) & 1).astype(np.float32)


def windows(raw: bytes) -> np.ndarray:
    """The five-byte windows that end at each byte of the text and at its end mark, zeros before the start."""
    b = np.frombuffer(b"\0\0\0\0" + raw + bytes([END]), np.uint8).astype(np.int64)
    return b[4:] | b[3:-1] << 8 | b[2:-2] << 16 | b[1:-3] << 24 | b[:-4] << 32


def part_of(grams: np.ndarray) -> np.ndarray:
    """The part of the counters that holds a window's hashed contexts: by hash of the two bytes before."""
    return (((grams >> 8 & 0xFFFF).astype(np.uint64) * _SEED[0]) >> np.uint64(64 - PART_BITS)).astype(np.int64)


def slots(grams: np.ndarray, bits: int) -> np.ndarray:
    """Slot of each window, order and bit: order one by its byte in LOW slots, the others by hash within their part."""
    byte, context = grams & 255, grams >> 8
    node = (1 << _J)[None, :] | (byte[:, None] >> (8 - _J)[None, :])
    out = np.empty((len(grams), ORDERS, 8), np.int64)
    out[:, 0] = (context & 255)[:, None] << 8 | node
    local = bits - PART_BITS
    start, steps = part_of(grams) << local, node.astype(np.uint64) * _NODE
    for o in range(1, ORDERS):
        h = (context & ((1 << 8 * (o + 1)) - 1)).astype(np.uint64) * _SEED[o]
        h = (((h ^ (h >> np.uint64(29)))[:, None] + steps) * _SEED[0]) >> np.uint64(64 - local)
        out[:, o] = h.astype(np.int64) + (start + (LOW + ((o - 1) << bits)))[:, None]
    return out


def bits_of(grams: np.ndarray) -> np.ndarray:
    return (grams[:, None] >> (7 - _J)[None, :]) & 1


def as_halves(n: np.ndarray) -> np.ndarray:
    """Counts (..., 2) as 16-bit floats; pairs beyond MOST_COUNT keep their ratio."""
    top = np.maximum(n.max(-1, keepdims=True), MOST_COUNT)
    return (n * (MOST_COUNT / top)).astype("<f2")


def write_counters(batches: Iterator[pd.DataFrame], folder: str, bits: int) -> Iterator[pd.DataFrame]:
    """Passes (gram, n) on, writes the counters of the parts it holds, and adds order one's counts as low rows."""
    local = 1 << (bits - PART_BITS)
    sums: dict[int, np.ndarray] = {}
    low = np.zeros((2, LOW))

    def add(grams: np.ndarray, c: np.ndarray) -> None:
        at, bit, part = slots(grams, bits), bits_of(grams), part_of(grams)
        weight = np.broadcast_to(c[:, None], bit.shape)
        for v in (0, 1):
            low[v] += np.bincount(at[:, 0][bit == v], weight[bit == v], LOW)
        for k in np.unique(part):
            mine = part == k
            total = sums.setdefault(int(k), np.zeros((HASHED, local, 2)))
            for o in range(HASHED):
                inside = (at[mine, o + 1] - LOW) & (local - 1)
                for v in (0, 1):
                    ok = bit[mine] == v
                    total[o, :, v] += np.bincount(inside[ok], weight[mine][ok], local)

    held: list[pd.DataFrame] = []
    for b in batches:
        yield b.assign(low=False)
        held.append(b)
        if sum(map(len, held)) >= 4 * CHUNK:
            both = pd.concat(held)
            add(both["gram"].to_numpy(), both["n"].to_numpy(float))
            held = []
    if held:
        both = pd.concat(held)
        add(both["gram"].to_numpy(), both["n"].to_numpy(float))
    for k, total in sums.items():
        write_atomic(folder, f"part-{k:03d}", as_halves(total).tobytes())
    v, at = np.nonzero(low)
    yield pd.DataFrame({"gram": at * 2 + v, "n": low[v, at].astype(np.int64), "low": True})


@functools.lru_cache(maxsize=1)  # a Python worker keeps the last model's counters for its next tasks
def counters(folder: str, bits: int) -> np.ndarray:
    """All counters as pairs of 16-bit floats, zeros where no part was written."""
    from pyarrow import fs

    out = np.zeros((LOW + (HASHED << bits), 2), "<f2")
    store, base = open_store(folder)
    local = 1 << (bits - PART_BITS)
    for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.startswith("."):
            continue
        with store.open_input_stream(f.path) as stream:
            part = np.frombuffer(stream.read(), "<f2")
        if f.base_name == "low":
            out[:LOW] = part.reshape(LOW, 2)
        else:
            k = int(f.base_name.removeprefix("part-"))
            for o, x in enumerate(part.reshape(HASHED, local, 2)):
                at = LOW + (o << bits) + k * local
                out[at : at + local] = x
    return out


class Mixer:
    """Counters, trained gate weights and trained map."""

    def __init__(self, folder: str, bits: int, weights: np.ndarray, refine: np.ndarray | None = None):
        self.folder, self.bits, self.weights, self.refine = folder, bits, weights, refine
        self.counts = counters(folder, bits).view("<u4").reshape(-1)
        self.known, self.records = pd.Index([], dtype=np.int64), np.zeros((1, 2 * ORDERS), np.int64)

    def inputs(self, grams: np.ndarray, leave_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(stretched probabilities by window, bit and order, in steps of 1/16; gates)."""
        pair = self.counts[slots(grams, self.bits)].view("<f2").reshape(len(grams), ORDERS, 8, 2).astype(np.float32)
        a, b = pair[..., 0], pair[..., 1]
        if leave_out:
            own = bits_of(grams)[:, None, :]
            b, a = np.maximum(b - own, 0), np.maximum(a - (1 - own), 0)
        n = (a + b)[:, 2:]
        seen = (n > 0.5).astype(np.int64) + (n > 2.5) + (n > 16.5)
        gate = _J[None, :] * 16 + seen[:, 0] * 4 + seen[:, 1]
        x = np.clip(np.rint(16 * np.log((b + 0.4) / (a + 0.4))), -127, 127).astype(np.int8)
        return x.transpose(0, 2, 1), gate

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * np.float32(1 / 16) * self.weights[gate]).sum(-1), -12, 12)

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, learning from each as it goes; about SLICE bytes of text at once."""
        out, at, held = np.zeros(len(texts)), 0, 0
        for i, t in enumerate(texts):
            held += len(t) + 1
            if held >= SLICE or i == len(texts) - 1:
                out[at : i + 1] = self._slice(texts[at : i + 1])
                at, held = i + 1, 0
        return out

    def _records(self, distinct: np.ndarray) -> np.ndarray:
        """A cache line a window: its inputs, eight steps of 1/16 an order, and the trained mix of its eight bits.

        Those of the slices before are remembered, up to REMEMBERED windows; most windows of a slice were there before.
        """
        at = self.known.get_indexer(distinct)
        out, new = self.records.take(at, 0, mode="clip"), np.flatnonzero(at < 0)
        for i in range(0, len(new), CHUNK):
            here = new[i : i + CHUNK]
            x, gate = self.inputs(distinct[here])
            out[here, :ORDERS] = np.ascontiguousarray(x.transpose(0, 2, 1)).view(np.int64)[..., 0]
            out[here, ORDERS:] = self.mixed(x, gate).view(np.int64)
        if len(self.known) + len(new) <= REMEMBERED:
            self.known, self.records = self.known.append(pd.Index(distinct[new])), np.concatenate([self.records[: len(self.known)], out[new]])
        else:
            self.known, self.records = pd.Index(distinct[:REMEMBERED]), out[:REMEMBERED]
        return out

    def _slice(self, texts: list[bytes]) -> np.ndarray:
        each = [windows(t) for t in texts]
        size = np.array([len(w) for w in each])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        code, distinct = pd.factorize(np.concatenate(each))
        del each
        records = self._records(distinct)
        last = (distinct & 255).astype(np.uint8)
        out, order = np.zeros(len(texts)), np.argsort(-size, kind="stable")
        i = 0
        while i < len(order):  # as many side by side as keeps a step's arrays in a core's cache
            step = next(run for end, run in RUNS if size[order[i]] <= end)
            mine = order[i : i + max(8, min(SIDE_BY_SIDE, STEP_BYTES // step))]
            out[mine] = self._online(code, records, last, start[mine], size[mine])
            i += len(mine)
        return out

    def _online(self, code: np.ndarray, records: np.ndarray, last: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Texts of falling size: each run is predicted from the state after the runs before.

        A text's state: `own`, what it adds to the weights by order and bit position, and by bucket how often
        (`seen`) and by how much in all (`off`) outcomes were above the trained map. Arrays are the bytes of a run by
        texts and bits, so what a text holds meets each byte as one long row.
        """
        n = len(size)
        own = np.zeros((ORDERS + 1, n * 8), np.float32)
        own[0] = 1  # of the trained mix, which goes before the orders' inputs
        seen, off = np.zeros(n * BUCKETS + 1), np.zeros(n * BUCKETS + 1)
        trained = self.refine.astype(np.float32).ravel()
        rate, half, least, most_likely = np.float32(RATE / 256), np.float32(0.5), np.float32(1e-6), np.float32(1 - 1e-6)
        rows, places = np.repeat(np.arange(n) * BUCKETS, 8), np.tile(_J * BUCKETS, n)
        shift = rows - places
        out = np.zeros(n)
        most = n * 8 * max(b - a for a, b in runs(int(size[0])))
        room = [np.empty(most * (ORDERS + 1), np.float32), *(np.empty(most, np.float32) for _ in range(5))]  # used by every run: they stay in a core's cache
        room += [np.empty(most, np.int64), np.empty(most, np.int64), np.empty(most // 8, np.int64), np.empty(most)]
        for a, b in runs(int(size[0])):
            live, whole = (int(np.searchsorted(-size, -v, "left")) for v in (a, b - 1))  # size > a, size >= b
            step, wide, shape = np.arange(a, b), b - a, (b - a, live * 8)
            xs, p, r, q, bits, scratch, k, mine, line, weight = (v[: wide * live * len(v) // (most // 8)] for v in room)
            p, r, q, bits, scratch, k = (v.reshape(shape) for v in (p, r, q, bits, scratch, k))
            xs = xs.reshape(ORDERS + 1, *shape)
            at = code.take(start[None, :live] + step[:, None], mode="clip").ravel()
            mine = records.take(at, 0, out=mine.reshape(-1, 2 * ORDERS), mode="clip")
            for o, v in enumerate(xs[1:]):
                np.copyto(line, mine[:, o])
                np.copyto(v, line.view(np.int8).reshape(shape))
            np.copyto(xs[0].view(np.int64).reshape(-1, ORDERS), mine[:, ORDERS:])
            _BITS.take(last.take(at), 0, out=bits.reshape(-1, 8), mode="clip")
            np.einsum("onk,ok->nk", xs, own[:, : live * 8], out=p)
            np.clip(p, -12, 12, out=p)
            bucket(p, scratch, k)
            k += places[: live * 8]
            trained.take(k, out=r, mode="clip")
            k += shift[: live * 8]
            np.negative(p, out=p)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            if whole < live:  # the last ones end within the run
                past = np.repeat(step[:, None] >= size[whole:live], 8, axis=1)
                k[:, whole * 8 :][past] = n * BUCKETS  # bytes beyond the end count in a cell that nobody reads
                np.copyto(bits[:, whole * 8 :], p[:, whole * 8 :], where=past)
            (off / (STRENGTH + seen)).astype(np.float32).take(k, out=q, mode="clip")
            q += p
            q += r
            q *= half
            np.clip(q, least, most_likely, out=q)
            q -= 1
            q += bits
            np.abs(q, out=q)  # the probability of what came
            if whole < live:
                q[:, whole * 8 :][past] = 1
            four = q.reshape(wide // 4, 4, live * 8)  # four of at least a millionth each: a float holds their product
            product = four[:, 0]
            for i in (1, 2, 3):
                product *= four[:, i]
            out[:live] += np.log(product, out=product).sum(0, dtype=np.float64).reshape(live, 8).sum(1)
            np.copyto(weight.reshape(shape), np.subtract(bits, r, out=scratch))
            weight += APART
            both = np.bincount(k.ravel(), weight, len(seen))  # one pass for counts and sums
            times = np.rint(both / APART)
            seen += times
            off += both - times * APART
            seen[-1] = off[-1] = 0
            bits -= p
            for v, w in zip(xs[1:], own[1:], strict=True):
                w[: live * 8] += rate * np.einsum("nk,nk->k", v, bits)
        return out / np.log(10)


def runs(size: int) -> Iterator[tuple[int, int]]:
    """Runs of bytes up to `size`, by the schedule alone: the last one may reach beyond."""
    a = 0
    while a < size:
        step = next(run for end, run in RUNS if a < end)
        yield a, a + step
        a += step


def bucket(z: np.ndarray, scratch: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Nearest half, from 0 on; the least and the greatest take all beyond."""
    twice = np.add(z, z, out=scratch)
    np.clip(twice, -(BUCKETS // 2), BUCKETS // 2, out=twice)
    twice += BUCKETS // 2 + 0.5
    if out is None:
        return twice.astype(np.int64)
    np.copyto(out, twice, casting="unsafe")
    return out


def _running_block(most_bytes: int):
    """Of a task's rows in order: the number of the block of each; only sizes pass through here."""

    @F.pandas_udf("long")
    def numbers(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number = held = rows = 0
        for batch in sizes:
            out = np.empty(len(batch), np.int64)
            for i, size in enumerate(batch.tolist()):
                if rows and (held + size > most_bytes or rows >= MOST_BLOCK_ROWS):
                    number, held, rows = number + 1, 0, 0
                held, rows, out[i] = held + size, rows + 1, number
            yield pd.Series(out)

    return numbers.asNondeterministic()


def blocks(docs: DataFrame, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, held_out, block: runs of rows of one task, of at most `most_bytes` of text or one text that has more."""
    cols = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id"), 7).alias("held_out"))
    numbered = cols.withColumn("block", _running_block(most_bytes)(F.octet_length("text").cast("long")))
    return materialise(numbered.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("block")), "blocks")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts, A-Z lower-cased, one after another; how many each text has)."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    some = pc.greater(pc.binary_length(bare), 0)
    lists = pc.ascii_split_whitespace(bare.filter(some))
    sizes = np.zeros(len(texts), np.int64)
    sizes[some.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
    return lists.flatten(), sizes


def block_tokens(cut: DataFrame) -> DataFrame:
    """block, token, n: each block's distinct tokens with their training count there (0 where only held-out texts have it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: int, train: list[pa.Array], held: list[pa.Array]) -> pa.RecordBatch:
            coded = pa.concat_arrays(train + held).dictionary_encode()
            tokens = coded.dictionary.cast(pa.large_binary()).cast(pa.binary())
            n = np.bincount(coded.indices.to_numpy()[: sum(map(len, train))], minlength=len(tokens))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), block)), tokens, pa.array(n)], ["block", "token", "n"])

        now, train, held = None, [], []
        for b in batches:
            numbers = b["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if now is not None and numbers[i] != now:
                    yield out(now, train, held)
                    train, held = [], []
                now, texts, apart = numbers[i], b["text"].slice(i, j - i), b["held_out"].slice(i, j - i)
                train.append(words_of(texts.filter(pc.invert(apart)))[0])
                held.append(words_of(texts.filter(apart))[0])
        if now is not None:
            yield out(now, train, held)

    return cut.select("block", "text", "held_out").mapInArrow(count, "block long, token binary, n long")


def window_counts(train: DataFrame) -> DataFrame:
    """gram, n, part over all training texts, not yet summed over tasks: a task sums what it can hold."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pd.DataFrame:
            both, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
            return pd.DataFrame({"gram": both, "n": n, "part": part_of(both).astype(np.int32)})

        new, size = [], 0
        for b in batches:
            for text in b["text"]:
                new.append(windows(text.encode()))
                size += len(new[-1])
                if size >= 2_000_000:
                    parts.append(np.unique(np.concatenate(new), return_counts=True))
                    new, size = [], 0
                    if sum(len(g) for g, _ in parts) >= 4_000_000:
                        yield out()
                        parts = []
        if new:
            parts.append(np.unique(np.concatenate(new), return_counts=True))
        if parts:
            yield out()

    return train.select("text").mapInPandas(count, "gram long, n long, part int")


def _sums(made: DataFrame) -> pd.DataFrame:
    """made(i, v): sums by i, a few thousand numbers at most."""
    return made.groupBy("i").agg(F.sum("v").alias("v")).toPandas()


def fit(train: DataFrame, train_bytes: int) -> tuple[str, int, np.ndarray, np.ndarray]:
    """(folder of counters, their bits, gate weights, map) of all training texts."""
    spark = train.sparkSession
    folder = new_path(spark, "counters")
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, train_bytes))) - 3)))
    dealt = window_counts(train).repartition(1 << PART_BITS, "part")  # a part's windows meet in one task
    summed = dealt.groupBy("part", "gram").agg(F.sum("n").alias("n")).select("gram", "n")
    found = materialise(summed.mapInPandas(lambda b: write_counters(b, folder, bits), "gram long, n long, low boolean"), "windows")
    low = found.where("low").groupBy("gram").agg(F.sum("n").alias("n")).coalesce(1)  # 2 LOW rows at most

    def write_low(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(2 * LOW)
        for b in batches:
            n[b["gram"]] = b["n"]
        write_atomic(folder, "low", as_halves(n.reshape(LOW, 2)).tobytes())
        yield pd.DataFrame({"done": [True]})

    low.mapInPandas(write_low, "done boolean").collect()
    counts = found.where("not low").select("gram", "n")
    weights = np.full((GATES, ORDERS), 0.3)
    pairs = [(o, q) for o in range(ORDERS) for q in range(o, ORDERS)]

    for _ in range(STEPS):
        now = weights

        def slopes(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            m, total = Mixer(folder, bits, now), np.zeros((ORDERS + len(pairs), GATES))
            for b in batches:
                grams, c = b["gram"].to_numpy(), b["n"].to_numpy(float)
                for i in range(0, len(grams), CHUNK):
                    part = grams[i : i + CHUNK]
                    x, gate = m.inputs(part, leave_out=True)
                    p = 1 / (1 + np.exp(-m.mixed(x, gate)))
                    n, g = c[i : i + CHUNK, None], gate.ravel()
                    xs = [(x[..., o] / 16.0).ravel() for o in range(ORDERS)]
                    err, curve = (n * (bits_of(part) - p)).ravel(), (n * p * (1 - p)).ravel()
                    for o in range(ORDERS):
                        total[o] += np.bincount(g, err * xs[o], GATES)
                    for k, (o, q) in enumerate(pairs):
                        total[ORDERS + k] += np.bincount(g, curve * xs[o] * xs[q], GATES)
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

        got, total = _sums(counts.mapInPandas(slopes, "i int, v double")), np.zeros((ORDERS + len(pairs)) * GATES)
        total[got["i"]] = got["v"]
        total = total.reshape(-1, GATES)
        weights = weights.copy()
        for g in range(GATES):
            curve = np.eye(ORDERS) * PRIOR
            for k, (o, q) in enumerate(pairs):
                curve[o, q] = curve[q, o] = total[ORDERS + k, g] + PRIOR * (o == q)
            weights[g] += np.clip(np.linalg.solve(curve, total[:ORDERS, g] - PRIOR * (weights[g] - 0.3)), -0.5, 0.5)
    weights = weights.round(6).astype(np.float32)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hits = Mixer(folder, bits, weights), np.zeros((2, 8 * BUCKETS))
        for b in batches:
            grams, c = b["gram"].to_numpy(), b["n"].to_numpy(float)
            for i in range(0, len(grams), CHUNK):
                x, gate = m.inputs(grams[i : i + CHUNK], leave_out=True)
                at = (_J[None, :] * BUCKETS + bucket(m.mixed(x, gate))).ravel()
                n = np.repeat(c[i : i + CHUNK], 8)
                hits[0] += np.bincount(at, n, 8 * BUCKETS)
                hits[1] += np.bincount(at, n * bits_of(grams[i : i + CHUNK]).ravel(), 8 * BUCKETS)
        yield pd.DataFrame({"i": np.arange(hits.size), "v": hits.ravel()})

    got, hits = _sums(counts.mapInPandas(mapped, "i int, v double")), np.zeros(2 * 8 * BUCKETS)
    hits[got["i"]] = got["v"]
    n, ones = hits.reshape(2, 8, BUCKETS)
    middle = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2))
    return folder, bits, weights, (ones + 2 * middle) / (n + 2)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Defined cases: null and empty texts have the end token alone; a null doc_id is not held out; with no training
    text every bit costs one bit and the base probabilities are 1 / 1; equal texts score alike; rows that repeat
    are scored each, other columns ignored.
    """
    cut = blocks(docs)
    asked = materialise(block_tokens(cut), "block-tokens")
    corpus = asked.groupBy("token").agg(F.sum("n").alias("c"))
    answers = materialise(asked.select("block", "token").join(corpus, "token"), "answers")
    train = cut.where(~F.col("held_out"))
    size = train.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    ends = size["rows"]
    sums = corpus.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("distinct")).first()
    total, distinct = sums["n"] + ends, sums["distinct"] + (ends > 0)
    model = fit(train, size["bytes"])
    end_value, scale = np.log10(ends + 1), np.log10(total + distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = Mixer(*model)
        texts = pa.concat_arrays([x.cast(pa.large_string()) for x in left["text"].chunks])
        raws = texts.cast(pa.large_binary()).to_pylist()
        found, sizes = words_of(texts)
        c = right["c"].to_numpy()
        at = pc.index_in(found.cast(pa.large_binary()), value_set=right["token"].cast(pa.large_binary())).to_numpy()
        some = sizes > 0
        start = (np.cumsum(sizes) - sizes)[some]
        base, known = np.zeros(len(raws)), np.full(len(raws), int(ends > 0))
        if len(start):
            base[some] = np.add.reduceat(np.log10(c + 1.0)[at], start)
            known[some] += np.add.reduceat((c > 0).astype(np.int64)[at], start)
        base += end_value - (sizes + 1) * scale
        del found, at
        once = {t: i for i, t in enumerate(dict.fromkeys(raws))}  # copies in a block are scored once
        s = m.costs(list(once))[[once[t] for t in raws]]
        a_byte = -s / np.log10(2) / np.maximum(1, [len(t) for t in raws])
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": sizes + 1, "n_known": known,
                         "train_tokens": np.full(len(raws), total), "base_score": base, "score": s.round(6), "bits_per_byte": a_byte})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return cut.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op8_context_mixing": op8_context_mixing}
ORACLES: dict[str, str] = {}
