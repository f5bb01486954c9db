"""Tables for the training-data operators: the small driver tables, and tables of awkward rows."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
CLASHES = ["n", "key", "id", "shard", "slot", "piece", "start", "length", "comp", "bucket", "block", "token", "set_id", "score", "kept", "_w", "_n", "rank", "record", "archive", "y", "f"]


def awkward_texts() -> list[str | None]:
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    para = " ".join(rnd.choice(words) for _ in range(120))
    near = para.split()
    near[60] = "changed"
    return [
        None, "", " \t\n ", "one", "One", "two words", para, para, para.upper(), " ".join(near), para + " tail",
        "\n".join(["same line here"] * 30), "naïve café Ünïcödé ✓ 漢字 \U0001f600", "<|endoftext|> ids of names </s> <unk>", "a\x0bb\x0cc\rd e f", "# * $ % & | < >" * 40,
        " ".join(rnd.choice(words) for _ in range(60_000)), "x" * 50_000, "the of and to a in is that for it " * 40, "\x00\x01 control \x7f", "  double  spaces   and\n\n\nlines ",
    ]


@pytest.fixture(scope="session")
def awkward(tmp_path_factory) -> str:
    d = tmp_path_factory.mktemp("awkward")
    texts = awkward_texts()
    ids = [*range(len(texts)), 6, None, 1]  # a repeated row, a row without id, a repeated id with another text
    texts += [texts[6], "no id here", "other text under a known id"]
    n = len(ids)
    cols = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en", None, "fr", "xx", ""] * n, pa.string())[:n], "source": pa.array([None, "web"] * n, pa.string())[:n], "n_chars": pa.array([None] * n, pa.int64())}
    pq.write_table(pa.table(cols | {c: pa.array(range(n), pa.int64()) for c in CLASHES}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([6, 6, 9, 10, None, 99, 1], pa.int64()), "quality": pa.array([1, None, 0, 1, 1, 1, 0], pa.int32()), "toxic": pa.array([0, 1, 1, 0, 1, 1, None], pa.int32())}), d / "labels.parquet")
    pages = {"page_id": pa.array(ids, pa.int64()), "url": pa.array([None, "http://a/b c\r\nX: y"] * n, pa.string())[:n], "html": pa.array(texts, pa.string())}
    pq.write_table(pa.table(pages | {c: pa.array(range(n), pa.int64()) for c in CLASHES}), d / "pages.parquet")
    for name, cols in (("benchmark", awkward_items(texts)), ("embeddings", awkward_vectors()), ("conversations", awkward_conversations())):
        size = len(next(iter(cols.values())))
        pq.write_table(pa.table(cols | {c: pa.array(range(size), pa.int64()) for c in CLASHES if c not in cols}), d / f"{name}.parquet")
    return str(d)


def awkward_items(texts: list[str | None]) -> dict:
    """Items of every short length, one twice, passages of the texts, and nulls."""
    long = max((t for t in texts if t), key=lambda t: len(t.split()))
    para = next(t for t in texts if t and len(t.split()) == 120)
    items = [" ".join(para.split()[5 : 5 + n]) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 40)]
    items += [None, "", "?!", para, para, "Naïve  CAFÉ", long[-300:], "nowhere to be found in any text of this table at all", " ".join(para.split()[30:39] + ["unlike"] + para.split()[40:52])]
    ids = [*range(100, 100 + len(items) - 1), None]
    ids[5] = 100
    return {"item_id": pa.array(ids, pa.int64()), "text": pa.array(items, pa.string())}


def awkward_vectors() -> dict:
    """Ties, copies, zero, huge, broken and ragged vectors."""
    rnd = random.Random(7)
    draw = lambda: [rnd.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.75]) for _ in range(8)]
    rows = [(i, i % 3, draw()) for i in range(400)]
    rows += [(100, 1, draw()), (150, 2, [0.0] * 8), (151, 2, [0.0] * 8), (50, 0, [1.0, 1.0]), (52, 0, []), (200, None, draw()), (250, 1, None), (None, 1, draw()), (300, 1, [0.1, None]), (350, 1, [float("nan")] * 8), (400, 1, [float("inf")] * 8), (450, 1, [3e38] * 8), (-50, 1, draw())]
    rows += [rows[50], rows[50], rows[57]] + [(1000 + i, 0, rows[0][2]) for i in range(60)]
    return {"vec_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32()), "embedding": pa.array([r[2] for r in rows], pa.list_(pa.float32()))}


def awkward_conversations() -> dict:
    """Every fault and role, copies, turns that repeat or are missing, nulls, and one very long conversation."""
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", "User", "", None]), rnd.choice(["Yes.", "No", " ", "", None, "again?", "again?", "well !  \n", "\u3000", "x" * 3000 + "."])) for c in range(60) for t in range(rnd.randrange(9))]
    rows += [(70, 1, "user", "hi."), (70, 1, "user", "hi."), (70, None, "system", "first."), (70, 2**40, "assistant", "late."), (70, -5, "assistant", "early"), (None, 1, "user", "whose?"), (None, None, None, None), (71, None, "user", "a."), (71, None, "assistant", "b.")]
    rows += [(72, t, "user" if t % 2 else "assistant", f"line {t % 900}{'.' if t % 7 else ''}") for t in range(2000)]
    return {"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string())}


@pytest.fixture(scope="session")
def empty(tmp_path_factory, awkward) -> str:
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages", "benchmark", "embeddings", "conversations"):
        pq.write_table(pq.read_table(f"{awkward}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    return str(d)


@pytest.fixture(params=["small", "awkward"])
def sf_dir(request, awkward) -> str:
    return SMALL if request.param == "small" else awkward


def rows_of(sf_dir: str, name: str) -> list[dict]:
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()
