"""Fill-in-the-middle rearrangement by a piece table.

A document is a table of descriptors (buffer, first, end) over two buffers that never change: its own bytes and the marks. Cutting
splits a descriptor, an arrangement permutes the pieces and puts each behind its mark, the inverse permutation restores the order, and
hashes are fed descriptor by descriptor, so nothing is copied but an output that is asked for. Where to cut and how to arrange follow
from a hash of the id alone, so a document's result depends on nothing but its row, whatever the partitions, retries and
lost executors; nothing is shuffled. The work is one Arrow pass over the texts, one document at a time.

Defined results: a null text is an empty one, which is plain; a text that holds a mark is plain, as it could not be told apart again;
a null id is the empty string in the hash; rows that repeat an id are cut alike; a very long text is cut whole, with eight bytes a
unit and no more; cuts may coincide, so that pieces are empty; the result is one column, so names of other columns do not matter; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import unused

PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: Which piece comes where in each form.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
TEXT, MARKS = 0, 1
Descriptor = tuple[int, int, int]
PIECES = "array<struct<buffer: int, first: long, end: long>>"


@dataclass(frozen=True)
class Plan:
    """Of 100 documents ``rate`` are arranged, and of 100 of these ``spm`` with the suffix first. marks: of prefix, middle, suffix."""

    rate: int = 50
    spm: int = 80
    seed: str = "42"
    marks: tuple[str, str, str] = ("<P>", "<M>", "<S>")

    def __post_init__(self) -> None:
        firsts = {m[:1] for m in self.marks}
        if len(set(self.marks)) < 3 or "" in firsts or any(c in firsts for m in self.marks for c in m[1:]):
            raise ValueError("marks must differ, and none may hold the first character of one further on, or outputs could not be read again")

    def bytes_of_marks(self) -> list[bytes]:
        return [m.encode() for m in self.marks]


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where units end: words with the white space before them, and white space at the end."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(raw))


def split(table: list[Descriptor], at: int) -> list[Descriptor]:
    """The same document with a border at a place of it: the first piece that reaches it becomes two, of which one may be empty."""
    out, passed = [], 0
    for k, (buffer, first, end) in enumerate(table):
        size = end - first
        if at <= passed + size:
            return [*out, (buffer, first, first + at - passed), (buffer, first + at - passed, end), *table[k + 1 :]]
        out.append(table[k])
        passed += size
    raise IndexError(at)


def arranged(pieces: list[Descriptor], form: str, marks: list[bytes]) -> list[Descriptor]:
    """The three pieces in the order of a form, each behind its mark."""
    out: list[Descriptor] = []
    for k in ORDERS[form]:
        start = sum(map(len, marks[:k]))
        out += [(MARKS, start, start + len(marks[k])), pieces[k]]
    return out


def read_back(output: bytes, form: str, marks: list[bytes]) -> list[Descriptor]:
    """Descriptors over an output that give the document again: pieces between the marks, put back by the inverse permutation."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    order, found, at = ORDERS[form], [], 0
    for k in order:
        at = output.index(marks[k], at)
        found.append((at, at + len(marks[k])))
        at += len(marks[k])
    ends = [a for a, _ in found[1:]] + [len(output)]
    parts = [(TEXT, first, end) for (_, first), end in zip(found, ends, strict=True)]
    return [parts[order.index(k)] for k in (PREFIX, MIDDLE, SUFFIX)]


def bytes_of(table: list[Descriptor], buffers: tuple) -> Iterator[memoryview]:
    for buffer, first, end in table:
        yield buffers[buffer][first:end]


def sha256_of(table: list[Descriptor], buffers: tuple) -> str:
    """Fed piece by piece."""
    h = hashlib.sha256()
    for part in bytes_of(table, buffers):
        h.update(part)
    return h.hexdigest()


def _characters(raw: np.ndarray, piece: Descriptor) -> int:
    return int(np.count_nonzero((raw[piece[1] : piece[2]] & 0xC0) != 0x80))


def table_of(doc_id: int | None, raw: np.ndarray, data: bytes, plan: Plan) -> tuple[int, str, list[Descriptor], list[Descriptor]]:
    """Units, form, and the table of a document as it is and as it is arranged."""
    ends = unit_ends(raw)
    n, whole = len(ends), [(TEXT, 0, len(raw))]
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    marks = plan.bytes_of_marks()
    if not n or h3 % 100 >= plan.rate or any(m in data for m in marks):
        return n, "plain", whole, whole
    places = [int(ends[u - 1]) if u else 0 for u in sorted((h1 % (n + 1), h2 % (n + 1)))]
    pieces = split(split(whole, places[0]), places[1])
    form = "spm" if h4 % 100 < plan.spm else "psm"
    return n, form, pieces, arranged(pieces, form, marks)


def arrange(text: Column, doc_id: Column, plan: Plan = Plan(), outputs: bool = True) -> Column:
    """struct(n, form, prefix_chars, middle_chars, pieces, output_sha256, restored_sha256, output) of a text.

    pieces: the arranged table, byte ranges over the text (buffer 0) and the marks one after another (buffer 1). restored_sha256: of
    the text that the output, read again by its form, gives. output is null where outputs are not asked for.
    """
    fields = f"n long, form string, prefix_chars long, middle_chars long, pieces {PIECES}, output_sha256 string, restored_sha256 string, output string"
    types = pa.struct([
        ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
        ("pieces", pa.list_(pa.struct([("buffer", pa.int32()), ("first", pa.int64()), ("end", pa.int64())]))),
        ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.string()),
    ])
    marks = plan.bytes_of_marks()
    names = ("buffer", "first", "end")

    def one(doc_id: int | None, data: pa.Buffer) -> dict:
        raw, view = np.frombuffer(data, dtype=np.uint8), memoryview(data)
        n, form, pieces, table = table_of(doc_id, raw, data.to_pybytes(), plan)
        output = b"".join(bytes_of(table, (view, b"".join(marks))))
        again = read_back(output, form, marks)
        plain = form == "plain"
        return {
            "n": n, "form": form, "prefix_chars": None if plain else _characters(raw, pieces[PREFIX]), "middle_chars": None if plain else _characters(raw, pieces[MIDDLE]),
            "pieces": [dict(zip(names, d, strict=True)) for d in table], "output_sha256": sha256_of(table, (view, b"".join(marks))),
            "restored_sha256": sha256_of(again, (memoryview(output),)), "output": output if outputs else None,
        }

    @F.arrow_udf(f"struct<{fields}>")
    def run(texts: pa.Array, ids: pa.Array) -> pa.Array:
        nothing = pa.py_buffer(b"")
        rows = (one(i, t.as_buffer() if t.is_valid else nothing) for i, t in zip(ids.to_pylist(), texts, strict=True))
        return pa.array(rows, types)

    return run(text, doc_id)


def restore(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that an output of a form was made of."""
    marks = plan.bytes_of_marks()

    @F.arrow_udf("string")
    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        def one(o: pa.Scalar, f: str) -> bytes | None:
            data = o.as_buffer().to_pybytes() if o.is_valid else None
            return None if data is None else b"".join(bytes_of(read_back(data, f, marks), (data,)))

        return pa.array([one(o, f) for o, f in zip(outputs, forms.to_pylist(), strict=True)], pa.binary()).cast(pa.string())

    return run(output, form)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """docs with arranged texts in place of ``text``, and ``form`` under this name or one that no column has. Null texts become empty."""
    f = unused(docs.columns, "form")
    s = unused([*docs.columns, f], "_fim")
    rows = docs.withColumn(s, arrange(F.col(text), F.col(key), plan))
    return rows.select(*(F.col(s)["output"].alias(c) if c == text else F.col(c) for c in docs.columns), F.col(s)["form"].alias(f))
