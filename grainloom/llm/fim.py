"""Fill-in-the-middle documents, cut at line ends that a Fenwick tree over fixed blocks of the text finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a block of text.
BLOCK = 4096
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class Fenwick:
    """Line ends and code points of the blocks of a text; both are summed along the same descent.

    A line is [^\\n]*\\n or a last [^\\n]+; it belongs to the block in which it ends.
    """

    def __init__(self, text: np.ndarray, block: int = BLOCK):
        self.text, self.block = text, block
        starts = np.arange(0, len(text), block)
        self.size = len(starts)
        lines = np.add.reduceat(text == 10, starts, dtype=np.int64) if self.size else np.zeros(0, np.int64)
        chars = np.add.reduceat((text & 0xC0) != 0x80, starts, dtype=np.int64) if self.size else np.zeros(0, np.int64)
        if self.size and text[-1] != 10:
            lines[-1] += 1
        self.n = int(lines.sum())
        self.lines, self.chars = [0, *lines.tolist()], [0, *chars.tolist()]
        for i in range(1, self.size + 1):
            up = i + (i & -i)
            if up <= self.size:
                self.lines[up] += self.lines[i]
                self.chars[up] += self.chars[i]

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first k lines."""
        if k == 0:
            return 0, 0
        at, chars = 0, 0
        step = 1 << (self.size.bit_length() - 1)
        while step:  # the last block before which fewer than k lines end
            if at + step <= self.size and self.lines[at + step] < k:
                at += step
                k -= self.lines[at]
                chars += self.chars[at]
            step >>= 1
        part = self.text[at * self.block : (at + 1) * self.block]
        ends = np.flatnonzero(part == 10)
        end = int(ends[k - 1]) + 1 if k <= len(ends) else len(part)
        return at * self.block + end, chars + int(np.count_nonzero((part[:end] & 0xC0) != 0x80))


def transformed(text: bytes, digest: str, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output of one text; digest: hexadecimal, 32 digits at least."""
    tree = Fenwick(np.frombuffer(text, np.uint8))
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= fim_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return tree.n, "plain", None, None, text
    a, b = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
    (i, before), (j, upto) = tree.cut(a), tree.cut(b)
    first, middle, last = text[:i], text[i:j], text[j:]
    if h4 % 100 < spm_percent:
        return tree.n, "spm", before, upto - before, b"".join((SUFFIX, last, PREFIX, first, MIDDLE, middle))
    return tree.n, "psm", before, upto - before, b"".join((PREFIX, first, SUFFIX, last, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n long, form string, prefix_chars and middle_chars long, and output string, the text to train on.

    A text has n lines ([^\\n]*\\n or a last [^\\n]+); two cuts between lines part it in prefix, middle and suffix. The cuts and
    the form are hashed from the seed and the id (a null id: the word null), so rows of equal ids and texts come out equal. The
    form is plain, and the output the text itself, for empty texts, texts that hold a mark, and 100 - fim_percent of a hundred
    others; then prefix_chars and middle_chars (code points) are null. Of the rest, spm_percent of a hundred are
    spm (suffix, prefix, middle), the others psm. A null text is an empty one. Texts are never cut short: a text is held
    once, with counts for each block of 4 KB. An empty table stays empty. Columns named like those added are replaced,
    others pass, whatever their names.
    """
    if {id_col, text_col} & set(ADDED):
        raise ValueError(f"columns of ids and texts can't be called {', '.join(ADDED)}")
    docs = docs.withColumn(text_col, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).cast("binary"), 256)
    names = [c for c in docs.columns if c not in ADDED]
    at, n = names.index(text_col), len(names)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], hashed.alias(f"c{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, at):
                out = [transformed(t.as_buffer().to_pybytes(), h, fim_percent, spm_percent) for t, h in zip(b.column(at), b.column(n).to_pylist())]
                cols = list(zip(*out)) or [()] * 5
                more = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *more, pa.array(cols[4], pa.binary()).cast(pa.string())], names=[f"c{i}" for i in range(n + 5)])

    kinds = ", ".join(f"c{i} {k}" for i, k in enumerate([*(f.dataType.simpleString() for f in rows.schema.fields[:n]), "bigint", "string", "bigint", "bigint", "string"]))
    out = rows.mapInArrow(run, kinds)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *[F.col(f"c{n + i}").alias(c) for i, c in enumerate(ADDED)])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, exactly."""
    body = F.substring(output, 4, 2_147_483_647)

    def three(text: Column, mark: str) -> tuple[Column, Column, Column]:
        """Up to the mark, from there up to the mark of the middle, and after that: each mark occurs once."""
        first = F.substring_index(text, mark, 1)
        rest = F.substring_index(text, mark, -1)
        return first, F.substring_index(rest, MIDDLE.decode(), 1), F.substring_index(rest, MIDDLE.decode(), -1)

    prefix, suffix, middle = three(body, SUFFIX.decode())
    last, first, inner = three(body, PREFIX.decode())
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, inner, last)).otherwise(output)
