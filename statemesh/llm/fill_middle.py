"""Fill-in-middle transformation with succinct rank and select over token boundaries.

The texts of a slice of rows are one run of bytes. A packed bitvector marks where tokens start, a second one where code points
start; a directory holds the number of ones before each block of 512 bits. A document's number of tokens is the total of ones
between its ends, a cut after k tokens is one ``select``, and the length of a part in code points is a difference of two ranks.
All of these run over whole arrays of documents; no token is ever made as an object. Nothing leaves the row: there is no shuffle.

A token is white space (20, 09-0D) and the run of other characters after it; white space at the very end is a token of its own.
The cuts, the form and the choice to leave a text as it is come from the sha256 of ``seed:id``, so they are the same in every
run, for any partitioning and on any executor.

Defined cases: null text is empty; an empty text and one that holds a marker stay plain; a null id hashes as no digits; rows
repeat as they do; columns of the input named as new ones are replaced; an empty table gives no rows. Texts are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import WHITE, release_memory

#: Words of 64 bits in a block of the directory.
BLOCK = 8
#: Rows whose texts are one bitvector.
SLICE = 256
_IS_WHITE = np.isin(np.arange(256), list(WHITE))


class BitVector:
    """Packed bits with a directory of the ones before each block."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1  # at least one word beyond the last bit, so that rank(len) has a word
        packed = np.zeros(-(-n // BLOCK) * BLOCK * 8, np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        self.words = packed.view("<u8")
        self.counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.counts.reshape(-1, BLOCK).sum(1))])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones there are before each position."""
        word = at >> 6
        block = word // BLOCK
        found = self.before[block]
        for j in range(BLOCK - 1):
            found = found + np.where(block * BLOCK + j < word, self.counts[block * BLOCK + j], 0)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return found + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of each one, counted from 0; k < ones."""
        block = np.searchsorted(self.before, k, "right") - 1
        left, word = k - self.before[block], block * BLOCK
        for _ in range(BLOCK - 1):
            on = left >= self.counts[word]
            left, word = np.where(on, left - self.counts[word], left), word + on
        x, at = self.words[word], word << 6
        for half in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= ones
            left, at = np.where(on, left - ones, left), at + half * on
            x = np.where(on, x >> np.uint64(half), x)
        return at


def token_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True where a token starts; begins: where the documents that are not empty begin."""
    white = _IS_WHITE[data]
    starts = white.copy()
    starts[1:] &= ~white[:-1]
    starts[begins] = True
    return starts


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def fill_middle(
    docs: DataFrame,
    seed: int = 42,
    percent: int = 50,
    spm_percent: int = 80,
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    columns: list[str] | None = None,
) -> DataFrame:
    """The columns of docs (or those named) with n, form (plain, psm, spm), prefix_chars, middle_chars and output.

    ``percent`` of the texts are cut; of these ``spm_percent`` have the suffix first. ``markers`` stand before prefix, suffix
    and middle.
    """
    ship(docs.sparkSession)
    new = [T.StructField(n, T.LongType()) for n in ("n", "prefix_chars", "middle_chars")]
    new = [new[0], T.StructField("form", T.StringType()), *new[1:], T.StructField("output", T.StringType())]
    own = [c for c in (docs.columns if columns is None else columns) if c not in {f.name for f in new}]
    schema = T.StructType([*(docs.schema[c] for c in own), *new])
    pre, suf, mid = (m.encode() for m in markers)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = [t or b"" for t in batch.column("_text").to_pylist()]
                lengths = np.array([len(t) for t in texts], np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                data = np.frombuffer(b"".join(texts), np.uint8)
                tokens, points = BitVector(token_starts(data, begins[lengths > 0])), BitVector((data & 0xC0) != 0x80)
                first = tokens.rank(begins)
                n = tokens.rank(ends) - first
                h = np.array([draws(seed, d) for d in batch.column("_id").to_pylist()], np.int64)
                cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                inside = cut < n[:, None]
                place = tokens.select(np.where(inside, first[:, None] + cut, 0)) if tokens.ones else np.zeros_like(cut)
                place = np.where(inside, place, ends[:, None])
                marked = np.array([pre in t or suf in t or mid in t for t in texts])
                plain = (lengths == 0) | marked | (h[:, 2] % 100 >= percent)
                spm = h[:, 3] % 100 < spm_percent
                start, a, b = points.rank(begins), points.rank(place[:, 0]), points.rank(place[:, 1])
                forms, outputs = [], []
                for t, p, s, (x, y) in zip(texts, plain.tolist(), spm.tolist(), (place - begins[:, None]).tolist()):
                    forms.append("plain" if p else "spm" if s else "psm")
                    outputs.append(t if p else suf + t[y:] + pre + t[:x] + mid + t[x:y] if s else pre + t[:x] + suf + t[y:] + mid + t[x:y])
                made = [
                    pa.array(n),
                    pa.array(forms, pa.string()),
                    pa.array(a - start, mask=plain),
                    pa.array(b - a, mask=plain),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *made], names=schema.names)
        release_memory()

    aside = docs.select(*own, F.col("doc_id").cast("string").alias("_id"), F.col("text").cast("binary").alias("_text"))
    return aside.mapInArrow(transform, schema)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made from. A text with a marker in it was left plain, so the first of each is the one put in."""
    where = {m: F.instr(output, m) for m in markers}
    pre, suf, mid = markers
    between = lambda a, b: F.substr(output, where[a] + len(a), where[b] - where[a] - len(a))
    rest = F.substr(output, where[mid] + len(mid))
    return (
        F.when(form == "psm", F.concat(between(pre, suf), rest, between(suf, mid)))
        .when(form == "spm", F.concat(between(pre, mid), rest, between(suf, pre)))
        .otherwise(output)
    )
