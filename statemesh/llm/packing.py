"""Packing by concatenate and cut.

Pass one tokenises every document once and stores chunks of consecutive documents (at most ``chunk_docs`` documents and,
but for a longer single document, ``chunk_tokens`` tokens) with their ids and token totals. Prefix sums give offsets:
over the chunks of a part, and over the parts, one row each; only these narrow totals are sorted. Pass two reads the
stored ids, adds its chunk's offset and cuts at every multiple of the window: sequence = offset div window. A document
that crosses a window's end leaves boundary records: each piece carries its start within the document, so documents can
be put together again. Only the last sequence can be shorter than the window, so padding is below one window in all.

Defined cases: null text is empty and still holds the end id; a document longer than a window spans several sequences;
repeated rows are packed again; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import n_partitions, pack, release_memory, stored_by_chunk, unpack


#: Punctuation that ends words: a pre-token of its own after letters.
_TAIL = ".,;:!?"
#: Punctuation before a comma or stop: such a run is one pre-token and stays whole.
_RUN = re.compile(r"[.,](?<=[^\w\s][.,])|[.,](?<=_[.,])").search
#: By tokenizer file, so that the tasks of one worker process share what they have learnt.
_WORD_IDS: dict[str, WordIds] = {}


class WordIds:
    """Ids of stretches of text without blank or newline, kept as bytes in two generations of bounded size.

    Cutting at blanks and newlines, always white space for this kind of tokenizer, keeps every pre-token whole. Words of
    letters only are one pre-token each: the new ones of a batch are encoded together and parted where a token ends a
    word. Everything else is encoded alone.
    """

    def __init__(self, path: str, most: int = 500_000, max_key: int = 256):
        from tokenizers import Tokenizer

        self.tok, self.most, self.max_key = Tokenizer.from_file(path), most, max_key
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _alone(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _together(self, words: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some):  # a letter that the tokenizer takes for something else
                found |= {w: self._alone(w) for w in some}
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist()):
                found[w] = raw[start:end]
                start = end
        return found

    def _learn(self, words: set[str]) -> None:
        known, old = self.known, self.old
        split, cores, rest = [], set(), []
        for w in words:
            ids = old.get(w)
            if ids is not None:
                known[w] = ids
                continue
            core = w.rstrip(_TAIL)
            if len(w) <= self.max_key and core.isalpha() and core.lower().isalpha():  # some letters are lowered to more than letters
                split.append((w, core, w[len(core) :]))
                cores.add(core)
            else:
                rest.append(w)
        found = {c: ids for c in cores if (ids := known.get(c) or old.get(c)) is not None}
        found |= self._together([c for c in cores if c not in found])
        for w, core, tail in split:
            if tail and tail not in known:
                known[tail] = self._alone(tail)
            known[w] = found[core] + known[tail] if tail else found[core]
        for w in rest:
            known[w] = self._alone(w)

    @staticmethod
    def _words(text: str) -> list[str]:
        """Stretches to look up. Lower case, and a comma or stop after a letter or digit apart: fewer to learn, equal ids."""
        # a final sigma is lowered by its context, which the tokenizer does not do
        low = text.replace("\u03a3", "\u03c3").lower()
        if "\u0130" in text or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
            return text.replace("\n", " ").split(" ")  # the tokenizer composes marks before it lowers
        text = low
        if not _RUN(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._words(t) for t in texts]
        if missing := set().union(*split).difference(self.known):
            if len(self.known) + len(missing) > self.most:
                self.known, self.old = {}, self.known
                missing = set().union(*split)
            self._learn(missing)
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in missing:
            if len(w) > self.max_key:
                self.known.pop(w, None)
        return out


def word_ids(path: str) -> WordIds:
    """This process's WordIds. A function of the module: what a task's own closure names would be copied for each task."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def tokenised(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, chunk_docs: int = 512, chunk_tokens: int = 1 << 20
) -> DataFrame:
    """Chunks (chunk, part, doc_ids, lengths, total, ids) of documents in the order of the scan."""
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("part", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("total", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        part, block = TaskContext.get().partitionId(), 0
        held_ids, held, size = [], [], 0

        def chunk() -> pa.RecordBatch:
            lengths = [len(b) // 4 for b in held]
            row = [(part << 32) + block], [part], [held_ids], [lengths], [sum(lengths)], [pack(np.frombuffer(b"".join(held), "<u4"))]
            types = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 256):
                part_of = batch.slice(at, 256)
                texts = [(x or b"").decode("utf-8", "replace") for x in part_of.column("body").to_pylist()]
                for doc_id, ids in zip(part_of.column("doc_id").to_pylist(), words.encode(texts)):
                    if held and (len(held) == chunk_docs or size + len(ids) // 4 >= chunk_tokens):
                        yield chunk()
                        held_ids, held, size, block = [], [], 0, block + 1
                    held_ids.append(doc_id)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
        if held:
            yield chunk()
        release_memory()

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(encode, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids."""
    spark = docs.sparkSession
    ship(spark)
    table = stored_by_chunk(tokenised(docs, tokenizer_path, end_id), "packing", n_partitions(spark))
    totals = table.select("chunk", "part", "total")
    parts = totals.groupBy("part").agg(F.sum("total").alias("in_part"))
    # One row per part of the scan: the only prefix sum in a single task; no document passes through it.
    bases = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("base"))
    ahead = totals.select(
        "chunk",
        "part",
        (F.sum("total").over(Window.partitionBy("part").orderBy("chunk")) - F.col("total")).alias("ahead"),
    )
    starts = ahead.join(bases, "part").select("chunk", (F.col("base") + F.col("ahead")).alias("at"))
    out = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
            *([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else []),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field("doc_ids").type.value_type, *[pa.int64()] * 6, pa.list_(pa.int32())][: len(out)]
            for row in batch.to_pylist():
                ids, at, first = unpack(row["ids"], "<u4"), row["at"], 0
                cols: list[list] = [[] for _ in out]
                for doc_id, n in zip(row["doc_ids"], row["lengths"]):
                    done = 0
                    while done < n:
                        place = at + first + done
                        length = min(n - done, window - place % window)
                        own = ids[first + done : first + done + length]
                        piece = (doc_id, done, length, zlib.crc32(own), n, place // window, place % window, own.astype(np.int32))
                        for c, v in zip(cols, piece):
                            c.append(v)
                        done += length
                    first += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=out.names)

    joined = table.select("chunk", "doc_ids", "lengths", "ids").join(starts, "chunk")
    return joined.select("doc_ids", "lengths", "ids", "at").mapInArrow(cut, out)
