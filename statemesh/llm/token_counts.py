"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of pre-token lengths that is broadcast: every entry of the tokenizer's vocabulary that
is itself one whole pre-token, with the number of tokens the tokenizer gives it. A byte-pair vocabulary lists the
frequent strings of its language by construction, so this table needs no pass over the corpus and its size is bounded
by the vocabulary (``max_table`` is checked). Tier two is a cache in each worker: a pre-token that misses is encoded
once by the tokenizer itself; the cache is emptied when it holds ``max_cache`` entries, and pre-tokens over
``max_key`` bytes are encoded without being kept. No pre-token is ever shuffled: the plan is a scan and one map.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text count as the library's
default has them, one token each; bytes that are not UTF-8 are read as U+FFFD; rows repeat as they do in the input; other
columns, whatever their names, are left alone and not returned.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Fixed value: the byte-level pre-token pattern of the vocabulary's library.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Printable character -> byte of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def length_table(path: str, max_table: int = 200_000) -> dict[str, int]:
    """Lengths in tokens of the vocabulary's whole pre-tokens, as the tokenizer itself gives them."""
    from tokenizers import Tokenizer

    tok, letters, whole = Tokenizer.from_file(path), byte_alphabet(), regex.compile(BYTE_LEVEL)
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = []
    for entry in vocabulary:
        if all(c in letters for c in entry):
            try:
                text = bytes(letters[c] for c in entry).decode()
            except UnicodeDecodeError:
                continue
            if (m := whole.match(text)) and m.end() == len(text):
                words.append(text)
    if len(words) > max_table:
        raise ValueError(f"{len(words)} entries are more than the broadcast table may hold ({max_table})")
    tok.encode_special_tokens = True
    return {w: len(e.ids) for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False))}


class _Cache(dict):
    """Tier two over tier one: misses are encoded by the tokenizer."""

    def __init__(self, table: dict[str, int], tok, max_cache: int, max_key: int):
        super().__init__(table)
        self.table, self.tok, self.most, self.max_key = table, tok, len(table) + max_cache, max_key

    def __missing__(self, word: str) -> int:
        n = len(self.tok.encode(word, add_special_tokens=False).ids)
        if len(word) <= self.max_key:
            if len(self) >= self.most:
                self.clear()
                self.update(self.table)
            self[word] = n
        return n


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, max_cache: int = 400_000, max_key: int = 256
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    special = [t.content for t in Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder().values()]
    shared = spark.sparkContext.broadcast((length_table(tokenizer_path), tokenizer_path, special))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, path, marks = shared.value
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True  # a miss is a piece of ordinary text
        length = _Cache(table, tok, max_cache, max_key).__getitem__
        pieces = regex.compile(BYTE_LEVEL).findall
        cut = regex.compile("|".join(map(regex.escape, sorted(marks, key=len, reverse=True)))) if marks else None
        for batch in batches:
            sizes, counts = [], []
            for raw in batch.column("body").to_pylist():
                raw = raw or b""
                text = raw.decode("utf-8", "replace")
                n = 0
                parts = [text]
                if cut is not None and any(m in text for m in marks):
                    parts = cut.split(text)
                    n = len(parts) - 1
                for part in parts:
                    n += sum(map(length, pieces(part)))
                sizes.append(len(raw))
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(count, schema)
