"""Token counts by the whole-token shortcut.

``whole_tokens`` proves once which vocabulary strings, as pieces of a text, encode alone as exactly one token: the string must be
one piece under the file's pattern, and the library must give one id for it. Pieces in that set count as 1 without any merge; only
the others are merged, each distinct one once per worker. The set is bounded by the vocabulary, so it is broadcast.

Edge cases: a null or empty text has 0 bytes and 0 tokens. Special strings inside a text are one token each, the library's default.
Repeated rows are counted once per row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.bpe import CACHED_CHUNKS, CACHED_PIECES, Encoder, _Aged, _Chunks, encoder
from chromaframe.llm.common import arrow, record_batch, slices

LIMIT = 512


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one piece and one token."""
    enc = Encoder(path)
    byte = {c: b for b, c in enc.letters.items()}
    found = []
    for letters in enc.library.get_vocab(with_added_tokens=False):
        if enc.words:
            letters = letters.removesuffix("</w>") if letters.endswith("</w>") else ""
        try:
            text = bytes(byte[c] for c in letters).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and enc.certain(text) and enc.pattern.findall(text) == [text]:
            found.append(text)
    ids = enc.library.encode_batch_fast(found, add_special_tokens=False)
    return frozenset(t for t, e in zip(found, ids, strict=True) if len(e.ids) == 1)


class Counter:
    """Counts the tokens of texts; ``whole`` are the pieces that count as one."""

    def __init__(self, enc: Encoder, whole: frozenset[str]):
        self.enc, self.whole = enc, whole
        self.merged = _Aged(lambda piece: len(enc.tokens(piece)), CACHED_PIECES)
        self.chunks = _Chunks(enc, self._piece, CACHED_CHUNKS)

    def _piece(self, piece: str) -> int:
        """One token without a merge where that was proved, else what the merges leave."""
        return 1 if piece in self.whole else len(self.enc.tokens(piece))

    def _pieces(self, pieces: list[str]) -> int:
        rest = [p for p in pieces if p not in self.whole]
        return len(pieces) - len(rest) + sum(map(self.merged.__getitem__, rest))

    def _plain(self, text: str) -> int:
        enc = self.enc
        first = 0
        if enc.words:
            if any(c in text for c in enc.odd_spaces):
                return len(enc.library.encode(text, add_special_tokens=False).ids)
            chunks = text.split()
        else:
            head, *chunks = enc.chunks_of(text)
            if head and not enc.whole_only(head):
                first = self._pieces(enc.split(head))
            elif head:
                chunks = [""]  # taken whole
        try:
            return first + sum(map(self.chunks.__getitem__, chunks))
        except TypeError:  # a None among them
            pass
        if enc.certain(text):
            return self._pieces(enc.split(text))
        return len(enc.library.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if self.enc.mark not in text:
            return self._plain(text)
        parts = self.enc.cut.split(text)
        return len(parts) // 2 + sum(map(self._plain, parts[::2]))


COUNTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row's text, as the library counts them for the file at ``path``."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(COUNTED)
        counter = _COUNTERS.get(path)
        if counter is None:
            counter = _COUNTERS[path] = Counter(encoder(path), whole.value)
        for batch in slices(batches, "text"):
            n = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield record_batch(schema, [batch.column("doc_id"), batch.column("n_bytes"), n])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(count, COUNTED)


def query(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
