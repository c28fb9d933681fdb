"""Katz backoff scoring of texts with an n-gram model of the corpus itself.

Texts are read once into blocks: token numbers of a block's own vocabulary, beside that vocabulary. An n-gram ends in a token and may
start with the start of its text. For every order, each block deals its distinct n-grams with their counts to buckets by a 96-bit
hash; a bucket adds up equal ones and sends the totals back, in the order it was asked, with two bits: whether the block owns the n-gram
(one of those that hold it does) and whether it occurs in a held-out text. From order 3 on, an n-gram need not be dealt where its parts
tell its total: no more than theirs, and all of it in this block.

Model: every order has Good-Turing discounts for counts up to ``K`` and keeps every n-gram, those seen once too. Words never seen share
one unknown event. The backoff weight of a history makes its distribution sum to 1 exactly: one less the discounted shares of what
followed it, over one less the lower order's probabilities of the same words. Blocks add both up for the n-grams that they own, buckets
add up the blocks. A history whose followers may all be without a discount counts one more occurrence, so that mass is always left.
A token's probability is its discounted n-gram where that was seen, else the weight of its history times its probability given the
history less its first token, and so on down to words; a history never seen has weight 1.

Tables: blocks, bucketed by block; per order the totals, and the masses of histories, partitioned by bucket (about ``BUCKET_GRAMS``
n-grams each, and one per block of every frequent one). They lie in the shared folder, and only the scores stay there.

Edge cases: a null or empty text is its end token alone. Texts whose doc_id is null are trained on. An empty table gives no rows; with no
training rows every word is unknown. Repeated rows are scored once per row and counted each. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.common import SPACE_WORDS, arrow, brief_shuffles, crc_remainder, new_path, record_batch, remove, slices, text_bytes, written

ORDER = 3
K = 5
BLOCK_TOKENS = 3 << 19
BUCKET_GRAMS = 1 << 20
#: Partitions of any step at most, and buckets of the table of blocks: Spark takes no more than 100,000 of these. Beyond, a partition holds several
#: blocks or buckets, which stay groups of the same size.
MOST_PARTITIONS = 50_000
#: Bytes of a hash.
KEY = 12
HELD_OUT_MOD, HELD_OUT = 5, 1

#: The end of a text as a token (no word contains a space), number 0 of every block's vocabulary; the start of a text as a history.
END, START = b" ", b"  "
_MASKS = (0xFFFFFFFFFFFFFFFF, 0xFFFFFFFF)
_LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))

BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("held_out", T.ArrayType(T.BooleanType())),
        T.StructField("tokens", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
    ]
)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype)


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks of about ``BLOCK_TOKENS`` tokens, numbered by each block's own vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(BLOCKS)
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        total = 0

        def block() -> pa.RecordBatch:
            ids, out, lengths, words = zip(*held, strict=True)
            codes = pa.concat_arrays(words).dictionary_encode()
            lengths = np.concatenate(lengths)
            tokens = np.zeros(int(lengths.sum()), "<u4")  # the end is number 0
            inside = np.ones(len(tokens), bool)
            inside[np.cumsum(lengths) - 1] = False
            tokens[inside] = codes.indices.to_numpy() + 1
            return record_batch(schema, [[number], [[i for some in ids for i in some]], [lengths], [np.concatenate(out)], [_pack(tokens)], [b" ".join(codes.dictionary.to_pylist())]])

        for batch in slices(batches, "text", BLOCK_TOKENS // 2):
            texts = pa.array([t.translate(SPACE_WORDS) for t in batch.column("text").to_pylist()], pa.binary())
            cut = pc.split_pattern(texts, b" ")
            words = cut.flatten()
            some = pc.greater(pc.binary_length(words), 0)
            upto = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
            lengths = np.diff(upto[cut.offsets.to_numpy() - cut.offsets[0].as_py()]) + 1
            held.append((batch.column("doc_id").to_pylist(), batch.column("held_out").to_numpy(zero_copy_only=False), lengths, words.filter(some)))
            total += int(lengths.sum())
            if total >= BLOCK_TOKENS:
                yield block()
                number += 1
                held, total = [], 0
        if held:
            yield block()

    held_out = F.coalesce(crc_remainder("doc_id", HELD_OUT_MOD) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_bytes().alias("text")).mapInArrow(run, BLOCKS)


class Words:
    """Hashes of words, by lane."""

    def __init__(self, digests: np.ndarray):
        self.digests = digests

    def lane(self, i: int) -> np.ndarray:
        return self.digests[i]


def _both(which: np.ndarray, out: np.ndarray, n: int) -> np.ndarray:
    """Per n-gram, how often training texts and held-out texts have it."""
    return np.bincount(which << 1 | out, minlength=2 * n).reshape(n, 2)


@dataclass(eq=False)
class Level:
    """The distinct n-grams of one order in a block.

    ``which`` has each token's (-1: none); ``history`` and ``suffix`` are places in the level below, ``last`` the word. ``parts`` are the
    hashes of histories and words. ``count`` is the training count, ``out`` whether a held-out text of the block has it; the rest is
    what buckets know of all blocks.
    """

    which: np.ndarray
    history: np.ndarray
    suffix: np.ndarray
    last: np.ndarray
    both: np.ndarray
    parts: tuple
    total: np.ndarray | None = None
    owned: np.ndarray | None = None
    held: np.ndarray | None = None
    made: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def count(self) -> np.ndarray:
        return self.both[:, 0]

    @property
    def out(self) -> np.ndarray:
        return self.both[:, 1] > 0

    def lane(self, i: int) -> np.ndarray:
        """Half ``i`` of the hashes: 64 bits of the first, 32 of the second."""
        if i not in self.made:
            histories, words = self.parts
            x = histories(i)[self.history] * np.uint64(_LANES[i][0]) + words(i)[self.last]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(_LANES[i][1])
            self.made[i] = (x ^ (x >> np.uint64(29))) & np.uint64(_MASKS[i])
        return self.made[i]


class Block:
    """A row of the blocks with its levels up to an order."""

    def __init__(self, row: dict, order: int):
        self.row = row
        tokens = _unpack(row["tokens"], "<u4").astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        out = np.repeat(np.array(row["held_out"], np.int64), self.lengths)
        words = [END, *(row["words"].split(b" ") if row["words"] else []), START]
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2).T & np.array(_MASKS, np.uint64)[:, None]
        n = len(words) - 1
        self.words, self.histories = Words(digests[:, :n]), Words(digests)
        none = np.zeros(0, np.int64)
        self.levels = [Level(tokens, none, none, none, _both(tokens, out, n), ())]
        first = np.zeros(len(tokens), bool)
        first[self.starts] = True
        for k in range(2, order + 1):
            below = self.levels[-1].which
            history = np.concatenate(([-1], below[:-1]))
            history[first] = n if k == 2 else -1  # the start of a text is the last of the words' histories
            at = None if k == 2 else np.flatnonzero(history >= 0)  # every token has a bigram
            keys, inverse = np.unique((history << 32 | tokens) if at is None else (history[at] << 32 | tokens[at]), return_inverse=True)
            last = keys & 0xFFFFFFFF
            if at is None:
                which, suffix, both = inverse, last, _both(inverse, out, len(keys))
            else:
                which = np.full(len(tokens), -1, np.int64)
                which[at] = inverse
                suffix = np.empty(len(keys), np.int64)
                suffix[inverse] = below[at]
                both = _both(inverse, out[at], len(keys))
            self.levels.append(Level(which, keys >> 32, suffix, last, both, (self.histories.lane if k == 2 else self.levels[-1].lane, self.words.lane)))

    def lanes(self, k: int):
        return self.words.lane if k == 1 else self.levels[k - 1].lane

    def history_lanes(self, k: int):
        """Hashes of the histories of order ``k``."""
        return self.histories.lane if k == 2 else self.levels[k - 2].lane

    def dealt(self, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of order ``k`` that buckets must add up, by bucket, and where each bucket starts. What the parts tell is settled here."""
        level = self.levels[k - 1]
        wanted = np.arange(len(level.both))
        level.total, level.owned, level.held = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        if k > 2:
            below = self.levels[k - 2]
            most = np.minimum(below.total[level.history], below.total[level.suffix])
            never = most == 0
            whole = ~never & (most == level.count) & ~(below.held[level.history] & below.held[level.suffix])
            level.total[whole], level.owned[whole], level.held[whole] = level.count[whole], True, False
            wanted = np.flatnonzero(~never & ~whole)
        return _by_bucket(self.lanes(k)(0), wanted, buckets)

    def answer(self, k: int, buckets: int, rows: list[dict]) -> None:
        """Take in the totals of order ``k``."""
        at, _ = self.dealt(k, buckets)
        level = self.levels[k - 1]
        if len(at):
            rows = sorted((r for r in rows if r["totals"] is not None), key=lambda r: r["bucket"])
            level.total[at] = np.concatenate([_unpack(r["totals"], f"<u{r['width']}").astype(np.int64) for r in rows])
            for name, bit in (("owned", 1), ("held", 2)):
                getattr(level, name)[at] = np.concatenate([_unpack(r["bits"], np.uint8) for r in rows]) & bit > 0


def _by_bucket(hashes: np.ndarray, wanted: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((hashes if len(wanted) == len(hashes) else hashes[wanted]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return wanted[order], np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def _keys(lanes, at: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The hashes of every bucket: the long halves, then the short ones."""
    high, low = lanes(0)[at], lanes(1)[at].astype("<u4")
    return [high[a:b].tobytes() + low[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _grouped(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys of ``rows`` together, and where each key starts in it."""
    sizes = [len(r["keys"]) // KEY for r in rows]
    high = np.concatenate([np.frombuffer(r["keys"], "<u8", n) for r, n in zip(rows, sizes, strict=True)])
    low = np.concatenate([np.frombuffer(r["keys"], "<u4", n, 8 * n) for r, n in zip(rows, sizes, strict=True)])
    order = np.argsort(high)
    sorted_high, sorted_low = high[order], low[order]
    same = sorted_high[1:] == sorted_high[:-1]
    if (same & (sorted_low[1:] != sorted_low[:-1])).any():
        order = np.lexsort((low, high))
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    return order, np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)


ASKED = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("keys", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("out", T.BinaryType()),
        T.StructField("tally", T.ArrayType(T.LongType())),
    ]
)
TOTALS = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("totals", T.BinaryType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("tally", T.ArrayType(T.LongType())),
    ]
)


def _tally(total: np.ndarray) -> list[int]:
    """How many n-grams occur 1 to K + 1 times, how many at all, and all their occurrences."""
    return [*np.bincount(np.minimum(total, K + 2), minlength=K + 2)[1 : K + 2].tolist(), int((total > 0).sum()), int(total.sum())]


def _ask(block: Block, k: int, buckets: int) -> list[dict]:
    at, ends = block.dealt(k, buckets)
    level = block.levels[k - 1]
    settled = _tally(level.total)
    keys, counts, out = _keys(block.lanes(k), at, ends), level.count[at].astype("<u4"), level.out[at]
    rows = []
    for b in np.flatnonzero(np.diff(ends)).tolist() or [0]:
        mine = slice(ends[b], ends[b + 1])
        rows.append({"bucket": b, "block": block.row["block"], "keys": keys[b], "counts": _pack(counts[mine]), "out": _pack(np.packbits(out[mine])), "tally": None if rows else settled})
    return rows


def _added(asked: DataFrame, buckets: int) -> DataFrame:
    """What each block is told about the n-grams that it asked for; a bucket's first row has its tally."""
    schema = arrow(TOTALS)

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        sizes = [len(r["keys"]) // KEY for r in rows]
        counts = np.concatenate([_unpack(r["counts"], "<u4") for r in rows]).astype(np.int64)
        out = np.concatenate([np.unpackbits(_unpack(r["out"], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)]).astype(np.int64)
        order, first = _grouped(rows)
        tally = np.sum([r["tally"] for r in rows if r["tally"] is not None] or [[0] * (K + 3)], axis=0)
        total = back = bits = np.zeros(0, np.int64)
        if len(order):
            total = np.add.reduceat(counts[order], first)
            held = np.add.reduceat(out[order], first) > 0
            times = np.diff(np.append(first, len(order)))
            back, bits = np.empty(len(order), np.int64), np.zeros(len(order), np.uint8)
            back[order] = np.repeat(total, times)
            bits[order] = np.repeat(held, times) * np.uint8(2)
            bits[order[first]] |= 1
        tally = (tally + _tally(total)).tolist()
        found, start = [], 0
        for r, n in zip(rows, sizes, strict=True):
            mine = back[start : start + n]
            width = 4 if not n or mine.max() < 1 << 32 else 8
            told = {"totals": _pack(mine.astype(f"<u{width}")), "width": width, "bits": _pack(bits[start : start + n])} if n else {"totals": None, "width": None, "bits": None}
            found.append({"bucket": r["bucket"], "block": r["block"], **told, "tally": None if found else tally})
            start += n
        return pa.Table.from_pylist(found, schema=schema)

    return asked.repartition(min(buckets, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(add, TOTALS)


def discounts(tally: list[int]) -> list[float]:
    """Good-Turing discount ratios of the counts 1 to K from how many types occur 1 to K + 1 times; 1 where they make no sense."""
    common = (K + 1) * tally[K] / tally[0] if tally[0] else 1.0
    out = []
    for r in range(1, K + 1):
        ratio = (r + 1) * tally[r] / (r * tally[r - 1]) if tally[r - 1] else 1.0
        d = (ratio - common) / (1 - common) if common < 1 else 1.0
        out.append(d if 0 < d < 1 else 1.0)
    return out


@dataclass
class Model:
    """Scalars of the model: discounts per order, and of words their number, kinds, discounted mass and the unknown event's share."""

    ratios: list[list[float]]
    train_tokens: int
    distinct: int
    mass: float
    unknown: float

    def discounted(self, k: int, total: np.ndarray) -> np.ndarray:
        return np.array([1.0, *self.ratios[k - 1], 1.0])[np.minimum(total, K + 1)] * total

    def occurrences(self, k: int, total: np.ndarray) -> np.ndarray:
        """How often a history before n-grams of order ``k`` counts: once more where none of its followers need have a discount."""
        sure = next((r for r, d in enumerate(self.ratios[k - 1]) if d == 1), K)
        return np.maximum(total + (total > sure), 1).astype(np.float64)

    def words(self, total: np.ndarray) -> np.ndarray:
        """Probabilities of seen words."""
        return self.discounted(1, total) / (self.mass or 1.0) * (1 - self.unknown)

    def seen(self, block: Block, k: int) -> np.ndarray:
        """Probabilities of the block's n-grams of order ``k``, right where they were seen."""
        level = block.levels[k - 1]
        if k == 1:
            return self.words(level.total)
        return self.discounted(k, level.total) / self.occurrences(k, _history_totals(block, k)[level.history])


def _history_totals(block: Block, k: int) -> np.ndarray:
    """Training counts of the histories of order ``k``; every text's start is followed once, as its end is reached once."""
    total = block.levels[k - 2].total
    return np.append(total, total[0]) if k == 2 else total


def model_of(tallies: list[list[int]]) -> Model:
    ratios = [discounts(t[: K + 1]) for t in tallies]
    *counts, distinct, n = tallies[0]
    mass = float(n) - sum(r * counts[r - 1] * (1 - d) for r, d in enumerate(ratios[0], 1))
    unknown = (n - mass + 1.0) / (n + 1.0) if n else 1.0  # what the discounts leave, and one more
    return Model(ratios, n, distinct, mass, unknown)


MASS = T.StructType(
    [T.StructField("order", T.IntegerType()), *ASKED.fields[:3], T.StructField("seen", T.BinaryType()), T.StructField("lower", T.BinaryType()), T.StructField("asks", T.BinaryType())]
)
WEIGHTS = T.StructType([T.StructField("order", T.IntegerType()), *ASKED.fields[:2], T.StructField("seen", T.BinaryType()), T.StructField("lower", T.BinaryType())])


def _unseen(block: Block, k: int) -> np.ndarray:
    """Histories of order ``k`` whose weight the block needs: seen in training, and before a token here that never followed them."""
    level = block.levels[k - 1]
    asked = np.unique(level.history[level.total == 0])
    return asked[_history_totals(block, k)[asked] > 0]


def _masses(block: Block, k: int, model: Model, buckets: int) -> list[dict]:
    """Discounted counts and lower probabilities of the followers that the block owns, of histories that a held-out text has."""
    level, below = block.levels[k - 1], block.levels[k - 2]
    n = len(_history_totals(block, k))
    held = np.append(below.held, True) if k == 2 else below.held
    mine = np.flatnonzero(level.owned & (level.total > 0) & held[level.history])
    h = level.history[mine]
    seen = np.bincount(h, model.discounted(k, level.total[mine]), minlength=n)
    lower = np.bincount(h, model.seen(block, k - 1)[level.suffix[mine]], minlength=n)
    asks = np.zeros(n, bool)
    asks[_unseen(block, k)] = True
    lanes = block.history_lanes(k)
    at, ends = _by_bucket(lanes(0), np.flatnonzero(asks | (seen > 0)), buckets)
    keys, seen, lower, asks = _keys(lanes, at, ends), seen[at], lower[at], asks[at]
    rows = []
    for b in np.flatnonzero(np.diff(ends)).tolist():
        mine = slice(ends[b], ends[b + 1])
        packed = {"seen": _pack(seen[mine]), "lower": _pack(lower[mine]), "asks": _pack(np.packbits(asks[mine]))}
        rows.append({"order": k, "bucket": b, "block": block.row["block"], "keys": keys[b], **packed})
    return rows


def _weighed(masses: DataFrame, buckets: int) -> DataFrame:
    """The masses of every history that a block asked for, in the order of its keys."""
    schema = arrow(WEIGHTS)

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        order, first = _grouped(rows)
        times = np.diff(np.append(first, len(order)))
        sums = {}
        for name in ("seen", "lower"):
            sums[name] = np.empty(len(order))
            sums[name][order] = np.repeat(np.add.reduceat(np.concatenate([_unpack(r[name], np.float64) for r in rows])[order], first), times)
        found, start = [], 0
        for r in rows:
            n = len(r["keys"]) // KEY
            asks = np.unpackbits(_unpack(r["asks"], np.uint8), count=n).astype(bool)
            if asks.any():
                found.append({c: r[c] for c in ("order", "bucket", "block")} | {c: _pack(s[start : start + n][asks]) for c, s in sums.items()})
            start += n
        return pa.Table.from_pylist(found, schema=schema)

    return masses.repartition(min(buckets, MOST_PARTITIONS), "bucket").groupBy("order", "bucket").applyInArrow(add, WEIGHTS)


SCORES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def _scored(block: Block, order: int, model: Model, weights: list[dict], buckets: int) -> list:
    """The columns of ``SCORES``: every token by its longest n-gram, from words upwards."""
    words = block.levels[0].total
    value = np.log10(np.where(words > 0, model.words(words), model.unknown))
    tokens = block.levels[0].which
    score = value[tokens]
    for k in range(2, order + 1):
        level = block.levels[k - 1]
        log_weight = np.zeros(len(_history_totals(block, k)))
        asked = _unseen(block, k)
        if len(asked):
            at, _ = _by_bucket(block.history_lanes(k)(0), asked, buckets)
            rows = sorted((w for w in weights if w["order"] == k), key=lambda w: w["bucket"])
            seen, lower = (np.concatenate([_unpack(w[c], np.float64) for w in rows]) for c in ("seen", "lower"))
            hc = model.occurrences(k, _history_totals(block, k)[at])
            log_weight[at] = np.log10((1 - seen / hc) / np.maximum(1 - lower, 1e-15))
        found = level.total > 0
        value = np.where(found, np.log10(np.where(found, model.seen(block, k), 1.0)), log_weight[level.history] + value[level.suffix])
        score = np.where(level.which >= 0, value[level.which] if len(value) else 0.0, score)
    base = np.log10((words + 0.5) / (model.train_tokens + 0.5 * (model.distinct + 1)))
    sums = [np.add.reduceat(x, block.starts) for x in ((words > 0)[tokens].astype(np.int64), base[tokens], score)]
    return [block.row["doc_ids"], block.row["held_out"], block.lengths, sums[0], np.full(len(block.lengths), model.train_tokens), *sums[1:]]


def _answered(row: dict, order: int, buckets: int, replies: list[dict]) -> Block:
    """A block of levels up to ``order`` with the totals that came for them."""
    block = Block(row, order)
    for k in range(1, order + 1):
        if any(r["k"] == k for r in replies):
            block.answer(k, buckets, [r for r in replies if r["k"] == k])
    return block


def _with_replies(blocks: DataFrame, replies: DataFrame, schema: T.StructType, make) -> DataFrame:
    """``make(row, replies)`` for every block, as rows of ``schema``."""

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        out = [b for row in block.to_pylist() for b in make(row, told.to_pylist())]
        return pa.Table.from_batches(out, schema=arrow(schema))

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def _totals(tables: dict[int, DataFrame]) -> DataFrame:
    out = None
    for k, t in tables.items():
        one = t.drop("tally").withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Base and model log10 probability of every row's text, by a model of n-grams up to ``order`` words."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = written(_blocks(docs), "katz-texts")
    n = first.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(shuffles, -(-n // BUCKET_GRAMS))
    # the blocks meet the replies of every order: dealt out once, and read by bucket from then on
    name = f"katz_blocks_{uuid.uuid4().hex}"
    dealt = min(MOST_PARTITIONS, max(shuffles, -(-n // BLOCK_TOKENS)))
    with brief_shuffles(spark):
        first.repartition(dealt, "block").write.format("parquet").option("compression", "zstd").option("path", new_path(spark, "katz-blocks")).bucketBy(dealt, "block").saveAsTable(name)
    remove(spark, first)
    try:
        return _scores_of(spark.table(name), order, buckets)
    finally:
        remove(spark, spark.table(name))
        spark.sql(f"DROP TABLE {name}")


def _scores_of(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    spark = blocks.sparkSession

    def asked(make, *columns: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield pa.RecordBatch.from_pylist(make(row), schema=arrow(ASKED))

        return blocks.select(*columns).mapInArrow(run, ASKED)

    totals: dict[int, DataFrame] = {}
    for k in range(1, min(order, 2) + 1):
        totals[k] = written(_added(asked(lambda row, k=k: _ask(Block(row, k), k, buckets), *[c for c in blocks.columns if c != "doc_ids"]), buckets), f"katz-totals-{k}")
    for k in range(3, order + 1):

        def more(row: dict, told: list[dict], k: int = k) -> list[pa.RecordBatch]:
            block = Block(row, k)
            for j in range(2, k):
                block.answer(j, buckets, [r for r in told if r["k"] == j])
            return [pa.RecordBatch.from_pylist(_ask(block, k, buckets), schema=arrow(ASKED))]

        totals[k] = written(_added(_with_replies(blocks, _totals({j: totals[j] for j in range(2, k)}), ASKED, more), buckets), f"katz-totals-{k}")
    tallies = []
    for k in range(1, order + 1):
        sums = totals[k].agg(*[F.coalesce(F.sum(F.element_at("tally", i)), F.lit(0)) for i in range(1, K + 4)]).first()
        tallies.append(list(sums))
    model = model_of(tallies)

    def masses(row: dict, told: list[dict]) -> list[pa.RecordBatch]:
        block = _answered(row, order, buckets, told)
        return [pa.RecordBatch.from_pylist([r for k in range(2, order + 1) for r in _masses(block, k, model, buckets)], schema=arrow(MASS))]

    every = _totals(totals)
    weights = written(_weighed(_with_replies(blocks, every, MASS, masses), buckets), "katz-masses")

    def scores(row: dict, told: list[dict]) -> list[pa.RecordBatch]:
        block = _answered(row, order, buckets, told)
        return [record_batch(arrow(SCORES), _scored(block, order, model, [r for r in told if r["k"] == 0], buckets))]

    both = every.unionByName(weights.withColumn("k", F.lit(0)), allowMissingColumns=True)
    out = written(_with_replies(blocks, both, SCORES, scores), "katz-scores")
    for table in (*totals.values(), weights):
        remove(spark, table)
    return out


def query(docs: DataFrame) -> DataFrame:
    return score(docs)
