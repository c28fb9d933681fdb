"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

One pass over the texts finds candidates: the four base kinds by their exact definitions, looser shapes (see ``LOOSE``), and near misses
that show what personal data is not: digit runs of a card's length without its checksum, dotted numbers out of range, addresses without a
domain, long codes without a keyword. Every candidate carries the votes of ``LABELERS`` (pattern and checksum, gazetteer, context words,
neighbourhood, digit variety) in -1, 0, 1 and a coarse shape. Votes are counted over all documents by (kind, votes, shape): at most a few
thousand distinct rows, whatever the input. On those, expectation-maximisation estimates each labeler's reliability per class without any
true label, and its posteriors train a logistic span classifier. Base spans always stay; other candidates stay where the classifier says so.

``redact`` numbers the rows itself, so null and repeated doc_ids and columns of any name are no matter. Edge cases: a null or empty text
has no spans; base_sha256 is then the digest of the empty string. Digit runs of any length are
handled without conversion to numbers. All patterns run in time linear in the text. Repeated rows are reported once per row; other
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.common import arrow, record_batch, slices, written

#: Kinds in the order of reports: the base kinds, then those that only the method finds.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# (?<![0-9]): where a run of digits fails from its first digit it fails from every other
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_BARE_EMAIL = re.compile(r"@[A-Za-z0-9-]+(?![A-Za-z0-9-]|\.[A-Za-z0-9-])")
_CODE = re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*[0-9])(?=[0-9_/+=-]*[A-Za-z])[A-Za-z0-9_/+=-]{32,}")

#: Looser shapes, by kind.
LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}){1,4}"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"(?i:\b(?:api[_-]?key|token|secret|password|passwd|access[_-]?key))[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9_/+=-]{16,}"),
}

#: Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov io co info biz de fr es it uk us ca au nl eu ch at be pl ru cn jp in br".split())
COUNTRIES = frozenset("AD AT BE CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
CONTEXT = {
    "email": ("mail", "contact", "write to", "from:", "to:"), "ip": ("ip", "address", "host", "server", "login"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social", "security"), "secret": ("token", "key", "secret", "passw"),
}
COUNTER_CONTEXT = ("version", "v.", "isbn", "order", "invoice", "figure", "fig.", "chapter", "section", "page", "test", "dummy", "commit", "sha", "checksum", "serial")
SECRET_PREFIXES = ("ghp_", "gho_", "sk-", "sk_live_", "AKIA", "xoxb-", "xoxp-", "glpat-", "AIza")

LABELERS = ["pattern", "gazetteer", "context", "neighbours", "variety"]
#: What their votes count before anything is estimated, and how much better than chance they are held to be where little is seen; the
#: last two mostly agree with every candidate.
FIRST_WEIGHTS = np.array([2, 1, 1, 0.5, 0.5])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str, missed: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base definitions: leftmost non-overlapping per kind, then failing matches dropped, into ``missed`` if given."""
    out = []
    missed = [] if missed is None else missed
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                last = m.end()
    if not _HAS_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
        else:
            missed.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
        elif 13 <= len(digits) <= 19:
            missed.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
            else:
                missed.append((3, *m.span()))
    return out


_HAS_DIGIT = re.compile("[0-9]")
_SECRET_HINT = re.compile(r"[:=]\x20?[\"']?[A-Za-z0-9_/+=-]{16}")


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "at]" in text or "at )" in text or "at)" in text or "at ]" in text:
        out += [(0, *m.span()) for m in LOOSE["email"].finditer(text)]
    if _HAS_DIGIT.search(text):
        for kind in ("phone", "iban", "ssn"):
            out += [(KINDS.index(kind), *m.span()) for m in LOOSE[kind].finditer(text)]
    if _SECRET_HINT.search(text):
        out += [(KINDS.index("secret"), *m.span()) for m in LOOSE["secret"].finditer(text)]
    return out


def near_misses(text: str, missed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What only looks like a kind: ``missed`` base matches, addresses without a domain, long codes."""
    out = list(missed)
    if "@" in text:
        for m in _BARE_EMAIL.finditer(text):
            start = m.start()
            while start and m.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
    if _HAS_DIGIT.search(text):
        out += [(KINDS.index("secret"), *m.span()) for m in _CODE.finditer(text)]
    return out


def text_candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all candidates; others leave room to base spans, and near misses to looser ones."""
    missed: list[tuple[int, int, int]] = []
    taken = base_spans(text, missed)
    out = [(*c, True) for c in taken]
    loose = [c for c in loose_spans(text) if not any(b[0] == c[0] and b[1] < c[2] and c[1] < b[2] for b in taken)]
    taken = sorted((c[1], c[2]) for c in taken + loose)
    reach, ends = 0, []
    for _, end in taken:
        reach = max(reach, end)
        ends.append(reach)
    starts = [a for a, _ in taken]
    for c in near_misses(text, missed):
        at = bisect_left(starts, c[2])  # those that start before its end
        if not at or ends[at - 1] <= c[1]:
            loose.append(c)
    return out + [(*c, False) for c in loose]


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """What each labeler says about a candidate: 1 personal data, -1 not, 0 no opinion."""
    name, found = KINDS[kind], text[start:end]
    digits = _digits(found)
    pattern = 1
    if name == "iban":
        plain = found.replace(" ", "")
        turned = plain[4:] + plain[:4]
        pattern = 1 if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else -1
    elif name == "ssn":
        pattern = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif name == "secret":
        value = re.split(r"[:=]", found, maxsplit=1)[-1]
        pattern = 1 if LOOSE["secret"].match(found) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) else -1
    elif not base:
        if name == "email":
            pattern = 0 if any(c in found for c in "[(") else -1
        elif name == "phone":
            pattern = -1 if found[0] == "+" or digits[0] in "01" else 1
        else:
            pattern = 1 if name == "card" and luhn(digits) else -1
    gazetteer = 0
    if name == "email":
        gazetteer = 1 if re.split(r"[. )\]@]", found.lower())[-1] in TOP_DOMAINS else -1
    elif name == "iban":
        gazetteer = 1 if found[:2] in COUNTRIES else -1
    elif name == "ip":
        gazetteer = -1 if not base or found.split(".")[0] in ("0", "127", "255") else 0
    elif name == "card":
        gazetteer = 1 if digits[0] in "3456" else -1
    elif name == "phone":
        gazetteer = -1 if digits[0] == "0" else 0
    elif name == "secret":
        gazetteer = 1 if any(p in found for p in SECRET_PREFIXES) else 0
    near = text[max(0, start - 40) : start].lower()
    own = name == "secret" and LOOSE["secret"].match(found) is not None  # the keyword is in the span
    context = 1 if own or any(w in near for w in CONTEXT[name]) else -1 if name == "secret" or any(w in near for w in COUNTER_CONTEXT) else 0
    before, after = text[start - 1 : start], text[end : end + 1]
    neighbours = -1 if before.isalnum() or after.isalnum() else 1
    variety = 0 if not digits else -1 if len(set(digits)) <= 2 and len(digits) > 6 else 1
    return [pattern, gazetteer, context, neighbours, variety]


_SPAN = [T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
CANDIDATE = T.StructType([*_SPAN, T.StructField("base", T.BooleanType()), T.StructField("key", T.IntegerType())])
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("found", T.ArrayType(CANDIDATE))])

_SHAPES = 4  # by length of the span: under 12, 20, 32 characters, longer


def _key(kind: int, said: list[int], length: int) -> int:
    """Kind, votes and shape as one number."""
    key = kind
    for v in said:
        key = key * 3 + v + 1
    return key * _SHAPES + sum(length >= n for n in (12, 20, 32))


def _unkey(key: int) -> tuple[int, list[int], int]:
    key, shape = divmod(key, _SHAPES)
    said = []
    for _ in LABELERS:
        key, v = divmod(key, 3)
        said.append(v - 1)
    return key, said[::-1], shape


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans (code points) of every row, with their votes as ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(FOUND)
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                out.append([{"kind": k, "start": a, "end": b, "base": own, "key": _key(k, votes(text, k, a, b, own), b - a)} for k, a, b, own in text_candidates(text)])
            yield record_batch(schema, [batch.column("doc_id"), out])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, FOUND)


@dataclass
class Model:
    """``reliability[j, y, v]``: how often labeler j votes v - 1 on spans of class y; ``probability`` by key, from the classifier."""

    reliability: np.ndarray
    prior: float
    probability: dict[int, float]

    def reliabilities(self) -> dict[str, tuple[float, float]]:
        """Per labeler, how often a vote for or against is right, by the classes' own estimate."""
        yes, no = self.prior, 1 - self.prior
        r = self.reliability
        return {n: (float(yes * r[j, 1, 2] / (yes * r[j, 1, 2] + no * r[j, 0, 2])), float(no * r[j, 0, 0] / (no * r[j, 0, 0] + yes * r[j, 1, 0]))) for j, n in enumerate(LABELERS)}


def fit(counted: list[tuple[int, int]], rounds: int = 50) -> Model:
    """From (key, count): reliabilities by expectation-maximisation, then a logistic classifier on its posteriors."""
    if not counted:
        return Model(np.full((len(LABELERS), 2, 3), 1 / 3), 0.5, {})
    parts = [_unkey(k) for k, _ in counted]
    weight = np.array([n for _, n in counted], np.float64)
    said = np.array([p[1] for p in parts]) + 1
    post = np.clip(0.5 + 0.15 * (said - 1) @ FIRST_WEIGHTS, 0.05, 0.95)  # a weighted majority to begin with
    for _ in range(rounds):
        prior = float(((post * weight).sum() + 2) / (weight.sum() + 4))
        reliability = np.empty((len(LABELERS), 2, 3))
        for j in range(len(LABELERS)):
            for y, p in ((0, 1 - post), (1, post)):
                tally = np.bincount(said[:, j], p * weight, 3) + 2.0 ** (FIRST_WEIGHTS[j] * (2 * y - 1) * np.arange(-1, 2))
                reliability[j, y] = tally / tally.sum()
        log = np.log(reliability)
        yes = np.log(prior) + sum(log[j, 1, said[:, j]] for j in range(len(LABELERS)))
        no = np.log(1 - prior) + sum(log[j, 0, said[:, j]] for j in range(len(LABELERS)))
        post = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    x = _features(parts)
    w = np.zeros(x.shape[1])
    share = weight / weight.sum()
    for _ in range(300):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (share * (p - post)) + 1e-3 * w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-x @ w))
    return Model(reliability, prior, {k: float(v) for (k, _), v in zip(counted, p, strict=True)})


def _features(parts: list[tuple[int, list[int], int]]) -> np.ndarray:
    x = np.zeros((len(parts), len(KINDS) + 3 * len(LABELERS) + _SHAPES))
    for i, (kind, said, shape) in enumerate(parts):
        x[i, kind] = 1
        for j, v in enumerate(said):
            x[i, len(KINDS) + 3 * j + v + 1] = 1
        x[i, len(KINDS) + 3 * len(LABELERS) + shape] = 1
    return x


def detect(docs: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, Model]:
    """Per row doc_id, ``spans`` (kind, start, end, base, probability) by kind as in ``KINDS``, then start, and ``rejected`` ones; and the model."""
    return _detected(written(candidates(docs), "pii-candidates"), threshold)


def _detected(found: DataFrame, threshold: float) -> tuple[DataFrame, Model]:
    # distinct keys are bounded by kinds x 3^labelers x shapes, far fewer in practice
    counted = [(r.key, r["count"]) for r in found.select(F.explode("found.key").alias("key")).groupBy("key").count().orderBy("key").collect()]
    model = fit(counted)
    if model.probability:
        known = F.create_map(*[F.lit(x) for kv in sorted(model.probability.items()) for x in kv])
    else:
        known = F.create_map().cast("map<int,double>")

    def spans(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), F.element_at(known, c["key"]).alias("probability"))

    def kept(c: Column) -> Column:
        return c["base"] | (c["probability"] >= threshold)

    every = F.transform("found", spans)
    return found.select("doc_id", F.array_sort(F.filter(every, kept)).alias("spans"), F.array_sort(F.filter(every, lambda c: ~kept(c))).alias("rejected")), model


def _written_spans(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(name, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "<{kind}>") -> DataFrame:
    """``docs`` with each span's text replaced; overlapping spans are taken together."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("all")), "pii-rows")  # numbers must not change
    spans, _ = detect(rows.select(F.col("row").alias("doc_id"), F.col("all.text").alias("text")))
    schema = T.StructType([rows.schema["all"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                at, out = 0, []
                for c in sorted(found or [], key=lambda c: (c["start"], -c["end"])):
                    if c["start"] >= at:
                        out += [text[at : c["start"]], mark.format(kind=KINDS[c["kind"]])]
                    at = max(at, c["end"])
                new.append(None if text is None else "".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("all"), pa.array(new, arrow(schema).field(1).type)], schema=pa.schema([batch.schema.field("all"), arrow(schema).field(1)]))

    some = spans.where(F.size("spans") > 0).select(F.col("doc_id").alias("row"), "spans")
    joined = rows.join(some, "row", "left").select("all", F.col("all.text").alias("text"), "spans")
    return joined.mapInArrow(run, schema).select(*[F.col("text") if c == "text" else F.col("all")[c].alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    found, _ = detect(docs)
    base = F.filter("spans", lambda c: c["base"])

    def of_kind(k: int) -> Column:
        return F.size(F.filter(base, lambda c: c["kind"] == k)).cast("long")

    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
        F.sha2(_written_spans(base), 256).alias("base_sha256"),
        _written_spans(F.col("spans")).alias("spans"),
        F.size("rejected").cast("long").alias("n_rejected"),
    )
