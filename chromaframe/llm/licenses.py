"""Licence scan: Aho-Corasick finds notice phrases and identifier tags; licence expressions are parsed by shunting-yard.

Texts become one line of lower-case words, in which the automaton finds every phrase on word boundaries. Documents with an
identifier tag are looked at once more as raw text: what follows the tag up to the line's end is an expression of licence ids, AND,
OR, WITH and parentheses. Its ids become labels, unless it cannot be parsed or a word in it is no licence id.

Of phrases that lie within each other the longest counts, base phrases aside: "creative commons attribution noncommercial" is not also "creative
commons attribution". Phrases that licences share, as warranty clauses, are evidence without a label. "All rights reserved" is a
label only where nothing grants any.

The verdict says whether the text may be used under permissive terms alone: "permissive" where every parsed expression can be met by
``PERMISSIVE`` ids (of an OR, one side is enough) and every phrase names a permissive licence, "restricted" where not, null without
labels. A phrase whose licence an expression names is left to that expression. The score is 1 less the product of the doubts that the distinct
pieces of evidence leave: ``WORD_DOUBT`` per word of a phrase, ``TAG_DOUBT`` of a parsed expression, ``BROKEN_DOUBT`` of another tag.

Edge cases: a null or empty text has no words, no places, null first and last word, empty labels, a null verdict and score 0. Repeated
rows are reported once per row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.common import ALNUM_WORDS, arrow, record_batch, slices, text_bytes

#: Base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notice phrases of well-known licences, beyond the base, as words; those that several licences share have no label.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache org licenses license 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "isc license": "isc",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "the software is provided as is without warranty of any kind": "",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "licensed under the apache license": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "to the extent possible under law": "cc0",
    "this is free and unencumbered software released into the public domain": "public-domain",
}

#: Labels whose terms ask for no more than notices.
PERMISSIVE = frozenset(
    "mit mit-0 apache-2 apache-2.0 bsd 0bsd bsd-2-clause bsd-3-clause isc zlib bsl bsl-1.0 cc0 cc0-1.0 cc-by cc-by-3.0 cc-by-4.0 unlicense public-domain".split()
)
#: First parts of the ids of the common licence list.
FAMILIES = frozenset(
    "0bsd adobe afl agpl apache artistic blueoak boost bsd bsl bzip2 cc0 cc cddl cecill cpl curl ecl epl eudatagrid eupl fsfap ftl gfdl gpl hpnd icu ijg "
    "intel ipa ipl isc jasper json latex lgpl libpng libtiff lppl mit mpl mpi ms mulanpsl naist nasa ncsa nist nlpl nokia ntp ofl oldap openssl osl php "
    "postgresql psf python qpl ruby sgi sissl sleepycat spencer tcl unicode unlicense upl vim w3c wtfpl x11 xfree86 xnet zend zlib zpl".split()
)
#: The phrase that keeps all rights says nothing where a licence grants some.
RESERVED = "all-rights-reserved"
WORD_DOUBT, TAG_DOUBT, BROKEN_DOUBT = 0.85, 0.05, 0.8

TAG = "spdx license identifier"
_RAW_TAG = re.compile(r"SPDX-License-Identifier\s*:([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_RANK = {"WITH": 3, "AND": 2, "OR": 1}


def parse_expression(text: str) -> list[tuple[str, str]] | None:
    """A licence expression in postfix order as ("id" | "op", value) pairs; None if it is not one."""
    out: list[tuple[str, str]] = []
    stack: list[str] = []
    operand_next = True
    at = 0
    text = re.split(r"\*/|-->", text)[0].rstrip()  # where a comment ends, so does the expression
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at, token = m.end(), m[1]
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(("op", stack.pop()))
            if not stack:
                return None
            stack.pop()
        elif token.upper() in _RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token.upper()]:
                out.append(("op", stack.pop()))
            stack.append(token.upper())
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(("id", token))
            operand_next = False
    if operand_next:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(("op", stack.pop()))
    return out


def evaluate(postfix: list[tuple[str, str]], allowed: frozenset[str]) -> bool:
    """Whether a licence expression can be met with ``allowed`` ids (lower case): AND needs both sides, OR one, WITH its licence."""
    stack: list[bool] = []
    for kind, value in postfix:
        if kind == "id":
            stack.append(value.lower() in allowed)
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a if value == "WITH" else a and b if value == "AND" else a or b)
    return stack[0]


def expression_ids(postfix: list[tuple[str, str]]) -> list[str]:
    """The licence ids of an expression, without the exceptions named after WITH."""
    stack: list[list[str]] = []
    for kind, value in postfix:
        if kind == "id":
            stack.append([value.lower()])
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a if value == "WITH" else a + b)
    return stack[0]


@cache
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, str, int]]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((kind, label, phrase.count(" ") + 1))
    automaton = ahocorasick.Automaton()
    for phrase, what in found.items():
        automaton.add_word(phrase, what)
    automaton.make_automaton()
    return automaton


def known_id(name: str) -> bool:
    """Whether a word of an expression is a licence id: of a listed family, or one of a project's own."""
    name = name.lower().rstrip("+")
    return name.startswith(("licenseref-", "documentref-")) or name.split("-")[0] in FAMILIES


def _outermost(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Phrases (start, end, kind, label) without notices that lie within a longer phrase."""
    out, reach, last = [], -1, None
    for one in sorted(found, key=lambda f: (f[0], -f[1])):
        if one[1] > reach or one[2] == "base" or one[:2] == last:
            out.append(one)
        if one[1] > reach:
            reach, last = one[1], one[:2]
    return out


def verdict(expressions: list[list[tuple[str, str]]], phrases: set[str]) -> str | None:
    """Whether all that a text names can be met by permissive licences."""
    if not expressions and not phrases:
        return None
    named = {i for e in expressions for i in expression_ids(e)}
    loose = {p for p in phrases if not any(i == p or i.startswith(p + "-") for i in named)}
    return "permissive" if loose <= PERMISSIVE and all(evaluate(e, PERMISSIVE) for e in expressions) else "restricted"


def scan_text(raw: bytes) -> tuple:
    """n_words, n_base, first and last word of base places, base labels, all labels, score, expressions, verdict."""
    words = raw.translate(ALNUM_WORDS).split()
    line = b" %b " % b" ".join(words)
    places, found, parsed, expressions = [], [], [], []
    tagged = False
    spaces = seen = 0
    for end, what in _automaton().iter(line.decode("latin-1")):
        spaces += line.count(b" ", seen, end)
        seen = end
        for kind, label, length in what:
            if kind == "tag":
                tagged = True
                continue
            found.append((spaces - length, spaces, kind, label))
            if kind == "base":
                places.append(spaces - length)
    base = {label for _, _, kind, label in found if kind == "base"}
    told = _outermost(found)
    evidence = {(kind + label, end - start) for start, end, kind, label in told}
    doubt = WORD_DOUBT ** sum(length for _, length in evidence)
    phrases = {label for _, _, _, label in told if label}
    labels = set(phrases)
    if tagged:
        for tail in sorted({m[1].strip() for m in _RAW_TAG.finditer(raw.decode("utf-8", "replace"))}):
            postfix = parse_expression(tail)
            if postfix is not None and not all(map(known_id, expression_ids(postfix))):
                postfix = None
            doubt *= BROKEN_DOUBT if postfix is None else TAG_DOUBT
            if postfix is not None:
                parsed.append(postfix)
                expressions.append(tail)
                labels.update(expression_ids(postfix))
    if labels - {RESERVED}:
        labels.discard(RESERVED)
        phrases.discard(RESERVED)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), 1.0 - doubt, expressions, verdict(parsed, phrases)


SCANNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("expressions", T.ArrayType(T.StringType())),
        T.StructField("verdict", T.StringType()),
    ]
)


def scan(docs: DataFrame) -> DataFrame:
    """Licence places, labels and parsed tag expressions of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(SCANNED)
        for batch in slices(batches, "text"):
            found = [scan_text(t) for t in batch.column("text").to_pylist()]
            yield record_batch(schema, [batch.column("doc_id"), *([f[k] for f in found] for k in range(9))])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, SCANNED)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", "verdict",
    )
