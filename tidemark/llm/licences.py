"""Licence scans (operator 3).

One Aho-Corasick automaton runs over the words of each text and finds notice phrases and the identifier tag
"spdx license identifier". Behind each tag that it finds, a shunting-yard parser reads the licence expression (and, or,
with, parentheses) and evaluates it to the labels that apply. Nothing is shuffled.

``n_choices`` counts the ways to meet the expressions of a text, as a double: whole numbers are exact up to 2^53, and
what is over 2^1023 is infinite. No way is listed, so the work is linear in the text however many ways there are.

Null and empty texts have no words: counts are 0, places null, labels empty, score 0. An expression that can't be
parsed adds no label. Overlapping phrases all count. Very long texts are read whole, in linear time. Repeated rows each
get their row; columns beside doc_id and text are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import documents, texts

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_notices long, n_tags long, n_choices double"

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases beyond the base, in words of a-z and 0-9, with label and weight.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "gnu free documentation license": ("gfdl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.8),
    "cc by nc nd": ("cc-by-nc-nd", 0.8),
    "cc0": ("cc0", 0.6),
    "creative commons attribution": ("cc-by", 0.8),
    "boost software license": ("bsl", 0.9),
    "do what the fuck you want to public license": ("wtfpl", 0.9),
    "this is free and unencumbered software": ("unlicense", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.5),
    "licensed under": ("licensed", 0.3),
}
TAG = "spdx license identifier"
BASE_WEIGHT, TAG_WEIGHT = 0.9, 1.0
#: Everything but 0-9 and a-z among ASCII stands between words; capital letters become small ones.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]+)")
#: How firmly an operator binds.
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """A licence expression in postfix order by the shunting-yard algorithm, None if it isn't well-formed. It ends where
    a token comes that can't continue it, so prose behind it does no harm, nor does an operator or parenthesis left open
    behind a well-formed beginning."""
    tokens, operand, depth, at, good = [], True, 0, 0, 0
    while m := _TOKEN.match(expression, at):
        token, low, at = m[1], m[1].lower(), m.end()
        if operand and token == "(":
            depth += 1
        elif operand and token != ")" and low not in _BINDS:
            operand = False
        elif not operand and low in _BINDS:
            operand = True
        elif not operand and token == ")" and depth:
            depth -= 1
        else:
            break
        tokens.append(low if low in _BINDS else token)
        if not operand and not depth:
            good = len(tokens)
    out: list[str] = []
    ops: list[str] = []
    for token in tokens[:good]:
        if token == "(":
            ops.append(token)
        elif token == ")":
            while (op := ops.pop()) != "(":
                out.append(op)
        elif token in _BINDS:
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[token]:
                out.append(ops.pop())
            ops.append(token)
        else:
            out.append(token)
    return [*out, *reversed(ops)] if good else None


def evaluate(items: list[str]) -> tuple[int, frozenset[str], int]:
    """What an expression in postfix order comes to: in how many ways it can be met (or adds ways, and multiplies them),
    all licences that some way names, and the number of exceptions. An exception, what stands behind with, is no licence."""
    stack: list[tuple[int, int]] = []  # ways, and where the operand begins among the items
    licence = [x not in _BINDS for x in items]
    exceptions = 0
    for k, x in enumerate(items):
        if x not in _BINDS:
            stack.append((1, k))
            continue
        (right, begin), (left, start) = stack.pop(), stack.pop()
        if x == "with":
            exceptions += 1
            licence[begin:k] = [False] * (k - begin)
            stack.append((left, start))
        else:
            stack.append((left + right if x == "or" else left * right, start))
    return stack[-1][0], frozenset(x.lower().rstrip("+") for x, some in zip(items, licence) if some), exceptions


def family(name: str) -> str:
    """The label of a licence identifier: its name up to the version, by the names that the base phrases use."""
    short = re.sub(r"-(v?\d[\w.]*)(-only|-or-later)?$", "", name)
    return re.sub(r"-\d+-clause$", "", short)


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for phrase in {**BASE, **NOTICES, TAG: None}:
            self.auto.add_word(f" {phrase} ", (phrase, phrase.count(" ")))
        self.auto.make_automaton()

    @staticmethod
    def expression(raw: bytes, folded: bytes, ends: list[int]) -> list[str]:
        """What follows, on its line, each word of ``ends`` (numbers of words, ascending)."""
        out, wanted = [], iter(ends)
        at = next(wanted, None)
        for k, m in enumerate(re.finditer(rb"[^ ]+", folded)):
            if k == at:
                stop = raw.find(b"\n", m.end())
                line = raw[m.end() : stop if stop >= 0 else None].lstrip(b" \t").removeprefix(b":")
                out.append(line.decode("utf-8", "replace"))
                at = next(wanted, None)
                if at is None:
                    break
        return out

    def scan(self, text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        folded = raw.translate(_FOLD)
        words = folded.split()
        if not words:
            return 0, 0, None, None, "", "", 0.0, 0, 0, 0.0
        line = b" " + b" ".join(words) + b" "
        base, labels, starts, notices, tags, ways, rest = set(), set(), [], 0, [], 0, 1.0
        last, spaces = 0, 0  # where counting of spaces stands, and how many stand before
        plain = line.decode("latin-1")
        for end, (phrase, inner) in self.auto.iter(plain):
            spaces += plain.count(" ", last, end)
            last = end
            if phrase == TAG:
                tags.append(spaces - 1)
            elif phrase in BASE:
                starts.append(spaces - inner - 1)
                base.add(BASE[phrase])
                rest *= 1 - BASE_WEIGHT
            else:
                label, weight = NOTICES[phrase]
                notices += 1
                labels.add(label)
                rest *= 1 - weight
        for expression in self.expression(raw, folded, tags):
            if items := postfix(expression):
                found, licences, _ = evaluate(items)
                ways += found
                labels.update(map(family, licences))
                rest *= 1 - TAG_WEIGHT
        labels |= base
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - rest, notices, len(tags), as_double(ways)


def as_double(n: int) -> float:
    return float(n) if n.bit_length() <= 1023 else float("inf")


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): see the contract columns in ``SCHEMA``. ``score`` is one less the
    product of what each finding leaves open: 0.1 for a base phrase, 0 for a tag with a well-formed expression."""

    def scan(batches):
        scanner = Scanner()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [scanner.scan(t.as_py()) for t in part.column(1)]
                cols = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_notices", "n_tags", "n_choices"])

    return texts(docs).mapInArrow(scan, SCHEMA)


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir))
