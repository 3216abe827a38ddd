"""Licence scans: Aho-Corasick over normalised words finds phrases and identifier tags; a shunting-yard parser
evaluates the expressions behind the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table, texts
from lodestone.llm.words import words

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method's own, as normalised words.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache-2.0",
    "apache org licenses license 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "creativecommons org licenses by": "cc-by",
    "creativecommons org publicdomain zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
#: What announces a licence expression, as normalised words.
TAGS = ("spdx license identifier", "license expression")
_TAG_TEXT = re.compile(rb"(?i)(?:spdx[-_ ]license[-_ ]identifier|license[-_ ]expression)[\"']?\s*[:=]\s*[\"']?")
_END = re.compile("[\\r\\n\"'<>]|\\Z")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Labels that leave a text free to use, alone or with others.
PERMISSIVE = ("apache-2.0", "mit", "bsd", "isc", "cc0", "cc-by", "public-domain", "zlib", "unlicense", "0bsd", "bsl-1.0")


def parse(expression: str, at: int = 0, end: int | None = None):
    """A licence expression as a tree of (operator, left, right) and lower-case identifiers, by shunting-yard.

    WITH binds closest, then AND, then OR. Reading stops at the first word that can't go on an expression; an expression
    that breaks off gives what is complete, or None. Only the part from at to end is read.
    """
    output, operators = [], []
    want = True  # an operand or an opening bracket comes next
    depth = 0  # open brackets

    def reduce() -> bool:
        op = operators.pop()
        if op == "(" or len(output) < 2:
            return False
        right, left = output.pop(), output.pop()
        output.append((op, left, right))
        return True

    for token in _TOKEN.finditer(expression, at, len(expression) if end is None else end):
        word = token[0].lower()
        if word in _RANK:
            if want:
                break
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= _RANK[word]:
                reduce()
            operators.append(word)
            want = True
        elif word == "(":
            if not want:
                break
            operators.append(word)
            depth += 1
        elif word == ")":
            if want or not depth:
                break
            while operators[-1] != "(":
                reduce()
            operators.pop()
            depth -= 1
        else:
            if not want:
                break
            output.append(word.strip(".:") or word)
            want = False
    if want and operators and operators[-1] != "(":
        operators.pop()
    while operators:
        if not reduce():
            continue
    return output[-1] if output else None


def identifiers(tree) -> set[str]:
    """The licences an expression names, exceptions behind WITH left out."""
    found, left = set(), [] if tree is None else [tree]
    while left:
        x = left.pop()
        if isinstance(x, str):
            found.add(x)
        else:
            left += x[1:2] if x[0] == "with" else x[1:]
    return found


def family(identifier: str) -> str:
    """An identifier's label: versions and variants of copyleft families fold into one, others stay."""
    for name in ("agpl", "lgpl", "gpl", "bsd", "mpl", "cc-by", "cc0"):
        if identifier == name or identifier.startswith((f"{name}-", f"{name}0")):
            return name
    return identifier


def freedom(tree) -> float:
    """1 if the expression can be met by permissive licences only, 0.5 if it can't; OR takes the better, AND the worse."""
    left, values = [tree], []
    while left:
        x = left.pop()
        if isinstance(x, str):
            values.append(1.0 if family(x) in PERMISSIVE else 0.5)
        elif len(x) == 1:  # both sides are known
            values.append((max if x[0] == "or" else min)(values.pop(), values.pop()))
        elif x[0] == "with":
            left.append(x[1])
        else:
            left += (x[:1], x[1], x[2])
    return values[0]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **dict.fromkeys(TAGS)}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(data: bytes, matcher) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    found = words(data)
    line = (b" " + b" ".join(found) + b" ").decode("utf-8", "replace")
    base, more, n_base, first, last, tagged, strength = set(), set(), 0, None, None, False, []
    for end, phrase in matcher.iter(line):
        if phrase in BASE:
            begin = end - len(phrase) - 1  # of the space before it
            first = begin if first is None else min(first, begin)
            last = begin if last is None else max(last, begin)
            n_base += 1
            base.add(BASE[phrase])
        elif phrase in NOTICES:
            more.add(NOTICES[phrase])
        else:
            tagged = True
    if tagged:
        source, end = data.decode("latin-1"), -1  # names are ASCII; a place is the same in the bytes
        for m in _TAG_TEXT.finditer(data):
            if end < m.end():
                end = _END.search(source, m.end()).start()
            tree = parse(source, m.end(), end)
            if tree is not None:
                more |= {family(x) for x in identifiers(tree)}
                strength.append(freedom(tree))
    labels = base | more
    if strength:
        score = max(strength)
    elif labels:
        score = 0.9 if labels & set(PERMISSIVE) and "reserved" not in labels else 0.6 if labels & set(PERMISSIVE) or labels != {"reserved"} else 0.3
    else:
        score = 0.0
    count = lambda at: None if at is None else line.count(" ", 0, at + 1) - 1
    return len(found), n_base, count(first), count(last), ",".join(sorted(base)), ",".join(sorted(labels)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document with the columns of SCHEMA.

    Base places are where a base phrase's words stand one after the other; labels adds what notices and the expressions
    behind identifier tags name. score: 0 without any sign; with an expression, 1 if permissive licences meet it, else
    0.5; else 0.9 for permissive notices, 0.6 for mixed or other ones, 0.3 for reserved rights only. Null text counts as
    empty (0 words, null places, empty labels); repeated rows come out repeated; other columns are ignored.
    """
    types = ["int64", "int64", "int64", "int64", "string", "string", "float64"]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches) -> Iterator:
        import pyarrow as pa

        matcher = automaton()
        for batch in batches:
            rows = [scan(x, matcher) for x in batch.column("text").to_pylist()]
            columns = zip(*rows) if rows else [[]] * len(types)
            arrays = [pa.array(list(c), pa.type_for_alias(t)) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    return texts(docs).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
