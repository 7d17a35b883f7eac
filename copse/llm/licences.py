"""Licence scan: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser evaluates licence expressions.

Words are runs of ASCII letters and digits and of characters from U+0080, A-Z lower-cased. One automaton per Python worker runs
over " word word ... ", so a phrase matches whole consecutive words only, at every place.

Defined results: a null text counts as empty: no words, no places, null first_word and last_word, empty labels, score 0. A tag
whose expression does not parse gives evidence but no label. Repeated rows are treated alike, an empty table gives an empty
result, and extra columns are ignored. Words of an expression that name no known licence give no label and permit nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from copse.llm.texts import ALNUM, batch, map_batches, raw

#: The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices: phrase, label.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "released into the public domain": "public-domain",
    "apache license 2 0": "apache-2",
    "licensed under the apache license": "apache",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license v2": "gpl-2",
    "gnu general public license v3": "gpl-3",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "mozilla public license version 2 0": "mpl-2",
    "mozilla public license v 2 0": "mpl-2",
    "boost software license": "bsl",
    "cc0 1 0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
}
TAG = "spdx license identifier"
_TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)

#: Families that allow use in training data; anything else, unknown ids included, does not.
PERMISSIVE = frozenset("mit apache-2 bsd bsd-2-clause bsd-3-clause isc zlib unlicense cc0 cc-by public-domain python-2 bsl-1 0bsd".split())
#: Families of licence ids without their versions. An id of no family, such as a word after the expression, is not a licence.
FAMILIES = frozenset(
    "0bsd aal afl agpl apache apsl artistic artistic-perl blueoak bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear "
    "bsd-3-clause-lbnl bsd-4-clause bsd bsl busl bzip2 cal cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cc-pddc cc0 cddl cecill cecill-b cecill-c "
    "cpal cpl curl ecl efl elastic epl eudatagrid eupl fair ftl gfdl gpl hpnd ibm-pibs icu ijg imagemagick info-zip intel ipl isc json lgpl lgpllr "
    "libpng libtiff lppl mit mit-cmu mit-modern-variant mpl ms-lpl ms-pl ms-rl mulanpsl ncsa netcdf ngpl nposl ntp odbl odc-by ofl oldap openssl opl osl "
    "pddl php polyform-noncommercial polyform-small-business postgresql psf public-domain python qpl ruby sgi-b sleepycat spencer sspl tcl ubuntu-font "
    "unicode unicode-dfs unlicense upl vim vsl w3c watcom wtfpl x11 xfree86 xnet zend zlib zlib-acknowledgement zpl".split()
)
#: How sure one finding of a kind makes a licence statement.
WEIGHT = {"tag": 0.95, "base": 0.8, "notice": 0.6}

_TOKEN = re.compile(r"\s*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """A licence id without its "or later" forms and ".0": apache-2.0 is apache-2, gpl-3.0-or-later is gpl-3, cc-by-nc-4.0 is cc-by-nc."""
    x = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    x = re.sub(r"(?<=\d)(\.0)+$", "", x)
    return re.sub(r"-\d[\d.]*$", "", x) if x.startswith("cc") else x


def is_licence(name: str) -> bool:
    """Whether a family name is a known licence, of any version, or a reference to a licence text of the document's own."""
    return name in FAMILIES or re.sub(r"-\d[\d.]*$", "", name) in FAMILIES or name.startswith(("licenseref-", "documentref-"))


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: the licence families named, and whether some choice it offers is permissive."""

    labels: frozenset[str]
    permits: bool


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: ids and operators in postfix order; "with" binds closest, then "and", then "or". None if it is malformed.

    Text after a complete expression, such as a comment's end, is not read; an operator must be followed by an operand.
    """
    out: list[str] = []
    held: list[str] = []
    operand, at = True, 0
    while m := _TOKEN.match(expression, at):
        word = (m[3] or "").rstrip(".:").lower()
        if m[1]:
            if not operand:
                break
            held.append("(")
        elif m[2]:
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif word in _RANK:
            if operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        else:
            if not operand:
                break
            out.append(word)
            operand = False
        at = m.end()
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> Terms | None:
    """"or" is permissive if a side is, "and" if both are; "with" adds an exception, which only widens its licence. Unknown ids have no label."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[Terms] = []
    for token in postfix:
        if token not in _RANK:
            name = family(token)
            stack.append(Terms(frozenset([name] if is_licence(name) else []), name in PERMISSIVE))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append(a)
        else:
            stack.append(Terms(a.labels | b.labels, a.permits or b.permits if token == "or" else a.permits and b.permits))
    return stack[0]


def automaton(phrases: dict[str, tuple[str, str]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase, (kind, label) in phrases.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 2, kind, label))
    machine.make_automaton()
    return machine


def all_phrases() -> dict[str, tuple[str, str]]:
    return {p: ("notice", x) for p, x in NOTICES.items()} | {TAG: ("tag", "")} | {p: ("base", x) for p, x in BASE_PHRASES.items()}


def scan(text: str | None, machine) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permits of one whole text."""
    flat = b" ".join(raw(text).translate(ALNUM).split())
    n_words = flat.count(b" ") + 1 if flat else 0
    line = f" {flat.decode('utf-8', 'surrogatepass')} " if flat else ""
    starts, base, labels, doubt, verdicts, expressions = [], set(), set(), 1.0, [], []
    tagged = False
    for end, (length, kind, label) in machine.iter(line) if line else ():
        doubt *= 1 - WEIGHT[kind]
        if kind == "tag":
            tagged = True
            continue
        labels.add(label)
        verdicts.append(label in PERMISSIVE)
        if kind == "base":
            base.add(label)
            starts.append(end - length + 1)
    if tagged:
        for m in _TAGGED.finditer(text):
            if terms := evaluate(m[1]):
                labels |= terms.labels
                verdicts.append(terms.permits)
                expressions.append(" ".join(to_postfix(m[1])))
    first = last = None
    if starts:
        first, last = line.count(" ", 0, min(starts)), line.count(" ", 0, max(starts))
    told = lambda x: ",".join(sorted(x))
    return n_words, len(starts), first, last, told(base), told(labels), round(1 - doubt, 6), "; ".join(expressions), all(verdicts) if verdicts else None


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permits"]
_TYPES = ["long", "long", "long", "long", "string", "string", "double", "string", "boolean"]


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton(all_phrases())
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    for b in batches:
        found = list(zip(*(scan(t, machine) for t in b.column(1).to_pylist()), strict=True)) or [()] * len(_TYPES)
        yield batch(_NAMES, b.column(0), *(pa.array(c, kinds[k]) for c, k in zip(found, _TYPES, strict=True)))


def licence_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document. Narrow: one pass over id and text, no shuffle."""
    schema = ", ".join(f"{n} {t}" for n, t in zip(_NAMES, ["long", *_TYPES], strict=True))
    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text"), _work, schema)
