"""Licence scan: Aho-Corasick over words, SPDX expressions by a shunting yard.

One automaton holds the notice phrases and the SPDX identifier tag, each as words
between single spaces; the text is brought to the same form, so that one pass finds
every place. Where the automaton finds the tag's words, written with hyphens and closed
by a colon, an expression is read: known identifiers (with +, -only or -or-later) and
LicenseRef names, joined by AND, OR and WITH exceptions, in parentheses. Names that are not
known stand in it as licences that are not allowed, where an operator in capitals before or behind
them shows that they are names; they get no label. It ends
at the first token that cannot continue it, so prose, full stops and comment ends behind
it do not count; it goes on over a line end, comment marks aside, while a parenthesis or
an operator is open. A shunting yard gives the operators WITH, AND, OR (in this order of
strength) their places, and the result is evaluated against a set of allowed licences.
An expression that breaks off, as in an open parenthesis or an operator without its
second licence, yields its licence names and no verdict.

Null and empty texts: no words, no places, null positions, empty labels, score 0.
Repeated rows are scanned each; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_texts, whole_texts

#: Phrases of the base result and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases of this scan; of several that start together the longest counts.
NOTICES = {
    "all rights reserved": "proprietary",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
}
TAG = "spdx license identifier"
#: Licences that an expression may rest on to be allowed.
ALLOWED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense", "zlib", "bsl-1.0", "cc-by-4.0"})

#: SPDX identifiers that an expression may name, without +, -only and -or-later.
KNOWN = frozenset(
    """0bsd afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0
    bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6
    cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0
    cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpl-1.0
    curl ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg
    imagemagick isc json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libpng-2.0 libtiff lppl-1.3c mit mit-0 mit-cmu mpl-1.0 mpl-1.1 mpl-2.0
    mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-2.1 osl-3.0 pddl-1.0
    php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim
    w3c wtfpl x11 xnet zend-2.0 zlib zpl-2.1""".split()
)
#: Exceptions that may stand after WITH.
EXCEPTIONS = frozenset(
    """autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0
    gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 libtool-exception linux-syscall-note llvm-exception openjdk-assembly-exception-1.0
    qt-gpl-exception-1.0 qt-lgpl-exception-1.1 swift-exception u-boot-exception-2.0 wxwindows-exception-3.1""".split()
)

_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_TAG_FORM = re.compile(rb"spdx-license-identifier[ \t]*:")
_BLANK = re.compile(r"[ \t]*")
#: A line end with the blanks and comment marks around it.
_LINE_END = re.compile(r"[ \t]*(?:\\|\*/|-->)?[ \t]*\r?\n[ \t]*(?:#+|//+|/?\*+|;+|--+|%+|<!--|REM\b)?[ \t]*")
#: A name of any licence, and an operator in capitals behind one.
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9.-]*\+?|[0-9][A-Za-z0-9.-]*[A-Za-z][A-Za-z0-9.-]*\+?")
_OPERATOR = re.compile(r"[ \t]+(?:AND|OR|WITH)(?=[ \t\r\n])")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def known(name: str) -> bool:
    """Is this a licence that an expression may name?"""
    name = name.lower()
    if name.startswith(("licenseref-", "documentref-")):
        return name.rpartition("licenseref-")[2] != "" and "licenseref-" in name
    name = name.removesuffix("+")
    return name in KNOWN or name.removesuffix("-only").removesuffix("-or-later") in KNOWN


def foreign(name: str, text: str, end: int, before: str | None) -> bool:
    """Is this a name that is not known, by its form and by an operator in capitals before it or behind its end in the text?"""
    formed = _NAME.fullmatch(name) is not None and (name[0].isupper() or any(c in "-." or c.isdigit() for c in name))
    return formed and (before in ("AND", "OR", "WITH") or _OPERATOR.match(text, end) is not None)


def read_expression(text: str, at: int = 0) -> str:
    """The longest run of tokens from `at` on that can be an expression or its beginning, one space apart."""
    out: list[str] = []
    depth, operand_next = 0, True
    while True:
        at = _BLANK.match(text, at).end()
        if (depth or (operand_next and out)) and (line := _LINE_END.match(text, at)):
            at = line.end()
        m = _TOKEN.match(text, at)
        if not m:
            break
        token, ends = m[0], False
        low = token.lower()
        if token == "(" and operand_next and (not out or out[-1].lower() != "with"):
            depth += 1
        elif token == ")" and not operand_next and depth:
            depth -= 1
        elif low in _STRENGTH and not operand_next and not (low == "with" and out[-1] == ")"):
            operand_next = True
        elif operand_next and low not in _STRENGTH and token not in "()":
            bare = token.rstrip(".:-")  # a full stop, a colon or a comment's end behind a name
            right = known(bare) if not out or out[-1].lower() != "with" else bare.lower() in EXCEPTIONS
            if not right and not foreign(bare, text, m.end() if bare == token else len(text), out[-1] if out else None):
                break
            ends = bare != token
            token, operand_next = bare, False
        else:
            break
        out.append(token)
        at = m.end()
        if ends:
            break
    return " ".join(out) if any(known(x) for x in out) else ""


@functools.cache
def automaton() -> ahocorasick.Automaton:
    own = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        own.add_word(f" {phrase} ", (len(phrase.split()), phrase))
    own.make_automaton()
    return own


def words_of(text: str) -> list[bytes]:
    """Words of [0-9a-z] and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()


def places(words: list[bytes]) -> list[tuple[int, int, str]]:
    """(first word, words, phrase) of every place of every phrase."""
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    out, seen, counted = [], 0, 0
    for end, (n, phrase) in automaton().iter(line):
        counted += line.count(" ", seen, end)  # spaces before the phrase's closing one
        seen = end
        out.append((counted - n, n, phrase))
    return out


def to_postfix(expression: str) -> list[str]:
    """Operators and licence names in postfix order; ValueError if malformed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _STRENGTH:
            if operand_next:
                raise ValueError(expression)
            while held and held[-1] != "(" and _STRENGTH[held[-1]] >= _STRENGTH[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise ValueError(expression)
            held.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError(expression)
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError(expression)
            held.pop()
        else:
            if not operand_next:
                raise ValueError(expression)
            out.append(low)
            operand_next = False
    if operand_next:
        raise ValueError(expression)
    while held:
        if held[-1] == "(":
            raise ValueError(expression)
        out.append(held.pop())
    return out


def evaluate(expression: str, allowed: frozenset[str] = ALLOWED) -> tuple[set[str], bool | None]:
    """(licence names, whether allowed licences satisfy the expression; None if malformed)."""
    try:
        postfix = to_postfix(expression)
    except ValueError:
        names = {t.lower() for t in _TOKEN.findall(expression) if t not in "()" and t.lower() not in _STRENGTH}
        return names, None
    names: set[str] = set()
    stack: list[tuple[bool, str]] = []
    for token in postfix:
        if token not in _STRENGTH:
            stack.append((token.rstrip("+") in allowed, token))
            names.add(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # an exception only widens what its licence permits
            names.discard(right[1])
            stack.append(left)
        elif token == "and":
            stack.append((left[0] and right[0], ""))
        else:
            stack.append((left[0] or right[0], ""))
    return names, stack.pop()[0]


def family(name: str) -> str:
    """An SPDX name's label: versions of the base labels' licences share theirs, every other licence has its own."""
    for label in ("apache", "gpl"):
        if name == label or name.startswith(label + "-"):
            return label
    return name


def scan(text: str) -> tuple:
    words = words_of(text)
    found = places(words)
    base = [(at, BASE[p]) for at, _, p in found if p in BASE]
    longest: dict[int, tuple[int, str]] = {}
    for at, n, p in found:
        if p in NOTICES:
            longest[at] = max(longest.get(at, (0, "")), (n, NOTICES[p]))
    base_labels = {label for _, label in base}
    labels = base_labels | {label for _, label in longest.values()}
    expressions, verdicts = [], []
    tags = {at for at, _, p in found if p == TAG}
    if tags:
        raw = text.encode("utf-8", "surrogatepass")
        low, plain = raw.lower(), raw.decode("latin-1")  # one character a byte
        for i, m in enumerate(_WORD.finditer(low)):
            if i in tags and (form := _TAG_FORM.match(low, m.start())):
                if own := read_expression(plain, form.end()):
                    names, verdict = evaluate(own)
                    expressions.append(own)
                    verdicts.append(verdict)
                    labels |= {family(n.rstrip("+")) for n in names if known(n)}
    evidence = len(base) + len(longest) + 2 * len(expressions)
    allowed = None if not verdicts or None in verdicts else all(verdicts)
    starts = [at for at, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - 0.5**evidence, expressions, allowed)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, allowed."""

    def make():
        def run(batch):
            return [batch["doc_id"], *zip(*map(scan, batch["text"]))]

        return run

    return map_texts(whole_texts(docs), make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, allowed boolean")
