import random
import re

import pytest
from tidemark.llm import licenses

PHRASES = licenses.BASE


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_base_columns_equal_brute_force(spark):
    r = random.Random(2)
    bits = ["MIT", "License", "license,", "Apache", "general", "public", "GNU", "é", "x\n", "limit license", "cc by-nc 4.0", "all rights reserved.", "--", "İ"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", "mit license " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan_licenses(df).collect():
        assert tuple(row)[1:6] == brute(texts[row.doc_id] or "")
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_notices_take_the_longest():
    assert licenses.scan("Licensed under CC BY-NC-SA 4.0.")[5] == "cc-by-nc-sa"
    assert licenses.scan("GNU Lesser General Public License")[5] == "gpl,lgpl"


@pytest.mark.parametrize(
    ("text", "names", "verdict"),
    [
        ("MIT", {"mit"}, True),
        ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, True),
        ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, False),
        ("MIT OR GPL-2.0-only AND ISC", {"mit", "gpl-2.0-only", "isc"}, True),
        ("(MIT OR GPL-2.0-only) AND LGPL-2.1+", {"mit", "gpl-2.0-only", "lgpl-2.1+"}, False),
        ("Apache-2.0 WITH LLVM-exception", {"apache-2.0"}, True),
        ("MIT OR", {"mit"}, None),
        ("(MIT", {"mit"}, None),
        ("MIT ISC", {"mit", "isc"}, None),
        ("", set(), None),
    ],
)
def test_expressions(text, names, verdict):
    assert licenses.evaluate(text) == (names, verdict)


def test_tags_add_labels():
    row = licenses.scan("x\n// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\ny\n# spdx-license-identifier: (MIT AND Zlib)\n")
    assert row[4] == "" and row[5] == "gpl,mit,zlib" and row[8] is False


@pytest.mark.parametrize(
    ("text", "expression"),
    [
        ("# SPDX-License-Identifier: see LICENSE file", ""),
        ("<!-- SPDX-License-Identifier: MIT -->", "MIT"),
        ("/* SPDX-License-Identifier: MIT*/", "MIT"),
        ("SPDX-License-Identifier: Apache-2.0 OR MIT. Then text continues here", "Apache-2.0 OR MIT"),
        ("// SPDX-License-Identifier: (MIT OR\n//   Apache-2.0) AND ISC\ncode", "( MIT OR Apache-2.0 ) AND ISC"),
        (" * SPDX-License-Identifier: GPL-2.0-only WITH\r\n * Linux-syscall-note\n */", "GPL-2.0-only WITH Linux-syscall-note"),
        ("SPDX-License-Identifier: MIT\nISC AND Zlib", "MIT"),
        ("SPDX-License-Identifier: (MIT OR\n\nISC)", "( MIT OR"),
        ("SPDX-License-Identifier: LicenseRef-Own.1 AND MPL-2.0+", "LicenseRef-Own.1 AND MPL-2.0+"),
        ("SPDX-License-Identifier: Unheard-1.0 OR MIT", "Unheard-1.0 OR MIT"),
        ("SPDX-License-Identifier: Intel OR MIT", "Intel OR MIT"),
        ("SPDX-License-Identifier: MPL-2.0 AND NASA-1.3. More", "MPL-2.0 AND NASA-1.3"),
        ("SPDX-License-Identifier: (Glide AND MIT) OR 389-own WITH Some-exception", "( Glide AND MIT ) OR 389-own WITH Some-exception"),
        ("SPDX-License-Identifier: see OR MIT", ""),
        ("SPDX-License-Identifier: Intel or MIT", ""),
        ("SPDX-License-Identifier: Intel OR Glide", ""),
        ("spdx license identifier: MIT", ""),
        ("SPDX-License-Identifier MIT", ""),
        ("SPDX-License-Identifier: MIT) or (ISC", "MIT"),
        ("é SPDX-License-Identifier : mit", "mit"),
    ],
)
def test_expressions_end_where_they_should(text, expression):
    assert licenses.scan(text)[7] == ([expression] if expression else [])


def test_labels_of_names():
    row = licenses.scan("SPDX-License-Identifier: Intel OR MIT-0\nSPDX-License-Identifier: NASA-1.3 AND MIT")
    assert row[5] == "mit,mit-0" and row[8] is False
    assert licenses.scan("SPDX-License-Identifier: Intel OR MIT")[8] is True and licenses.scan("SPDX-License-Identifier: Apache-1.0")[5] == "apache"


def brute_labels(text):
    """Labels of one-line tags and of notices, by plain loops and recursive descent."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels = set()
    for i in range(len(words)):
        labels |= {label for p, label in licenses.BASE.items() if words[i : i + len(p.split())] == p.split()}
        longest = max((p for p in licenses.NOTICES if words[i : i + len(p.split())] == p.split()), key=lambda p: len(p.split()), default=None)
        labels |= {licenses.NOTICES[longest]} if longest else set()
    for found in re.finditer(r"spdx-license-identifier: (?=([^\n]*))", low):
        tokens = re.findall(r"\(|\)|[a-z0-9.+-]+|.", found[1])
        raw = re.findall(r"\(|\)|[A-Za-z0-9.+-]+|.", text[found.start(1) : found.end(1)])
        assert [t.lower() for t in raw if t.isascii()] == [t for t in tokens if t.isascii()]
        tokens, raw = ([t for t in x if t != " "] for x in (tokens, raw))
        names, at = [], 0

        def foreign(at):
            """A name that is not known, between operators in capitals."""
            name = raw[at]
            shaped = re.fullmatch(r"[A-Za-z0-9.-]+\+?", name) and any(c.isalpha() for c in name) and name[0].isalnum() and (name[0].isupper() or re.search("[-.0-9]", name))
            return shaped and ((at and raw[at - 1] in ("AND", "OR", "WITH")) or (at + 1 < len(raw) and raw[at + 1] in ("AND", "OR", "WITH") and not closes(at + 1)))

        def closes(at):
            """Is this operator the last of its line? Then no blank may follow it."""
            return at == len(raw) - 1 and not text[found.start(1) : found.end(1) + 1].endswith((" ", "\n"))

        def operand(at):
            if at < len(tokens) and tokens[at] == "(":
                at, ok = expression(at + 1)
                return (at + 1, True) if ok and at < len(tokens) and tokens[at] == ")" else (at, False)
            if at < len(tokens) and (licenses.known(tokens[at]) or (tokens[at] not in ("and", "or", "with") and foreign(at))):
                names.append(tokens[at])
                if at + 1 < len(tokens) and tokens[at + 1] == "with":
                    right = at + 2 < len(tokens) and (tokens[at + 2] in licenses.EXCEPTIONS or (tokens[at + 2] not in ("and", "or", "with") and foreign(at + 2)))
                    return (at + 3, True) if right else (at + 2, False)
                return at + 1, True
            return at, False

        def expression(at):
            at, ok = operand(at)
            while ok and at < len(tokens) and tokens[at] in ("and", "or"):
                at, ok = operand(at + 1)
            return at, ok

        expression(at)
        labels |= {licenses.family(n.rstrip("+")) for n in names if licenses.known(n)}
    return ",".join(sorted(labels))


def test_labels_equal_brute_force(spark):
    r = random.Random(7)
    bits = ["MIT", "license", "Apache-2.0", "GPL-2.0-only", "(", ")", "OR", "and", "WITH", "LLVM-exception", "ISC", "Foo-1.0", "see", "\n", "SPDX-License-Identifier:", "\nSPDX-License-Identifier:", "cc by", "nc 4.0", "all rights reserved", "LicenseRef-x", "zlib+", "é"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    texts = [re.sub(r"(?i)(\(|or|and|with)(\s*)\n", r"\1 Foo-1.0\n", t) for t in texts]  # line ends within open expressions have their own test
    texts = [t for t in texts if not any(x.count("(") > x.count(")") for x in t.lower().split("spdx-license-identifier:"))]
    assert len(texts) > 500
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan_licenses(df).collect():
        assert row.labels == brute_labels(texts[row.doc_id]), texts[row.doc_id]
