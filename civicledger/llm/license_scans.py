"""Licence detection by a positional rare-token index.

The templates (licence texts, notices, tags) are indexed by their words with positions. A first pass counts in how many documents each
of these words stands (a bounded vocabulary, so Spark adds up a few hundred counts). A second pass
takes from each text its licence words of highest inverse document frequency, for each template so many
that no alignment can lack them all, looks their postings up, and intersects them by relative position: occurrences that agree on where a template begins
support one alignment. An alignment counts if the template's words stand there and every mandatory
key phrase does, and no denial stands shortly before. Behind a tag an expression of short names is read. Both passes are map-only over whole texts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicledger.llm.common import release_memo

#: Phrases that give a label wherever they stand.
BASE_PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Licence texts and notices, one template a row: (label, text, mandatory key phrases).
TEXTS = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
     "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     ("permission is hereby granted free of charge", "shall be included in all copies or substantial portions")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("may not use this file except in compliance with the license",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
     "see the license for the specific language governing permissions and limitations under the license", ("distributed on an as is basis without warranties or conditions of any kind", "governing permissions and limitations under the license")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("terms of the gnu general public license",)),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
     ("in the hope that it will be useful", "see the gnu general public license for more details")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
     "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
     ("redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
     ("names of its contributors may be used to endorse or promote products",)),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    ("bsd-2-clause", "licensed under the bsd 2 clause license", ("bsd 2 clause",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
     ("distribute this software for any purpose with or without fee",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose with or without fee",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
     "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
     ("to alter it and redistribute it freely subject to the following restrictions",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("epl-2.0", "licensed under the eclipse public license version 2 0", ("eclipse public license version 2 0",)),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", ("eclipse public license v1 0",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("unencumbered software released into the public domain",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("wtfpl", "do what the fuck you want to public license", ("what the fuck you want to public license",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("bsd-3-clause", "under the terms of the 3 clause bsd license", ("3 clause bsd license",)),
    ("bsd-2-clause", "under the terms of the 2 clause bsd license", ("2 clause bsd license",)),
    ("isc", "released under the isc license", ("isc license",)),
    ("zlib", "released under the zlib license", ("zlib license",)),
    ("artistic-2.0", "released under the artistic license 2 0", ("artistic license 2 0",)),
    ("artistic-2.0", "under the terms of the artistic license version 2 0", ("artistic license version 2 0",)),
    ("gpl-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the licenses for most software are designed to take away your freedom to share and change it "
     "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
     ("licenses for most software are designed to take away your freedom", "gnu general public license is intended to guarantee your freedom")),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
     ("free copyleft license for software and other kinds of works", "designed to take away your freedom to share and change the works")),
    ("lgpl", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
     ("supplemented by the additional permissions listed below",)),
    ("agpl", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
     ("specifically designed to ensure cooperation with the community",)),
    ("apache-2.0", "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
     ("as defined by sections 1 through 9 of this document",)),
    ("mpl-2.0", "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software contributor version means the combination of the contributions of others if any used by a contributor and that particular contributor s contribution",
     ("contributes to the creation of or owns covered software",)),
)
#: Families whose versions notices name in short: (label without version, spellings, versions).
FAMILIES = (
    ("gpl", ("gnu gpl", "gnu general public license"), ("2", "3")), ("lgpl", ("gnu lgpl", "gnu lesser general public license"), ("2 1", "3")), ("agpl", ("gnu agpl", "gnu affero general public license"), ("3",)),
)
#: Words that deny a notice, just before it or between its words.
DENIALS = frozenset((b"not", b"never", b"neither", b"nor"))
#: Short names as files state them in a tag, and the two spellings of a Creative Commons licence's terms.
TAGS = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "0BSD", "EUPL-1.2", "Artistic-2.0",
    "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MIT-0", "BSD-4-Clause", "X11", "NCSA", "OFL-1.1", "PSF-2.0", "PostgreSQL", "WTFPL", "CDDL-1.0", "CC-BY-3.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "Apache-1.1", "GFDL-1.3",
)
COMMONS = (
    ("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"),
)
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _tag(short: str) -> tuple[str, str, tuple[str, ...]]:
    words = " ".join(short.lower().replace("-", " ").replace(".", " ").split())
    return short.lower(), f"spdx license identifier {words}", (f"license identifier {words}",)


def _commons(terms: str, name: str, version: str) -> list[tuple[str, str, tuple[str, ...]]]:
    label = f"cc-{terms.replace(' ', '-')}-{version.replace(' ', '.')}"
    return [(label, f"licensed under cc {terms} {version}", (f"cc {terms} {version}",)), (label, f"licensed under a creative commons {name} {version} international license", (f"creative commons {name} {version}",))]


def _family(label: str, name: str, version: str) -> list[tuple[str, str, tuple[str, ...]]]:
    full = f"{label}-{version.replace(' ', '.')}" + ".0" * (" " not in version)
    return [(full, f"licensed under the {name} {v}", (f"{name} {v}",)) for v in (f"v{version}", f"version {version}")]


TEMPLATES = (*TEXTS, *(t for label, names, versions in FAMILIES for name in names for version in versions for t in _family(label, name, version)), *map(_tag, TAGS), *(t for terms, name in COMMONS for version in VERSIONS for t in _commons(terms, name, version)))
#: Short names by their words, for the expressions that follow a tag.
NAMES = {tuple(text.encode().split()[3:]): label for label, text, _ in map(_tag, TAGS)}
#: Words that an exception behind WITH has at most.
EXCEPTION_WORDS = 6
#: Share of a template's words that must stand at their places.
MIN_SCORE = 0.8
#: Places of a template on which looked-up words must agree before all its words are compared.
SUPPORT = 2
#: Places by which the beginning of an alignment may differ between its words.
SLACK = 2

#: A-Z to a-z; ASCII that is neither digit nor letter to a space; UTF-8 bytes beyond ASCII stay.
_FOLD = bytes((c | 0x20 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32) for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Index:
    """Positional postings of the templates' words, those of highest inverse document frequency first."""

    def __init__(self, templates, n_docs: int, df: dict[bytes, int]):
        self.words = frozenset(vocabulary(templates))
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for w in self.words}
        self.templates = [(label, text.encode().split(), [k.encode().split() for k in keys]) for label, text, keys in templates]
        self.order = [sorted(((w, at) for at, w in enumerate(words)), key=lambda x: (-self.idf[x[0]], x)) for _, words, _ in self.templates]
        self.need = np.array([math.ceil(MIN_SCORE * len(words) - 1e-9) for _, words, _ in self.templates])
        # places of each template that hold each word
        self.row = {w: i for i, w in enumerate(sorted(self.words))}
        self.held = np.zeros((len(self.row), len(self.templates)), np.int16)
        for t, (_, words, _) in enumerate(self.templates):
            for w in words:
                self.held[self.row[w], t] += 1

    def _postings(self, present: set[bytes]) -> dict[bytes, list[tuple[int, int]]]:
        """Places of templates by the text's rarest words: an alignment that may lack k places holds SUPPORT of any k + SUPPORT, absent ones among these."""
        out: dict[bytes, list[tuple[int, int]]] = {}
        places = self.held[[self.row[w] for w in present]].sum(axis=0)
        for t in np.flatnonzero(places >= self.need).tolist():
            need = int(self.need[t])
            here = [x for x in self.order[t] if x[0] in present]
            for w, place in here[: len(here) - need + min(SUPPORT, need)]:
                out.setdefault(w, []).append((t, place))
        return out

    def scan(self, words: list[bytes], present: set[bytes]) -> tuple[set[str], float]:
        """Labels that the templates give, and the best score among them."""
        labels, best = set(), 0.0
        postings = self._postings(present)
        if not postings:
            return labels, best
        votes: dict[tuple[int, int], set[int]] = {}
        for at, w in enumerate(words):
            for t, place in postings.get(w, ()):
                for s in range(-SLACK, SLACK + 1):
                    votes.setdefault((t, at - place + s), set()).add(place)
        for (t, begin), support in votes.items():
            if len(support) < min(SUPPORT, self.need[t]):
                continue
            label, pattern, keys = self.templates[t]
            window = words[max(0, begin - SLACK) : begin + len(pattern) + SLACK]
            score = aligned(pattern, window) / len(pattern)
            if score >= MIN_SCORE and all(places(window, k) for k in keys) and not denied(words, max(0, begin - SLACK), window, pattern, keys[0]):
                labels.add(label)
                best = max(best, score)
        return labels, best


def denied(words: list[bytes], first: int, window: list[bytes], pattern: list[bytes], key: list[bytes]) -> bool:
    """Whether a denial that isn't the pattern's own stands between the word before the notice and its key phrase."""
    at = first + places(window, key)[0]
    begin = at - places(pattern, key)[0]
    return not DENIALS.difference(pattern).isdisjoint(words[max(0, begin - 1) : at])


def expression_labels(words: list[bytes]) -> set[str]:
    """The short names of the expressions that follow tags: names joined by AND and OR, exceptions behind WITH left out."""
    out: set[str] = set()
    longest = max(map(len, NAMES))
    for at in places(words, [b"license", b"identifier"]):
        at += 2
        while True:
            n = next((n for n in range(longest, 0, -1) if tuple(words[at : at + n]) in NAMES), 0)
            if not n:
                break
            out.add(NAMES[tuple(words[at : at + n])])
            at += n
            if words[at : at + 1] == [b"with"]:
                at = next((k for k in range(at + 1, min(len(words), at + 2 + EXCEPTION_WORDS)) if words[k] in (b"and", b"or")), len(words))
            if words[at : at + 1] not in ([b"and"], [b"or"]):
                break
            at += 1
    return out


def aligned(pattern: list[bytes], window: list[bytes]) -> int:
    """Words of the pattern that stand in the window in its order, each within SLACK of its place."""
    at, n = 0, 0
    for i, w in enumerate(pattern):
        for j in range(max(at, i), min(len(window), i + 2 * SLACK + 1)):
            if window[j] == w:
                at, n = j + 1, n + 1
                break
    return n


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    out, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + len(phrase)] == phrase:
            out.append(at)


def vocabulary(templates) -> set[bytes]:
    return {w for _, text, _ in templates for w in text.encode().split()}


def document_frequencies(docs: DataFrame, text_col: str, templates) -> tuple[int, dict[bytes, int]]:
    """Documents in all, and those that hold each word of the templates; a row for each word reaches the driver."""
    vocab = vocabulary(templates)

    def count(batches):
        n, df = 0, Counter()
        for b in batches:
            n += b.num_rows
            for text in b.column(0).to_pylist():
                df.update(vocab.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *df], pa.binary()), pa.array([n, *df.values()], pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in rows}
    return df.pop(b"", 0), df


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the best alignment's share of its template's words, 1 where a base phrase stands, 0 without labels.
    Null and empty texts have no words and no labels. Null and repeated ids and rows keep their rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    index = Index(templates, *document_frequencies(docs, text_col, templates))
    base = {label: phrase.encode().split() for label, phrase in BASE_PHRASES.items()}

    def scan(batches):
        release_memo()
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                present = index.words.intersection(words)
                starts, named, labels, score = [], set(), set(), 0.0
                if b"license" in words:
                    for label, phrase in base.items():
                        found = places(words, phrase)
                        starts += found
                        if found:
                            named.add(label)
                if present:
                    labels, score = index.scan(words, present)
                if b"identifier" in present:
                    tagged = expression_labels(words)
                    labels, score = labels | tagged, 1.0 if tagged else score
                labels |= named
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), 1.0 if named else score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            cols = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = f"`{id_col}` {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text")).mapInArrow(scan, kind)
