"""Licence statements, by sentence rules.

A text is cut into segments at line ends and sentence ends and becomes one stream of normalised words: lower case, only
letters and digits. A known licence sentence is a pattern of words; it matches where it begins at a segment's beginning
and ends at a segment's end, over as many segments as it takes: how a text is wrapped, indented or marked as a comment
makes no difference, and no statement is too long. Words that a sentence leaves open stay within a paragraph, don't run over
the beginning of another sentence, and stay within a segment where they end the sentence. Matches give the sentence's identifier; a document's identifiers in
order are matched against the rules, in the rules' order. A rule takes the first run of identifiers that equals it, again
and again; what no rule takes is reported as unmatched. SPDX tags name their licence themselves. The method follows
sentence-based licence identification (German et al., 2010).

Applied in one pass without a shuffle, in linear time but for binary searches; texts without any word that all known
sentences need are passed over by plain searches. Defined cases: null and empty texts have no licence; null ids and equal
rows are carried along; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licences by what a short statement calls them; normalised, `lic` for either spelling.
NAMES = {
    "ApacheUse": ("Apache-2.0", "apache(?: software)?(?: lic)?(?: version| v)? ?2(?: 0)?"),
    "MitUse": ("MIT", "(?:mit|expat)"),
    "BsdUse": ("BSD", "bsd"),
    "Bsd3Use": ("BSD-3-Clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    "Bsd2Use": ("BSD-2-Clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    "IscUse": ("ISC", "isc"),
    "Gpl3LaterUse": ("GPL-3.0-or-later", "(?:gnu general public lic|gnu gpl|gpl)(?: version| v)? ?3(?: 0)? or (?:later|any later version|at your option any later version)"),
    "Gpl2LaterUse": ("GPL-2.0-or-later", "(?:gnu general public lic|gnu gpl|gpl)(?: version| v)? ?2(?: 0)? or (?:later|any later version|at your option any later version)"),
    "Gpl3Use": ("GPL-3.0", "(?:gnu general public lic|gnu gpl|gpl)(?: version| v)? ?3(?: 0)?(?: only)?"),
    "Gpl2Use": ("GPL-2.0", "(?:gnu general public lic|gnu gpl|gpl)(?: version| v)? ?2(?: 0)?(?: only)?"),
    "Lgpl3Use": ("LGPL-3.0", "(?:gnu lesser general public lic|gnu lgpl|lgpl)(?: version| v)? ?3(?: 0)?(?: only)?"),
    "Lgpl21Use": ("LGPL-2.1", "(?:gnu lesser general public lic|gnu lgpl|lgpl)(?: version| v)? ?2 1(?: only)?"),
    "Agpl3Use": ("AGPL-3.0", "(?:gnu affero general public lic|gnu agpl|agpl)(?: version| v)? ?3(?: 0)?(?: only)?"),
    "Mpl2Use": ("MPL-2.0", "(?:mozilla public lic|mpl)(?: version| v)? ?2 0"),
    "Epl2Use": ("EPL-2.0", "(?:eclipse public lic|epl)(?: version| v)? ?2 0"),
    "Epl1Use": ("EPL-1.0", "(?:eclipse public lic|epl)(?: version| v)? ?1 0"),
    "Eupl12Use": ("EUPL-1.2", "(?:european union public lic|eupl)(?: version| v)? ?1 2"),
    "BoostUse": ("BSL-1.0", "boost software lic(?: version| v)? ?1 0"),
    "ZlibUse": ("Zlib", "zlib(?: libpng)?"),
    "ArtisticUse": ("Artistic-2.0", "artistic lic(?: version| v)? ?2 0"),
    "WtfplUse": ("WTFPL", "(?:do what the fuck you want to public lic|wtfpl)(?: version 2)?"),
    "UnlicenseUse": ("Unlicense", "unlicense"),
    "Cc0Use": ("CC0-1.0", "(?:cc0|creative commons zero|creative commons cc0)(?: v)?(?: ?1 0)?(?: universal)?(?: public domain dedication)?"),
    "CcByNcSa": ("CC-BY-NC-SA-4.0", "(?:creative commons attribution noncommercial sharealike|cc by nc sa)(?: lic)? 4 0(?: international)?"),
    "CcByNcNd": ("CC-BY-NC-ND-4.0", "(?:creative commons attribution noncommercial noderivatives|cc by nc nd)(?: lic)? 4 0(?: international)?"),
    "CcByNc": ("CC-BY-NC-4.0", "(?:creative commons attribution noncommercial|cc by nc)(?: lic)? 4 0(?: international)?"),
    "CcBySa": ("CC-BY-SA-4.0", "(?:creative commons attribution sharealike|cc by sa)(?: lic)? 4 0(?: international)?"),
    "CcByNd": ("CC-BY-ND-4.0", "(?:creative commons attribution noderivatives|cc by nd)(?: lic)? 4 0(?: international)?"),
    "CcBy": ("CC-BY-4.0", "(?:creative commons attribution|cc by)(?: lic)? 4 0(?: international)?"),
    "CcBySa3": ("CC-BY-SA-3.0", "(?:creative commons attribution sharealike|cc by sa)(?: lic)? 3 0(?: unported)?"),
    "CcBy3": ("CC-BY-3.0", "(?:creative commons attribution|cc by)(?: lic)? 3 0(?: unported)?"),
}
USE = "(?:this (?:work|software|program|file|project|code|library|package) is )?(?:released|licensed|distributed|published|available|made available) under (?:a |an |the )?(?:terms of (?:the )?)?<name>(?: lic)?(?: the lic)?(?: see (?:the )?lic(?: md| txt)?(?: file)?(?: for (?:more )?(?:details|information))?)?"
# The wording of public licences, normalised. <any> stands for any words.
SENTENCES = {
    "ApacheComply": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at",
    "ApacheBasis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "ApacheTitle": "apache license version 2 0 january 2004(?: http www apache org licenses)?",
    "MitTitle": "(?:the )?mit license(?: mit)?",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction <any>",
    "MitNotice": "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software",
    "AsIs": "the software is provided as is without warranty of any kind <any>",
    "NoLiability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability <any>",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "(?:[1a] )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "(?:[2b] )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdNames": "(?:[3c] )?neither the name of <any> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAsIs": "this software is provided by the copyright holders and contributors as is <any>",
    "BsdNoLiability": "in no event shall the copyright (?:holder|owner|holders|owners) or contributors be liable for any direct indirect incidental special exemplary or consequential damages <any>",
    "Gpl3Later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "Gpl2Later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "Gpl3Only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3(?: of the license)?",
    "Gpl2Only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license (?:version 2 as published by the free software foundation|as published by the free software foundation version 2(?: of the license)?)",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplSee": "see the gnu general public license for more details",
    "GplReceived": "you should have received a copy of the gnu general public license along with this program <any>",
    "Gpl3Title": "gnu general public license version 3 29 june 2007",
    "Gpl2Title": "gnu general public license version 2 june 1991",
    "Lgpl21Later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "Lgpl3Later": "this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LgplHope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "LgplSee": "see the gnu lesser general public license for more details",
    "LgplReceived": "you should have received a copy of the gnu lesser general public license along with this (?:library|program) <any>",
    "Lgpl21Title": "gnu lesser general public license version 2 1 february 1999",
    "Lgpl3Title": "gnu lesser general public license version 3 29 june 2007",
    "Agpl3Later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AgplSee": "see the gnu affero general public license for more details",
    "AgplReceived": "you should have received a copy of the gnu affero general public license along with this program <any>",
    "Agpl3Title": "gnu affero general public license version 3 19 november 2007",
    "Mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "Mpl2Copy": "if a copy of the mpl was not distributed with this file you can obtain one at <any>",
    "Mpl2Title": "mozilla public license version 2 0",
    "Epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0 <any>",
    "Epl1": "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0 <any>",
    "BoostUse2": "distributed under the boost software license version 1 0",
    "BoostGrant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software <any>",
    "ZlibAsIs": "this software is provided as is without any express or implied warranty",
    "ZlibGrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "UnlicenseFree": "anyone is free to copy modify publish use compile sell or distribute this software <any>",
    "Isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "IscAsIs": "the software is provided as is and the author disclaims all warranties with regard to this software <any>",
    "IscNoLiability": "in no event shall the author be liable for any special direct indirect or consequential damages <any>",
    "Wtfpl": "you just do what the fuck you want to",
    "Cc0Title": "(?:creative commons )?cc0 1 0 universal",
    "Cc0Waived": "to the extent possible under law <any> waived all copyright and related or neighboring rights to this work",
    "AllRights": "(?:copyright <any> )?all rights reserved",
}
_GPL, _LGPL, _AGPL = (["GplHope", "GplSee", "GplReceived"], ["LgplHope", "LgplSee", "LgplReceived"], ["GplHope", "AgplSee", "AgplReceived"])
RULES = [
    ("Apache-2.0", ["ApacheUse", "ApacheComply", "ApacheCopy", "ApacheBasis", "ApacheSee"]),
    ("Apache-2.0", ["ApacheUse", "ApacheComply"]),
    ("Apache-2.0", ["ApacheTitle"]),
    ("BSL-1.0", ["BoostGrant", "AsIs"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostUse2"]),
    ("MIT", ["MitTitle", "MitGrant", "MitNotice", "AsIs", "NoLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs", "NoLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitTitle"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "BsdAsIs", "BsdNoLiability"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "BsdAsIs"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdNoLiability"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    *((name, [first, *rest[:n]]) for name, first, rest in (
        ("GPL-3.0-or-later", "Gpl3Later", _GPL), ("GPL-2.0-or-later", "Gpl2Later", _GPL), ("GPL-3.0", "Gpl3Only", _GPL), ("GPL-2.0", "Gpl2Only", _GPL),
        ("LGPL-2.1-or-later", "Lgpl21Later", _LGPL), ("LGPL-3.0-or-later", "Lgpl3Later", _LGPL), ("LGPL-3.0-or-later", "Lgpl3Later", ["GplHope", "LgplSee", "LgplReceived"]),
        ("AGPL-3.0-or-later", "Agpl3Later", _AGPL)) for n in (3, 2, 0)),
    ("GPL-3.0", ["Gpl3Title"]),
    ("GPL-2.0", ["Gpl2Title"]),
    ("LGPL-2.1", ["Lgpl21Title"]),
    ("LGPL-3.0", ["Lgpl3Title"]),
    ("AGPL-3.0", ["Agpl3Title"]),
    ("MPL-2.0", ["Mpl2", "Mpl2Copy"]),
    ("MPL-2.0", ["Mpl2"]),
    ("MPL-2.0", ["Mpl2Title"]),
    ("EPL-2.0", ["Epl2"]),
    ("EPL-1.0", ["Epl1"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Zlib", ["ZlibGrant"]),
    ("Unlicense", ["Unlicense", "UnlicenseFree"]),
    ("Unlicense", ["Unlicense"]),
    ("ISC", ["Isc", "IscAsIs", "IscNoLiability"]),
    ("ISC", ["Isc", "IscAsIs"]),
    ("ISC", ["Isc", "AsIs"]),
    ("ISC", ["Isc"]),
    ("WTFPL", ["Wtfpl"]),
    ("CC0-1.0", ["Cc0Title"]),
    ("CC0-1.0", ["Cc0Waived"]),
    *((name, [use]) for use, (name, _) in NAMES.items()),
    ("Proprietary", ["AllRights"]),
]
#: One of these is in every known sentence.
NEEDED = tuple(x.encode() for x in (
    "license", "licence", "permission", "redistribution", "warranty", "liability", "liable", "copyright", "rights reserved", "received",
    "released", "published", "available", "distributed", "copy of the mpl", "anyone is free", "fuck", "cc0", "provided", "free software", "unencumbered",
))
SPDX = "SPDX="
_SPDX = re.compile(r"(?i)spdx-licen[cs]e-identifier\s*:\s*([A-Za-z0-9.+() -]*[A-Za-z0-9.+)])")
_END = re.compile(r"\n|(?<=[.!?;:])[^\S\n]+")
_OTHER = re.compile("[^a-z0-9]+")
_GAP, _STOP = "[ \n]", "(?=\n|$)"  # between words; a segment's end


def _pattern(words: str) -> str:
    """A regular expression of a pattern of words."""
    out = re.sub(r"\blic\b|\blicense\b", "licen[cs]e", words)
    return out.replace(" ", _GAP)


class Sentence:
    """A known sentence: a beginning, and for those with <any> what follows it."""

    def __init__(self, name: str, words: str) -> None:
        self.name = name
        self.options = []  # (beginning, end or None); an optional part with <any> makes two
        optional = re.match(r"\(\?:([^()]*<any> )\)\?(.*)$", words)
        for own in [optional[1] + optional[2], optional[2]] if optional else [words]:
            before, any_, after = own.partition("<any>")
            if any_:
                tail = after.strip()
                self.options.append((re.compile(_pattern(before.strip()) + _GAP), re.compile("(?<![a-z0-9])" + _pattern(tail) + _STOP) if tail else _NEXT))
            else:
                self.options.append((re.compile(_pattern(own) + _STOP), None))


_NEXT = re.compile(r"(?=\n|$)")
KNOWN = [Sentence(name, words) for name, words in SENTENCES.items()] + [Sentence(name, USE.replace("<name>", words)) for name, (_, words) in NAMES.items()]


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


class Stream:
    """Normalised segments, a line each; where paragraphs (runs of lines with words) end; which segments may begin a known
    sentence; and for each end pattern where it occurs, found when first asked."""

    def __init__(self, text: str) -> None:
        self.places, self.starts, self.paragraphs, parts, size = [], [], [], [], 0
        at, blank = 0, False
        for end in [*_END.finditer(text), None]:
            own = normalised(text[at : end.start() if end else len(text)])
            if own:
                parts.append(own)
                self.starts.append(size)
                self.places.append(at)
                size += len(own) + 1
                blank = False
            if end and end[0] == "\n":
                if blank and size:
                    self.paragraphs.append(size - 1)
                blank = True
            at = end.end() if end else at
        self.paragraphs.append(size)
        self.words = "\n".join(parts)
        self.heads = [x for x in self.starts if _BEGINS.match(self.words, x)]
        self.found: dict[re.Pattern, tuple[list[int], list[int]]] = {}

    def next(self, pattern: re.Pattern, at: int) -> int | None:
        """Where the first occurrence of the pattern behind a word from `at` on ends, if it begins in the same paragraph and
        no later than the next segment that may begin a sentence."""
        if pattern not in self.found:
            all_ = [(m.start(), m.end()) for m in pattern.finditer(self.words)]
            self.found[pattern] = [a for a, _ in all_], [b for _, b in all_]
        begins, ends = self.found[pattern]
        i = bisect_right(begins, at)
        if i == len(begins) or begins[i] > self.paragraphs[bisect_left(self.paragraphs, at)]:
            return None
        j = bisect_left(self.heads, at)
        return ends[i] if j == len(self.heads) or begins[i] <= self.heads[j] else None

    def match(self, sentence: Sentence, at: int) -> int | None:
        """Where the sentence that begins at `at` ends."""
        for begin, end in sentence.options:
            if m := begin.match(self.words, at):
                to = m.end() if end is None else self.next(end, m.end())
                if to is not None:
                    return to
        return None


def identifiers(text: str) -> list[str]:
    """Identifiers of the known sentences in a text, in order."""
    stream, out, i = Stream(text), [], 0
    heads = set(stream.heads)
    tags = {bisect_right(stream.places, m.start()) - 1: SPDX + m[1].strip() for m in _SPDX.finditer(text)}
    while i < len(stream.starts):
        at = stream.starts[i]
        if i in tags:
            out.append(tags[i])
        elif at in heads:
            for sentence in KNOWN:
                to = stream.match(sentence, at)
                if to is not None:
                    out.append(sentence.name)
                    i = bisect_left(stream.starts, to) - 1
                    break
        i += 1
    return out


_BEGINS = re.compile("|".join(begin.pattern for x in KNOWN for begin, _ in x.options))


def matched(found: list[str]) -> tuple[list[str], list[str]]:
    """Licences by the rules, in the order of their places, and the identifiers that no rule takes."""
    left: list[str | None] = list(found)
    out = [(i, x[len(SPDX):]) for i, x in enumerate(found) if x.startswith(SPDX)]
    for i, _ in out:
        left[i] = None
    for name, rule in RULES:
        for i in range(len(left) - len(rule) + 1):
            if left[i] == rule[0] and left[i : i + len(rule)] == rule:
                out.append((i, name))
                left[i : i + len(rule)] = [None] * len(rule)
    return [name for _, name in sorted(out)], [x for x in left if x]


def may_have(text: bytes) -> bool:
    """Whether a text has a word that known sentences need."""
    low = text.lower()
    return any(x in low for x in NEEDED)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, sentences, licenses, unmatched (arrays of names, in order)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = identifiers(text.decode()) if text and may_have(text) else []
                rows.append((found, *matched(found)))
            columns = [pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "sentences", "licenses", "unmatched"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(run, "id long, sentences array<string>, licenses array<string>, unmatched array<string>")
    return out.withColumnRenamed("id", id_col)
