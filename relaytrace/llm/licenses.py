"""License scans by a positional index of rare words.

Every licence template is a list of words with mandatory key phrases.  It is
indexed under its highest-IDF words (IDF over the templates), each posting
with the word's position.  What a file looks up are thus its own highest-IDF
licence words.  A word at place p of the file and q of a template proposes that
the template begins at p - q; the postings are intersected by these relative
positions, in windows that allow for inserted and left-out words.  Where enough
different rare words agree, the template's key phrases must stand inside the
window, and the IDF-weighted share of its words found at their places is the
score.

A text is kept as one number a word (0: in no template), so memory is four
bytes a word however long it is, and all windows of a template are judged
together; the work is linear in the text.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaytrace.llm.common import narrow
from relaytrace.session import ship_package

# fixed phrases of the scan and their labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Least IDF-weighted share of a template's words at their places.
SHARE = 0.7
#: Most words under which a template is indexed.
RARE = 8
#: Characters of a text whose words are looked at together.
BLOCK = 1 << 20

# Short forms and notices of public licences, with the phrases
# that each must hold.  (label, key phrases, text)
TEMPLATES = (
    ("agpl-3.0", ("gnu affero general public license",), "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", ("apache license", "version 2 0"), "licensed under the apache license version 2 0"),
    ("apache-2.0", ("apache license", "on an as is basis"),
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
     "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
     "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd-2-clause", ("bsd 2 clause license",), "licensed under the bsd 2 clause license"),
    ("bsd-3-clause", ("bsd 3 clause license",), "licensed under the bsd 3 clause license"),
    ("bsd-2-clause", ("redistributions of source code", "redistributions in binary form"),
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
     "in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", ("endorse or promote products", "specific prior written permission"),
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission"),
    ("bsl-1.0", ("boost software license",), "distributed under the boost software license version 1 0"),
    ("cc-by-4.0", ("cc by 4 0",), "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", ("cc by nc 4 0",), "licensed under cc by nc 4 0"),
    ("cc-by-nc-nd-4.0", ("cc by nc nd 4 0",), "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", ("cc by nc sa 4 0",), "licensed under cc by nc sa 4 0"),
    ("cc-by-nd-4.0", ("cc by nd 4 0",), "licensed under cc by nd 4 0"),
    ("cc-by-sa-4.0", ("cc by sa 4 0",), "licensed under cc by sa 4 0"),
    ("cc-by-4.0", ("commons attribution 4 0",), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", ("commons attribution noncommercial 4 0",), "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4.0", ("commons attribution sharealike 4 0",), "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0-1.0", ("cc0",), "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-2.0", ("gnu general public license", "version 2"), "licensed under the gnu general public license version 2"),
    ("gpl-3.0", ("gnu general public license", "version 3"), "licensed under the gnu general public license version 3"),
    ("gpl-2.0-or-later", ("gnu general public license", "either version 2 of the license or"),
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", ("gnu general public license", "either version 3 of the license or"),
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", ("isc license",), "licensed under the isc license"),
    ("isc", ("with or without fee",),
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-2.1", ("gnu lesser general public license", "version 2 1"), "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3.0", ("gnu lesser general public license", "version 3"), "licensed under the gnu lesser general public license version 3"),
    ("mit", ("mit license",), "licensed under the mit license"),
    ("mit", ("mit license",), "released under the mit license"),
    ("mit", ("permission is hereby granted free of charge", "without restriction"),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
     "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
     "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain"),
    ("zlib", ("freely subject to the following restrictions",),
     "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it "
     "freely subject to the following restrictions"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


class Template:
    """A template's words as numbers, their weights, and its rare words.

    ``slack`` is how many words a file may have more or fewer before a place."""

    def __init__(self, label: str, keys: list[np.ndarray], ids: np.ndarray, idf: dict[int, float], rare: int):
        self.label, self.keys, self.ids = label, keys, ids
        self.weight = np.array([idf[i] for i in ids.tolist()])
        self.weight /= self.weight.sum()
        self.slack = 2 + len(ids) // 10
        by_idf = sorted(set(ids.tolist()), key=lambda i: (-idf[i], i))
        self.rare = by_idf[:min(rare, (len(by_idf) + 1) // 2)]
        self.need = (len(self.rare) + 1) // 2


class Index:
    """Positional index of templates under their rare words."""

    def __init__(self, templates=TEMPLATES, base=BASE, rare: int = RARE):
        self.vocab: dict[str, int] = {}
        listed = [(label, [self._ids(k) for k in keys], self._ids(text)) for label, keys, text in templates]
        self.base = [(self._ids(phrase), label) for phrase, label in base]
        df = Counter(i for _, _, ids in listed for i in set(ids.tolist()))
        idf = {i: math.log(1 + len(listed) / n) for i, n in df.items()}
        self.templates = [Template(label, keys, ids, idf, rare) for label, keys, ids in listed]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, tem in enumerate(self.templates):
            for q, i in enumerate(tem.ids.tolist()):
                if i in tem.rare:
                    self.postings.setdefault(i, []).append((t, q))
        self.is_rare = np.zeros(len(self.vocab) + 1, bool)
        self.is_rare[list(self.postings)] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in _words(text)], np.int32)

    def numbers(self, text: str, block: int = BLOCK) -> np.ndarray:
        """One number a word of the text; 0 for words of no template."""
        out, at, get = [], 0, self.vocab.get
        while at < len(text):
            m = _GAP.search(text, at + block) if len(text) - at > block else None
            end = m.start() if m else len(text)
            words = _words(text[at:end])
            out.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def places(self, phrase: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where the words of ``phrase`` stand consecutively."""
        at = np.flatnonzero(ids[:max(0, len(ids) - len(phrase) + 1)] == phrase[0])
        for j in range(1, len(phrase)):
            at = at[ids[at + j] == phrase[j]]
        return at

    def base_places(self, ids: np.ndarray) -> list[tuple[str, int, int, float, bool]]:
        return [(label, p, p + len(phrase), 1.0, True) for phrase, label in self.base for p in self.places(phrase, ids).tolist()]

    def windows(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Per template, the least begin of the windows in which enough of its
        rare words agree on where it begins; a window is 2 * slack + 1 wide."""
        hits = np.flatnonzero(self.is_rare[ids])
        if not len(hits):
            return {}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        words = ids[hits]
        for i in np.unique(words).tolist():
            at = hits[words == i]
            for t, q in self.postings[i]:
                found.setdefault(t, []).append((at - q, i))
        out = {}
        for t, lists in found.items():
            tem = self.templates[t]
            if len({i for _, i in lists}) < tem.need:
                continue
            step = tem.slack + 1  # windows overlap, so begins that differ by up to slack share one
            cells = []
            for begins, i in lists:
                cell = np.floor_divide(begins, step)
                both = np.unique(np.concatenate([cell, cell - 1]))
                cells.append(both * len(self.is_rare) + i)
            # a rare word that stands twice in the template counts once a window
            cells = np.unique(np.concatenate(cells))
            cell, n = np.unique(np.floor_divide(cells, len(self.is_rare)), return_counts=True)
            if (ok := cell[n >= tem.need]).size:
                out[t] = ok * step
        return out

    def best(self, t: int, begins: np.ndarray, ids: np.ndarray, phrases: dict[bytes, np.ndarray], share: float) -> tuple[str, int, int, float, bool] | None:
        """The template's best window that holds every key phrase, if it scores."""
        tem = self.templates[t]
        width, size = 2 * tem.slack + 2, len(tem.ids)
        for key in tem.keys:
            if (name := key.tobytes()) not in phrases:
                phrases[name] = self.places(key, ids)
            at = phrases[name]
            first = np.searchsorted(at, begins)
            ends = np.append(at, len(ids) + width + size)[first] + len(key)  # none left: past every window
            begins = begins[ends <= begins + width + size]
            if not len(begins):
                return None
        top, where = 0.0, 0
        per = max(1, (1 << 20) // size)
        for lo in range(0, len(begins), per):
            some = begins[lo:lo + per]
            hit = np.zeros((len(some), size), bool)
            for d in range(width):
                at = some[:, None] + (d + np.arange(size))
                ok = (at >= 0) & (at < len(ids))
                hit |= ok & (ids[np.clip(at, 0, len(ids) - 1)] == tem.ids)
            score = hit @ tem.weight
            j = int(score.argmax())
            if score[j] > top + 1e-12:
                top, where = float(score[j]), int(some[j])
        if top < share:
            return None
        return tem.label, max(where, 0), min(where + width + size, len(ids)), min(top, 1.0), False

    def scan(self, text: str, share: float = SHARE, block: int = BLOCK) -> tuple[int, list[tuple[str, int, int, float, bool]]]:
        """Number of words, and ``(label, first word, end, score, base)`` of the
        places of the fixed phrases and of the best window of each label."""
        ids = self.numbers(text, block)
        if not len(ids) or not ids.any():
            return len(ids), []
        out: dict[str, tuple[str, int, int, float, bool]] = {}
        phrases: dict[bytes, np.ndarray] = {}
        for t, begins in self.windows(ids).items():
            got = self.best(t, begins, ids, phrases, share)
            if got and (got[0] not in out or (-got[3], got[1]) < (-out[got[0]][3], out[got[0]][1])):
                out[got[0]] = got
        return len(ids), sorted([*self.base_places(ids), *out.values()], key=lambda m: (m[1], m[0], not m[4]))


@functools.lru_cache(maxsize=1)
def default_index() -> Index:
    return Index()


MATCHES = "array<struct<label:string,first:bigint,end:bigint,score:double,base:boolean>>"
_MATCH_ARROW = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
_OUT_ARROW = pa.struct([("n_words", pa.int64()), ("matches", _MATCH_ARROW)])
_NAMES = ("label", "first", "end", "score", "base")


def license_matches(text: Column, share: float = SHARE) -> Column:
    """Column of ``struct<n_words, matches>`` of a text; see ``scan``."""

    @F.arrow_udf(f"struct<n_words:bigint,matches:{MATCHES}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = default_index()
        for batch in batches:
            rows = []
            for v in batch:
                n, found = index.scan(v.as_py() or "", share)
                rows.append({"n_words": n, "matches": [dict(zip(_NAMES, m, strict=True)) for m in found]})
            yield pa.array(rows, _OUT_ARROW)

    return run.asNondeterministic()(text)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``(id_col, n_words, matches)``: the licence statements of every whole text.

    A match has a label, its first word and end (words from 0), a score and
    whether it is a place of a fixed phrase (every place is given, score 1).
    Of the templates' matches the best of each label is given, the first of
    equal ones.  A null or empty text has no words and no matches; a null id
    stays null; repeated rows are scanned each; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    out = narrow(df, id_col, text_col).select(id_col, license_matches(F.col(text_col), share).alias("found"))
    return out.select(id_col, "found.n_words", "found.matches")
