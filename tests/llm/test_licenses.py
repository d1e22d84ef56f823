"""License scans against brute force and written notices."""

import random
import re

import numpy as np
import pytest

from relaytrace.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = "doc_id bigint, text string, n_words string, matches string, labels string, found string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def brute_base(text):
    w = words(text)
    out = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(label, i) for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), sorted(out)


def test_query_columns_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    parts = ["CC", "by", " BY-", "cc\tby", "General Public License", "general  public", "license", "All Rights", "rights reserved", "ALL.RIGHTS,RESERVED", "é", "x", "ccby", "İ", "\x00", ". "]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "cc by " * 30_000), (903, "z" * 100_000), (3, "cc by"), (3, "cc by"), (None, "all rights reserved"), (904, "ccby all rights"), (905, " cc by")]
    spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_licenses(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = []
    for i, t in rows:
        n, base = brute_base(t or "")
        at = [p for _, p in base]
        want.append((i, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in base}))))
    rows = got.collect()
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(want, key=str)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    assert licenses.scan(spark.createDataFrame([], CLASH)).count() == 0


def added(text, **kw):
    return {m[0] for m in licenses.default_index().scan(text, **kw)[1] if not m[4]}


@pytest.mark.parametrize(("text", "want"), [
    ("Released under the MIT License.", {"mit"}),
    ("code, licensed under the MIT license (see LICENSE)", {"mit"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
    ("Licensed under CC BY 4.0.", {"cc-by-4.0"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
    ("This work is licensed under the GNU Affero General Public License, version 3.", {"agpl-3.0"}),
    ("under the GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
    ("licensed by the mit people under some license", set()),
    ("the general public license of version three, all rights reserved", set()),
    ("version 3 of the public library, licensed in general under the gnu", set()),
    ("", set()),
])
def test_notices(text, want):
    assert added(text) == want
    assert added("Wer das liest. " * 40 + text + "\nund so weiter, " * 40) == want


def test_full_texts_changed_here_and_there():
    """Every long template is found among other words with one word in twelve
    replaced or left out (key phrases kept), and not without a key phrase."""
    rng = random.Random(8)
    for label, keys, text in licenses.TEMPLATES:
        w = text.split()
        if len(w) < 25:
            continue
        fixed = set()
        for k in keys:
            k = k.split()
            fixed |= {i + j for i in range(len(w)) if w[i:i + len(k)] == k for j in range(len(k))}
        free = [i for i in range(len(w)) if i not in fixed]
        gone = set(rng.sample(free, len(w) // 12))
        changed = " ".join("foo" if i % 2 else "" for i in range(300)) + " " + " ".join(rng.choice(["", "changed"]) if i in gone else x for i, x in enumerate(w))
        assert label in added(changed), label
        assert label not in added(changed.replace(keys[0], keys[0].replace(" ", " or "))), label


def test_windows_equal_all_alignments():
    """The index proposes a window for every alignment that a plain scan over all
    begins accepts, and the score is the plain one's or better."""
    ix = licenses.Index(templates=(("t", ("b c",), "a b c d e f g h"), ("u", ("x",), "x a d y z")), rare=4)
    rng = random.Random(2)
    for _ in range(400):
        text = " ".join(rng.choices("abcdefghxyz_", k=rng.randint(1, 30)))
        ids = ix.numbers(text)
        got = {m[0]: m[3] for m in ix.scan(text, share=0.5)[1] if not m[4]}
        for t in ix.templates:
            for b in range(-2, len(ids)):
                at = b + np.arange(len(t.ids))
                ok = (at >= 0) & (at < len(ids)) & (ids[np.clip(at, 0, len(ids) - 1)] == t.ids)
                agree = len({int(i) for i, hit in zip(t.ids, ok, strict=True) if hit} & set(t.rare))
                keyed = all(any(max(b, 0) <= p and p + len(k) <= b + len(t.ids) for p in ix.places(k, ids).tolist()) for k in t.keys)
                if keyed and agree >= t.need and ok @ t.weight >= 0.5:
                    assert got.get(t.label, 0) >= ok @ t.weight - 1e-9


def test_long_and_hot_texts():
    """Work stays linear: a million rare words, and blocks cut inside a text."""
    ix = licenses.default_index()
    assert ix.scan("mit " * 1_000_000)[0] == 1_000_000
    text = "Released under the MIT License. " * 20_000
    n, found = ix.scan(text, block=1000)
    assert n == 100_000 and [m for m in found if not m[4]] == [m for m in ix.scan(text)[1] if not m[4]]
    assert np.array_equal(ix.numbers(text, 17), ix.numbers(text))
