"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from relaytrace.llm import collocation

ROWS = "doc_id bigint, text string, lang string, n string, chunk string, phrase string"


def brute(rows, least, top=2000, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        inside = any(x == lang and len(v) > len(w) and b >= a and any(v[i:i + len(w)] == w for i in range(len(v))) for (x, v), b in cand.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out.sort()
    got, rank = [], Counter()
    for lang, s, a, p, left, right, total in out:
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, total, -s))
    return got


def mixed(seed, docs=60):
    rng = random.Random(seed)
    words = ["a", "B", "c", "the", "É", "x\x00y", "\x1c", "ß", "z", "漢字"]
    shared = " ".join(rng.choices(words, k=40))
    out = []
    for _ in range(docs):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " \x0b"]) for w in rng.choices(words, [9, 8, 7, 6, 5, 4, 3, 2, 1, 1], k=rng.randint(0, 90)))
        out.append((text + rng.choice(["", " " + shared, "\n" + shared]), rng.choice(["en", "en", "de", None])))
    return out + [(None, "en"), ("", None), ("   ", "en"), ("only", "fr"), ("go " * 3000, "en"), *[("the same text again and again", "en")] * 7]


@pytest.mark.parametrize(("seed", "least", "top", "period", "block"), [(1, 5, 2000, 3, 200), (2, 3, 4, 8, 1 << 20), (3, 1, 2000, 1, 64)])
def test_collocations_equal_brute_force(spark, seed, least, top, period, block):
    rows = mixed(seed, 60 if least > 1 else 12)
    df = spark.createDataFrame([(None, t, lang, "n", "c", "p") for t, lang in rows], ROWS).repartition(3)
    got = collocation.collocations(df, least=least, top=top, period=period, block=block)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, least, top))


def test_parse_is_a_partition_of_the_words(spark):
    """Every word starts in exactly one chunk, and equal pieces are cut alike."""
    text = " ".join(random.Random(5).choices("abcdefgh", k=500))
    df = spark.createDataFrame([(1, text, "en", "", "", ""), (2, "other words, " + text, "en", "", "", "")], ROWS)
    found = {(r["chunk"], r["n"]) for r in collocation.parse(df, period=4).collect()}
    words = sum((len(c.split()) - 4 * c.endswith(" ")) * n for c, n in found)
    assert words == 2 * 500 + 2
    assert all(n >= 2 for c, n in found if c not in ("other words",)) and len(found) > 50


def test_empty_table(spark):
    assert collocation.collocations(spark.createDataFrame([], ROWS)).count() == 0


def test_scores_past_64_bits(spark):
    """1000 * a * n and l * r pass 64 bits without loss."""
    a, n = 3_000_000_000, 9_000_000_000_000
    num = spark.range(1).selectExpr(f"cast(1000 as decimal(38,0)) * cast({a} as decimal(38,0)) * cast({n} as decimal(38,0)) AS num",
                                    f"cast({a} as decimal(38,0)) * cast({a + 7} as decimal(38,0)) AS den")
    assert num.selectExpr("num div den AS s").first()["s"] == 1000 * a * n // (a * (a + 7))


def test_bit_table_keeps_every_hash(spark):
    """A table far too small still holds every hash, negative ones too."""
    hashes = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 500)
    table = collocation.bit_table(spark.createDataFrame([(int(h),) for h in hashes], "h bigint"), 500, most=1 << 10)
    assert table[1] == 1 << 10 and collocation._known(table, hashes.view(np.uint64)).all()


def test_weights_past_doubles():
    w = np.array([2**53 + 1, 5, 2**60 + 3, 7], np.int64)
    assert collocation._weighted(np.array([0, 1, 0, 1]), w, 2).tolist() == [2**53 + 2**60 + 4, 12]


def test_small_tables_change_no_count(spark, monkeypatch):
    """Bit tables that let nearly everything through leave the result as it is."""
    rows = mixed(11, 40)
    df = spark.createDataFrame([(None, t, lang, "n", "c", "p") for t, lang in rows], ROWS)
    monkeypatch.setattr(collocation.bit_table, "__defaults__", (64,))
    assert sorted(map(tuple, collocation.collocations(df, least=4).collect())) == sorted(brute(rows, 4))
