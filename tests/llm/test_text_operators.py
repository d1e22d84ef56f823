"""Text operators against brute force: BPE, token counts, PII, secrets, quality, decontamination."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from relaytrace.llm import bpe, common, decontaminate, pii, quality, secrets, token_counts, token_store
from relaytrace.llm.boosting import Boosted, fit

ODD = [None, "", " ", "\n\n", "a", "plain words here", "naïve café 漢字 😀 ß İ ΟΔΟΣ", "<s> </s> <|endoftext|> <unk>", "x" * 30_000,
       "it's a 'stuff' we'll 12ab!!\t\r\n y", "é   \x01\x02", "word " * 20_000]
CLASH = "doc_id bigint, text string, ids string, spans string, kept string, fp string, n_tokens string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, null ids and columns whose names clash."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "twice"), (3, "twice"), (None, "no id"), (None, None)]
    return spark.createDataFrame([(i, t, *["x"] * 5) for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def fuzz(alphabet, n, most=50, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_bpe_equals_library_and_decodes(spark, odd, none):
    enc = bpe.encoding(bpe.VOCAB)
    out = bpe.decode(bpe.encode(odd, long_text=1000)).collect()
    want = sorted(((i, enc.encode_ordinary(t), t.encode()) for i, t in texts(odd)), key=str)
    assert sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in out), key=str) == want
    raw = bpe.decode(bpe.encode(odd, raw=True)).collect()
    assert sorted(bytes(r["decoded"]) for r in raw) == sorted(w[2] for w in want)
    assert bpe.encode(none).count() == 0


def test_bpe_cuts_are_safe():
    enc = bpe.encoding(bpe.VOCAB)
    for t in fuzz("ab e\n\t'sé漢1.,!  ", 2000):
        assert "".join(bpe.safe_pieces(t, 3)) == t
        assert bpe.encode_text(t, limit=3).tolist() == enc.encode_ordinary(t)


def test_token_counts_equal_library(spark, odd, none):
    count = token_counts.PieceCounter()
    for t in fuzz("ab e\n\t  ▁ñé漢😀<s></>0x'12\x00 ", 3000) + [" " * 500, "a" * 700]:
        assert count(t) == len(count.sp.encode(t))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd).collect() if r["doc_id"] is not None)
    assert got == sorted((False, i, len(t.encode()), len(count.sp.encode(t))) for i, t in texts(odd) if i is not None)
    assert token_counts.count_tokens(none).count() == 0


# ---- PII --------------------------------------------------------------------

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub(r"\D", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")),
            "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute_pii(t):
    return sorted((m.start(), i, k, m.end()) for i, k in enumerate(PII) for m in re.finditer(PII[k], t) if valid(k, m[0]))


def test_pii_base_spans_equal_brute_force(spark, odd, none):
    some = fuzz("ab1234567890. -+@()é😀\x01\x02-_%", 3000, 60) + fuzz("0123456789 -", 500, 40) + [
        "x@y.z mail a.b+c@d-e.co.uk! 1.2.3.4.5 4111 1111 1111 1111, +1 (555) 123-4567.", "9" * 20_000, "a@b" + ".c" * 5000, "a" * 50_000 + "@"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")
    got = dict(pii.find(df, model=Boosted(0.0, [])).collect())
    for i, t in enumerate(some):
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in got[i]] == brute_pii(t), t[:80]
    assert pii.find(odd).count() == odd.count() and pii.find(none).count() == 0


def test_pii_model_adds_spans_and_redacts(spark):
    rows = [(i, f"call me at +1 (202) 555-01{i % 90 + 10} now") for i in range(300)] + [(i, f"part number 12-34-{i}-7788 in stock") for i in range(300, 600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pii.train(df)
    assert np.isfinite(model.threshold)
    spans = {r["doc_id"]: r["spans"] for r in pii.find(df, model=model).collect()}
    assert all(any(s["base"] for s in spans[i]) for i in range(300)) and not any(spans[i] for i in range(300, 600))
    # the same format and context without the plus: only the trees can see it
    more = spark.createDataFrame([(1, "x"), (2, None), (3, "a@b.c, 1.2.3.4"), (None, "a@b.c")], "doc_id bigint, text string").withColumn("extra", F.lit(7))
    out = {(r["doc_id"], r["text"], r["extra"]) for r in pii.redact(more, model=model).collect()}
    assert out == {(1, "x", 7), (2, None, 7), (3, "[EMAIL], [IP]", 7), (None, "[EMAIL]", 7)}


def test_boosting_held_out_precision_and_expression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3) ^ (rng.random(4000) < 0.02)
    model = fit(x, y, precision=0.95)
    fresh = rng.normal(size=(4000, 3))
    on = model.score(fresh) >= model.threshold
    assert on.sum() > 500 and (fresh[on, 0] + 0.5 * fresh[on, 1] > 0.3).mean() > 0.93
    df = spark.createDataFrame([tuple(map(float, r)) for r in fresh[:50]], "a double, b double, c double")
    got = [r[0] for r in df.select(model.column([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert np.allclose(got, model.score(fresh[:50]))
    assert not fit(x, np.zeros(4000, bool)).trees


# ---- secrets ----------------------------------------------------------------

def test_secrets(spark, odd, none):
    kw = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

    def brute(t):
        out = [("assign", *m.span()) for m in re.finditer(rf"(?ai:{kw})([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) >= 12]
        out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        return sorted(out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16])

    rng = random.Random(4)
    bits = ["token", "secret", "API_KEY", "=", ": ", '"', "AKIA", "abcdef0123456789", "Z9" * 8, "_", " ", "passwd", "0f" * 9, "x"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        assert sorted(secrets.base_spans(t)) == brute(t), t
    assert [s[0] for s in secrets.find("key wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLE9KEY end")] == ["token"]
    for clean in ("this_is_a_long_identifier_name", "123e4567-e89b-12d3-a456-426614174000", "getUserNameFromDatabaseConnection", "D41D8CD98F00B204E9800998ECF8427E",
                  "internationalization/localization", "=" * 40, "1234567890123456789012"):
        assert not [s for s in secrets.find(clean) if s[0] == "token"], clean
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(none).count() == 0
    joined = secrets.scan(spark.createDataFrame([(1, "secret=abcdefghijkl")], "doc_id bigint, text string")).select(common.joined_spans(F.col("spans"))).first()[0]
    assert joined == "assign:0:19"


def test_secrets_of_letters_and_inside_runs():
    def tokens(t):
        return [t[a:b] for kind, a, b, _ in secrets.find(t) if kind == "token"]

    rng = random.Random(9)
    lower, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters in (lower, mixed, mixed[26:]):  # a few random strings look like words
        keys = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(200)]
        assert sum(tokens(f"a {key}.") == [key] for key in keys) >= 190
    key = "kqzXvbWpLmRtYhGdSjFc42"
    for t in ("key {} end", "/internationalization/localization/configuration/{}/information", "application_configuration_information_identifier_{}",
              "information={}", "Authorization-Information-Localization-{}", "123e4567-e89b-12d3-a456-426614174000/{}"):
        found = tokens(t.format(key))
        assert found == [key], t
    assert tokens("0123456789abcdef0123_" + key) == [key]
    assert tokens("sent Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA== here") == ["Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA=="]
    for clean in ("usr/local/lib/python/site-packages", "information_about_2024_report", "OPTIMIZED_BYTECODE_SUFFIXES", "erberbeeinheitkeiter", "do_not_use_it_as_is_if_on_it", "a_b_c_d_e_f_g_h_i_j_k_l",
                  "2024-01-02-03-04-05-06", "InformationAboutConfiguration2024", "D41D8CD98F00B204E9800998ECF8427E/information"):
        assert not tokens(clean), clean


# ---- quality ----------------------------------------------------------------

def brute_counts(t):
    w = re.findall(r"[^ \t\n\v\f\r]+", t)
    at = set()
    for i in range(len(w) - 4):
        if any(w[i:i + 5] == w[j:j + 5] for j in range(len(w) - 4) if j != i):
            at.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^ \t\n\v\f\r]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(at)


def test_quality_counts_and_bands(spark, odd, none):
    for t in fuzz("ab \n#\t\x1c", 1500, 120):
        assert quality.counts(t) == brute_counts(t)
    squeeze = zstandard.ZstdCompressor(level=3)
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900))
    import base64
    blob = base64.b64encode(rng.randbytes(6000)).decode()
    assert quality.in_bands(prose.encode(), squeeze)
    assert not quality.in_bands(("buy now " * 400).encode(), squeeze)
    assert not quality.in_bands(blob.encode(), squeeze)
    assert not quality.in_bands((prose + "buy now " * 3000).encode(), squeeze) and not quality.in_bands(b"", squeeze)
    got = {(r["doc_id"], r["n_words"], r["kept"]) for r in quality.rules(odd).collect()}
    assert (0, 0, False) in got and len(quality.rules(odd).collect()) == odd.count()
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and all(r["text"] for r in kept.collect())
    assert quality.rules(none).count() == 0


def test_one_bad_chunk_rejects():
    import base64
    squeeze = zstandard.ZstdCompressor(level=3)
    rng = random.Random(10)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = " ".join(rng.choice(words) for _ in range(14_000)).encode()
    blob = base64.b64encode(rng.randbytes(9000))
    for size in (5, 8, 16):
        text = prose[:size * 4096]
        assert quality.in_bands(text, squeeze) and quality.in_bands(text + prose[:500], squeeze)
        for at in range(size):
            bad = text[:at * 4096] + blob[:4096] + text[(at + 1) * 4096:]
            assert not quality.in_bands(bad, squeeze)
            assert not quality.in_bands(text[:at * 4096] + blob[:8192] + text[at * 4096:], squeeze)
    # a short tail and the chunk before it are one
    ratio = lambda x: len(x) / len(squeeze.compress(x))
    ends = [(prose[:k] + blob[:4096 - k], blob[5000:6000]) for k in range(0, 4096, 16)]
    ends = [(chunk, tail) for chunk, tail in ends if ratio(chunk) >= quality.Bands().chunk[0] > ratio(chunk + tail)]
    assert ends
    for chunk, tail in ends:
        assert quality.in_bands(prose[:5 * 4096] + chunk, squeeze) and not quality.in_bands(prose[:5 * 4096] + chunk + tail, squeeze)


# ---- decontamination --------------------------------------------------------

def make_items(rng, n):
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    return vocab, [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(4, 40))) + ". " + " ".join(rng.choice(vocab) for _ in range(6)) + ".") for i in range(n)]


def test_search_equals_exhaustive_scores():
    rng = random.Random(6)
    vocab, items = make_items(rng, 60)
    from collections import Counter
    df = Counter(w for _, t in items for w in set(decontaminate.words(t)))
    index = decontaminate.Index([decontaminate.Item(i, *map(decontaminate.words, decontaminate.halves(t)), df) for i, t in items], 60, 25.0, 0.3)
    for _ in range(200):
        terms = np.array([index.term.get(rng.choice(vocab), 0) for _ in range(rng.randint(1, 300))])
        found = {}
        for lo, hi, blocks in index.passages(terms):
            q = sorted(set(terms[lo:hi].tolist()) - {0})
            found[lo] = {d: round(s, 9) for b in blocks for d, s in index.search(q, b)}
        step = index.window // 2
        for lo in range(0, max(1, len(terms)), step):
            if lo and lo + step >= len(terms):
                break
            q = set(terms[lo:lo + index.window].tolist()) - {0}
            score = {d: sum(index.impact[t][index.docs[t].index(d)] for t in q if d in index.docs[t]) for d in range(60)}
            assert found.get(lo, {}) == {d: round(s, 9) for d, s in score.items() if s >= 0.3 - 1e-9}


def test_leaks_and_blocks(spark, odd, none, monkeypatch):
    rng = random.Random(7)
    _, items = make_items(rng, 30)
    noise = lambda n: " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(5)) for _ in range(n))
    docs = [(i, f"{noise(200)} {items[i][1]} {noise(150)}") for i in range(10)] + [(10, noise(400)), (11, None), (12, ""), (12, ""), (None, items[3][1].upper())]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    tests = spark.createDataFrame(items + [(90, None), (91, ""), items[0]], "item_id bigint, text string")
    want = sorted([(i, i) for i in range(10)] + [(None, 3)], key=str)
    assert sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, tests).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, tests).collect()), key=str) == want
    clean = decontaminate.clean(d, tests)
    assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == [10, 11, 12, 12]
    assert decontaminate.leaks(d, tests.limit(0)).count() == 0 and decontaminate.leaks(none, tests).count() == 0
    assert decontaminate.clean(odd, tests).count() == odd.count()


# ---- token files ------------------------------------------------------------

def test_token_store_round_trip(spark, odd, none):
    import public_tokenizers
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_store.VOCAB))
    ids = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
    some = fuzz("aB'sé.,!?^ \n\t\x1c ́İßΣσ漢9_😀É", 1500, 30)
    assert token_store.encode_texts(some) == [ids(t).tobytes() for t in some]
    hashes = {r["text"] or "": r["h"] for r in odd.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = sorted(texts(odd), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    folder = token_store.write_store(odd)
    got = token_store.read_store(spark, folder).orderBy("start").collect()
    start = 0
    for (i, t), r in zip(rows, got, strict=True):
        want = ids(t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    shard = token_store.manifest(spark, folder).orderBy(F.desc("shard")).first()
    assert token_store.read_document(folder, shard["path"], 5).tolist() == ids(ODD[5]).tolist()
    assert token_store.read_document(folder, shard["path"], 12345) is None
    assert token_store.read_store(spark, token_store.write_store(none)).count() == 0


def test_token_store_spreads_one_id_over_shards(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text of "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one shard
    try:
        folder = token_store.write_store(df.repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = [r["path"] for r in token_store.manifest(spark, folder).collect()]
    assert sum(token_store.read_document(folder, p, 7) is not None for p in shards) > 1
    got = token_store.read_store(spark, folder, with_ids=False).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got) and sum(r["doc_id"] == 7 for r in got) == 1001


def test_other_vocabularies_get_the_library_s_ids():
    import public_tokenizers
    import tokenizers

    some = ["It's  a naïve\n\ntest", "", " lead and trail ", "CAPS and ünï", "a\tb\x1cc", "^~`|#*", *fuzz("aB'sé.,!?^ \n\t漢9_😀", 300, 30)]
    for vocab in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok = tokenizers.Tokenizer.from_file(public_tokenizers.path(vocab))
        want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        assert token_store.encode_texts(some, vocab, None) == want


def test_token_store_uses_a_trained_dictionary(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common words of many documents"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    folder = token_store.write_store(df)
    assert token_store.read_store(spark, folder).count() == 400
    found = token_store.train_dictionary(df, "doc_id", "text", token_store.encode_texts)
    assert len(found) > 1000 and hashlib.sha256(found).hexdigest() == re.search(
        r"dict-(\w+)", " ".join(p.path for p in token_store.files.place(folder)[0].get_file_info(token_store.files.fs.FileSelector(token_store.files.place(folder)[1]))))[1]
