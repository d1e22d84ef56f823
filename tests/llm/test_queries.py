"""The registered queries on a whole small table, against the libraries and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from relaytrace.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return {int(i): t or "" for i, t in zip(d["doc_id"], d["text"], strict=True)}


def rows(spark, query, *cols):
    got = query(spark, SF).collect()
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in got}, len(got)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op1(spark, docs):
    enc = bpe.encoding(bpe.VOCAB)
    want = {}
    for i, t in docs.items():
        ids = enc.encode_ordinary(t)
        want[i] = len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())
    assert rows(spark, queries.op1_bpe_round_trip, "n_tokens", "ids_sha256", "decoded_sha256") == (want, len(want))


def test_op3(spark, docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in docs.items()}
    assert rows(spark, queries.op3_token_counts, "n_bytes", "n_tokens", "over_limit") == (want, len(want))


def test_op5(spark, docs):
    import public_tokenizers
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for i in sorted(docs):
        ids = np.array(tok.encode(docs[i], add_special_tokens=False).ids + [2], "<u4")
        want[i] = start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)
    assert rows(spark, queries.op5_token_files, "start", "n_tokens", "ids_crc32") == (want, len(want))


def joined(found, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(((a, kinds.index(k), b) for k, a, b in found)) for k in [kinds[k]])


def digits(s):
    return re.sub(r"[^0-9]", "", s)


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_op4(spark, docs):
    kinds = ["email", "ip", "card", "phone"]
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
               "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
          "card": lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    want = {}
    for i, t in docs.items():
        found = [(k, *m.span()) for k in kinds for m in re.finditer(pattern[k], t) if ok[k](m[0])]
        want[i] = *(sum(f[0] == k for f in found) for k in kinds), sha(joined(found, kinds).encode())
    got = rows(spark, queries.op4_personal_data, "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == (want, len(want)) and any(sum(w[:4]) for w in want.values())


def test_op7(spark, docs):
    kinds = ["assign", "access", "hex"]
    word = "".join
    low = word(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|")
    pattern = {"assign": f"({low}[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    ok = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    want = {}
    for i, t in docs.items():
        found = [(k, *m.span()) for k in kinds for m in re.finditer(pattern[k], t) if ok[k](m)]
        want[i] = *(sum(f[0] == k for f in found) for k in kinds), sha(joined(found, kinds).encode())
    assert rows(spark, queries.op7_secrets, "n_assign", "n_access", "n_hex", "base_sha256") == (want, len(want))


def test_op8(spark, docs):
    from collections import Counter

    want = {}
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen, dup = set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        grams = [tuple(words[j:j + 5]) for j in range(len(words) - 4)]
        n = Counter(grams)
        covered = {j + d for j, g in enumerate(grams) if n[g] > 1 for d in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want[i] = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed
    got, many = rows(spark, queries.op8_quality_rules, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {i: r[:6] for i, r in got.items()} == want and many == len(want)
    assert not any(r[5] and r[6] for r in got.values())


def test_op10(spark, docs):
    lower = {c: c + 32 for c in range(65, 91)}
    fp = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        grams = [" ".join(w[j:j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in fp}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(fp)
    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            if (fp[i] ^ fp[j]).bit_count() <= 3 and (x := find(i)) != (y := find(j)):
                least[max(x, y)] = min(x, y)
    want = {i: (f"{fp[i]:016x}", find(i)) for i in ids}
    assert rows(spark, queries.op10_simhash_groups, "fingerprint", "component_id") == (want, len(want))


def test_op11_and_op12_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op11_collocations", "op12_hard_negatives"):
        want = con.execute(queries.ORACLE_SQL[name])
        cols = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, SF).select(*cols).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got
