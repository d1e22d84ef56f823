"""WARC, main text, SimHash and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relaytrace.llm import bpe, components, files, html_text, simhash, warc


# ---- WARC -------------------------------------------------------------------

def pages(spark):
    fake = warc.record(999, "http://x", b"y" * 200, "0" * 64, None).decode()
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("<p>abc é") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows += [(100 + i, "http://dup", "same " * 40) for i in range(30)] + [(200 + i, None, "small") for i in range(3)]
    rows += [(300, "http://fake\r\nX: y", fake * 3), (301, "u", fake), (302, "u", "x" * 50_000), (303, None, None), (304, "u", ""), (305, "u", "same page " * 20),
             (305, "u", "same page " * 20), (306, "u", "same page " * 20)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, payload string")


@pytest.mark.parametrize("gzip", [True, False])
@pytest.mark.parametrize("range_bytes", [700, 1 << 20])
def test_warc_round_trip(spark, gzip, range_bytes):
    df = pages(spark)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    first = {}
    for i, p in rows:
        first[p] = min(first.get(p, i), i)
    want = []
    for i, p in rows:
        revisit = len(p) >= 100 and first[p] != i
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None, None if revisit else p))
    folder = warc.write_warc(df.coalesce(2), gzip=gzip)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))
           for r in warc.read_warc(spark, folder, range_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_magic_inside_payloads_is_a_candidate_and_rejected(spark, tmp_path):
    inner = warc.gzipped(warc.record(5, None, b"in" * 100, hashlib.sha256(b"in" * 100).hexdigest(), None), level=0)
    outer = warc.gzipped(warc._MAGIC + b"Content-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n", level=0)
    path = str(tmp_path / "a.warc.gz")
    with files.written(path) as f:
        f.write(outer + outer)
    found = warc.candidates(path, 0, 2 * len(outer))
    assert len(found) == 4 and [a for a, b in found if b >= 0] == [0, len(outer)]


def test_warc_empty(spark):
    folder = warc.write_warc(pages(spark).limit(0))
    assert warc.read_warc(spark, folder).count() == 0


# ---- main text --------------------------------------------------------------

LONG = "Plain words of the article that go on for a while, without any links at all. " * 3


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<html></html>", ""), ("just text", "just text"), ("<p>a &amp; b<p>c\n  d", "a & b\nc d"),
    (f"<body><nav><a href=a>Menu</a></nav><article><h1>T</h1><p>{LONG}</p><script>var x='</p>';</script><p>End <b>bold</b>.</p></article><footer>(c)</footer>",
     f"T\n{LONG.strip()}\nEnd bold."),
    (f"<body><div class='site-header'>Site</div><div id=page><div class='post'><h2>H</h2><div><p>{LONG}</p></div><div><p>{LONG}</p></div></div>"
     f"<div id='comments'><p>{LONG}</p></div><div class=sidebar><a href=x>l</a></div></div>", f"H\n{LONG.strip()}\n{LONG.strip()}"),
    (f"<body><main><p>{LONG}</p><form><p>Subscribe</p></form><div class='cookie-notice'>Cookies</div><aside>More</aside></main>", LONG.strip()),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def paragraphs(a, b):
    return [f"Sentence {i} of it, in plain words that go on for a while. " * 4 for i in range(a, b)]


def tagged(some):
    return "".join(f"<p>{x}</p>" for x in some)


def lines(*some):
    return "\n".join(x.strip() for x in some)


MENU = "<ul>" + "".join(f"<li><a href=/{i}>Entry number {i}</a></li>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize("cuts", [(0, 2, 5), (0, 1, 9), (0, 1, 2, 10), (0, 6, 8), (0, 3, 4, 5, 9)])
@pytest.mark.parametrize("menu", ["", MENU])
def test_main_text_of_sections_in_the_body(cuts, menu):
    some = paragraphs(0, cuts[-1])
    sections = [f"<h2>Part {i}</h2><div>{tagged(some[a:b])}</div>" for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    want = lines(*(x for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for x in (f"Part {i}", *some[a:b])))
    for page in (f"<body>{menu}{''.join(sections)}<div class=footer>(c) Someone</div></body>", f"<body><div>{menu}</div><div id=page><div>{''.join(sections)}</div></div>{menu}</body>"):
        assert html_text.main_text(page) == want
    assert html_text.main_text(f"<body>{''.join(sections[:1])}<p>Short.</p>{''.join(sections[1:])}</body>").count("Short.") == 1
    if len(cuts) == 3:
        assert html_text.main_text(f"<body>{menu}{''.join(sections)}<div>(c) Someone</div></body>") == want


@pytest.mark.parametrize("open_, close", [
    ("<div class='content has-sidebar'>", "</div>"), ("<div class=no-sidebar>", "</div>"), ("<div class='page with-nav'>", "</div>"), ("<div class='post social-post'>", "</div>"),
    ("<div id=widget-area-main>", "</div>"), ("<form action=/>", "</form>"), ("<form><div class=toolbar-page><div class=sidebar-wrap>", "</div></div></form>")])
@pytest.mark.parametrize("tag", ["article", "main", "div", ""])
def test_main_text_within_wrappers(open_, close, tag):
    some = paragraphs(0, 4)
    inner = f"<{tag}>{tagged(some)}</{tag}>" if tag else tagged(some)
    page = f"<body><div class=nav>{MENU}</div>{open_}{inner}<div class=sidebar><p>Read this as well</p></div>{close}<div class=footer>(c) Someone</div></body>"
    assert html_text.main_text(page) == lines(*some)


def test_main_text_leaves_notices_and_comments_out():
    some, other = paragraphs(0, 2), paragraphs(2, 9)
    for name in ("comments", "cookie-notice", "related", "newsletter"):
        for body in (f"<article>{tagged(some)}</article>", f"<div class=post>{tagged(some)}</div>"):
            for inner in (tagged(other), "".join(f"<article>{tagged([x])}</article>" for x in other)):
                assert html_text.main_text(f"<body>{body}<div class={name}>{inner}</div></body>") == lines(*some)
    assert html_text.main_text(f"<body><article>{tagged(some)}</article><div class=sidebar><article>{tagged(other[:1])}</article></div><form>{tagged(other[:1])}</form></body>") == lines(*some)


def test_extract_odd_rows(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>a</p>", "t"), (2, "u", deep, "t"), (3, "u", "<p>" + "w " * 100_000, "t")],
                               "page_id bigint, url string, html string, text string")
    out = sorted(((r["page_id"], r["text"]) for r in html_text.extract(df).collect()), key=str)
    assert out == sorted([(1, ""), (1, ""), (None, "a"), (2, "x"), (3, ("w " * 100_000).strip())], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def test_generated_pages_give_their_article(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    import html
    for r in rows:
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " "))
        blocks = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1)[^>]*>", inner))
        assert html_text.main_text(r["html"]) == "\n".join(b for b in blocks if b)


# ---- SimHash ----------------------------------------------------------------

def brute_fingerprint(t):
    w = re.findall(r"[^ \t\n\v\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints():
    rng = random.Random(2)
    for t in ["", "  \n", "One", "one TWO", "ÀB İ ß", "a\x1cb c d"] + [" ".join(rng.choice(["Aa", "b", "É", "d"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_near_duplicates_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] for r in rows} | {5000: None, 5001: "", 5002: " "}
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts.items()], "doc_id bigint, text string, fp string, component_id string")
    got = {r["doc_id"]: (r["fp"] % 2 ** 64, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = {i: brute_fingerprint(t or "") for i, t in texts.items()}
    assert got == {i: (fps[i], c) for i, c in brute_components(fps).items()}


def linked(spark, fps, **how):
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    edges = spark.createDataFrame(simhash.links(df, **how).collect(), "u bigint, v bigint")
    tips = {r["node"] % 2 ** 64: r["least"] % 2 ** 64 for r in components.components(edges).collect()}
    sets = {}
    for x in fps:
        sets.setdefault(tips.get(x, x), set()).add(x)
    return sorted(map(sorted, sets.values()))


def test_dense_groups_cut_into_blocks_lose_no_link(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 3))) for s in seeds for _ in range(150)} | {rng.getrandbits(64) for _ in range(300)}
    fps |= {s ^ (0b111 << 40) for s in seeds} | {s ^ (0b111 << 40) ^ (0b111 << 50) for s in seeds}
    by = {}
    for x, c in brute_components(dict(zip(sorted(fps), sorted(fps), strict=True))).items():
        by.setdefault(c, set()).add(x)
    want = sorted(map(sorted, by.values()))
    assert linked(spark, sorted(fps)) == want
    assert linked(spark, sorted(fps), block=16) == want


def test_allotments_keep_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    some = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)
    some[:, None]
    skewed = np.where(rng.random(3000) < 0.7, some & np.uint64(0x0000FFFFFFFFFFFF), some)
    for sample in (some, skewed):
        for total in (3000, 10 ** 6, 10 ** 9, 10 ** 11):
            plan = simhash.allot(sample, total)
            assert sum(t + 1 for _, t in plan) == simhash.DISTANCE + 1
            bits = [b for g, _ in plan for b in g]
            assert len(bits) == len(set(bits))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (2000, 2000)]
    got = dict(components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_keep_first(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(7, long), (3, long), (3, long), (9, "something else entirely, alone here"), (None, long), (None, "only null id in this group of words"), (11, None), (12, "")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id bigint, text string, component_id string")
    out = simhash.keep_first(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect() if r["doc_id"] is not None)) == [3, 9, 11]
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_keep_first_keeps_one_row_of_every_group(spark):
    rng = random.Random(8)
    text = [" ".join(f"w{rng.getrandbits(32)}" for _ in range(60)) for _ in range(8)]
    # null ids: unrelated texts, a copied text, a copy of a numbered one; one id with two texts, one of them a copy
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (None, text[3]), (3, text[3]),
            (5, text[4]), (5, text[5]), (4, text[5]), (5, text[6]), (6, text[6]), (9, text[7]), (9, text[7])]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id bigint, text string, fp string")
    out = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(df.repartition(5)).collect()), key=str)
    assert out == sorted([(None, text[0]), (None, text[1]), (None, text[2]), (3, text[3]), (5, text[4]), (4, text[5]), (5, text[6]), (9, text[7])], key=str)


# ---- pipeline ---------------------------------------------------------------

def test_pipeline_decisions(spark):
    import corpus_pipeline
    from relaytrace.llm import decontaminate, quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, now, sf).collect(), now.schema)
        assert out.columns == docs.columns
        before, after = ({r["doc_id"]: r for r in x.collect()} for x in (now, out))
        if name == "quality":
            gone = {r["doc_id"] for r in quality.rules(now).collect() if not r["kept"]}
        elif name == "near_duplicates":
            comp = brute_components({i: brute_fingerprint(r["text"]) for i, r in before.items()})
            gone = {i for i, c in comp.items() if i != c}
        elif name == "decontaminate":
            gone = {r["doc_id"] for r in decontaminate.leaks(now, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert {i for i, r in before.items() if any(x in r["text"] for x in items)} <= gone
        else:
            gone = set()
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert not any("@mail" in r["text"] for r in after.values())
        assert set(after) == set(before) - gone, name
        now = out
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    enc = bpe.encoding(bpe.VOCAB)
    assert {i: list(r["ids"]) for i, r in final.items()} == {r["doc_id"]: enc.encode_ordinary(r["text"]) for r in now.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(next(x["text"] for x in now.collect() if x["doc_id"] == i).encode()).hexdigest() for i, r in list(final.items())[:5])
