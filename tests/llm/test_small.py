"""Defined results on nulls, empties, ties, repeats, empty tables and clashing columns."""

import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, html_extract, langid, media, minhash, mixing, quality, substring_dedup, toxicity
from sparkloom.llm import sentencepiece as pieces
from sparkloom.llm.queries import model_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(30_000))


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


def odd(spark):
    """Nulls in any column, empty and long texts, repeats."""
    return docs(spark, (1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, LONG, "en", None), (None, "some text here", "en", "b"), (5, "dup row", "en", "b"), (5, "dup row", "en", "b"), (6, "ÄÖ \x0b tab", None, "b"))


SENTENCES = ["The council met on Tuesday to decide on the new bridge across the river, which had been planned for ten years.", "Its members heard two engineers, who explained why the old piers could not be used again without costly repairs to each.",
             "In the end a narrow majority voted for the cheaper of the two designs, and building is to begin in the spring of next year."]
#: Pages with the text that a reader would call the article's.
LABELLED = [
    # usual marks
    (f"""<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site</div>
    <main><article><h1>Head&amp;line of the day</h1><p>{SENTENCES[0]}<p>{SENTENCES[1]} <b>So</b> it is.<p>&copy; {SENTENCES[2]}</article></main><aside>Also read</aside><form>Sign up<input></form>
    <section id="comments"><p>Nice article, thanks!</p><p>Me too.</p></section><footer>(c) the site</footer></body></html>""", f"Head&line of the day {SENTENCES[0]} {SENTENCES[1]} So it is. © {SENTENCES[2]}"),
    # no marks at all: short words in dense markup before and after
    (f"""<body><table><tr><td><b>Home</b><td><b>News</b><td><b>Sport</b><td><i>Log in</i></table><div><p>{SENTENCES[0]}</p><p>{SENTENCES[1]}</p><p>Short one.</p><p>{SENTENCES[2]}</p></div>
    <div><ul><li><span>Terms</span></li><li><span>Imprint</span></li></ul></div></body>""", f"{SENTENCES[0]} {SENTENCES[1]} Short one. {SENTENCES[2]}"),
    # the article stands in an element with a word that marks adverts
    (f"<body><nav><a href=a>One</a> <a href=b>Two</a></nav><div class='widget'><p>{' '.join(SENTENCES)}</p><p>{' '.join(SENTENCES[::-1])}</p></div><div class='ad'>Buy now!</div></body>", f"{' '.join(SENTENCES)} {' '.join(SENTENCES[::-1])}"),
    # reader comments of some length
    (f"<body><div id=main><p>{' '.join(SENTENCES)}</p><p>{' '.join(SENTENCES)}</p></div><div class=comments><ul>" + "".join(f"<li><b>user{k}</b><p>I think this was a rather good decision.</p><a href=r>reply</a></li>" for k in range(6)) + "</ul></div></body>", f"{' '.join(SENTENCES)} {' '.join(SENTENCES)}"),
]


def test_html_labelled_pages(monkeypatch):
    """Precision and recall in words; without ratios, or by marks alone, the text is worse."""

    def share(text):
        hit = got = want = 0
        for page, label in LABELLED:
            found, right = text(page).split(), label.split()
            hit, got, want = hit + sum((Counter(found) & Counter(right)).values()), got + len(found), want + len(right)
        return hit / got, hit / want

    assert [html_extract.main_text(p) for p, _ in LABELLED] == [x for _, x in LABELLED]
    assert share(html_extract.main_text) == (1, 1)
    by_marks = share(lambda p: " ".join(x.text for x in html_extract.page_lines(p) if not x.marked))
    assert by_marks[0] < 0.98 and by_marks[1] < 0.8
    assert share(lambda p: html_extract.main_text(p, lambda _: -1.0))[0] < 0.85
    monkeypatch.setattr(html_extract, "MARK_TAGS", 0)
    no_marks = share(html_extract.main_text)
    assert no_marks[0] > 0.9 and no_marks[1] == 1


def test_html_cases():
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p><script>x</script>") == ""
    plain = "<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div><p>A long paragraph of real content stands here for the reader.<p>Short.<p>Another long paragraph of real content ends the page.</div></body>"
    assert html_extract.main_text(plain) == "A long paragraph of real content stands here for the reader. Short. Another long paragraph of real content ends the page."
    assert html_extract.main_text("<<<a <b" + "<div>" * 3000 + "x") is not None


def test_html_smoothing():
    assert np.allclose(html_extract.smooth(np.ones(7)), 1)
    assert html_extract.threshold(np.array([1.0, 1, 1, 50, 60])) > 1


def test_html_ratios_smoothing_and_clusters_by_hand():
    page = "<body><nav><a href=x>Home page</a></nav><div><p>Real words, a line of them.</p><p>No.</p><p>And here is another line.</p></div><div class=ad>Buy!</div></body>"
    lines = html_extract.page_lines(page)
    assert [(x.text, x.link_chars, x.marked) for x in lines] == [("Home page", 9, True), ("Real words, a line of them.", 0, False), ("No.", 0, False), ("And here is another line.", 0, False), ("Buy!", 0, True)]
    assert [x.tags for x in lines] == [5, 3, 2, 2, 3]
    r = np.log1p([0, 27 / 3, 3 / 2, 25 / 2, 4 / 13])
    far = [0, 3, 4, 5, 8]  # a border counts as two lines more
    g = lambda i, j: np.exp(-((far[i] - far[j]) ** 2) / 2) * (abs(i - j) <= 2)
    want = [sum(g(i, j) * r[j] for j in range(5)) / sum(g(i, j) for j in range(5)) for i in range(5)]
    ratios, number, values = html_extract.region_values(lines)
    assert np.allclose(ratios, want) and number.tolist() == [0, 1, 1, 1, 2]
    main = (27 * want[1] + 3 * want[2] + 25 * want[3]) / 55
    assert np.isnan(values[0]) and np.allclose(values[1:], [main, want[4]])
    assert html_extract.threshold(values[1:]) == pytest.approx((main + want[4]) / 2)
    assert html_extract.main_text(page) == "Real words, a line of them. No. And here is another line."


def test_html_time_grows_with_length():
    import time

    def took(page):
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    for make in (lambda n: "<div>" * n + "x</i>" * n, lambda n: "<p><b>" * n + "<h1>x</h1>" * n, lambda n: "<b>" * n + "<hr>x<a>" * n, lambda n: "<td><i>" * n + "x</td>" * n):
        assert took(make(40_000)) < 40 * took(make(4_000)) + 1


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, None, "old"), (2, "<p>x y</p>", "old")], "page_id long, html string, text string")
    assert [tuple(r) for r in html_extract.extract(pages).select("page_id", "text").orderBy("page_id").collect()] == [(1, ""), (2, "x y")]
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 64 * 192, 64 * 192 + 1, 500_000])
def test_media_round_trip(n):
    data = bytes(i % 251 for i in range(n))
    blob = media.write_file(media.pad(data))
    t = media.read_tables(blob)
    back = b"".join(blob[x["start"] : x["start"] + x["length"]] for x in t["chunks"])
    assert back == media.pad(data) and len(back) % 192 == 0 and len(back) > 0
    assert t["codec"] == "raw " and t["n_samples"] == t["duration"] == len(back) // 192
    for k, x in enumerate(t["keyframes"]):
        assert blob[x["start"] : x["start"] + x["length"]] == back[k * 24 * 192 : (k * 24 + 1) * 192]


def test_media_foreign_layouts():
    """64-bit boxes, boxes to the end, varying sample sizes, no sync table."""
    raw = b"aabbbccccd"
    stbl = media._box(b"stbl", media._full(b"stsd", struct.pack(">I", 1), media._box(b"avc1", bytes(70))), media._full(b"stts", struct.pack(">I4I", 2, 3, 10, 1, 5)), media._full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)),
                      media._full(b"stsz", struct.pack(">II4I", 0, 4, 2, 3, 4, 1)), media._full(b"co64", struct.pack(">I3Q", 3, 0, 0, 0)))
    head = media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 90, 35, 0, 0)), media._box(b"minf", stbl))))
    start = len(head) + 16
    head = head.replace(struct.pack(">I3Q", 3, 0, 0, 0), struct.pack(">I3Q", 3, start, start + 5, start + 9))
    t = media.read_tables(head + struct.pack(">I4sQ", 1, b"mdat", 16 + len(raw)) + raw + struct.pack(">I4s", 0, b"free"))
    assert [x["length"] for x in t["chunks"]] == [5, 4, 1] and [x["length"] for x in t["keyframes"]] == [2, 3, 4, 1] and t["duration"] == 35
    assert t["keyframes"][3]["start"] == start + 9


def track(kind, sizes, keys, start):
    full, box = media._full, media._box
    tables = [full(b"stsd", struct.pack(">I", 1), box(b"avc1" if kind == b"vide" else b"mp4a", bytes(70))), full(b"stts", struct.pack(">III", 1, len(sizes), 1)), full(b"stsc", struct.pack(">I3I", 1, 1, len(sizes), 1)),
              full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), full(b"stco", struct.pack(">II", 1, start))]
    if keys:
        tables.append(full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)))
    return box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 9, 0, 0)), full(b"hdlr", struct.pack(">I4s", 0, kind), bytes(12)), box(b"minf", box(b"stbl", *tables))))


def test_media_tables_come_from_one_track():
    """Sound without a sync table before video with one: codec, samples and keyframes are the video's."""
    movie = media._box(b"moov", track(b"soun", [1] * 10, [], 8), track(b"vide", [2, 3, 4], [1, 3], 18))
    t = media.read_tables(media._box(b"mdat", bytes(30)) + movie)
    assert (t["codec"], t["n_samples"]) == ("avc1", 3) and [(x["start"], x["length"]) for x in t["keyframes"]] == [(18, 2), (23, 4)]
    sound = media.read_tables(media._box(b"mdat", bytes(30)) + media._box(b"moov", track(b"soun", [1] * 10, [], 8)))
    assert sound["codec"] == "mp4a" and len(sound["keyframes"]) == 10


def test_media_broken_files_have_a_reason():
    nest = b""
    for _ in range(3000):
        nest = media._box(b"moov", nest)
    whole = media.write_file(media.pad(b"x" * 5000))
    at = whole.index(b"stsz") + 4
    cases = [nest, media._box(b"moov", media._box(b"trak", media._box(b"mdhd"))), whole[: at + 8] + b"\xff\xff\xff\xf0" + whole[at + 12 :], whole[:-30], b"\0" * 40]
    for blob in cases:
        with pytest.raises(ValueError):
            media.read_tables(blob)


def test_media_mutated_files():
    """10,000 files with changed, cut or repeated bytes: tables or a reason, and never more samples than bytes."""
    rng = np.random.default_rng(0)
    seeds = [media.write_file(media.pad(b"ab" * 700)), media._box(b"mdat", bytes(60)) + media._box(b"moov", track(b"soun", [1] * 9, [], 8), track(b"vide", [2, 3, 4], [1, 3], 18))]
    read = 0
    for k in range(10_000):
        blob = bytearray(seeds[k % 2])
        low = blob.index(b"moov") if k % 3 else 0
        for _ in range(rng.integers(1, 5)):
            i = int(rng.integers(low, len(blob)))
            if (how := rng.integers(0, 4)) == 0:
                blob[i] = int(rng.integers(256))
            elif how == 1:
                blob[i : i + 4] = b"\xff\xff\xff\xf0" if rng.integers(2) else bytes(4)
            elif how == 2:
                del blob[i : i + int(rng.integers(1, 9))]
            else:
                blob[i:i] = blob[i : i + int(rng.integers(1, 40))]
            low = min(low, len(blob) - 1)
        try:
            found = media.read_tables(bytes(blob))
        except ValueError:
            continue
        read += 1
        assert sum(x["length"] for x in found["chunks"]) <= len(blob) and all(0 <= x["start"] and x["start"] + x["length"] <= len(blob) for x in found["chunks"])
    assert read > 500


def test_media_frame(spark):
    made = media.write_media(odd(spark).withColumn("media", F.lit(1)))
    got = media.read_media(made).select("doc_id", "n_bytes", F.length("payload").alias("n"), "tables.error").collect()
    assert all(r["n"] % 192 == 0 and r["n"] >= 192 and r["error"] is None for r in got)
    broken = spark.createDataFrame([(None,), (b"",), (b"xx",), (struct.pack(">I4s", 99, b"moov"),)], "media binary")
    assert all(r["error"] for r in media.read_media(broken).select("tables.error").collect())


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in ids}


def test_near_duplicates_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [" ".join(rng.choice(["ab", "Cd", "ef", "gh", "éi", "jk", "lm", "no"], 120)) for _ in range(6)]
    rows = []
    for k in range(150):
        w = base[k % 6].split(" ")
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(len(w))] = f"edit{rng.integers(50)}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(1, "one two"), (2, "ONE two"), (3, "a b c d e"), (4, "a b c d f"), (5, ""), (6, None), (7, " \t\n"), (8, LONG), (9, LONG + " end"), (10, "one")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def test_near_duplicates_hot_group_is_split(spark):
    """One chain of near copies larger than a block, all compared across blocks."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k : k + 200])) for k in range(0, 200)]
    got = {r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_near_duplicates_of_one_text_are_held_against_pivots_only(spark, monkeypatch):
    """Near copies meet the pivots of their bands; only what these leave apart is compared in blocks."""
    dealt, verified = [], minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda df, percent: dealt.append(df.count()) or verified(df, percent))
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(base[:k] + [f"edit{k}"] + base[k + 1 :])) for k in range(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and not any(dealt)


def test_near_duplicates_many_sets_in_one_band(spark, monkeypatch):
    """Many distinct sets that share every band, near ones in small groups among them."""
    monkeypatch.setattr(minhash, "features", lambda *a, real=minhash.features, **b: real(*a, **b).withColumn("bands", F.when(F.col("n") > 0, F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))))
    rng = np.random.default_rng(3)
    rows = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(60)]
        for _ in range(1 + g % 3):
            words = [*words]
            words[int(rng.integers(60))] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=70).collect()}
    assert got == brute_components(rows, 70)


def test_near_duplicates_links_that_pivots_miss(spark, monkeypatch):
    """A text near a band's member, not near its pivot, with blocks and parts of a few sets."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = []
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(260)]
        rows += [(1000 * g + (37 * k) % 60, " ".join(words[k : k + 200])) for k in range(0, 60, 3 + g)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)


def test_pipeline_drops_pairs_from_four_fifths_on(spark):
    """Pairs of 5-shingle sets between 0.80 and 0.85 are one document in the pipeline, and pairs below 0.80 are two."""
    import corpus_pipeline

    rows, near = [], set()
    for i in range(60):
        words = [f"w{i}x{j}" for j in range(104)]  # 100 shingles
        lost = 10 + i % 3  # a shift by n loses n of 100 on each side: 90/110, 89/111, 88/112
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[lost:] + [f"n{i}x{j}" for j in range(lost)]))]
        if 100 * (100 - lost) >= 80 * (100 + lost):
            assert 100 * (100 - lost) < 85 * (100 + lost)
            near.add(2 * i + 1)
    table = docs(spark, *((i, t, "en", "s") for i, t in rows))
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table, "").collect()}
    assert near and kept == set(range(120)) - near


def test_near_duplicates_odd_rows(spark):
    got = minhash.near_duplicates(odd(spark)).collect()
    assert len(got) == 8
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got}
    assert by[None, 1] == (None, True) and by[1, 0] == (1, True) and by[4, 29_996] == (3, False)
    assert minhash.near_duplicates(odd(spark).limit(0)).count() == 0
    assert {r["doc_id"] for r in minhash.drop_near_duplicates(odd(spark)).collect()} == {1, 2, 3, None, 5, 6}


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = [r["text"] or "" for r in odd(spark).collect()] + ["  two  spaces ", "\n\n\t", "a" * 5000, " " * 61, "naïve café — 漢字 🙂", "<s>x</s><0x41>", "▁▁a", "\x00\x7f"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = pieces.decode(pieces.encode(frame, model_path()), model_path()).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        assert r["ids"] == lib.encode(t, add_eos=True) and r["decoded"] == lib.decode(r["ids"])
    tok = pieces.PrefixTokenizer(open(model_path(), "rb").read())
    rng = np.random.default_rng(1)
    for _ in range(2000):
        s = "".join(rng.choice(list("aeinst  he\nxyz.,éß€漢"), rng.integers(0, 40)))
        assert tok.encode(s, True) == lib.encode(s, add_eos=True)
        ids = [int(x) for x in rng.integers(0, 600, rng.integers(0, 8))]
        assert tok.decode(ids) == lib.decode(ids)


def test_sentencepiece_odd_rows(spark):
    out = pieces.encode(odd(spark).withColumn("ids", F.lit("x")), model_path())
    assert out.where("doc_id = 1").head()["ids"] == [2] and out.count() == 8
    nulls = spark.createDataFrame([(None,), ([],), ([1, 2],)], "ids array<int>")
    assert [r[0] for r in pieces.decode(nulls, model_path()).select("decoded").collect()] == [None, "", ""]


def brute_ann(vectors, k):
    out = {}
    ok = {i: v for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in ok:
        if q % 20 == 0:
            near = sorted((-float(np.dot(np.float32(ok[q]).astype(float), np.float32(v).astype(float))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out[q] = [i for _, i in near]
    return out


def test_ann_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, [1.0] * 8) for i in range(60)]  # one vector many times
    rows += [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] * 8), (1080, [None] * 8), (1100, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, window=700, curves=2, segment=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_ann(rows, 20)
    assert got.keys() == want.keys()
    assert all(got[q] == want[q] for q in want)


def test_ann_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (20, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(frame, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


def ann_found(spark, rows, **options):
    frame, got = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_ann(rows, 20)
    return np.mean([len(got[q] & set(want[q])) / 20 for q in want])


@pytest.mark.parametrize("n", [1000, 3000, 6000])
def test_ann_recall_holds_for_noise_as_tables_grow(spark, n):
    rng, measured = np.random.default_rng(n), []
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(n, 32)))]
    assert ann_found(spark, rows, measured=measured) >= 0.9
    assert measured[0][1] < n and measured[0][2] >= ann.TARGET


def test_ann_windows_smaller_than_the_table(spark):
    """Clustered vectors get windows that hold a small part of the table on all curves together; segments are dealt over several tasks."""
    rng, measured = np.random.default_rng(3), []
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.1 * rng.normal(size=16)]) for i in range(4000)]
    assert ann_found(spark, rows, measured=measured) >= 0.9
    curves, window, _, n = measured[0]
    assert n == 4000 and curves * (2 * window + 1) < 1000


def test_ann_narrow_windows_are_dealt(spark, monkeypatch):
    """The same result whether a window's queries meet a segment in one task or in several."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(3000)]
    frame, found = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), []
    for deal in (1000, 2):
        monkeypatch.setattr(ann, "_DEAL", deal)
        found.append(sorted(tuple(r) for r in ann.search(frame, F.col("vec_id") % 20 == 0, window=600, curves=3, segment=100).collect()))
    # runs of queries differ between tasks, so what lies beyond a window may be met by chance; within windows all agree
    assert np.mean([a == b for a, b in zip(*found, strict=True)]) > 0.95


def test_ann_cheapest_windows():
    gaps = np.array([[900, 10, 5], [20, 700, 4], [30, 40, 800], [1, 2, 3]] * 25)
    curves, window, share = ann.cheapest(gaps, 100_000, 50_000)
    assert (curves, window, share) == (2, 30, 1.0)


def test_hilbert_neighbours_touch():
    from sparkloom.llm.hilbert import hilbert_keys

    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = cells[np.argsort(hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def train_rows(n=60):
    return [(i, ("the cat and the dog ran to the house " if i % 2 else "le chat et le chien vont à la maison ") * 3, "en" if i % 2 else "fr", "s") for i in range(n)]


def test_language_id(spark):
    table = docs(spark, *train_rows(), (100, "le chat", None, None), (101, None, "en", "s"), (102, "123 …", "en", "s"), (103, "chatte maisonnette", None, "s"), (None, "the house", None, "s"))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table, langid.LanguageModel.fit(table)).collect()}
    assert out[100][0] == out[103][0] == "fr" and out[None][0] == "en" and out[101] == out[102] == ("und", 0.0)
    assert all(out[i][0] == ("en" if i % 2 else "fr") for i in range(60)) and all(0 <= s <= 1 for _, s in out.values())
    empty = langid.LanguageModel.fit(table.limit(0))
    assert {r["lang_pred"] for r in langid.identify(table, empty).collect()} == {"und"}
    assert langid.identify(table.limit(0), empty).count() == 0


def test_language_backoff_against_plain_counts(spark):
    """Known words, then ever shorter n-grams, from counts of the training texts; a rare word and a very long one count too."""
    import math

    rows = [*train_rows(30), (900, "zyzzyva " + "q" * 60, "en", "s"), (901, "œuvre", "fr", "s")]
    table = docs(spark, *rows)
    kept = {r["doc_id"] for r in table.where(~langid.held_out("doc_id")).collect()}
    model = langid.LanguageModel.fit(table)
    counts, totals = {}, Counter()
    for i, t, lang, _ in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()) if i in kept else ():
            for size in (0, 5, 4, 3, 2, 1):
                p = f" {w} "
                for g in [w] if size == 0 else [p[k : k + size] for k in range(len(p) - size + 1)]:
                    counts.setdefault((size, g), Counter())[lang] += 1
                    totals[lang, size] += 1

    def evidence(size, g):
        e = [math.log((counts[size, g][x] + 0.5) / (totals[x, size] + 1)) for x in ("en", "fr")]
        return np.array(e) - np.mean(e)

    for w in ("cat", "chat", "zyzzyva", "q" * 60, "œuvre", "thehouse", "maisonette", "xxq", "漢字"):
        want, p = np.zeros(2), f" {w} "
        if (0, w) in counts:
            want = evidence(0, w)
        else:
            for step, size in enumerate((5, 4, 3, 2, 1), 1):
                grams = [p[k : k + size] for k in range(len(p) - size + 1) if (size, p[k : k + size]) in counts]
                if grams:
                    want = np.mean([evidence(size, g) for g in grams], axis=0) * math.exp(-0.4 * step)
                    break
        assert np.allclose(model.words([w])[0], want, atol=1e-5), w


def test_language_id_very_long_line(spark):
    table = docs(spark, *train_rows(), (100, "le chat et le chien " * 50_000, None, None))
    out = langid.identify(table, langid.LanguageModel.fit(table)).where("doc_id = 100").head()
    assert out["lang_pred"] == "fr"


def test_samples_are_bounded_with_repeated_ids(spark, monkeypatch):
    """Rows that share an id, or have none, do not make a fitting sample larger than its limit."""
    from sparkloom.llm import labelled

    rows = [(1, f"some words {i}", "en") for i in range(300)] + [(None, f"other words {i}", "de") for i in range(300)] + [(i, f"more {i}", "en") for i in range(2, 60)] + [(3, "long " * 9000, "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    texts, y, weight = labelled.labelled_sample(table, labels, "toxic", 4, 2, 20)
    assert 20 <= len(texts) == len(y) == len(weight) <= 60 and max(map(len, texts)) <= labelled.FIT_CHARS
    seen = []
    monkeypatch.setattr(langid, "_counts", lambda df, real=langid._counts: seen.append(df.count()) or real(df))
    assert langid.LanguageModel.fit(table, max_docs=40).langs == ["de", "en"] and 10 <= seen[0] <= 80


def test_classifiers(spark):
    rng = np.random.default_rng(0)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 40)) + "."
    rows = [(i, (good() + " idiot fool " if i % 3 == 0 else good()) if i % 2 else good().upper() + "!!! %%% " * 9 + ("idiot fool" if i % 3 == 0 else ""), "en", "s") for i in range(400)]
    table = docs(spark, *rows, (1000, None, None, None), (1001, "", "en", "s"), (1002, LONG, "en", "s"), (None, "x", None, None))
    labels = spark.createDataFrame([*((i, i % 2, int(i % 3 == 0)) for i in range(400)), (1000, 1, 0), (5, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for module, model, label in ((toxicity, toxicity.ToxicityModel, "toxic"), (quality, quality.QualityModel, "quality")):
        out = {r["doc_id"]: r for r in module.score(table.withColumn("score", F.lit("old")), model.fit(table, labels)).collect()}
        assert len(out) == 404 and all(0 <= r["score"] <= 1 for r in out.values())
        truth = [(i % 3 == 0) if label == "toxic" else bool(i % 2) for i in range(400)]
        assert np.mean([(out[i]["score"] >= 0.3) == t for i, t in enumerate(truth)]) > 0.97
        none = model.fit(table, labels.limit(0))
        assert module.score(table, none).count() == 404 and module.score(table.limit(0), none).count() == 0
    spans = toxicity.score(table, toxicity.ToxicityModel.fit(table, labels)).where("doc_id = 3").head()
    assert {spans["text"][s["start"] : s["end"]] for s in spans["toxic_spans"]} <= {"idiot", "fool", "idiot fool"} and spans["toxic_spans"]


@pytest.mark.parametrize("strength", [0.3, 1.0, 2.0, 3.0])
def test_marginals_of_texts_laid_end_to_end_equal_whole_chains(strength):
    """Against plain forward-backward over each text on its own, with weak and strong transitions."""
    rng = np.random.default_rng(int(strength * 10))
    for chain in (np.array([[strength, -strength], [-strength, strength]]), rng.normal(0, strength, (2, 2))):
        texts = [rng.normal(-1, 3, n) for n in (1, 0, 60, 64, 65, 700, 2, 0, 129)]
        gap = np.array([-np.inf])
        got = toxicity.chain_marginals(np.concatenate([gap, *(x for t in texts for x in (t, gap))]), chain)
        at = 1
        for t in texts:
            if len(t):
                padded = np.concatenate([[-600.0], t, [-600.0]])
                assert np.abs(got[at : at + len(t)] - toxicity.forward_backward(padded[None], chain)[0][0, 1:-1]).max() < 1e-9
            at += len(t) + 1


def test_toxic_offsets_are_those_of_the_original_text():
    tagger = toxicity.Tagger(toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS), np.zeros((2, 2)), np.array([0.0, -4.0]), np.array([1.0, 0.0, 0.0, 0.0])))
    tagger["idiot"] = tagger["IDIOT"] = 6.0
    for text in ("İstanbul is fine you idiot", "İİİ IDIOT. Ok", "idiot"):
        ((score, spans),) = tagger.score([text])
        assert score > 0.5 and [text[a:b].lower() for a, b, _ in spans] == ["idiot"]
    assert [s for _, s in tagger.score([None, "", "...", "fine"])] == [[], [], [], []]


def test_passages_have_no_long_lines_and_lose_nothing():
    text = " ".join(f"word{i}" for i in range(5000)) + "\nshort\n" + "x" * 5000
    runs = quality.passages(text)
    assert max(sum(map(len, r)) for r in runs) <= 3 * quality.PASSAGE_CHARS and "".join("".join(r) for r in runs).replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert quality.passages(None) == quality.passages("") == [[""]]


def test_quality_attention_and_gradient():
    """Attention against its formula bag by bag, and the gradient against finite differences of the loss."""
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.N_FEATURES)).astype(np.float32) for n in (1, 4, 9)]
    y, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 0.5, 2.0])
    model = quality.QualityModel.fit_texts(["a b c", "D! E?"], np.array([0.0, 1.0]), np.ones(2), epochs=1)
    p = model.layers
    for bag, z, s in zip(bags, model._forward(bags)["z"], model._forward(bags)["score"], strict=True):
        h = np.tanh(np.clip((bag - p["mean"]) / p["scale"], -8, 8) @ p["w"] + p["b"])
        e = np.array([p["a"] @ (np.tanh(p["v"].T @ x) / (1 + np.exp(-p["u"].T @ x))) for x in h])
        a = np.exp(e) / np.exp(e).sum()
        assert np.allclose(z, a @ h) and s == pytest.approx(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))

    def loss():
        s = model._forward(bags)["score"]
        return float(-(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean())

    gradient = model._gradient(bags, y, weight)
    for name in ("w", "b", "v", "u", "a", "c", "d"):
        for at in list(np.ndindex(p[name].shape))[::37] or [(0,)]:
            old = p[name][at]
            p[name][at] = old + 1e-5
            up = loss()
            p[name][at] = old - 1e-5
            down = loss()
            p[name][at] = old
            assert gradient[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), list(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return sizes, target


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 50)), "en", f"s{int(rng.integers(0, 7))}" if i % 11 else None) for i in range(2000)] + [(5000, None, "en", "s1"), (5001, "", "en", "zero"), (None, "a b", "en", "s2")]
    out = mixing.mix(docs(spark, *rows).withColumn("size", F.lit("old"))).collect()
    sizes, target = brute_mix(rows)
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.15 * max(1, target[s]) for s in sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs(spark, *rows)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in out}
    assert mixing.emit(mixing.mix(docs(spark, *rows))).count() == sum(r["copies"] for r in out)
    assert mixing.mix(docs(spark, *rows).limit(0)).count() == 0


def test_mixing_many_sources_and_clashing_names(spark):
    """Targets of 300 sources of very uneven size need several rounds; columns of any name come through."""
    rows = [(i, "w " * (1 + (i * i * 37) % 900 if i % 5 else 1), "en", f"src{i % 300:03d}") for i in range(600)]
    names = ("_source", "_copy", "mix_source", "mix_copy", "at")
    table = docs(spark, *rows).withColumns({c: F.lit(c) for c in names})
    out = mixing.mix(table).collect()
    _, target = brute_mix(rows)
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in out) and all(r[c] == c for r in out for c in names)
    copies = mixing.emit(mixing.mix(table)).collect()
    assert len(copies) == sum(r["copies"] for r in out) and all(r["_copy"] == "_copy" for r in copies)


def test_mixing_without_words(spark):
    out = mixing.mix(docs(spark, (1, None, None, "a"), (2, " ", None, None))).collect()
    assert all(r["target"] == 0 and r["taken"] == 0 for r in out)


def brute_substring(rows, least=13):
    """Texts left, by comparing every window of pieces with all windows before it."""
    clean = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    seen, out = set(), {}
    for i, t in sorted(rows):
        cut, own, mine = [re.findall(r".+?(?:[.!?] +|$)", x) or [""] for x in t.split("\n")], [], []
        for n, line in enumerate(cut):
            own += [((n, k), clean(x)) for k, x in enumerate(line) if clean(x)]
        gone, units = set(), []
        for a in range(len(own)):
            for b in range(a, len(own)):
                words = " ".join(x for _, x in own[a : b + 1]).split(" ")
                whole_line = own[a][0][0] == own[b][0][0] and (a == 0 or own[a - 1][0][0] < own[a][0][0]) and (b + 1 == len(own) or own[b + 1][0][0] > own[b][0][0])
                enough = len(words) >= least
                if enough and len(words) - len(own[b][1].split(" ")) < least or whole_line:
                    units.append((a, b, tuple(words)))
        for a, b, key in units:
            if key in seen or key in mine:
                gone |= {p for p in [(n, k) for n, line in enumerate(cut) for k in range(len(line))] if own[a][0] <= p <= own[b][0]}
            mine.append(key)
        seen |= set(mine)
        left = []
        for n, line in enumerate(cut):
            stays = [x for k, x in enumerate(line) if (n, k) not in gone]
            if len(stays) == len(line) or any(map(clean, stays)):
                left.append("".join(stays))
        out[i] = "\n".join(left)
    return out


def test_substring_dedup(spark):
    rng = np.random.default_rng(0)
    short = [" ".join(rng.choice(["aa", "Bb", "cc", "dd"], rng.integers(1, 12))) for _ in range(40)]
    pool = [*short, "", "  ", *(". ".join(rng.choice(short, 14)) + "." for _ in range(25))]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(1, 7)))) for i in range(120)]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"removed": F.lit("old"), "cut_doc": F.lit("mine")})).collect()
    want, texts = brute_substring(rows), dict(rows)
    assert sum(r["n_removed"] for r in out) > 50
    for r in out:
        assert r["text"] == want[r["doc_id"]] and r["cut_doc"] == "mine"
        whole, left = texts[r["doc_id"]], [c for c in texts[r["doc_id"]]]
        for x in r["removed"]:
            assert left[x["start"] : x["start"] + x["length"]] == list(whole[x["start"] : x["start"] + x["length"]])
            left[x["start"] : x["start"] + x["length"]] = [""] * x["length"]
        strip = lambda t: t.replace("\n", "").replace(" ", "")
        assert strip("".join(left)) == strip(r["text"])
        assert all(x["first_doc_id"] <= r["doc_id"] for x in r["removed"]) and r["n_removed"] == len(r["removed"])


def test_every_piece_that_goes_equals_one_that_stays(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["p q r.", "s t.", "u.", "v w x y."], rng.integers(1, 60)))) for i in range(30)]
    kept = {x for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in substring_dedup.pieces(r["text"])[1]}
    assert {x for _, t in rows for x in substring_dedup.pieces(t)[1]} <= kept


def test_passages_wrapped_and_inside_paragraphs(spark):
    """A passage goes where another document has it inside a paragraph, in lines of its own, or wrapped in other places."""
    words = lambda k, n: " ".join(f"{chr(97 + (k + j) % 26)}{k}{j}" for j in range(n))
    passage = f"{words(1, 12)}. {words(2, 30)}. {words(3, 20)}."
    rows = [(1, f"{words(4, 20)} {passage} {words(5, 9)}."), (2, f"{words(6, 40)}. {passage} {words(7, 11)}. End here."), (3, f"{words(8, 60)}. {words(9, 9)}."), (4, f"{words(10, 30)}.\n" + passage.replace(". ", ".\n") + f"\n{words(11, 15)}.")]
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] == rows[2][1]
    for i in (2, 4):
        assert words(2, 30) not in out[i]["text"] and words(3, 20) not in out[i]["text"]
    assert words(6, 40) in out[2]["text"] and "End here." in out[2]["text"] and words(11, 15) in out[4]["text"]
    assert {x["first_doc_id"] for x in out[2]["removed"]} == {1}


def test_repeated_lines_go_whatever_their_length(spark):
    text = {1: "Menu\nOne line of its own here.", 2: "menu \nAnother one. With two sentences.\nMenu", 3: "Another one.  With two sentences.", 4: "One line of its own here. And more."}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == {1: text[1], 2: "Another one. With two sentences.", 3: "", 4: text[4]}
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(docs, min_line_words=2).collect()}
    assert kept == {**got, 2: text[2]}


def test_substring_ids_of_any_type(spark):
    rows = [("b", LONG, 1), ("a", LONG, 2), (None, LONG, 3), (None, "x", 4)]
    got = {r["_doc"]: (r["text"], [x["first_doc_id"] for x in r["removed"]]) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string, _doc int")).collect()}
    assert got[2] == (LONG, []) and got[1] == got[3] == ("", ["a"]) and got[4] == ("x", [])
    top = spark.createDataFrame([((1 << 63) - 1, LONG), (None, LONG)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["text"]) for r in substring_dedup.dedup_substrings(top).collect()} == {(1 << 63) - 1: len(LONG), None: 0}


def test_substring_odd_rows(spark):
    out = substring_dedup.dedup_substrings(odd(spark)).collect()
    assert len(out) == 8 and {r["doc_id"]: r["text"] for r in out}[1] is None
    assert {r["doc_id"]: r["text"] for r in out}[3] == LONG and {r["doc_id"]: r["text"] for r in out}[4] == ""
    assert all(r["text"] == "dup row" for r in out if r["doc_id"] == 5)
    assert substring_dedup.dedup_substrings(odd(spark).limit(0)).count() == 0


def test_pipeline_odd_rows(spark):
    """Nulls, empties, long texts, repeats, an empty table, and columns named as the stages' own."""
    import corpus_pipeline

    clash = ("found_lang", "found_score", "_lang", "gone_id", "cut_doc", "mix_source", "mix_copy", "copies", "size", "target", "removed", "n_removed", "aside_size")
    table = odd(spark).unionByName(docs(spark, *train_rows(40))).withColumns({c: F.lit(c) for c in clash})
    for start in (table, table.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == start.columns, name
            now = spark.createDataFrame(now.collect(), now.schema)
        tokens = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
        assert len(tokens) == now.count()
        assert all(r[c] == c for r in now.collect() for c in clash)
