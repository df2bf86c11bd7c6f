"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import common as c
from quern.llm import decontam, embed_dedup, jaccard_join, langid, license_scan, line_dedup, mixing, pipeline, quality, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so", "ta") for b in ("n", "rt", "s", "la", "mo", "vi", "x", "z")]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(text: str, k: int) -> str:
    w = text.split(" ")
    for i in rng.sample(range(len(w)), k):
        w[i] = "edit" + str(rng.random())[2:8]
    return " ".join(w)


BASE, PASSAGE = prose(200), prose(60)
DOCS = (
    [(1, BASE), (2, BASE), (3, edited(BASE, 2)), (4, edited(BASE, 60)), (5, None), (6, ""), (7, "one two"), (8, "one two"), (9, "   "), (10, prose(3000)), (11, prose(50) + " " + PASSAGE), (12, PASSAGE + " " + prose(40)), (13, "x"), (13, "x"), (14, "aXa " * 200)]
    + [(20 + i, edited(BASE, 3)) for i in range(12)]
    + [(40 + i, prose(rng.randint(1, 80))) for i in range(20)]
)


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in DOCS], SCHEMA).withColumns({x: F.lit("clash") for x in ("r", "k1", "row", "d", "size", "rule", "node", "score")})
    return own.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text, pattern):
    return re.findall(pattern, "".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))


def test_grams_and_sliding_minimum():
    h = np.arange(20, dtype=np.uint64)
    for k in (1, 2, 3, 5, 7, 10):
        g = c.grams(h, k)
        assert len(g) == 20 - k + 1 and len(set(g.tolist())) == len(g) and c.grams(h[3 : 3 + k], k)[0] == g[3]
    x = np.array([5, 3, 8, 1, 9, 2, 7], dtype=np.uint64)
    assert c.sliding_min(x, 3).tolist() == [3, 1, 1, 1, 2] and len(c.sliding_min(x, 9)) == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in c.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert c.components(edges.limit(0)).count() == 0


# ---- 1 ----


def test_licenses(spark, docs, none):
    mit = dict(license_scan.TEXTS)["MIT"]
    rows = [(1, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit), (2, "Copyright 2001 X\n" + mit.upper().replace(". ", ".   ")), (3, "Some text.\nLicenced under the  Apache Licence, v. 2.0!\nMore."), (4, mit[:-20]), (5, None), (6, "")]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.known(spark)).collect()}
    assert out[2]["license"] == "MIT" and out[4]["license"] is None and out[3]["line_licenses"] == ["Apache-2.0"] and out[5]["digest"] is None and out[6]["digest"] is None
    assert license_scan.scan(docs, license_scan.known(spark)).count() == len(DOCS) and license_scan.scan(none, license_scan.known(spark)).count() == 0


def test_titled_licenses(spark):
    known = license_scan.known(spark)
    own = dict(license_scan.TEXTS)
    rows = [(1, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + own["MIT"]), (2, "Copyright The Go Authors. All rights reserved.\n" + own["BSD-3-Clause"]), (3, "Copyright Acme Corp. 2019\n\n" + own["ISC"])]
    # Sentences that only begin with the word stay: without them the text is another one.
    rows += [(4, "Copyright notices must stay.\n" + own["MIT"]), (5, own["BSD-2-Clause"].replace("the above copyright", "the above\ncopyright")), (6, own["BSD-2-Clause"].replace("THE COPYRIGHT HOLDERS AND", "THE\nCOPYRIGHT HOLDERS AND"))]
    rows += [(100 + k, f"{title}\nCopyright 2001 X\n{x}") for k, (i, x) in enumerate(own.items()) for title in license_scan.TITLES[i][:1]]
    out = {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert [out[i] for i in range(1, 7)] == ["MIT", "BSD-3-Clause", "ISC", None, "BSD-2-Clause", "BSD-2-Clause"] and [out[100 + k] for k in range(len(own))] == list(own)


def plain_canonical(text: str) -> list[str]:
    """Canonical lines by plain loops: the same lists of spellings and words, one line and one spelling at a time."""
    import regex

    out = []
    owners = regex.compile(rf"copyright[ \t:,]+(?!(?:{license_scan.NOT_OWNERS})\b)(.*)")
    for line in text.translate(str.maketrans("\r‘’“”–—\u00a0", "\n''\"\"-- ")).lower().split("\n"):
        bare = regex.sub(r"^[^\p{L}\p{N}]+", "", line)
        owner = owners.match(bare)
        sign = regex.match(r"copyright(ed)?\b[^\p{L}\p{N}]*(\(c\)|\d|©|by\b)", bare) or regex.match(r"[^\p{L}\p{N}]*(\(c\)[^\p{L}]*\d|©)", line) or regex.fullmatch(r"all rights reserved\W*", bare)
        if sign or (owner and (regex.search(r"\b(19|20)\d\d\b", owner[1]) or 1 <= len(owner[1].split()) <= 6)):
            line = ""
        for a, b in license_scan.SPELLINGS:
            line = regex.sub(r"(?<!\p{L})" + regex.escape(a) + (r"(?!\p{L})" if a[-1].isalpha() else ""), b, line)
        out.append(regex.sub(r"[^\p{L}\p{N}]+", " ", line).strip())
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_licenses_against_brute_force(spark):
    """All documents of the smallest table and known texts with changed spellings, against a dictionary of canonical texts."""
    known = license_scan.known(spark)
    names = {}
    for r in known.collect():
        key = " ".join(x for x in plain_canonical(r["text"]) if x)
        names[key] = min(names.get(key, r["license"]), r["license"])
    own = [(10**6 + k, f"Copyright (c) 1999 A\n\n{x.upper()}\n{y}") for k, (_, x) in enumerate(license_scan.TEXTS) for y in ("", "More.")] + [(2 * 10**6, "Licensed under CC BY 4.0.\r\nReleased under the MIT licence!\n© 2020 B"), (2 * 10**6 + 1, "word " * 30_000)]
    docs = c.read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(spark.createDataFrame(own, "doc_id long, text string"))
    want = []
    for r in docs.collect():
        lines = plain_canonical(r["text"] or "")
        whole = " ".join(x for x in lines if x)
        want.append((r["doc_id"], hashlib.sha256(whole.encode()).hexdigest() if whole else None, names.get(whole), sorted({names[x] for x in lines if x in names})))
    got = [(r["doc_id"], r["digest"], r["license"], r["line_licenses"]) for r in license_scan.scan(docs, known).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] is not None for x in got) >= len(license_scan.TEXTS)


# ---- 2 ----


def test_weak_labels_agree():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.7
    rates = r.uniform(0.7, 0.95, len(quality.LABELLERS))
    seen: dict[str, list] = {}
    for x in truth:
        p = "".join("-" if r.random() < 0.2 else str(int(x if r.random() < a else not x)) for a in rates)
        seen.setdefault(p, []).append(x)
    prior, _, post = quality.agree([(p, len(v)) for p, v in sorted(seen.items())])
    assert abs(prior - 0.7) < 0.06 and np.mean([(post[p] > 0.5) == x for p, v in seen.items() for x in v]) > 0.9


def test_quality_rows(spark, docs, none):
    junk = [(900 + i, " ".join([rng.choice(VOCAB)] * 60)) for i in range(8)] + [(950 + i, "".join(f"{w}### " for w in prose(60).split())) for i in range(8)]
    good = [(1000 + i, ". ".join(prose(9).capitalize() for _ in range(12)) + ".") for i in range(60)]
    out = {r["doc_id"]: r for r in quality.classify(spark.createDataFrame(junk + good, "doc_id long, text string")).collect()}
    assert np.mean([out[i]["keep"] for i, _ in good]) > 0.95 and np.mean([out[i]["keep"] for i, _ in junk]) < 0.2
    assert quality.classify(docs).count() == len(DOCS) and quality.classify(none).count() == 0


# ---- 3 ----


def test_mix(spark, none):
    rows = [(i, prose(rng.randint(0, 30)) if i % 9 else None, f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(1, "a b", "tiny")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), cell=16).collect()
    sizes: dict = {}
    for _, x, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(x, r"[^\x20\x09-\x0D]+"))
    names = sorted((x for x in sizes if x is not None)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        level = (total - 3 * sum(sizes[s] for s in held)) / sum(w[s] for s in names if s not in held)
        more = {s for s in names if s not in held and w[s] * level >= 3 * sizes[s]}
        if not more:
            break
        held |= more
    taken: dict = {}
    for r in out:
        want = 3.0 * sizes[r["source"]] if r["source"] in held else w[r["source"]] * level
        assert abs(r["target"] - want) < 1e-6 and r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - (3.0 * sizes[s] if s in held else w[s] * level)) <= 30 for s in names)
    assert mixing.mix(none).count() == 0


def test_mix_prefers_good_documents(spark):
    rows = [(i, "a b c d", "s") for i in range(2000)] + [(5000 + i, "a b", "t") for i in range(6000)]
    weights = spark.createDataFrame([(i, 8.0 if i % 2 else 1.0) for i in range(2000)], "id long, weight double")
    out = [r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), quality=weights, weights=(1, 8)).collect() if r["source"] == "s"]
    odd = sum(r["copies"] for r in out if r["doc_id"] % 2)
    assert odd > 1.5 * sum(r["copies"] for r in out if not r["doc_id"] % 2)


# ---- 4 ----


def test_suffix_array_and_prefixes():
    for _ in range(30):
        t = np.frombuffer(bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 200))), np.uint8)
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())
        lcp = suffix_dedup.kasai(t, sa, 1000, lane=7)
        for i in range(1, len(t)):
            x, y = t[sa[i - 1] :].tobytes(), t[sa[i] :].tobytes()
            assert lcp[i] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.mark.parametrize("crowd", [4096, 2])
def test_repeated_strings(docs, none, crowd):
    out = suffix_dedup.remove_repeats(docs, crowd=crowd).collect()
    got = sorted((r["doc_id"], r["n_bytes"], sum(e - s for s, e in zip(r["starts"], r["ends"], strict=True)), len(r["starts"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out)
    want = sorted((i, *x) for (i, _), x in zip(DOCS, suffix_dedup.brute_force([x for _, x in DOCS], 200), strict=True))
    assert got == want and any(x[2] for x in want)
    assert suffix_dedup.remove_repeats(none).count() == 0


# ---- 5 ----


def test_url_rules(spark):
    urls = ["https://a.COM/en/7", "http://example.com/en/7", "http://example.com/en/70", "http://x.example.com/en/8", "http://net/de/1", "http://a.example.net/de/8?x", "http://org/es", "http://org/es/", "no scheme", None, "https://example.com:80/en/", "x://a.com/en/?q://b.org/es/", "https://notcom/en/"]
    out = {r["url"]: r for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string").withColumn("rule", F.lit(1)), spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")).collect()}
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        h, p = m[1].lower(), m[2]
        fits = [(len(a + b), a + b, v) for v, a, b in url_filter.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, default=(0, None, "allow"))
        assert (out[u]["host"], out[u]["path"], out[u]["rule"], out[u]["verdict"]) == (h, p, best[1], best[2])


# ---- 6 ----


@pytest.mark.parametrize("shard", [8192, 40])
def test_near_vectors(spark, shard):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    v = np.concatenate([base, base[:20] + 0.02 * r.normal(size=(20, 16)), np.repeat(base[:1], 30, axis=0), base[5:6] * 7, 0.03 * r.normal(size=(40, 16)) + base[9]]).astype(np.float32)
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [None] * 16, 0), (504, v[0].tolist(), None), (505, [], 0), (506, [1.0], 0)]
    out = {x["vec_id"]: x for x in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=shard).collect()}
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None, :] % 2) & ~np.eye(len(x), dtype=bool)
    assert [out[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    assert [out[i]["component_id"] for i in range(len(x))] == root and all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(500, 507))


# ---- 7 ----


def test_language(spark, docs, none):
    a, b = "abcdefgh", "mnopqrst"
    text = lambda x, n: " ".join("".join(rng.choice(x) for _ in range(5)) for _ in range(n))
    rows = [(i, text(a if i % 2 else b, rng.randint(5, 60)), "aa" if i % 2 else "bb") for i in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), window=64, epochs=6)
    test = [(i, text(a if i % 2 else b, 40)) for i in range(40)] + [(100, None), (101, "123 !"), (102, text(a, 5000))]
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert np.mean([out[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(40)]) > 0.95
    assert (out[100]["lang_pred"], out[101]["score"], out[102]["lang_pred"]) == ("und", 0.0, "aa")
    assert langid.learn(none) is None and {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    """20 000 copies of one text and 500 others: copies are drawn once, rows and characters stay within the bounds."""
    rows = spark.range(20_000).select(F.lit("hot copy " * 900).alias("text"), F.lit("aa").alias("lang")).union(spark.range(500).select(F.concat(F.lit("own text "), F.col("id").cast("string")), F.lit("bb")))
    own = langid.sampled(rows, per_class=100).collect()
    by = {y: [r["t"] for r in own if r["y"] == y] for y in ("aa", "bb")}
    assert len(by["aa"]) == 1 and 60 <= len(by["bb"]) <= 100 and max(len(r["t"]) for r in own) == 4096


def test_language_forward_pass():
    """Scores against a plain loop over windows, filters and positions."""
    rng_ = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], 16, [rng_.normal(size=(w, 256, 4)) for w in langid.WIDTHS], rng_.normal(size=12), rng_.normal(size=(12, 3)), rng_.normal(size=3))
    text = bytes(rng_.integers(32, 127, 40).tolist())
    each = []
    for k in range(0, 40, 16):
        x = text[k : k + 16].ljust(16, b"\0")
        hidden = [max(0.0, max(sum(t[o][x[i + o]][f] for o in range(w)) for i in range(16 - w + 1)) + model.bias[4 * n + f]) for n, (t, w) in enumerate(zip(model.tables, langid.WIDTHS, strict=True)) for f in range(4)]
        logit = [sum(h * model.out[j][q] for j, h in enumerate(hidden)) + model.out_bias[q] for q in range(3)]
        each.append(np.exp(logit) / np.exp(logit).sum())
    assert np.allclose(langid.predict(model, model.fold(), [text])[0], np.mean(each, axis=0), atol=1e-5)


# ---- 8 ----


def brute_jaccard():
    sets = []
    for _, x in DOCS:
        w = words(x, r"[^\x20\x09-\x0D]+")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(DOCS)))
    for _ in range(len(DOCS)):
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, (d, _) in enumerate(DOCS):
        least[root[i]] = min(least.get(root[i], d), d)
    return sorted((d, len(sets[i]), least[root[i]]) for i, (d, _) in enumerate(DOCS))


def test_jaccard(docs, none):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == brute_jaccard() and jaccard_join.jaccard_join(none).count() == 0


def test_jaccard_links_null_ids(spark):
    other = prose(120)
    rows = [(None, BASE), (None, edited(BASE, 1)), (None, other), (7, other), (8, prose(90))]
    out = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out) == [(0, 0), (0, 0), (0, 7), (7, 7), (8, 8)]
    # A class of null ids joins with one that has an id.
    out = jaccard_join.jaccard_join(spark.createDataFrame([(None, BASE), (3, edited(BASE, 1))], "doc_id long, text string")).collect()
    assert [r["component_id"] for r in out] == [3, 3]


def test_pipeline_stages_of_null_and_repeated_ids(spark, tmp_path):
    near, own, far = edited(BASE, 1), prose(80), prose(70)
    rows = [(None, BASE), (None, near), (None, own), (5, far), (5, far), (6, edited(far, 1)), (7, BASE + " x"), (7, prose(60)), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], SCHEMA)
    got = pipeline.near_copies(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(None, own), (5, far), (7, BASE + " x"), rows[7], (None, None), (None, None)], key=repr)
    spark.createDataFrame([(1, " ".join(own.split(" ")[5:30])), (2, " ".join(rows[7][1].split(" ")[5:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.benchmark(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted((x for k, x in enumerate(rows) if k not in (2, 7)), key=repr)


# ---- 9 ----


def test_lines(spark, none):
    line = prose(40)
    rows = [(1, "Head\n" + line + "\n\nTail one here"), (2, line), (3, edited(line, 1) + "\n" + prose(30)), (4, None), (5, ""), (6, "\n\n"), (7, "  HEAD\t\nother words in this line"), (8, edited(line, 25)), (9, "a\n" * 300 + "b")]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))).collect()}
    kept = [x for r in out.values() for x in (r["text"] or "").split("\n") if x.strip()]
    alike = [x for x in kept if len(set(x.split()) & set(line.split())) > 0.9 * len(set(line.split()))]
    assert len(alike) == 1 and len([x for x in kept if x.strip().lower() == "head"]) == 1 and out[4]["text"] is None and out[5]["text"] == "" and out[6]["text"] == "\n\n"
    assert out[9]["text"] == "a\nb" and out[8]["text"] == rows[7][1] and [out[i]["n_lines"] for i in (4, 6, 9)] == [0, 3, 301]
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_of_long_tokens(spark):
    """Different addresses of one host and lines without spaces agree in a prefix only: all of them stay."""
    lines = ["https://www.example.com/articles/1", "https://www.example.com/about-us", "see https://example.com/reports/2019", "see https://example.com/accounts/7", "今日は天気がとても良いので散歩に行きましょう皆で公園へ", "今日は天気がとても良いので散歩に行くのはやめて家で本を読む"]
    rows = [(i, x) for i, x in enumerate(lines)] + [(10, "ab"), (11, "abc"), (12, lines[0].upper())]
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == 0 for i in (1, 2, 3, 4, 5, 10, 11)) and out[0] + out[12] == 1
    got = line_dedup.shingles(spark.createDataFrame([(1, "abcdefg"), (2, "abc"), (3, "a😀cde f"), (4, "x" * 70000)], "d long, norm string"), 5, "d").groupBy("d").agg(F.count("*").alias("n"), F.count_distinct("h").alias("m")).orderBy("d").collect()
    assert [(r["n"], r["m"]) for r in got] == [(3, 3), (1, 1), (4, 4), (69996, 1)]


def test_short_lines_with_a_changed_letter(spark):
    """One letter less in a line of nine words: 5-character shingles have a similarity of 0.84, which must link."""
    pairs = [("subscribe to our newsletter for weekly updates and offers", "subscribe to our newsletter for weekly update and offers"), ("all rights reserved by the example publishing company 2019", "all rights reserved by the example publishing company 2020")]
    rows = [(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)] + [(9, "subscribe to their magazine for monthly news and prizes")]
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] + out[1] == 1 and out[2] + out[3] == 1 and out[9] == 0


def grams_of(line: str) -> set[str]:
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def jaccard(x: str, y: str) -> float:
    a, b = grams_of(x), grams_of(y)
    return len(a & b) / len(a | b)


def changed(line: str, k: int) -> str:
    out = list(line)
    for i in rng.sample(range(len(out)), min(k, len(out))):
        out[i] = rng.choice("abcdefghij")
    return "".join(out)


def brute_lines(lines: list[str]) -> list[int]:
    """The least index of each line's component under links of similarity 0.8."""
    root = list(range(len(lines)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(lines):
        for j in range(i):
            if jaccard(x, lines[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(lines))]


def test_lines_against_brute_force(spark):
    """Lines of words, addresses, characters without spaces and single characters, edited a little or much, and a dense family: the same components as all pairs give."""
    seeds = [prose(rng.randint(6, 60)) for _ in range(25)] + [f"https://www.example.com/{prose(3).replace(' ', '/')}/{i}" for i in range(15)] + ["".join(chr(0x4E00 + rng.randrange(400)) for _ in range(rng.randint(12, 60))) for _ in range(15)] + list("abcde")
    lines = seeds + [changed(x, rng.choice((1, 1, 2, 4, 12))) for x in seeds for _ in range(3)] + [changed(seeds[0], rng.randint(1, 8)) for _ in range(60)]
    lines = list(dict.fromkeys(x for x in lines if x.strip() == x))
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed = 0").count()
    assert abs(out - len(set(brute_lines(lines)))) <= 1
    assert line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)) * 2, "doc_id long, text string")).where("n_removed = 0").count() == 2 * out  # repeated rows decide alike


def test_recall_of_bands_and_sketches(spark):
    """Of pairs of similarity 0.8 to 0.85 at least 0.985 agree in a band, and of these all but one in 200 pass both sketches."""
    pairs = []
    while len(pairs) < 600:
        x = prose(rng.randint(8, 120))
        y = changed(x, max(1, len(x) // 42))
        if 0.8 <= jaccard(x, y) < 0.86:
            pairs.append((x, y))
    lines = spark.createDataFrame([(2 * i + k, pair[k]) for i, pair in enumerate(pairs) for k in (0, 1)], "d long, norm string").repartition("d").cache()
    sigs, long_ = line_dedup.signatures(lines, 5, 4, 6), line_dedup.long_sketches(lines, 5)
    own = sigs.join(long_, "d").withColumn("pair", F.expr("d div 2")).cache()
    x, y = own.where("d % 2 = 0").alias("x"), own.where("d % 2 = 1").alias("y")
    out = x.join(y, F.col("x.pair") == F.col("y.pair")).select(F.expr("size(array_intersect(x.bands, y.bands)) > 0").alias("band"), line_dedup.near("x.q", "y.q").alias("near"), line_dedup.alike("x", "y", 80).alias("alike")).collect()
    met = [r for r in out if r["band"]]
    assert len(out) == 600 and len(met) >= 0.985 * 600 and sum(r["near"] and r["alike"] for r in met) >= 0.995 * len(met)


def test_pairs_verified_by_arrays_and_by_rows(spark, monkeypatch):
    """F1: both ways link the pairs that sets of shingles link: short and empty ends, repeats, characters of two units, exactly 0.8, lines of many rows."""
    lines = ["abc", "abcdefgh", "abcdefghi", "abcdefghz", "ab" * 40, "ab" * 90, "😀 smile at this 😀 line", "😀 smile at this 😀 lines", prose(300)]
    lines += [changed(x, 1) for x in lines[1:]] + [changed(prose(n), 0) for n in (20, 21)] + [changed(lines[8], 40)]

    def units(x: str) -> list[bytes]:
        return [x.encode("utf-16-be")[2 * i : 2 * i + 2] for i in range(len(x.encode("utf-16-be")) // 2)]

    def linked(x: str, y: str) -> bool:
        p, q = [{tuple(u[i : i + 5]) for i in range(max(1, len(u) - 4))} for u in (units(x), units(y))]
        return 100 * len(p & q) >= 80 * len(p | q)

    want = {(i, j) for j in range(len(lines)) for i in range(j) if linked(lines[i], lines[j])}
    assert {(1, 2), (1, 3)} <= want and (2, 3) not in want
    texts = spark.createDataFrame(list(enumerate(lines)), "d long, norm string").cache()
    pairs = texts.select(F.col("d").alias("a")).crossJoin(texts.select(F.col("d").alias("b"))).where("a < b")
    for most in (line_dedup.LONG, 100, 0):  # all by arrays, some by rows, all by rows
        monkeypatch.setattr(line_dedup, "LONG", most)
        assert {tuple(r) for r in line_dedup.verified(pairs, texts, 5, 80).collect()} == want


def test_rows_of_several_shingles(spark):
    """signatures and sets take a row for several shingles and still hold each of them."""
    lines = spark.createDataFrame([(1, "abcdefg"), (2, "abc"), (3, "a😀cde f"), (4, prose(200)), (5, "")], "d long, norm string").cache()
    single = line_dedup.shingles(lines, 5, "d").collect()
    one = {(r["d"], r["h"]) for r in single}
    several = line_dedup._several(lines, 5).collect()
    assert {(r["d"], h) for r in several for h in r[1:]} == one and len(several) < len(single) / 3
    least = line_dedup.shingles(lines, 5, "d").groupBy("d").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(line_dedup.masks(24))])
    bands = F.array(*[F.xxhash64(F.lit(k), *[F.col(f"m{i}") for i in own]) for k, own in enumerate(line_dedup.band_rows(4, 6))])
    assert {(r[0], tuple(r[1])) for r in line_dedup.signatures(lines, 5, 4, 6).select("d", "bands").collect()} == {(r[0], tuple(r[1])) for r in least.select("d", bands).collect()}


def test_pairs_across_are_made_once(spark):
    """a family of lines that share many bands and link little gives each pair once, not once a band, and none is lost."""
    base = prose(60)
    lines = list(dict.fromkeys(changed(base, 4) for _ in range(40))) + [prose(60) for _ in range(10)]
    texts = spark.createDataFrame(list(enumerate(lines)), "d long, norm string").repartition("d").cache()
    rows = line_dedup.signatures(texts, 5, 4, 6).select("d", "q", F.explode("bands").alias("band")).where("d % 7 <> 0 or band % 2 = 0").withColumn("root", F.expr("if(d < 5, 0L, d)"))
    own = rows.groupBy("d").agg(F.collect_set("band").alias("own"))
    ends = rows.join(own, "d").join(line_dedup.long_sketches(texts, 5), "d").cache()
    x, y = ends.alias("x"), ends.alias("y")
    every = [tuple(r) for r in x.join(y, line_dedup.across() & line_dedup.alike("x", "y", 80) & (F.col("x.d") < F.col("y.d"))).select("x.d", "y.d").collect()]
    got = [tuple(r) for r in line_dedup.all_across(ends, 80).collect()]
    assert len(got) == len(set(got)) and set(got) == set(every) and len(every) > 2 * len(got) > 100


def test_lines_are_trimmed_as_by_btrim(spark):
    """lines without a blank at an end are not trimmed at all; the others and blank ones are told as before."""
    lines = ["Plain Line", " a", "b ", "\tC\x0b", "\x0c\rd \t", "", " ", "\t \x0b\x0c\r", "\x01 e ", "\x01", "\xa0f\xa0", "!", " !", "É ", "a b\t c", "\x1fg\r"]
    got = line_dedup.occurrences(spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id long, text string"), "text", "doc_id").select("pos", "norm").collect()
    want = [(i, x.strip("\t\n\x0b\x0c\r ").lower()) for i, x in enumerate(lines)]
    assert sorted(map(tuple, got)) == [x for x in want if x[1]]


def test_bucket_tables_are_shuffled_once(spark):
    """the aggregate and the join of a bucket table read one shuffle."""
    sigs = spark.createDataFrame([(d, d % 3, [d % 5, 7, d]) for d in range(40)], "d long, q long, bands array<long>")
    out = line_dedup.buckets(sigs, 0, 2)
    want = [(k, d, d % 3, k, k % 3) for d in range(40) for k in [d % 5] if d != k] + [(7, d, d % 3, 0, 0) for d in range(40) if d]
    assert {r["band"] for r in out.collect()} == {0, 1, 2, 3, 4, 7} and sorted(map(tuple, out.collect())) == sorted(want)
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_stage_lines_against_brute_force(spark):
    """One line of each component stays; documents of which nothing is left go; nulls, repeated rows and clashing names are kept."""
    seeds = [prose(rng.randint(8, 30)) for _ in range(12)]
    texts = ["\n".join(rng.choice([x, changed(x, 1), x.upper(), ""]) for x in rng.sample(seeds, 3)) for _ in range(15)] + [None, "", seeds[0], "  "]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], SCHEMA).withColumns({"n_lines": F.lit("clash"), "d": F.lit("clash")})
    out = pipeline.lines(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    lines = sorted({y.strip().lower() for x in texts if x for y in x.split("\n") if y.strip()})
    kept = [y.strip().lower() for r in got.values() if r["text"] for y in r["text"].split("\n") if y.strip()]
    root = dict(zip(lines, brute_lines(lines), strict=True))
    assert sorted(root[x] for x in kept) == sorted(set(root.values())) and {15, 16, 18} <= set(got)
    assert all((r["text"] is None) == (texts[i] is None) and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for i, r in got.items())
    assert pipeline.lines(spark, docs.limit(0), "").count() == 0


def test_stage_language(spark):
    """Documents without a letter go, all others of the trained languages stay, with all their columns; nothing of an empty table."""
    text = lambda x, n: " ".join("".join(rng.choice(x) for _ in range(5)) for _ in range(n))
    rows = [(i, text("abcdefgh" if i % 2 else "mnopqrst", rng.randint(20, 60)), "aa" if i % 2 else "bb", "s", 0) for i in range(400)] + [(1000, None, "aa", "s", 0), (1001, "12 !", "bb", "s", 0), (None, text("abcdefgh", 40), None, None, 0), (0, rows_text := text("mnopqrst", 3000), "bb", "s", 0), (0, rows_text, "bb", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    out = pipeline.language(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((x[0] is None, x[0] or 0) for x in rows if x[0] not in (1000, 1001)) and {r["score"] for r in got} == {"clash"}
    assert pipeline.language(spark, docs.limit(0), "").count() == 0


def test_stage_mixture_against_brute_force(spark, tmp_path):
    """Each source's words come near its target, which a plain loop gives: weights 5, 2, 1 by name, no more than three times what a source has, the rest shared again."""
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, prose(rng.randint(5, 40)), "en", "abc"[i % 3], 0) for i in range(120)] + [(None, prose(9), "en", None, 0), (500, None, "en", "a", 0), (3, prose(7), "en", "a", 0), (3, prose(7), "en", "a", 0)]
    size = {s: sum(len(x[1].split(" ")) for x in rows if x[1] and x[3] == s) for s in ("a", "b", "c", None)}
    weight, target, held = dict(zip(("a", "b", "c", None), (5, 2, 1, 5), strict=True)), {}, set()
    while True:
        rest, free = sum(size.values()) - sum(3 * size[s] for s in held), [s for s in size if s not in held]
        target = {s: 3.0 * size[s] if s in held else rest * weight[s] / sum(weight[x] for x in free) for s in size}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        held |= over
    out = pipeline.mixture(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert len(out) == len(rows) and sorted(r["size"] for r in out) == sorted(len(x[1].split(" ")) if x[1] else 0 for x in rows) and all(r["taken"] <= 3 * r["size"] for r in out)
    for s in size:
        own = [r for r in out if r["source_size"] == size[s]]
        assert own and abs(own[0]["target"] - target[s]) < 1e-6 and abs(sum(r["taken"] for r in own) - target[s]) <= 40


# ---- 10 ----


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 300])
def test_benchmark(spark, docs, none, block):
    own = PASSAGE.split(" ")
    items = [(1, " ".join(own[5:30])), (2, prose(25)), (3, "One two"), (4, None), (5, ""), (6, " ".join(own[40:49])), (1, " ".join(own[5:30])), (None, "axa AXA")]
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["item_ids"])) for r in decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=block).collect())
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = []
    for d, x in DOCS:
        w, hit, seen = words(x, pattern), set(), set()
        for i, y in items:
            v = words(y, pattern)
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    seen.add(i)
        want.append((d, len(w), len(hit), len(seen), tuple(sorted(str(i) for i in seen if i is not None))))
    assert got == sorted(want) and any(x[2] for x in want)
    assert decontam.decontaminate(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0 and not any(r["contaminated"] for r in decontam.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect())
