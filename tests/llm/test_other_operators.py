"""Pages, benchmark passages, languages, addresses and Hamming search against plain versions."""

import hashlib
import math
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest

from barloom.llm.decontaminate import decontaminate
from barloom.llm.hamming_search import search, sign_codes
from barloom.llm.html_blocks import blocks_of
from barloom.llm.html_crf import default_model, extract_text, labelled_blocks
from barloom.llm.html_pages import labelled_pages
from barloom.llm.language_id import identify, mixtures, train
from barloom.llm.queries import ORACLES, QUERIES
from barloom.llm.url_rules import Rule, judge, mine
from tests.llm.conftest import ODD_TEXTS, SF_DIR

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_decontamination_equals_sql(spark):
    equal_sql(spark, "op2_decontamination")


def test_hamming_search_equals_sql(spark):
    equal_sql(spark, "op9_hamming_search")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination_by_hand(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (2, "Solo"), (10, "two words"), (3, None), (4, "..."), (None, "w1"), (5, passage), (6, passage + " É one more")]
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    docs += [
        (50, passage), (51, "x " * 300 + passage.upper() + " y"), (52, " ".join(passage.split()[:12])), (53, "solo, SOLO"),
        (54, "two, words two"), (55, "a two-words b " * 40), (56, passage + " é one more"), (56, "again solo"), (None, passage),
        (57, " ".join(passage.split()[3:16])), (57, " ".join(passage.split()[3:16])),
    ]
    windows = set()
    for item, text in items:
        w = words(text)
        if item is not None and w:
            size = min(13, len(w))
            windows |= {(item, tuple(w[i : i + size])) for i in range(len(w) - size + 1)}
    want = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, gram in windows:
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found.add(str(item))
        want.append((doc, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate(frame, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = decontaminate(frame, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["n_hit"] or r["contaminated"] for r in none)
    assert decontaminate(frame.limit(0), bench).collect() == []


def test_languages_held_out(spark, documents):
    rows = QUERIES["op5_language_id"](spark, SF_DIR).collect()
    truth = {d["doc_id"]: d["lang"] for d in documents}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(documents) and held
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_texts_and_mixtures(spark):
    one, two = "the house and the garden with this and that", "der Hund und die Katze sowie ein Haus"
    labelled = spark.createDataFrame([(one * 9, "en"), (two * 9, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = train(labelled, "text", "lang")
    assert model[0] == ["de", "en"]
    rows = [(i, t, 7) for i, t in enumerate([*ODD_TEXTS, None, "123 ...", one, two, f"{one} {one} {two}"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language int")
    got = {r["doc_id"]: r["language"] for r in identify(docs, model).collect()}
    for i, text, _ in rows:
        letters = any(c.isalpha() for c in text or "")
        assert (got[i]["lang"] == "und") == (not letters), text
    last = len(rows) - 1
    assert (got[last - 2]["lang"], got[last - 1]["lang"], got[last]["lang"]) == ("en", "de", "en")
    assert 0.5 < got[last]["score"] < 0.9
    nothing = train(labelled.limit(0), "text", "lang")
    assert {r["language"]["lang"] for r in identify(docs, nothing).collect()} == {"und"}


def mixture_by_hand(words, rounds=12):
    """Plain expectation-maximisation of one row's words (log likelihoods by language), then the penalised search."""
    if not words:
        return None
    size = len(words[0])
    weights = [[np.exp(max(x - max(w), -30.0)) for x in w] for w in words]

    def em(chosen, steps):
        share = {k: 1 / len(chosen) for k in chosen}
        for _ in range(steps):
            total = dict.fromkeys(chosen, 0.0)
            for w in weights:
                z = sum(share[k] * w[k] for k in chosen)
                for k in chosen:
                    total[k] += share[k] * w[k] / z
            share = {k: v / len(weights) for k, v in total.items()}
        return share, sum(np.log(sum(share[k] * w[k] for k in chosen) + 1e-300) for w in weights)

    full, _ = em(range(size), rounds)
    order = sorted(range(size), key=lambda k: -full[k])
    best, gain = em(order[:1], 1)
    for n in range(2, size + 1):
        share, new = em(order[:n], rounds)
        if 2 * (new - gain) <= np.log(max(len(words), 2)):
            break
        best, gain = share, new
    return [best.get(k, 0.0) for k in range(size)]


def test_mixtures_by_hand():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 40, 0, 15, 7, 60]
    row = np.repeat(np.arange(len(sizes)), sizes)
    words = np.round(rng.normal(-20, 4, (len(row), 4)), 1)
    words[row == 7] -= np.where(np.arange(4) == (np.arange(60) % 2)[:, None], 0, 9.0)
    words[row == 3] = words[row == 3][np.arange(40) % 6]
    best, count = mixtures(words, row, len(sizes))
    assert count.tolist() == sizes
    for i in range(len(sizes)):
        want = mixture_by_hand(words[row == i].tolist())
        assert np.allclose(best[i], 0 if want is None else want)
    assert (best[7] > 0).sum() > 1 and (best[1] > 0).sum() == 1
    # Equal words counted once with their number give the same.
    first, times = np.unique(np.column_stack([row, words]), axis=0, return_counts=True)
    again, _ = mixtures(first[:, 1:], first[:, 0].astype(int), len(sizes), times=times)
    assert np.allclose(again, best)


def test_mixtures_without_words():
    best, count = mixtures(np.zeros((0, 3)), np.zeros(0, int), 2)
    assert best.tolist() == [[0, 0, 0]] * 2 and count.tolist() == [0, 0]


def test_pages_of_other_layouts():
    model = default_model()
    pages = [labelled_blocks(p) for p in labelled_pages(200, 77)]
    right = [y == z for blocks, labels in pages for y, z in zip(labels, model.decode(blocks), strict=True)]
    assert np.mean(right) > 0.98


def test_page_texts(spark):
    pages = [
        (0, None), (1, ""), (2, "<p>unclosed <b>bold &amp; more &am"), (3, "<article><h1>T</h1><p>a&nbsp;b<br>c</p></article><footer>&copy; x</footer>"),
        (3, "<article><h1>T</h1><p>a&nbsp;b<br>c</p></article><footer>&copy; x</footer>"), (4, "<script>no</script><!-- no -->"),
        (5, "<nav><a href=x>menu</a></nav><article>" + "<p>Text of one line.</p>" * 3000 + "</article>"),
    ]
    frame = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract_text(frame).collect()}
    assert (got[0], got[1], got[4]) == ("", "", "")
    assert got[2] == "unclosed bold & more &am" and got[3] == "T\na b c"
    assert got[5] == "\n".join(["Text of one line."] * 3000)
    assert extract_text(frame.limit(0)).collect() == []


def test_self_closed_foreign_elements_drop_no_text():
    first, second = "The first line of the article is here.", "The second line of it comes later."
    page = f'<svg class="i"/><article><p>{first}</p><svg viewBox="0 0 9 9" /><math/><p>{second}</p></article>'
    for end in ("", "<svg><text>no</text></svg>", "</svg></math>"):
        assert [b.text for b in blocks_of(page + end)] == [first, second]
    assert [b.text for b in blocks_of("<p>a</p><svg><text>no</text><path/></svg><script/>no</script><p>b</p>")] == ["a", "b"]


def test_addresses(spark):
    urls = [
        ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/x?q=1#f", "m.example.com", "/en/x", "example.com/en/", "block"),
        ("http://A.COM/z", "a.com", "/z", "com/", "allow"), ("http://a.com", "a.com", "", None, "allow"),
        ("http://x.NET/es/", "x.net", "/es/", "net/es/", "block"), ("x.net/es/", "", "", None, "allow"),
        (None, "", "", None, "allow"), ("http://bad-host.org/p", "bad-host.org", "/p", None, "block"), ("http://com.org/en/", "com.org", "/en/", None, "allow"),
    ]
    labelled = [(f"http://bad-host.org/{i}", True) for i in range(30)] + [(f"http://fine.org/{i}", False) for i in range(60)] + [(None, True), ("x", None)]
    mined = mine(spark.createDataFrame(labelled, "url string, blocked boolean"))
    assert mined.count() > 0
    frame = spark.createDataFrame([(i, u[0], "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r["page_id"]: r["judged"] for r in judge(frame, mined).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict)
    none = mine(spark.createDataFrame([], "url string, blocked boolean"))
    assert {r["judged"]["verdict"] for r in judge(frame, none, [Rule("com/", "allow")]).collect()} == {"allow"}


def split_address(url):
    """Tokens of addresses without a query, dots inside words or numbers."""
    host, _, path = url.partition("://")[2].partition("/")
    labels = host.split(".")
    parts = [p for x in labels for p in re.split("[-_]", x) if p not in labels]
    return [f"host:{host}", *(f"label:{x}" for x in labels), *(f"part:{p}" for p in parts), *(f"path:{w}" for w in path.split("/") if w)]


def wilson(bad, n, z):
    share = bad / n
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def test_mined_rules_equal_counts_of_all_token_sets(spark):
    """Every token set of every blocked address, counted one by one, against mining with a span over all items."""
    r = random.Random(5)
    rows = []
    for _ in range(400):
        words = [r.choice("abcd"), r.choice("efg"), r.choice("hij")]
        url = f"http://{r.choice(['x', 'y'])}.org/" + "/".join(words)
        rows.append((url, r.random() < (0.9 if words[0] == "a" and words[1] == "e" else 0.7 if words[2] == "h" else 0.05)))
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    mined = mine(frame, support=0.02, span=12)
    rules = {tuple(x["tokens"]): x for x in mined.collect()}
    tokens = [set(split_address(u)) for u, _ in rows]
    assert any(len({t for t in k if t.startswith("path:")}) > 1 for k in rules)
    base, good = sum(b for _, b in rows) / len(rows), {}
    for have in {frozenset(t) for t in tokens}:
        for size in range(1, len(have) + 1):
            for part in combinations(sorted(have), size):
                if part not in good:
                    n = sum(set(part) <= t for t in tokens)
                    bad = sum(b and set(part) <= t for t, (_, b) in zip(tokens, rows, strict=True))
                    kept = bad >= 10 and bad / n >= 0.5 and wilson(bad, n, 3.0) > base
                    good[part] = (bad / n, bad / n / base, bad / len(rows)) if kept else None
    for k, x in rules.items():
        assert good[k] == pytest.approx((x["confidence"], x["lift"], x["support"]))
    judged = judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string"), mined, []).collect()
    for x in judged:
        best = max((v[0] for k, v in good.items() if v and set(k) <= tokens[x["page_id"]]), default=None)
        assert (x["judged"]["confidence"], x["judged"]["verdict"]) == (pytest.approx(best) if best else None, "block" if best else "allow")
        assert not best or set(x["judged"]["tokens"]) <= tokens[x["page_id"]]


def test_mining_a_frequent_address_of_many_words(spark):
    """Words of one long address that each stand elsewhere too: item sets stay bounded by the span."""
    names = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [("http://bad.org/" + "/".join(names) + f"/k{chr(97 + k)}", True) for k in range(26)]
    rows += [(f"http://good.org/{names[k % 20]}/z{chr(97 + k % 25)}", False) for k in range(600)]
    rows += [("http://bad.org/" + "/".join(f"v{i}x" for i in range(3000)), True)] * 15
    mined = mine(spark.createDataFrame(rows, "url string, blocked boolean"))
    urls = [(0, rows[0][0]), (1, rows[30][0]), (2, rows[-1][0]), (3, None)]
    got = judge(spark.createDataFrame([(*u, "x") for u in urls], "page_id long, url string, judged string"), mined).collect()
    assert {x["page_id"]: x["judged"]["verdict"] for x in got} == {0: "block", 1: "allow", 2: "block", 3: "allow"}
    assert judge(spark.createDataFrame([], "page_id long, url string"), mined).collect() == []
    assert mine(spark.createDataFrame([("http://a.org/x", False)] * 30, "url string, blocked boolean")).collect() == []


def test_search_with_ties_copies_and_odd_vectors(spark):
    r = np.random.default_rng(2)
    vectors = [(i, r.normal(size=64).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(40)] + [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 64), (None, [1.0])]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, rank int")
    codes = sign_codes(frame, "vec_id", "embedding")
    rows = {r["id"]: r["code"] for r in codes.collect()}
    got = {}
    for x in search(codes, codes.filter("id % 20 = 0")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["distance"], x["neighbor_id"]))
    assert set(got) == {i for i in rows if i % 20 == 0}
    for q, found in got.items():
        far = sorted((sum(bin(a ^ b).count("1") for a, b in zip(rows[q], c)), i) for i, c in rows.items())[:10]
        assert sorted(found) == [(k + 1, d, i) for k, (d, i) in enumerate(far)]
    assert search(codes.limit(0), codes).collect() == []


def test_search_with_repeated_query_ids(spark):
    """Two queries of one id and opposite codes both get their nearest; equal ones are one query."""
    codes = spark.createDataFrame([(i, bytes([i] * 8)) for i in range(8)] + [(3, bytes([255] * 8))], "id long, code binary")
    asked = spark.createDataFrame([(1, bytes(8)), (1, bytes([255] * 8)), (1, bytes(8))], "id long, code binary")
    got = sorted((x["distance"], x["rank"], x["neighbor_id"]) for x in search(codes, asked, k=2).collect())
    assert got == [(0, 1, 0), (0, 1, 3), (8, 2, 1), (40, 2, 7)]


def test_blocks_of_deep_pages_and_open_quotes():
    n = 100_000
    deep = blocks_of("<div class='menu'>x" * n + "</i></b>" * n + "<p class='own'>y")
    assert len(deep) == n + 1 and deep[-1].tag == "p"
    assert set(deep[-1].above) == {"tag:div", "name:menu", "tag:p", "name:own"}
    assert set(blocks_of("<div class=menu><p>y", {"tag:p"})[0].above) == {"tag:p"}
    inline = blocks_of("<b>" * n + "<h1>z</h1><div>x</div></a>" * 1000)
    assert [b.tag for b in inline[:2]] == ["h1", "div"] and len(inline) == 2000
    assert [b.text for b in blocks_of('<p class="a>first</p><p>b</p>')] == ["first", "b"]
    assert [b.text for b in blocks_of("<ul><li>a<li>b</ul><p>c<div>d</div>e")] == ["a", "b", "c", "d", "e"]


def test_digests_of_no_items(spark):
    rows = QUERIES["op2_decontamination"](spark, SF_DIR).filter("n_items = 0").collect()
    assert {r["items_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
