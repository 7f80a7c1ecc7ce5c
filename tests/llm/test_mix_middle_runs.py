"""Mixing, fill-in-the-middle and runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb, floor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import fill_middle, periodic_runs, source_mix
from barloom.llm.queries import ORACLES, op11_source_mix, op12_fill_in_middle, op13_periodic_runs, with_planted_periods
from tests.llm.conftest import DOCUMENT, ODD_TEXTS, SF_DIR

BLANK = "\x20\x09-\x0d"


def words_of(text):
    return re.findall(f"[^{BLANK}]+", text or "")


def equal_to_sql(spark, name, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    got = query(spark, SF_DIR)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(want, key=str) == sorted(map(tuple, got.collect()), key=str)


# --- mixing ---------------------------------------------------------------------------------------


def test_mix_equals_sql(spark):
    equal_to_sql(spark, "op11_source_mix", op11_source_mix)


def targets_by_rounds(sizes):
    """Excess over twice a source's size is shared out again until there is none."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, Fraction(0))
    free, rest = set(order), Fraction(3 * sum(sizes.values()), 2)
    while rest and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / total
        over = {s for s in free if target[s] > 2 * sizes[s]}
        rest = sum((target[s] - 2 * sizes[s] for s in over), Fraction(0))
        for s in over:
            target[s] = Fraction(2 * sizes[s])
        free -= over
    return target


def units_of(spark, rows):
    return spark.createDataFrame(rows, "source string, id long, key string, copy long, size long")


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_rounds(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(["a", "b", "B", "é", "\U0001f600", "z", "", None, "aa", "￮"], rng.randrange(1, 10))
    sizes = {s: rng.choice([0, 1, 7, 100, 5000, 10**6]) for s in names}
    got = source_mix.targets(units_of(spark, [(s, i, "k", 0, n) for i, (s, n) in enumerate(sizes.items())]))
    want = targets_by_rounds(sizes)
    for r in got.collect():
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)


@pytest.mark.parametrize("case", [(10, 4, 5), (50, 1, 25), (40, 39, 20), (7, 0, 3), (9, 9, 4), (300, 120, 150), (5, 3, 5)])
def test_hypergeometric_shares(spark, case):
    """An even grid of u gives every value its probability."""
    total, marked, drawn = case
    grid = 20_000
    u = (F.col("id") + 0.5) / grid
    draw = source_mix.hypergeometric(*[F.lit(x).cast("long") for x in case], u)
    got = Counter({r["x"]: r["n"] for r in spark.range(grid).select(draw.alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()})
    for x in range(total + 1):
        ways = comb(marked, x) * comb(total - marked, drawn - x) if x <= drawn else 0
        assert abs(got[x] - grid * ways / comb(total, drawn)) <= 2


def test_hypergeometric_of_billions(spark):
    total, marked, drawn = 30_000_000_000, 10_000_000_000, 15_000_000_000
    draw = source_mix.hypergeometric(*[F.lit(x).cast("long") for x in (total, marked, drawn)], source_mix.uniform(F.col("id")))
    values = np.array([r["x"] for r in spark.range(40).select(draw.alias("x")).collect()], float)
    sd = (drawn * (1 / 3) * (2 / 3) * 0.5) ** 0.5
    assert abs(values.mean() - drawn / 3) < 5 * sd / 40**0.5
    assert 0.5 < values.std() / sd < 1.5


def test_tree_keeps_quotas(spark):
    quotas = {0: 1000, 1: 3, 4: 500_000, 5: 0, 7: 77}
    rows = spark.createDataFrame(list(quotas.items()), "number long, quota long")
    leaves = source_mix.shard_quotas(rows, 9).collect()
    assert len(leaves) == 512 * len(quotas)
    by_number, by_shard = Counter(), Counter()
    for r in leaves:
        assert r["quota"] >= 0
        by_number[r["number"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
    assert all(by_number[k] == v for k, v in quotas.items())
    assert max(by_shard.values()) - min(by_shard.values()) <= 9
    assert len({r["quota"] for r in leaves if r["number"] == 0}) > 5


def mix_rows():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = " ".join(f"w{rng.randrange(1000)}" for _ in range(rng.choice([0, 1, 5, 600, 1300])))
        rows.append((i, text, "x", "hot" if i % 3 else rng.choice(["a", "b", None, ""]), 0))
    rows += [(100 + i, t, None, "odd", 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, "null id " * 700, "x", "hot", 0), (None, "other", "x", "hot", 0), rows[100 - 38]]
    return rows


def test_mix_of_odd_rows(spark):
    rows = mix_rows()
    frame = spark.createDataFrame(rows, DOCUMENT).withColumns({"shard": F.lit("own"), "size": F.lit(-1), "key": F.lit("k")})
    units, sources, _ = source_mix.mix_documents(frame)
    mixed = source_mix.mix(units, sources, shard_blocks=16)
    taken = source_mix.taken_words(units, sources, mixed).collect()
    assert len(taken) == len(rows)
    assert Counter((r["id"], r["source"], r["size"]) for r in taken) == Counter(
        (i, s, len(words_of(t))) for i, t, _, s, _ in rows
    )
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(words_of(text))
    want = targets_by_rounds(sizes)
    given = Counter()
    for r in taken:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        given[r["source"]] += r["taken"]
    for source, target in want.items():
        assert given[source] in (floor(target), floor(target) - 1)

    blocks = mixed.collect()
    places = defaultdict(list)
    for r in blocks:
        places[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len(places) > 8 and max(map(len, places.values())) - min(map(len, places.values())) <= 5
    names = [(r["source"], r["id"], r["key"], r["copy"], r["pass"], r["start"]) for r in blocks]
    assert len(set(names)) == len(names)

    texts = {(r["shard"], r["position"]): r["text"] for r in source_mix.mixed_texts(mixed, frame).collect()}
    own = {(s, i, hashlib.md5(t.encode()).hexdigest()): t for i, t, _, s, _ in rows if t is not None}
    assert len(texts) == len(blocks)
    for r in blocks:
        words = words_of(own[r["source"], r["id"], r["key"]])[r["start"] : r["start"] + r["words"]]
        assert words_of(texts[r["shard"], r["position"]]) == words and len(words) == r["words"]


def test_mix_reruns_agree(spark):
    frame = spark.createDataFrame(mix_rows(), DOCUMENT)
    runs = []
    for parts in (1, 7):
        units, sources, _ = source_mix.mix_documents(frame.repartition(parts))
        runs.append(sorted(map(str, source_mix.mix(units, sources, shard_blocks=16).collect())))
    assert runs[0] == runs[1]


@pytest.mark.parametrize("rows", [[], [(1, None, "x", None, 0)], [(1, " \n", "x", "a", 0), (2, "", "x", None, 0)]])
def test_mix_without_words(spark, rows):
    units, sources, mixed = source_mix.mix_documents(spark.createDataFrame(rows, DOCUMENT))
    assert mixed.count() == 0
    assert [(r["size"], r["taken"]) for r in source_mix.taken_words(units, sources, mixed).collect()] == [(0, 0)] * len(rows)


def test_mix_splits_hot_source(spark):
    """Buckets, cells and shards stay small although one source has all rows."""
    units = source_mix.stage(
        spark.range(120_000).select(
            F.lit("hot").alias("source"), "id", F.lit("k").alias("key"), F.lit(0).cast("long").alias("copy"),
            (F.col("id") % 5).alias("size"),
        ), "units",
    )
    sources = source_mix.stage(source_mix.targets(units), "sources")
    blocks = source_mix.ordered_blocks(units, sources)
    assert blocks.groupBy("number", "pass", "bucket").count().agg(F.max("count")).first()[0] < 1.5 * source_mix.BUCKET_BLOCKS
    mixed = source_mix.mix(units, sources, shard_blocks=1 << 14)
    assert mixed.agg(F.sum("words")).first()[0] == 360_000
    assert mixed.groupBy("shard").count().agg(F.max("count")).first()[0] <= (1 << 14) + 5


# --- fill in the middle ---------------------------------------------------------------------------


def middle_by_hand(doc, text):
    text = text or ""
    units = re.findall(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle_equals_sql(spark):
    equal_to_sql(spark, "op12_fill_in_middle", op12_fill_in_middle)


def test_middle_of_odd_texts(spark):
    texts = [*ODD_TEXTS, "a <P> b", "x<S>", "<M>", "<P", "< P>", "é <S", "<<S <M P> >", "S> <P\n", "é ü " * 200_000]
    rows = [(i * 40 + k, t) for i, t in enumerate(texts) for k in range(12)] + [(None, "a b c"), (5, "same"), (5, "same")]
    frame = spark.createDataFrame([(*r, "n", "f", "o") for r in rows], "doc_id long, text string, h1 string, row string, fim string")
    made = fill_middle.fill_in_middle(frame)
    assert made.columns == ["doc_id", "text", "h1", "row", "fim"]
    got = made.collect()
    want = Counter((d, t, *middle_by_hand(d, t)) for d, t in rows)
    assert Counter(
        (r["doc_id"], r["text"], r["fim"]["n"], r["fim"]["form"], r["fim"]["prefix_chars"], r["fim"]["middle_chars"], r["fim"]["output"])
        for r in got
    ) == want
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
    back = fill_middle.restore(made.select("doc_id", "text", "h1", "fim.form", "fim.output"))
    assert back.columns == ["doc_id", "text", "h1", "form", "restored"]
    assert all(r["restored"] == (r["text"] or "") and r["h1"] == "n" for r in back.collect())


def test_middle_empty_table(spark):
    empty = fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []
    assert fill_middle.restore(empty.select("doc_id", "fim.*")).collect() == []


def test_rotation_and_back():
    rng = random.Random(1)
    for _ in range(300):
        text = bytes(rng.choice(b"ab <>PSM \n") for _ in range(rng.randrange(1, 30)))
        if any(m in text for m in (b"<P>", b"<S>", b"<M>")):
            continue
        low, high = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        for form in ("psm", "spm"):
            assert fill_middle.rebuild(bytes(fill_middle.rearrange(text, low, high, form)), form) == text


# --- runs -----------------------------------------------------------------------------------------


def runs_by_hand(words, min_length=24):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def row_by_hand(doc, text):
    words = words_of(text)
    n = len(words)
    if doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_by_hand(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    rest = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest(),
    )


def test_runs_query_by_hand(spark, documents):
    got = Counter(map(tuple, op13_periodic_runs(spark, SF_DIR).collect()))
    assert got == Counter(row_by_hand(d["doc_id"], d["text"]) for d in documents)
    assert sum(r[1] > 0 for r in got) > 10


def periodic_words(rng):
    k, out = rng.choice([1, 2, 3, 5, 50]), []
    for _ in range(rng.choice([1, 3, 12])):
        p = rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 23, 24, 25, 31, 32, 33, 47])
        base = [str(rng.randrange(k)) for _ in range(p)]
        if rng.random() < 0.3:
            base = ["x"] * (p - 1) + ["y"]
        if rng.random() < 0.2:
            base = base[: max(1, p // 2)] * 2 + ["q"]
        out += (base * 6)[: rng.randrange(1, 5 * len(base) + 2)]
        if rng.random() < 0.3:
            out += [str(rng.randrange(k)) for _ in range(rng.randrange(4))]
    return out


def test_runs_of_periodic_texts():
    rng = random.Random(11)
    for _ in range(120):
        many = [periodic_words(rng) for _ in range(rng.choice([1, 4]))]
        got = periodic_runs.runs_of_texts([" ".join(w).encode() for w in many])
        assert [found for _, found in got] == [runs_by_hand(w) for w in many]


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "words",
    [
        fibonacci(1500), ["a"] * 2000, ["a", "b"] * 700 + ["c"], (["a"] * 40 + ["b"]) * 30, ((["a"] * 20 + ["b"]) * 5 + ["c"]) * 6,
        [bin(i).count("1") % 2 for i in range(1000)], ["a"] * 23, ["a"] * 24, [f"w{i % 100}" for i in range(299)],
        [f"w{i % 100}" for i in range(300)], [f"w{i}" for i in range(400)],
    ],
)
def test_runs_of_known_words(words):
    words = list(map(str, words))
    assert periodic_runs.runs_of_texts([" ".join(words).encode()])[0][1] == runs_by_hand(words)


def test_runs_do_not_depend_on_hashes(monkeypatch):
    """Hashes that often collide change no run."""
    monkeypatch.setattr(periodic_runs, "mixed", lambda a, b: (a * np.uint64(31) + b) % np.uint64(13))
    rng = random.Random(2)
    for _ in range(30):
        words = periodic_words(rng)
        assert periodic_runs.runs_of_texts([" ".join(words).encode()])[0][1] == runs_by_hand(words)


def test_selected_places_of_equal_words_are_apart():
    rng = random.Random(4)
    for _ in range(40):
        words = np.array([rng.randrange(2) for _ in range(300)] + [9])
        words[50:250] = words[50 + np.arange(200) % rng.choice([1, 2, 3, 30])]
        sizes, kept = np.array([300]), [np.stack([s, e, np.full(len(s), q)], 1) for s, e, q in periodic_runs.small_periods(words, 8)]
        hashes = words.astype(np.uint64)
        for width in (1, 2, 4):
            hashes = periodic_runs.mixed(hashes, np.concatenate((hashes[width:], np.zeros(width, np.uint64))))
        at, ids = periodic_runs.selected(np.arange(301), np.zeros(301, int), hashes, 8, np.cumsum(sizes + 1), kept)
        for value in set(ids.tolist()):
            gaps = np.diff(at[ids == value])
            assert (3 * gaps > 8).all()


def test_runs_of_odd_rows(spark):
    texts = [*ODD_TEXTS, "x " * 100, "ab\tcd\n" * 30, "é ü\x0bö " * 50, "a b " * 500_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "n " * 40), (3, "r " * 30), (3, "r " * 30)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, periodic long")
    found = periodic_runs.periodic_runs(frame)
    assert found.columns == ["doc_id", "text", "n", "periodic"]
    for r in found.collect():
        words, runs = words_of(r["text"]), [tuple(x) for x in r["periodic"]["runs"]]
        assert r["n"] == 1 and r["periodic"]["n"] == len(words)
        if len(words) < 10_000:
            assert runs == runs_by_hand(words)
        else:
            assert runs == [(0, len(words), 2)] and r["periodic"]["collapsed"] == "a b"
    assert periodic_runs.periodic_runs(frame.limit(0)).collect() == []


def test_planted_periods_of_odd_rows(spark):
    rows = [(d, t) for d, t in enumerate(ODD_TEXTS)] + [(40 + i, "a b c d e f g h") for i in range(40)] + [(None, "a b c")]
    got = with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (doc, text), r in zip(rows, got):
        words = words_of(text)
        if doc is not None and words and zlib.crc32(str(doc).encode()) % 10 == 0:
            g, n = zlib.crc32(str(doc).encode()) // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r["text"].split(" ") == [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        else:
            assert r["text"] == text
