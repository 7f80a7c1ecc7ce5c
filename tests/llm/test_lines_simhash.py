"""Line dedup and SimHash groups against brute force."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import xxhash

from barloom.llm.line_dedup import dedup_lines
from barloom.llm.queries import ORACLES, op4_line_dedup, op8_simhash
from barloom.llm.simhash import build_tree, close_pairs, near_duplicates, route, shard_links
from tests.llm.conftest import ODD_TEXTS, SF_DIR

BLANKS = " \t\n\x0b\x0c\r"


def lines_by_hand(rows, min_docs=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(doc)
    low = -(10**9)
    keeper = {k: max(v, key=lambda d: low if d is None else d) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def by_order(rows):
    return sorted(rows, key=str)


def test_lines_by_hand(spark):
    long, wide = "The same long line of more than forty characters, here.", "É" * 40
    rows = [(i, f"{i}\n  {long.upper() if i % 2 else long}\t\n{wide}\nend {i}\n") for i in range(7)]
    rows += [(7, "é" * 40), (8, long + "\n" + long), (9, wide[:39]), (None, long), (8, long), (6, rows[6][1])]
    rows += [(20 + i, t) for i, t in enumerate(ODD_TEXTS)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, pos string, dropped string")
    got = dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "pos", "dropped", "dedup"]
    made = [
        (r["doc_id"], r["dedup"]["n_lines"], r["dedup"]["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest())
        for r in got.collect()
    ]
    assert by_order(made) == by_order(lines_by_hand(rows))


def test_lines_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({ORACLES['op4_line_dedup']})").fetchall()
    assert sorted(want) == sorted(map(tuple, op4_line_dedup(spark, SF_DIR).collect()))


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, reach=2):
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= reach):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((doc, f"{fps[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def test_simhash_documents(spark, documents):
    got = [tuple(r) for r in op8_simhash(spark, SF_DIR).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == groups([(d["doc_id"], d["text"]) for d in documents])


def test_simhash_odd_texts(spark):
    rows = [(i + 5, t) for i, t in enumerate(ODD_TEXTS)] + [(1, "One two THREE"), (2, "one\ttwo three"), (None, "one two three"), (1, " "), (1, " ")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = [(r["id"], f"{r['fp'] & (2**64 - 1):016x}", r["component"]) for r in near_duplicates(frame).collect()]
    assert sorted(got, key=str) == groups(rows)
    assert near_duplicates(frame.limit(0)).collect() == []


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    flips = [base]
    for _ in range(3):
        flips.append(base[: n // 4] ^ (np.uint64(1) << rng.integers(0, 64, n // 4).astype(np.uint64)))
    centre = np.uint64(0x0123456789ABCDEF)
    dense = centre ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    return np.unique(np.concatenate([*flips, dense, [centre]]))


def test_trees_find_every_pair():
    values = planted(3000, 1)
    want = set()
    for v in values:
        for w in values[np.bitwise_count(values ^ v) <= 2]:
            if v < w:
                want.add((int(v), int(w)))
    got = {(int(min(p)), int(max(p))) for a, b in close_pairs(values, values[:0], 2) for p in zip(a, b)}
    assert got == want
    tree, leaves = build_tree(values[::7], 40)
    assert leaves > 5
    shards = defaultdict(lambda: ([], []))
    for leaf, at, asks in route(tree, values, 2):
        shards[leaf][asks].append(values[at])
    none = values[:0]
    found = set()
    for members, asking in shards.values():
        m, q = (np.concatenate([none, *x]) for x in (members, asking))
        found |= {(int(min(p)), int(max(p))) for a, b in close_pairs(m, q, 2) for p in zip(a, b)}
    assert found == want
    a, b = shard_links(values, none, 2)
    assert set(a.tolist()) < {x for p in want for x in p} and (b < a).all()
