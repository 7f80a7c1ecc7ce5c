"""Removal of repeated strings against brute force; merged transforms against sorting all suffixes."""

import random
from collections import Counter

import numpy as np

from barloom.llm import suffix_dedup
from barloom.llm.suffix_dedup import remove_repeats
from barloom.llm.suffix_merge import merge_transforms, suffix_order
from tests.llm.conftest import ODD_TEXTS


def by_hand(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(t), sum(gone), runs, kept))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r)[:4] + (bytes(r["kept"]),) for r in remove_repeats(docs, **more).collect()), key=str)


def texts_with_repeats(seed, n, length):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcé xyz") for _ in range(r.randint(length - 3, 4 * length))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            kind = r.random()
            if kind < 0.4:
                parts.append("".join(r.choice("abcdefgh ñ") for _ in range(r.randint(1, 3 * length))))
            elif kind < 0.8:
                p = r.choice(passages)
                a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
                parts.append(r.choice([p, p[a:b], p[: len(p) // 2] + "#" + p[len(p) // 2 :]]))
            elif kind < 0.9:
                parts.append(r.choice("ab") * r.randint(1, 3 * length))
            else:
                parts.append("xyz" * r.randint(1, length))
        out.append((i, "".join(parts)))
    return out


def test_short_strings_by_hand(spark):
    rows = texts_with_repeats(3, 60, 40)
    rows += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [rows[5], (None, rows[7][1]), (5, "other text of a used id")]
    want = by_hand(rows, 40)
    assert any(w[2] for w in want) and any(not w[2] for w in want)
    assert run(spark, rows, length=40) == want


def test_split_cells_change_nothing(spark):
    rows = texts_with_repeats(4, 60, 40)
    assert run(spark, rows, length=40, cell_rows=3) == by_hand(rows, 40)


def test_passage_with_other_surroundings_is_not_searched_whole(spark, monkeypatch):
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh ñ") for _ in range(70))

    def other(n):
        return "".join(r.choice("ABCDEFGH") for _ in range(n))

    rows = [(i, other(r.randint(0, 60)) + passage + other(r.randint(0, 60))) for i in range(40)]
    rows += [(50, passage), (51, passage[:45] + other(50)), (52, other(50) + passage[-45:]), (53, passage[5:46] + "#" + other(40))]
    rows += [rows[3], (54, rows[4][1])]
    search = suffix_dedup.repeated_windows

    def bounded(pieces, left, low, high, cell, length):
        largest = max(Counter(cell.tolist()).values())
        assert largest <= 4, f"{largest} rows of one cell"
        return search(pieces, left, low, high, cell, length)

    monkeypatch.setattr(suffix_dedup, "repeated_windows", bounded)
    assert run(spark, rows, length=40, cell_rows=4) == by_hand(rows, 40)


def test_full_length(spark):
    rows = texts_with_repeats(5, 25, 400)
    assert run(spark, rows) == by_hand(rows, 400)


def test_documents(spark, documents):
    rows = [(d["doc_id"], d["text"]) for d in documents]
    assert run(spark, rows) == by_hand(rows, 400)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merged_transforms_order_all_suffixes():
    r = random.Random(1)
    strings = [[r.randint(1, 3) for _ in range(r.randint(1, 12))] for _ in range(40)]
    strings[7] = strings[3]
    shards = [strings[:11], strings[11:30], strings[30:]]
    transforms, orders, first = [], [], 0
    for shard in shards:
        symbols = np.array([s for x in shard for s in [*x, 0]])
        string = np.repeat(np.arange(len(shard)), [len(x) + 1 for x in shard])
        starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in shard])[:-1]))
        own = suffix_order(symbols, string)
        transforms.append(np.where(np.isin(own, starts), 0, symbols[own - 1]))
        suffixes = [(tuple(symbols[p : starts[string[p]] + len(shard[string[p]])]), first + string[p]) for p in own]
        orders.append(suffixes)
        first += len(shard)
    z, common = merge_transforms(transforms, 14)
    at = [0, 0, 0]
    merged = []
    for s in z:
        merged.append(orders[s][at[s]])
        at[s] += 1
    assert merged == sorted(merged)
    for k in range(1, len(merged)):
        a, b = merged[k - 1][0], merged[k][0]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == same or not a or not b
