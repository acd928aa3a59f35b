"""Template decontamination: copies, other parameters, inconsistent slots, brute force."""

import numpy as np
import pyarrow as pa

from pathloom.llm import decontaminate as dc

ITEM = "A train leaves Boston at 60 miles per hour and then Maria waits 15 minutes until the train reaches Boston again after 60 miles of track."


def found(spark, texts, items, **more):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, doc_id int")
    return sorted((r["doc_id"], r["item_id"], r["exact"]) for r in dc.contaminated(docs, bench).collect())


def test_copies_and_parameters(spark):
    filler = "nothing here is of any interest to the reader of these lines so it goes on "
    other = ITEM.replace("Boston", "Leeds").replace("60", "75").replace("Maria", "Ann").replace("15", "20")
    mixed = ITEM.replace("60", "75", 1).replace("Boston", "Rome", 1).replace("15", "75").replace("Maria", "Boston")
    texts = [filler + ". " + ITEM + " " + filler, filler + ". " + other, filler * 3, mixed, None, "", ITEM[: len(ITEM) // 2], filler * 20_000 + ". " + ITEM]
    got = found(spark, texts, [ITEM, None, "", "short one here"])
    assert (0, 0, True) in got and (1, 0, False) in got and (7, 0, True) in got and (6, 0, False) in got
    assert {g[0] for g in got} == {0, 1, 6, 7}


def test_short_items_and_empty(spark):
    assert found(spark, ["we saw short one here today", "short one"], ["short one here"]) == [(0, 0, True)]
    assert found(spark, [], [ITEM]) == [] and found(spark, ["a"], []) == []
    assert found(spark, [ITEM, ITEM], [ITEM, ITEM]) == [(0, 0, True), (0, 1, True), (1, 0, True), (1, 1, True)]


def test_many_items_and_a_small_bitmap(spark, monkeypatch):
    monkeypatch.setattr(dc.bitmap, "__defaults__", (8,))
    items = [f"question {c * 4} about the {c * 5} of a very long {c * 6} sentence" for c in "abcdefg"]
    texts = ["so. " + t + " and more" for t in items]
    assert [(a, b) for a, b, _ in found(spark, texts, items)] == [(i, i) for i in range(7)]


def test_items_of_slots_alone_are_found_as_copies(spark):
    item = "Paris London Rome Berlin 7 km 9"
    texts = [f"They went to {item} again", f"so. {item}.", "They went to Paris London Rome Oslo 7 km 8 again"]
    assert found(spark, texts, [item]) == [(0, 0, True), (1, 0, True)]


def test_a_template_of_many_items_is_matched_once(spark):
    items = [f"a train of {k} cars leaves the old station of the town at noon and stops after {k + 1} miles" for k in range(50)]
    texts = [items[7], items[9].replace("9", "900").replace("10", "901"), "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = dc.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_items"], r["exact"]) for r in rows) == [(0, 7, 50, True), (1, 0, 50, False)]


def test_rows_go_by_their_own_text(spark):
    rows = [(1, ITEM, 5), (1, "clean text", 6), (None, ITEM, 7), (None, "clean too", 8), (3, None, 9), (3, None, 9), (4, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    left = dc.without_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r["key"] for r in left.collect()) == [1, 6, 8, 9, 9]
    assert dc.without_contaminated(docs.limit(0), bench).count() == 0 and dc.without_contaminated(docs, bench.limit(0)).count() == 7


def test_matching_against_brute_force(spark):
    """Every text with every item: windows by tuples, the best line, slots by all value pairs."""
    rng = np.random.default_rng(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "it", "of", "Maria", "Leeds", "7", "12", "km", "40"]
    items = [" ".join(rng.choice(vocabulary, n)) for n in rng.integers(4, 30, 25)]
    texts = []
    for k in range(60):
        item = items[k % 25].split()
        a = rng.integers(0, max(1, len(item) // 2))
        part = [str(rng.choice(vocabulary)) if rng.random() < 0.06 else w for w in item[a:]]
        texts.append(" ".join([*rng.choice(vocabulary, 15), *part, *rng.choice(vocabulary, 10)]))

    def tokens(text):
        x = dc.canonicalise(pa.array([text]))
        return list(zip(x.template.tolist(), x.kind.tolist(), x.value.tolist(), strict=True)), x.word.tolist()

    def held(text, item):
        (t, plain), (i, own) = tokens(text), tokens(item)
        width = min(8, len(i))
        good = [p for p in range(len(i) - width + 1) if 2 * sum(k > 0 for _, k, _ in i[p : p + width]) <= width]
        if not good:
            t, i = [(w, 0, w) for w in plain], [(w, 0, w) for w in own]
            width = min(8, len(i))
            good = list(range(len(i) - width + 1))
        name = lambda x: [a for a, _, _ in x]
        lines = {}
        for p in good:
            for at in range(len(t) - width + 1):
                if name(t[at : at + width]) == name(i[p : p + width]) and 2 * sum(k > 0 for _, k, _ in t[at : at + width]) <= width:
                    lines.setdefault(at - p, set()).add(p)
        if not lines:
            return False
        best = min(lines, key=lambda d: (-len(lines[d]), d))
        matched = set().union(*(own for d, own in lines.items() if abs(d - best) <= 8))
        pairs = [(i[p][1], i[p][2], t[best + p][1], t[best + p][2]) for p in range(len(i)) if 0 <= best + p < len(t) and i[p][1] and t[best + p][1]]
        first = {}
        for p in range(len(i)):
            first.setdefault(i[p][2], p)
        most = lambda xs: min(sorted(set(xs)), key=lambda x: (-xs.count(x), x))
        agree = [a == b and most([q[2:] for q in pairs if q[:2] == (a, u)]) == (b, v) and most([(q[0], first[q[1]]) for q in pairs if q[2:] == (b, v)]) == (a, first[u]) for a, u, b, v in pairs]
        return len(matched) >= dc.COVERAGE * len(good) and (not agree or sum(agree) / len(agree) >= dc.CONSISTENCY)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = dc.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    want = {(k, j) for k, t in enumerate(texts) for j, i in enumerate(items) if held(t, i)}
    assert got == want and len(want) > 12


def test_windows_against_brute_force():
    rng = np.random.default_rng(1)
    vocabulary = ["alpha", "beta", "Gamma", "7", "12", "km", "delta.", "it"]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (0, 1, 5, 30, 60)]
    x = dc.canonicalise(pa.array(texts))
    hashes, good = dc.windows(x.template, x.kind, x.first, 4)
    seen = {}
    for row in range(len(texts)):
        for i in range(x.first[row], x.first[row + 1]):
            inside = i + 4 <= x.first[row + 1] and sum(x.kind[i : i + 4] > 0) <= 2
            assert good[i] == inside
            if inside:
                key = tuple(x.template[i : i + 4].tolist())
                assert seen.setdefault(key, hashes[i]) == hashes[i]
    assert len(set(seen.values())) == len(seen)


def test_kinds():
    x = dc.canonicalise(pa.array(["Near Paris 12,500 km north. Then m was 5 Kilograms of New York"]))
    assert x.kind.tolist() == [0, 2, 1, 3, 0, 0, 0, 0, 1, 2, 0, 2]
