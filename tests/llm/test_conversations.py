"""Quotation linking on small threads."""

import random

from pathloom.llm import conversations as cv

THREAD = [
    (1, 0, "user", "How do I boil eggs?\nI have no pan."),
    (1, 1, "assistant", "> How do I boil eggs?\nUse water."),
    (1, 2, "user", "> I have no pan.\nThanks anyway.\nAny other idea?"),
    (1, 3, "assistant", "On Monday Ann wrote:\n> > How do I boil  EGGS?\n> Use water.\n\nNo, steam them."),
    (1, 4, "user", ">> Thanks anyway.\n> No, steam them.\nAnother thing"),
    (1, 5, "user", "no quote here"),
    (1, 6, "user", "> nowhere said\nhm"),
    (2, 0, "user", "> How do I boil eggs?\nfirst of another"),
    (2, 5, "user", "after a gap"),
]


def rows(spark, data):
    df = spark.createDataFrame([(*r, 1) for r in data], "conv_id long, turn int, role string, text string, depth int")
    return {(r["conv_id"], r["turn"]): r for r in cv.reply_ordered(df).collect()}


def test_links(spark):
    got = rows(spark, THREAD)
    assert {k: r["reply_to"] for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 3, (1, 5): 4, (1, 6): 5, (2, 0): None, (2, 5): 0}
    assert {k: r["depth"] for k, r in got.items()} == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (1, 3): 2, (1, 4): 3, (1, 5): 4, (1, 6): 5, (2, 0): 0, (2, 5): 1}
    assert got[1, 3]["text"] == "No, steam them." and got[1, 3]["n_quoted"] == 2 and got[1, 1]["n_linked"] == 1
    assert got[1, 4]["root_turn"] == 0 and got[2, 5]["root_turn"] == 0
    assert got[1, 0]["formatted"] == "<|user|>\nHow do I boil eggs?\nI have no pan.\n"


def test_edge_rows(spark):
    data = [(None, 0, "user", "a"), (3, None, None, "b"), (3, 0, "user", None), (3, 1, "user", ""), (3, 1, "user", "> "), (4, 0, "user", "x\n" * 50_000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = cv.reply_ordered(df).collect()
    assert len(got) == 6 and all(r["depth"] >= 0 for r in got)
    assert sorted(r["reply_to"] is None for r in got if r["conv_id"] == 3 and r["turn"] == 1) == [False, False]
    assert cv.reply_ordered(df.limit(0)).collect() == []


def test_long_chain(spark):
    got = rows(spark, [(7, t, "user", f"> line {t - 1}\nline {t}") for t in range(70)])
    assert all(got[7, t]["depth"] == t and got[7, t]["root_turn"] == 0 for t in range(70))


def test_parse_levels():
    p = cv.parse("hi\n> a b\n>> C\n > > d\nend\n>")
    assert p.own == "hi\nend" and p.quoted == [(1, "a b"), (2, "c"), (2, "d")]


def test_links_against_brute_force(spark, monkeypatch):
    """Random threads with repeated lines at several levels, gaps and long steps."""
    monkeypatch.setattr(cv, "STEP", 4)
    rng = random.Random(5)
    data = []
    for conv in range(12):
        for turn in sorted(rng.sample(range(40), 15)):
            text = "\n".join("> " * rng.choice([0, 0, 1, 1, 2]) + f"line {rng.randint(0, 12)}" for _ in range(rng.randint(1, 5)))
            data.append((conv, turn, "user", text))
    got = rows(spark, data)
    for conv, turn, _, text in data:
        earlier = [(t, set(held)) for c, t, _, x in data if c == conv and t < turn for held in [[(0, p) for p in cv.parse(x).own.split("\n")] + cv.parse(x).quoted]]
        votes = {}
        for level, line in set(cv.parse(text).quoted):
            holders = [t for t, held in earlier if (level - 1, line) in held]
            for t in {min(holders), max(holders)} if holders else ():
                votes[t] = votes.get(t, 0) + 1
        want = max(votes, key=lambda t: (votes[t], t)) if votes else max((t for t, _ in earlier), default=None)
        assert got[conv, turn]["reply_to"] == want, (conv, turn)
        assert got[conv, turn]["n_linked"] == (votes[want] if votes else 0)


def test_a_quotation_of_a_quotation_links(spark):
    got = rows(spark, [(1, 0, "a", "one line"), (1, 1, "b", "> one line\nyes"), (1, 2, "a", "other"), (1, 9, "c", ">> one line\nno")])
    assert got[1, 9]["reply_to"] == 1 and got[1, 9]["depth"] == 2
