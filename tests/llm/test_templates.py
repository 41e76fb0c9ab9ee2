"""Leaks of benchmark items, exact and with other values in their slots."""

import random

from sitelens.llm import templates

ITEMS = [
    (1, "A farmer named Olga sells 12 eggs for $3.50 each day, and Olga keeps 4 eggs for baking. How many remain?"),
    (2, "the quick brown fox jumps over the lazy dog while seven wizards brew a potion at midnight"),
    (3, "too short"),
    (4, None),
    (None, "the quick brown fox jumps over the lazy dog while seven wizards brew a potion at midnight"),
]


def found(spark, df, items=ITEMS, **settings):
    benchmark = spark.createDataFrame([(*i, "clash") for i in items], "item_id BIGINT, text STRING, doc_id STRING")
    return {(r.doc_id, r.item_id): r for r in templates.leaks(df, benchmark, **settings).collect()}


def test_tokens(spark):
    text = "'Tom paid $5.50 for 3 kg of rice, and then Anna Smith ran 12km.'"
    n, u, m = templates.NUMBER, templates.UNIT, templates.NAME
    assert len({n, u, m}) == 3 and all(len(x) == 1 for x in (n, u, m))
    got = spark.sql(f"SELECT {templates.tokens(text)}").head()[0]
    assert got == [
        "tom", "paid", f"{u}$", f"{n}5.50", "for", f"{n}3", f"{u}kg", "of", "rice", "and", "then",
        f"{m}anna", f"{m}smith", "ran", f"{n}12", f"{u}km",
    ]


ROWS = [
    (10, "before. " + ITEMS[0][1] + " after"),
    (11, ITEMS[0][1].replace("Olga", "Petra").replace("12", "30").replace("3.50", "1.25")),
    (12, ITEMS[0][1].replace("Olga sells", "Petra sells").replace("12", "30").replace("and Olga", "and Bruno")
         .replace("4", "5")),
    (13, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG WHILE SEVEN WIZARDS BREW A POTION AT MIDNIGHT"),
    (14, "the quick brown fox jumps over the lazy dog and nothing else of it follows here"),
    (15, "an entirely different text about eggs and farmers and foxes"),
    (None, ITEMS[1][1]),
]


def test_leaks(spark, documents, odd):
    df = documents(ROWS + [(11, ROWS[1][1])] + odd)
    got = found(spark, df)
    assert {(10, 1), (11, 1), (13, 2)} <= set(got) <= {(10, 1), (11, 1), (12, 1), (13, 2)}
    assert got[10, 1].n_changed == 0 and got[11, 1].n_changed == 3
    # Both ways of meeting, by broadcast and by shuffle, agree.
    assert set(found(spark, df, max_broadcast=0)) == set(got)
    assert templates.clean(df, spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")).columns == df.columns


def test_inconsistent_slots_are_no_leak(spark, documents):
    item = "then Ada met Ada and Ada saw Ada while Ada heard Ada before Ada left Ada at last"
    names = iter("Bob Cid Dan Eve Fay Gus Hal Ida".split())
    words = [next(names) if w == "Ada" else w for w in item.split()]
    same = [("Bob" if w == "Ada" else w) for w in item.split()]
    got = found(spark, documents([(1, " ".join(words)), (2, " ".join(same))]), [(1, item)])
    assert set(got) == {(2, 1)}


def test_empty_tables(spark, documents):
    assert found(spark, documents([])) == {} == found(spark, documents(ROWS), [])


def test_a_copy_after_its_sibling_is_found(spark, documents):
    item = "In a box there are 3 red balls, 4 blue balls and 5 green balls. What is the chance of drawing red?"
    sibling = "In a box there are 7 red balls, 8 blue balls and 9 green balls. How many balls are there?"
    rows = [(1, f"{sibling} {item}"), (2, f"{item} {sibling}"), (3, f"{sibling} {sibling} {item} {item}"), (4, sibling)]
    got = found(spark, documents(rows), [(1, item)])
    assert {(1, 1), (2, 1), (3, 1)} <= set(got)
    assert all(got[d, 1].n_changed == 0 and got[d, 1].similarity == 1 for d in (1, 2, 3))


def test_short_items_are_found_verbatim(spark, documents):
    items = [(1, "What is 17 * 24?"), (2, "Ann met Bob"), (3, "Zyzzyva"), (4, "?!"), (5, "")]
    rows = [
        (1, "some words. What is 17 * 24? And more"), (2, "what is 18 * 24?"), (3, "What is 17 * 24?"),
        (4, "later Ann met Bob again"), (5, "Ann met Rob"), (6, "a ZYZZYVA"), (7, "?! nothing"), (8, "What is 17"), (9, None),
    ]
    got = found(spark, documents(rows + rows[:1]), items)
    assert set(got) == {(1, 1), (3, 1), (4, 2), (6, 3)}
    assert all(r.similarity == 1 and r.n_changed == 0 for r in got.values())
    assert set(found(spark, documents(rows), items, max_broadcast=0)) == set(got)


def test_texts_under_one_id_are_searched_each_for_itself(spark, documents):
    first, second = ITEMS[0][1], ITEMS[1][1]
    rows = [(1, first), (2, second), (3, "nothing of either is here at all"), (3, second), (None, second)]
    # Either text of the item is found, and a document is its texts, not their sum.
    got = found(spark, documents(rows), [(7, first), (7, second)])
    assert set(got) == {(1, 7), (2, 7), (3, 7)} and all(r.similarity == 1 for r in got.values())
    half = second.split()
    split = [(4, " ".join(half[:9])), (4, " ".join(half[9:]))]
    assert found(spark, documents(split), [(7, second)]) == {}
    benchmark = spark.createDataFrame([(7, second)], "item_id BIGINT, text STRING")
    kept = templates.clean(documents(rows), benchmark)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([rows[0], rows[2]])


def windows(item, text, window=5):
    """Brute force: the share of an item's windows that a text holds, both as templates."""
    share = [tuple(item[i : i + window]) for i in range(len(item) - window + 1)]
    share = share[1:] if len(share) > 1 else share
    held = {tuple(text[i : i + window]) for i in range(len(text) - window + 1)}
    return sum(w in held for w in share) / len(share)


def test_shares_against_brute_force(spark, documents):
    rng = random.Random(3)
    words = "the cat sat on a mat while seven old dogs ran home to eat warm bread and 12 eggs".split()
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 14)))) for i in range(12)]
    rows = []
    for d in range(150):
        _, item = rng.choice(items)
        cut = [w if rng.random() > 0.04 else rng.choice(words) for w in item.split()]
        rows.append((d, " ".join(rng.choices(words, k=rng.randint(0, 9)) + cut + rng.choices(words, k=3))))
    plain = lambda text: ["#" if w.isdecimal() else w for w in text.split()]
    want = {
        (d, i): share
        for d, text in rows
        for i, item in items
        if (share := windows(plain(item), plain(text))) >= 0.8
    }
    got = found(spark, documents(rows), items)
    # One number stands for itself everywhere, so slots are always consistent.
    assert len(want) > 50 and set(got) == set(want)
    assert all(abs(got[k].similarity - share) < 1e-9 for k, share in want.items())
