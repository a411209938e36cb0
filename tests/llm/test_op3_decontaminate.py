"""Template decontamination: re-parameterised items, slot consistency, DuckDB, cases of the docstring."""

import duckdb
from corpus_helpers import docs, with_extra

from reviewgrid.llm import op3_decontaminate as op

ITEM = "In spring Tom bought 12 apples for 3 dollars and Anna sold 12 pears for 5 dollars to Tom near the old mill."
OTHER = "In spring Bob bought 40 apples for 8 dollars and Lisa sold 40 pears for 9 dollars to Bob near the old mill."
MIXED = "In spring Bob bought 40 apples for 8 dollars and Lisa sold 77 pears for 9 dollars to Max near the old mill."
CLEAN = "In spring the river rose and many people went to the market to buy what they could for little money."
SHORT = "What is the boiling point exactly"


def bench(spark, items):
    return spark.createDataFrame([(k, t) if not isinstance(t, tuple) else t for k, t in enumerate(items)], "item_id bigint, text string")


def test_slots_and_literals(spark):
    rows = [ITEM, f"Some words before. {OTHER} And after.", MIXED, CLEAN, f"x {SHORT} of lead?"]
    got = {(r.doc_id, r.item_id): r for r in op.leaks(docs(spark, rows), bench(spark, [ITEM, SHORT])).collect()}
    assert set(got) >= {(0, 0), (1, 0), (4, 1)} and not any(d == 3 for d, _ in got)
    assert got[0, 0].slots_changed == 0 and got[0, 0].consistent
    assert got[1, 0].slots_changed > 0 and got[1, 0].consistent and got[1, 0].n_slots == got[1, 0].slots_changed + 2  # two units stay
    assert (2, 0) not in got or not got[2, 0].consistent


def test_same_rows_as_sql(spark, tmp_path):
    words = [f"w{i % 37}x" for i in range(60)]
    rows = [ITEM, OTHER, MIXED, CLEAN, " ".join(words), "Zoe has 7 km. " + " ".join(words[5:25]) + " 4 kg", None, "", "!!! ...",
            "x " + " ".join(words[3:16]) + " y", "x " + " ".join(words[3:15]) + " y", (3, CLEAN), (0, ITEM), (None, ITEM), "50% off $ 3 €"]
    items = [ITEM, " ".join(words[:30]), SHORT, "a b", None, "Zoe has 7 km", (1, " ".join(words[:30])), (None, CLEAN)]
    d, b = docs(spark, rows), bench(spark, items)
    got = sorted((tuple(r) for r in op.leaks(d, b).drop("thash").collect()), key=str)
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        con.register(name, df.toArrow())
    cols = ("doc_id", "item_id", "matched_tokens", "item_tokens", "n_slots", "slots_changed", "consistent")
    want = con.execute(f"select {', '.join(cols)} from ({op.ORACLE})").fetchall()
    assert got == sorted(want, key=str) and len(got) > 8


def test_shuffled_path_gives_the_same(spark):
    rows = [ITEM, OTHER, CLEAN]
    one = op.leaks(docs(spark, rows), bench(spark, [ITEM])).collect()
    two = op.leaks(docs(spark, rows), bench(spark, [ITEM]), broadcast_windows=0).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 2


def test_clean_keeps_columns_and_other_rows(spark):
    df = with_extra(docs(spark, [ITEM, CLEAN, None, OTHER, (1, CLEAN)]))
    got = op.clean(df, bench(spark, [ITEM]))
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 1, 2]


def test_empty_tables(spark):
    none = bench(spark, [ITEM]).limit(0)
    assert op.leaks(docs(spark, [ITEM]), none).collect() == []
    assert op.leaks(docs(spark, [ITEM]).limit(0), bench(spark, [ITEM])).collect() == []
    assert op.clean(docs(spark, [ITEM]), none).count() == 1


def test_reparameterised_and_verbatim_probes(spark):
    tom = "Tom has 3 apples and 5 pears. Tom buys 7 more at the market."
    title = "The Old Man And The Sea Is A Short Novel By Ernest Hemingway"
    two = "What is two plus two"
    long = "On the second day John walked to the station and waited for the train that left at 5 in the evening"
    tiny = "Paris France"
    items = [tom, title, two, long, tiny]
    rows = [tom.replace("Tom", "Sara"), f"See: {title}, again.", f"well, {two}?", long.replace("John", "Mary Ann"), long.replace(" 5 ", " twenty five "),
            "paris, france!", "They met in Paris, France and left", "What is one of the two things that you like about this town", CLEAN]
    got = {(r.doc_id, r.item_id) for r in op.leaks(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 4)}


def test_random_rows_equal_the_sql(spark):
    import random
    rnd = random.Random(9)
    words = ["Tom", "Anna", "has", "7", "two", "km", "apples", "and", "The", "old", "mill", ".", "for", "$", "3,5", "Über", "straße", "is", "?"]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 24))) for _ in range(25)]
    rows = [" ".join([*(rnd.choice(words) for _ in range(rnd.randint(0, 9))), *(x if rnd.random() < 0.93 else rnd.choice(words) for x in rnd.choice(items).split(" ")),
                      *(rnd.choice(words) for _ in range(rnd.randint(0, 9)))]) for _ in range(80)] + items[:6]
    d, b = docs(spark, rows), bench(spark, items)
    got = sorted((tuple(r) for r in op.leaks(d, b).drop("thash").collect()), key=str)
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        con.register(name, df.toArrow())
    cols = ("doc_id", "item_id", "matched_tokens", "item_tokens", "n_slots", "slots_changed", "consistent")
    assert got == sorted(con.execute(f"select {', '.join(cols)} from ({op.ORACLE})").fetchall(), key=str) and len(got) > 40


def test_very_long_text(spark):
    rows = [" ".join(["filler words here"] * 40_000) + ". " + ITEM, ITEM]
    got = op.leaks(with_extra(docs(spark, rows)), bench(spark, [ITEM])).collect()
    assert {(r.doc_id, r.slots_changed) for r in got} == {(0, 0), (1, 0)}
