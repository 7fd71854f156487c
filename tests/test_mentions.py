"""Names of products in texts."""

from quarrystone.operators import mentions

PRODUCTS = [
    ("B", "p1", "Everyday Account"), ("B", "p2", "Everyday Account Plus"), ("B", "p3", "Harbour Savings Account"), ("B", "p4", "Harbour Savings Account"), ("B", "p5", "Savings Account"), ("B", "p6", "Max"), ("C", "p7", "Max Rewards Card"),
    ("B", "p8", None), ("B", "p9", "Credit Cards"), (None, "p0", "Lost"),
]


def told(spark, rows):
    products = spark.createDataFrame(PRODUCTS, "bank_code string, product_id string, product_name string")
    evidence = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "evidence_id int, bank_code string, product_id string, text string")
    return [(r.others, r.names_own, r.refused) for r in mentions.other_products(evidence, products).orderBy("evidence_id").collect()]


def test_evidence_that_names_another_product_is_refused(spark):
    rows = [
        ("B", "p1", "Monthly fee of the Everyday Account: $5"), ("B", "p1", "Everyday Account Plus costs $9"), ("B", "p2", "Everyday Account Plus costs $9"), ("B", "p2", "The everyday account costs $5"), ("B", "p1", "EVERYDAY-ACCOUNT, or Everyday account plus"),
        ("B", "p3", "Harbour Savings Account: 4%"), ("B", "p4", "Harbour: 4%"), ("B", "p1", "Savings accounts and credit cards"), ("B", "p1", "Max pays 4%"), ("C", "p7", "Max pays 4%"), ("B", "p1", "Maximum fee"), ("B", "p1", None), ("B", "p1", ""), (None, "p0", "Max"), ("B", "p1", "max, max and Everyday"),
    ]
    assert told(spark, rows) == [
        ([], True, False), (["everyday account plus"], False, True), ([], True, False), (["everyday account"], False, True), (["everyday account plus"], True, False),
        ([], True, False), ([], True, False), ([], False, False), (["max"], False, True), ([], False, False), ([], False, False), ([], False, False), ([], False, False), ([], False, False), (["max"], True, False),
    ]


def test_mentions_are_those_of_brute_force(spark):
    import random

    rng = random.Random(4)
    words = ["red", "blue", "big", "account", "plus"]
    products = [("B", f"p{k}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for k in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    names = mentions.dictionary(spark.createDataFrame(products, "bank_code string, product_id string, product_name string"))
    evidence = spark.createDataFrame([(k, "B", t) for k, t in enumerate(texts)], "evidence_id int, bank_code string, text string")
    known = {tuple(r.name.split()) for r in names.collect()}
    assert ("account",) not in known
    want = set()
    for k, t in enumerate(texts):
        own = t.split()
        found = {(s, s + len(n), " ".join(n)) for n in known for s in range(len(own) - len(n) + 1) if tuple(own[s : s + len(n)]) == n}
        want |= {(k, s + 1, z + 1, n) for s, z, n in found if not any(a <= s and b >= z and b - a > z - s for a, b, _ in found)}
    assert {tuple(r) for r in mentions.mentions(evidence, names).collect()} == want


def test_empty_tables(spark):
    assert told(spark, []) == []
    none = spark.createDataFrame([], "bank_code string, product_id string, product_name string")
    evidence = spark.createDataFrame([(1, "B", "p", "Max")], "evidence_id int, bank_code string, product_id string, text string")
    assert [tuple(r) for r in mentions.other_products(evidence, none).collect()] == [(1, [], False, False)]
