import random

from helpers import docs, store
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D


def least(pattern, text):
    """Sellers' dynamic programme: least edit distance to any stretch of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
def test_bit_parallel_distance(pattern, text):
    assert D.least_distance(D.masks(pattern), len(pattern), text)[0] == least(pattern, text)


def test_pieces_cover_the_item():
    for n in (1, 9, 10, 25, 99, 100, 333):
        item = "".join(random.Random(n).choices("xyz", k=n))
        cut = D.pieces(item)
        assert len(cut) == D.budget(n) + 1 and "".join(p for _, p in cut) == item and all(item[a : a + len(p)] == p for a, p in cut)


def edited(rnd, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rnd.randrange(len(out)), rnd.randrange(3)
        if kind == 0:
            out[at] = rnd.choice("abcdefgh ")
        elif kind == 1:
            out.insert(at, rnd.choice("abcdefgh"))
        else:
            del out[at]
    return "".join(out)


def test_matcher_finds_exactly_what_brute_force_finds():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7)))
    items = [(i, D.normal(" ".join(word() for _ in range(rnd.randint(6, 25))))) for i in range(12)]
    items = [(i, t) for i, t in items if len(t) >= D.SHORT]
    match = D.matcher(items)
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(0, 2)):
            t = rnd.choice(items)[1]
            parts += [" ".join(word() for _ in range(15)), edited(rnd, t, rnd.randint(0, len(t) // 7))]
        text = " ".join([*parts, word()])
        got = {m["item_id"]: m["distance"] for m in match(text)}
        want = {i: d for i, t in items if (d := least(t, D.normal(text))) <= D.budget(len(t))}
        assert got == want


def test_query_and_stage(spark, tmp_path):
    item = "The quick brown fox jumps over the lazy dog again and again."
    texts = [None, "", "unrelated text", item, "intro " + item.upper().replace(" ", "\n  ") + " outro", item.replace("quick", "quack"), "filler " * 40_000 + item, "the quick brown fox", item, "cut Short, it is", "shortage and resort"]
    bench = spark.createDataFrame([(1, item), (2, "short"), (3, None), (4, item), (5, ""), (6, " \n")], "item_id long, text string")
    sf = store(tmp_path, documents=docs(spark, texts), benchmark=bench)
    found = sorted((r.doc_id, r.item_id, r.distance) for r in D.op6(spark, sf).collect())
    assert found == sorted([(i, j, d) for i, d in ((3, 0), (4, 0), (5, 1), (6, 0), (8, 0)) for j in (1, 4)] + [(9, 2, 0)])
    clash = docs(spark, texts).withColumn("item_id", F.lit(1)).withColumn("row", F.lit("r")).withColumn("m", F.lit(0))
    kept = D.drop_contaminated(clash, bench)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 7, 10]
    assert sorted(r.doc_id for r in D.drop_contaminated(clash, bench, 70).collect()) == [0, 1, 2, 7, 10]
    many = D.contaminations(docs(spark, texts), bench, 70)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in many.collect()) == found
    assert D.drop_contaminated(clash, bench.limit(0)).count() == len(texts)
    assert D.op6(spark, store(tmp_path / "none", documents=docs(spark, []), benchmark=bench)).count() == 0


def test_short_items_stand_as_whole_words():
    match = D.matcher([(1, "b c"), (2, "ab"), (3, "(x)")])
    got = lambda text: [(m["item_id"], m["places"]) for m in match(text)]
    assert got("ab c") == [] or got("ab c") == [(2, 1)]
    assert got("a b c d") == [(1, 1)] and got("ab,ab cab") == [(2, 2)] and got("f(x)y") == [(3, 1)] and got("abb cc") == []


def test_passes_hold_every_item_once(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (a, one), (b, many) = D.passes(bench), D.passes(bench, 3000)
    one, many = list(one), list(many)
    assert a == len(one) == 1 and b == len(many) > 1 and sorted(x for p in many for x in p) == sorted(one[0])


def test_ids_of_items_keep_their_type(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    docs_ = spark.createDataFrame([(1, f"before {text} behind"), (2, "nothing here")], "doc_id long, text string")
    for kind, ids in (("string", ["x1", None]), ("int", [7, None])):
        items = spark.createDataFrame([(i, text) for i in ids], f"item_id {kind}, text string")
        found = D.contaminations(docs_, items)
        assert dict(found.dtypes)["item_id"] == kind
        assert {(r.doc_id, r.item_id, r.distance) for r in found.collect()} == {(1, i, 0) for i in ids}
        assert [r.doc_id for r in D.drop_contaminated(docs_, items).collect()] == [2]
        # Passes of one item each give the same.
        assert D.contaminations(docs_, items, pass_chars=20).count() == 2
        none = D.contaminations(docs_, items.limit(0))
        assert none.count() == 0 and dict(none.dtypes)["item_id"] == kind
