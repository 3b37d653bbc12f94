import random

import pytest

from boxloom.llm.decontaminate import ERRORS, Matcher, best_end, find_leaks, normal, pieces, without_leaks
from boxloom.llm.queries import QUERIES
from tests.llm.helpers import edge_docs, no_docs

SF = "/root/testdata/sf0.001"


def plain_distance(pattern, text):
    """Smallest edit distance of the pattern to any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choices("abc ", k=rng.randint(1, 70)))
        t = "".join(rng.choices("abc ", k=rng.randint(0, 90)))
        got = best_end(p, t, len(p))
        assert (got[0] if got else len(p)) == plain_distance(p, t)


def test_pieces_tile_an_item_and_outnumber_its_edits():
    for n in (1, 5, 12, 13, 100, 399):
        item = "".join(random.Random(n).choices("abcdefgh", k=n))
        cut = pieces(item)
        assert "".join(p for _, p in cut) == item and len(cut) == int(n * ERRORS) + 1
        assert all(item[a:a + len(p)] == p and p for a, p in cut)


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz")
        elif kind == 1 and len(chars) > 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("xyz"))
    return "".join(chars)


def test_every_occurrence_within_the_budget_is_found(spark):
    rng = random.Random(4)
    words = ["stone", "river", "calm", "and", "the", "of", "lantern", "é", "walks", "hill"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(30)]
    docs = []
    for i, (_, item) in enumerate(items):
        budget = int(len(normal(item)) * ERRORS)
        filler = [" ".join(rng.choices(["lorem", "ipsum", "dolor", "sit"], k=30)) for _ in range(2)]
        docs.append((i, f"{filler[0]}\n {edited(rng, item, budget)} \t{filler[1]}"))
    found = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"),
                       spark.createDataFrame(items, "item_id bigint, text string")).collect()
    own = {r["doc_id"]: r for r in found if r["doc_id"] == r["item_id"]}
    texts = dict(docs)
    for i, item in items:
        assert plain_distance(normal(item), normal(texts[i])) <= int(len(normal(item)) * ERRORS)
        assert own[i]["distance"] == plain_distance(normal(item), normal(texts[i]))
        part = normal(texts[i][own[i]["start"]:own[i]["end"]])
        assert plain_distance(normal(item), part) == own[i]["distance"]
    for r in found:
        assert plain_distance(normal(dict(items)[r["item_id"]]), normal(texts[r["doc_id"]])) == r["distance"]


@pytest.mark.parametrize("item", [None, "", "  \n"])
def test_empty_items_match_nothing(item):
    assert Matcher(((1, item),)).find("any text") == []


def test_edge_rows(spark):
    items = spark.createDataFrame([(1, "the QUICK brown\nfox jumps"), (1, "the QUICK brown\nfox jumps"), (None, "one"), (2, None)],
                                  "item_id bigint, text string")
    docs = edge_docs(spark)
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in find_leaks(docs, items).collect()}
    assert {(8, 1, 45 * k) for k in range(4)} <= got and (3, None, 0) in got
    assert {r["doc_id"] for r in without_leaks(docs, items).collect()} == {0, 1, 2, 4, 5, 6, 7, None}
    assert find_leaks(no_docs(spark), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0


def test_query_finds_exactly_the_documents_that_hold_an_item(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {i for i, t in texts.items() if any(x in normal(t) for x in items)}
    got = QUERIES["op4_benchmark_leaks"](spark, SF).collect()
    assert exact and {r["doc_id"] for r in got if r["distance"] == 0} == exact


def test_each_copy_in_a_chain_is_a_place(spark):
    item = "the calm river walks and the calm stone walks "
    text = normal(item * 3)
    found = Matcher(((1, item),)).find(text)
    assert [(a, b) for _, a, b, d in found if d == 0] == [(46 * k, 46 * k + 45) for k in range(3)]
    rng = random.Random(2)
    budget = int(45 * ERRORS)
    copies = [edited(rng, normal(item), budget) for _ in range(6)]
    found = Matcher(((1, item),)).find(" ".join(copies))
    assert len(found) == 6 and all(x[2] <= y[1] for x, y in zip(found, found[1:]))
    starts = [sum(len(c) + 1 for c in copies[:k]) for k in range(6)]
    assert all(abs(f[1] - s) <= budget for f, s in zip(found, starts))
    assert all(d == plain_distance(normal(item), normal(" ".join(copies)[a:b])) for _, a, b, d in found)


def test_very_many_copies_take_one_pass():
    item = "a stone and a river and a hill"
    found = Matcher(((1, item),)).find((item + " ") * 4_000)
    assert len(found) == 4_000 and all(d == 0 for *_, d in found)
