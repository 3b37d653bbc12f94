import re

from boxloom.llm.queries import QUERIES
from boxloom.llm.substring_dedup import LEAST_WORDS, repeats, units_of, without_repeats
from tests.llm.helpers import edge_docs, no_docs

SF = "/root/testdata/sf0.001"


def plain_units(text):
    """(start, end, words, key): the same units, their full key kept instead of a digest."""
    spans, at = [], 0
    for part in re.findall(r".*?(?:\n|[.!?。！？]+[^\S\n]+\n?|[.!?。！？]+\n|\Z)", text, re.S):
        own = tuple(part.encode().lower().split())
        if own:
            spans.append((at, at + len(part), own))
        at += len(part)
    out = []
    for i, (a, b, own) in enumerate(spans):
        key, k = own, i
        while len(key) < LEAST_WORDS and k + 1 < len(spans):
            k += 1
            key += spans[k][2]
        left = len(key) if len(key) < LEAST_WORDS else 0
        if left:
            for _, _, before in spans[:i][::-1]:
                key = before + key if len(key) < LEAST_WORDS else key
        out.append((a, b, len(own), (key, left, len(own) if left or k > i else 0)))
    return out


def plain_repeats(rows):
    rank = lambda i, start, row: (i is None, i or 0, start, row)
    first, units = {}, []
    for row, (i, text) in enumerate(rows):
        for a, b, n, key in plain_units(text or ""):
            units.append((i, a, b, n, key, row))
            first[key] = min(first.get(key, rank(i, a, row)), rank(i, a, row))
    return sorted(((i, a, b, n) for i, a, b, n, key, row in units if rank(i, a, row) > first[key]), key=repr)


PASSAGE = ("The lantern stands on the hill and looks over the calm river at night. Short one. "
           "Then the walker comes home with a stone in the hand and leaves it there!")
TEXTS = [f"Begin here with text {PASSAGE} and the end of it.", f"Other words go before. {PASSAGE} Tail.", PASSAGE + "\n" + PASSAGE,
         "Of it.\nOf it.\nOf it.", "a.b c.d e!f one two three four five six seven\r\n", "Short one. Then nothing."]


def test_repeats_equal_plain_ones(spark):
    docs = edge_docs(spark, TEXTS)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["start"], r["end"], r["n_words"]) for r in repeats(docs).collect()), key=repr)
    assert got == plain_repeats(rows)
    assert repeats(no_docs(spark)).count() == 0


def test_units_tile_the_words():
    for text in [*TEXTS, PASSAGE * 50, "", "...", "x" * 9000]:
        assert [u[:3] for u in units_of(text)] == [u[:3] for u in plain_units(text)]


def test_first_passage_stays_and_the_others_go(spark):
    docs = spark.createDataFrame([(5, TEXTS[0]), (2, TEXTS[1]), (9, "Clean words stand here, and nobody else has said them so.")],
                                 "doc_id bigint, text string")
    cut = {r["doc_id"]: r["text"] for r in without_repeats(docs).collect()}
    assert cut[2] == TEXTS[1] and cut[9].startswith("Clean words")
    assert "Then the walker" not in cut[5] and "Short one" not in cut[5] and cut[5].startswith("Begin here")


def test_short_ends_repeat_with_what_stands_before_them(spark):
    lead = "One text stands here with enough words in it.\n"
    docs = spark.createDataFrame(
        [(1, lead + "The end. So it."), (2, "Another one goes there with words enough too.\nThe end. So it."),
         (3, "Thanks."), (4, "Thanks."), (5, "Thanks. More comes."), (6, "First. " + lead + "the  END. so it.")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["start"], r["kept_doc_id"]) for r in repeats(docs).collect())
    at = len("First. " + lead)
    assert got == [(4, 0, 3), (6, 7, 1), (6, at, 1), (6, at + len("the  END. "), 1)]


def test_one_of_equal_rows_stays(spark):
    row = (7, "The same row comes three times with its id and its text.\nShort end.", "x")
    other = (None, row[1], "y")
    docs = spark.createDataFrame([row, row, other, row], "doc_id bigint, text string, row string").repartition(3)
    assert sorted(r["doc_id"] or 0 for r in repeats(docs).collect()) == [0, 0, 7, 7, 7, 7]
    cut = without_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["row"]) for r in cut.collect()) == [(0, "", "y"), (7, "", "x"), (7, "", "x"), row]


def test_query_equals_plain_repeats(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["start"], r["end"], r["n_words"]) for r in QUERIES["op2_substring_dedup"](spark, SF).collect()), key=repr)
    assert got == plain_repeats(rows)
