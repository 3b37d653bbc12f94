import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from boxloom.llm import byte_bpe, token_counts
from boxloom.llm.queries import QUERIES, ranks_path
from tests.llm.helpers import edge_docs, no_docs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(ranks_path()),
                             special_tokens={})


def test_ids_and_offsets_equal_the_library(library):
    random.seed(7)
    alphabet = [*"ab 'stmdrevlN  \n\t.!19é漢　\x1c\x85²Ⅷ😀ก́", "'s", "'re", "'ll", " '", "<|endoftext|>"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 5000 + "é" * 300, "", " " * 4000, "'" * 50, "ab" * 20_000]
    for text, (ids, starts, ends) in zip(texts, byte_bpe.encoded(texts, ranks_path()), strict=True):
        want = library.encode_ordinary(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert starts.tolist() == library.decode_with_offsets(want)[1]
        assert ends.tolist() == sorted(ends.tolist()) and (not want or ends[-1] == len(text))
    assert list(byte_bpe.encoded_ids(texts, ranks_path())) == [x[0] for x in byte_bpe.encoded(texts, ranks_path())]


def test_scan_does_not_depend_on_block_width():
    rng = np.random.default_rng(2)
    marks = rng.choice([0, 1, 2, 3, 4, 5, 8], 5000).astype(np.uint8)
    assert (byte_bpe.token_starts(marks, 128) == byte_bpe.token_starts(marks, 5000)).all()
    assert (byte_bpe.token_starts(marks, 1) == byte_bpe.token_starts(marks, 7)).all()


def test_query_round_trip(spark, library):
    rows = {r["doc_id"]: r for r in QUERIES["op7_byte_bpe"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_edge_rows(spark, library):
    docs = edge_docs(spark)
    got = byte_bpe.encode(docs, ranks_path(), ["doc_id", "text", "key", "n"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
    assert byte_bpe.encode(no_docs(spark), ranks_path(), []).count() == 0
    assert token_counts.section_tokens(no_docs(spark), ranks_path()).count() == 0


def plain_sections(text, offsets):
    bounds = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
    edges = [*bounds, len(text)]
    n, crossing = [0] * len(bounds), [0] * len(bounds)
    for a, b in offsets:
        shares = [max(0, min(b, edges[k + 1]) - max(a, edges[k])) for k in range(len(bounds))]
        owner = shares.index(max(shares))
        n[owner] += 1
        crossing[owner] += sum(s > 0 for s in shares) > 1
    return [(k, edges[k], edges[k + 1], n[k], crossing[k]) for k in range(len(bounds))]


def test_sections_equal_plain_attribution(spark):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    docs = edge_docs(spark, ["a\n\n\n\nb\n\nc \n d", "\n\n", "x\n \n \n y", "é\n漢\n"])
    got = {}
    for r in token_counts.section_tokens(docs, ranks_path()).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    for i, text in texts:
        times = sum(j == i for j, _ in texts)
        offsets = other.encode(text, add_special_tokens=False).offsets
        assert sorted(got[i]) == sorted(plain_sections(text, offsets) * times)
