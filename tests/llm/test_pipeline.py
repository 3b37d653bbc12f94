"""The pipeline's stages against plain versions of what each decides."""

import hashlib

import numpy as np
import tiktoken
import public_tokenizers

import corpus_pipeline as P
from boxloom.llm import byte_bpe
from boxloom.llm.decontaminate import normal
from boxloom.llm.queries import QUERIES, ranks_path
from boxloom.llm.secret_scan import base_spans
from tests.llm.helpers import edge_docs
from tests.llm.test_jaccard_join import plain_components

SF = "/root/testdata/sf0.001"


def test_each_stage_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before.collect(), docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS

    before, after = kept["quality_rules"]
    verdict = {r["doc_id"] for r in QUERIES["op10_quality_rules"](spark, SF).collect() if r["kept"]}
    assert {r["doc_id"] for r in after} == verdict and 0 < len(after) < len(before)

    before, after = kept["jaccard_join"]
    groups = plain_components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in groups})

    before, after = kept["benchmark_leaks"]
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone >= {r["doc_id"] for r in before if any(x in normal(r["text"]) for x in items)}

    before, after = kept["secret_scan"]
    texts = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for r in before:
        found = base_spans(r["text"])
        clean = texts[r["doc_id"]]["text"]
        assert all(v not in clean for *_, v in found) and (found or clean == r["text"])
        assert texts[r["doc_id"]]["n_chars"] == len(clean)

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.ranks_of(ranks_path()))
    before, after = kept["byte_bpe"]
    ids = {r["doc_id"]: np.frombuffer(r["token_ids"], "<u4").tolist() for r in after}
    assert ids == {r["doc_id"]: library.encode_ordinary(r["text"]) for r in before}
    assert sorted(r["doc_id"] for r in P.run(spark, SF).collect()) == sorted(ids)


def test_last_stage_decodes_what_it_encodes(spark):
    docs = edge_docs(spark)
    got = P.tokens(spark, docs, SF).collect()
    want = sorted((r["doc_id"] or -1, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["decoded_sha256"]) for r in got) == want
    assert all(len(r["token_ids"]) == 4 * r["n_tokens"] for r in got)
