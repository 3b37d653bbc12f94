"""Language-model scores of whole texts: a word model and context-tree weighting over bytes.

Both models learn from the documents whose crc32(id) mod 5 is not 1 and score all documents.
What they learn grows with the corpus, so neither is broadcast. Documents are dealt into blocks
of bounded size by hash:

1. Each block lists its distinct words and byte grams with their training counts, packed into
   arrays by key hash.
2. Each hash bucket sums the arrays of all blocks and answers every block's keys. For grams the
   sums are regrouped by their nearest two context bytes; such a group holds complete subtrees
   of the context tree (at most 256^3 grams) and gives every gram's code length.
3. Each block meets the answers to its own keys and scores its texts.

The two top levels of the context tree span all groups: 256 * 256 nodes, which is what the
driver collects and tasks get.

Defined results: a null or empty text is scored as its end alone; a null id counts as training;
without training texts every bit has probability 1/2 and every count is 0; repeated rows are
counted and scored each; an empty table gives no rows. Columns beyond (doc_id, text) are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.context_tree import LOW, LowLevels, code_lengths, grams_of, levels_of, low_sums
from boxloom.llm.shingles import mixed
from boxloom.session import durable

#: Text bytes of a block.
BLOCK_BYTES = 8_000_000
#: Groups of grams by their nearest context bytes; a task takes one at a time.
GROUPS = 512

PACKED = "bucket int, block int, is_word boolean, keys binary, counts binary"
ANSWER = "block int, is_word boolean, keys binary, answers binary"
SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
          "base_score double, score double")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def distinct_grams(texts: list[str], step: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all texts and how often each occurs."""
    keys, counts, held, size = [], [], [], 0
    for i, text in enumerate(texts):
        held.append(grams_of((text or "").encode("utf-8", "surrogatepass")))
        size += len(held[-1])
        if size >= step or i + 1 == len(texts):
            k, c = np.unique(np.concatenate(held), return_counts=True)
            keys.append(k)
            counts.append(c)
            held, size = [], 0
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return summed(np.concatenate(keys), np.concatenate(counts))


def batch_of(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


def list_block(buckets: int):
    """Packs a block's distinct keys and their training counts by bucket."""
    def pack(key: tuple, docs: pa.Table) -> pa.Table:
        block = key[0].as_py()
        held = docs.column("held_out").to_pylist()
        texts = docs.column("text").to_pylist()
        learned, other = Counter(), set()
        for text, out in zip(texts, held):
            other.update(words := words_of(text)) if out else learned.update(words := words_of(text))
        rows = []
        parts: dict[int, tuple[list, list]] = {}
        for word in learned.keys() | other:
            part = parts.setdefault(crc32(word) % buckets, ([], []))
            part[0].append(word)
            part[1].append(learned.get(word, 0))
        for bucket, (words, counts) in parts.items():
            rows.append((bucket, block, True, b" ".join(words), np.array(counts, np.int64).tobytes()))
        grams, counts = distinct_grams([t for t, out in zip(texts, held) if not out])
        more, _ = distinct_grams([t for t, out in zip(texts, held) if out])
        grams, counts = summed(np.concatenate((grams, more)), np.concatenate((counts, np.zeros(len(more), np.int64))))
        place = (mixed(grams) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(np.bincount(place, minlength=buckets))
        for bucket, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            if a < b:
                own = order[a:b]
                rows.append((bucket, block, False, grams[own].tobytes(), counts[own].astype(np.int64).tobytes()))
        return batch_of([("bucket", pa.int32()), ("block", pa.int32()), ("is_word", pa.bool_()),
                         ("keys", pa.binary()), ("counts", pa.binary())], rows)

    return pack


def answer_words(key: tuple, packed: pa.Table) -> pa.Table:
    """Counts of a bucket's words over all blocks, for each block that asked; and the bucket's totals."""
    blocks, keys, counts = (packed.column(c).to_pylist() for c in ("block", "keys", "counts"))
    counts = [np.frombuffer(c, np.int64) for c in counts]
    lists = [k.split(b" ") for k in keys]
    total: Counter = Counter()
    for words, own in zip(lists, counts):
        for word, n in zip(words, own.tolist()):
            total[word] += n
    rows = [(block, True, k, np.fromiter(map(total.__getitem__, words), np.int64, len(words)).tobytes(), 0, 0)
            for block, k, words in zip(blocks, keys, lists)]
    rows.append((-1, True, b"", b"", sum(total.values()), sum(1 for n in total.values() if n)))
    return batch_of([("block", pa.int32()), ("is_word", pa.bool_()), ("keys", pa.binary()), ("answers", pa.binary()),
                     ("n", pa.int64()), ("v", pa.int64())], rows)


def sum_grams(key: tuple, packed: pa.Table) -> pa.Table:
    """A bucket's grams summed over all blocks, packed by the group of their nearest context bytes."""
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in packed.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(c, np.int64) for c in packed.column("counts").to_pylist()])
    keys, counts = summed(keys, counts)
    group = group_of(keys)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS))
    rows = [(g, key[0].as_py(), keys[order[a:b]].tobytes(), counts[order[a:b]].tobytes())
            for g, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())) if a < b]
    return batch_of([("grp", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())], rows)


def group_of(grams: np.ndarray) -> np.ndarray:
    return (mixed(grams >> np.uint64(8 * (5 - LOW))) % np.uint64(GROUPS)).astype(np.int64)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]),
            np.concatenate([np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()]))


def top_of_group(key: tuple, packed: pa.Table) -> pa.Table:
    """What a group adds to the two top levels."""
    places, zeros, ones, deeper = low_sums(levels_of(*unpacked(packed))[0])
    return pa.table([pa.array(places, pa.int32()), pa.array(zeros), pa.array(ones), pa.array(deeper)],
                    names=["place", "zeros", "ones", "deeper"])


def code_group(low: LowLevels):
    """Code lengths of a group's grams, packed by bucket as they came."""
    def code(key: tuple, packed: pa.Table) -> pa.Table:
        grams, counts = unpacked(packed)
        lengths = code_lengths(grams, levels_of(grams, counts), low)
        sizes = [len(k) // 8 for k in packed.column("keys").to_pylist()]
        ends = np.cumsum(sizes).tolist()
        rows = [(b, k, lengths[e - n:e].tobytes()) for b, k, e, n in zip(
            packed.column("bucket").to_pylist(), packed.column("keys").to_pylist(), ends, sizes)]
        return batch_of([("bucket", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary())], rows)

    return code


def answer_grams(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
    """Code lengths of a bucket's grams for each block that asked."""
    grams = np.concatenate([np.frombuffer(k, np.uint64) for k in known.column("keys").to_pylist()])
    lengths = np.concatenate([np.frombuffer(x, np.float64) for x in known.column("lengths").to_pylist()])
    order = np.argsort(grams)
    grams, lengths = grams[order], lengths[order]
    rows = [(block, False, k, lengths[np.searchsorted(grams, np.frombuffer(k, np.uint64))].tobytes())
            for block, k in zip(asked.column("block").to_pylist(), asked.column("keys").to_pylist())]
    return batch_of([("block", pa.int32()), ("is_word", pa.bool_()), ("keys", pa.binary()), ("answers", pa.binary())], rows)


def score_block(train_tokens: int, distinct: int, train_texts: int):
    """Scores the texts of a block with the answers to its keys."""
    def score(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        grams, lengths = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for is_word, keys, got in zip(*(answers.column(c).to_pylist() for c in ("is_word", "keys", "answers"))):
            if is_word:
                known.update(zip(keys.split(b" "), np.frombuffer(got, np.int64).tolist()))
            else:
                grams.append(np.frombuffer(keys, np.uint64))
                lengths.append(np.frombuffer(got, np.float64))
        gram, length = np.concatenate(grams), np.concatenate(lengths)
        order = np.argsort(gram)
        gram, length = gram[order], length[order]
        floor = math.log10(train_tokens + 0.5 * (distinct + 1)) if train_tokens else math.log10(0.5)
        n_tokens, n_known, base, model = [], [], [], []
        for text in docs.column("text").to_pylist():
            words = words_of(text)
            counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            counts = np.append(counts, train_texts)
            n_tokens.append(len(counts))
            n_known.append(int((counts > 0).sum()))
            base.append(float(np.log10(counts + 0.5).sum() - len(counts) * floor))
            own = grams_of((text or "").encode("utf-8", "surrogatepass"))
            model.append(float(length[np.searchsorted(gram, own)].sum()))
        n = docs.num_rows
        return pa.table([
            docs.column("doc_id"), docs.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
            pa.array([train_tokens] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """Word-model and context-tree log10 probabilities of every document."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    size, train_texts = docs.agg(
        F.sum(F.octet_length("text")), F.sum((~F.col("held_out")).cast("bigint"))).first()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    packed = durable(dealt.groupBy("block").applyInArrow(list_block(blocks), PACKED), "keys")
    words = durable(packed.where("is_word").groupBy("bucket").applyInArrow(
        answer_words, ANSWER + ", n bigint, v bigint"), "words")
    n, v = words.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    train_texts = train_texts or 0

    grams = packed.where("NOT is_word")
    counted = durable(grams.groupBy("bucket").applyInArrow(
        sum_grams, "grp int, bucket int, keys binary, counts binary"), "grams")
    tops = counted.groupBy("grp").applyInArrow(top_of_group, "place int, zeros double, ones double, deeper double")
    top = tops.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "deeper")]).collect()
    columns = [np.array([r[c] for r in top], k) for c, k in (
        ("place", np.int64), ("zeros", float), ("ones", float), ("deeper", float))]  # at most 256 * 256 rows
    coded = counted.groupBy("grp").applyInArrow(
        code_group(LowLevels(*columns)), "bucket int, keys binary, lengths binary")
    answered = grams.groupBy("bucket").cogroup(coded.groupBy("bucket")).applyInArrow(answer_grams, ANSWER)

    answers = words.where("block >= 0").select("block", "is_word", "keys", "answers").union(answered)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score_block(n + train_texts, v + (train_texts > 0), train_texts), SCORES)
