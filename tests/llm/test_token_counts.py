"""Token counts against the public tokenizer with the same vocabulary."""

from __future__ import annotations

import random

from tokenizers import Tokenizer, models

from ravine.llm.pieces import SPACE, load
from ravine.llm.token_counts import Counter


def test_counts_are_the_tokenizers():
    v = load()
    vocabulary = [("<unk>", 0.0), *zip(v.pieces, v.scores), *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    counter, rng = Counter(v), random.Random(5)
    texts = ["".join(rng.choice("ab the▁ éèñ\n\t\r日本😀x  .,") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(rng.choice("abthe é日") for _ in range(200)).replace(" ", k) for k in ("", "x")]
    texts += [" ".join(rng.choice(["the", "quick", "Brown", "fox,", "jumps", "überall"]) for _ in range(300)), "x" * 3000, " " * 50]
    for t in texts:
        assert counter.count(t) == len(tokenizer.encode(SPACE + t.replace(" ", SPACE)).ids), repr(t[:80])


def test_the_query_over_a_whole_table(spark):
    from ravine.llm.entries import op6_token_counts

    v, d = load(), "/root/testdata/sf0.001"
    vocabulary = [("<unk>", 0.0), *zip(v.pieces, v.scores), *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.n_tokens for r in op6_token_counts(spark, d).collect()}
    assert got == {i: len(tokenizer.encode(SPACE + t.replace(" ", SPACE)).ids) if t else 0 for i, t in texts.items()}
    long = spark.createDataFrame([("ab" * 300_000,), (None,), ("",)], "text string")
    from ravine.llm.token_counts import count_tokens

    assert sorted(r.n_tokens for r in count_tokens(long).collect())[:2] == [0, 0]


def test_ties_take_the_longest_last_piece():
    from ravine.llm.pieces import Vocabulary

    v = Vocabulary(("a", "b", "c", "ab", "bc", "▁"), (-1.0, -1.0, -1.0, -1.0, -1.0, -1.0), True)
    # a|bc and ab|c score alike in two pieces; three single pieces score less
    assert Counter(v).search("abc") == 2
    assert Counter(v).count("é") == 3  # the sign, and two bytes
