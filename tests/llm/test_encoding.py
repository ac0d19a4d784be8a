import os
import random

import pytest

from rookery.llm import encoding as en

pytestmark = pytest.mark.skipif(not os.path.isdir(en.TOKENIZERS), reason="no vocabulary files")

TEXTS = [
    "it's we'll they'RE don't  x\n\n y   z\t\t!", "a" * 5000, " " * 3000, "\n" * 999 + "end", "<|endoftext|> as text", "日本語のテキスト。" * 300, "it'" + "s" * 700, "1234567890" * 300,
    "mixed 日本 text, with ' quotes' and 'll 've " * 90, "👩‍🔧👍🏽 emoji " * 200, "Привет, склад! " * 200, "é" * 1000, "word " * 2000, "'s't're've'm'll'd" * 200, "naïve café façade   " * 100,
]


def test_tree_equals_encoding_at_once():
    coding, sizes = en.tokenizer(en.TOKENIZERS, "byte_bpe_50k")
    for text in TEXTS:
        whole = coding.encode_ordinary(text)
        for leaf in (1, 3, 17, 64, 1000):
            if leaf < 17 and len(text) > 1500:
                continue
            assert en.encode_tree(text, coding, sizes, leaf) == whole
        assert en.decode_tree(whole, coding) == text


def test_random_texts_and_leaves():
    coding, sizes = en.tokenizer(en.TOKENIZERS, "byte_bpe_multi_50k")
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "'", "s", "ll", " ", "  ", "\n", "7", "42", ".", "—", "é", "日", "。", "​", "🤖"]) for _ in range(rng.randint(1, 160)))
        assert en.encode_tree(text, coding, sizes, rng.randint(1, 40)) == coding.encode_ordinary(text)


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")], "key int, text string, ids string")
    got = sorted((r.key, list(r.ids)) for r in en.encode_corpus(df, "key", "text").collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    counts = sorted((r.key, r.n_tokens) for r in en.count_tokens(df, ["key"], "text").collect())
    assert counts == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert en.encode_corpus(df.limit(0), "key", "text").count() == 0
