import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import tokenizer

if not os.path.exists(tokenizer.FOLDER):
    pytest.skip("no vocabularies here", allow_module_level=True)


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.load()


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokenizer.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", "Hello  world", "<|endoftext|> it's 12345", "naïve 漢字 👩‍💻 x", "a" * 300, "\r\n\t  \n x  ", "��\x00"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_public_library(encoder, public, text):
    assert encoder.encode(text) == public(text)


def test_random_texts(encoder, public):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(30))
        assert encoder.encode(text) == public(text)


def test_appended_prefixes_and_edits(encoder):
    rng = random.Random(5)
    data = "".join(rng.choice("abc der xy") for _ in range(60)).encode()
    table = tokenizer.PrefixTable(encoder, data[:10]).append(data[10:33]).append(data[33:])
    for end in range(len(data) + 1):
        assert table.ids(end) == [encoder.ranks[t] for t in encoder._merged(data[:end])]
    for _ in range(200):
        text = "".join(rng.choice("ab c  1's\n.") for _ in range(50))
        i = rng.randrange(51)
        changed, ids = encoder.edited(text, encoder.encode(text), i, min(50, i + rng.randrange(5)), rng.choice(["", " ", "xy", "'s "]))
        assert ids == encoder.encode(changed)


def test_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello"), (3, "Hello")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.ids, r.n) for r in df.select("doc_id", tokenizer.token_ids(F.col("text")).alias("ids"), tokenizer.token_counts(F.col("text")).alias("n")).collect())
    assert rows == [(1, [], 0), (2, [], 0), (3, [15496], 1), (3, [15496], 1)]
