"""What a worker of the word-level encoder keeps."""

import tracemalloc
from hashlib import sha256

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urbanlens.llm import common
from urbanlens.llm.word_bpe import Encoder, build_lexicon, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def digest_words(i):
    """A hundred words of letters, nearly all of them met once."""
    digits = "".join(sha256(f"{i} {j}".encode()).hexdigest() for j in range(13))
    letters = digits.translate(str.maketrans("0123456789", "ghijklmnop"))
    return " ".join(letters[k : k + 8] for k in range(0, 800, 8))


def test_rare_words_take_little_memory(tmp_path):
    lexicon = tmp_path / "lexicon"
    lexicon.write_bytes(build_lexicon(["the", "of"], PATH))
    encoder = Encoder(PATH, str(lexicon))
    last = None
    tracemalloc.start()
    try:
        for start in range(0, 3000, 100):
            for last in encoder([digest_words(i) + " of the" for i in range(start, start + 100)]):
                pass
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    expected = Tokenizer.from_file(PATH).encode(digest_words(2999) + " of the", add_special_tokens=False)
    assert memoryview(last[0]).cast("I").tolist() == expected.ids
    assert last[1] == " ".join(expected.tokens)
    assert kept < 45_000_000  # ids and decoded text of each of the 300,000 words took far more


def test_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("of the rows").alias("text"))
        result = word_bpe(docs, PATH, {"n": ("long", lambda ids, _: len(ids) // 4)})
        assert spark.conf.get(key) == str(common.BATCH_ROWS)
        assert [r.n for r in result.collect()] == [3, 3, 3]
    finally:
        spark.conf.set(key, before)
