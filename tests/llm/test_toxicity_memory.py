"""What a worker of the toxicity operator keeps."""

import tracemalloc

from urbanlens.llm import toxicity as T


def test_words_met_are_not_kept():
    texts = [" ".join(f"w{i}x{j}" for j in range(2000)) + " stupidest" for i in range(60)]
    words = T._matcher(["idiot", "stupid*"])
    assert len(list(T._matches(texts[:1], words))) == 1
    tracemalloc.start()
    try:
        found = [x[0] > 0 for x in T._matches(texts, words)]
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert found == [True] * len(texts)
    assert kept < 2_000_000  # a table of the 120,000 words took 9.5 MB
