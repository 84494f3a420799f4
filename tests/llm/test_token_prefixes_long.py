import random
import time

from loomline.llm import packing, token_counts
from loomline.llm.words import tokenizer


def count(text):
    return len(tokenizer(packing.vocabulary("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)


def at_prefixes(text):
    import numpy as np

    changes = token_counts.tables(packing.vocabulary("byte_bpe_50k.json")).text(text)
    return [0, *np.cumsum(np.frombuffer(changes, "<i2"), dtype=np.int64).tolist()]


def test_contractions_and_blanks_by_force():
    rng = random.Random(6)
    parts = ["'", "'re", "'ve", "'ll", "'s", "'t", "don", "I", "l", "r", "re", "é", " ", "  ", "\n", "\u3000", "\xa0", "\t", "!", "9", "'l", "'v", "日"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert at_prefixes(t) == [count(t[:i]) for i in range(len(t) + 1)], repr(t)


def test_time_grows_with_the_text_and_not_with_a_words_square():
    for make in (lambda n: " " * n, lambda n: "\n" * n + "x", lambda n: "it's" * (n // 4), lambda n: "a'" * (n // 2), lambda n: "\u3000" * n, lambda n: "=" * n, lambda n: "ab" * (n // 2)):
        at_prefixes(make(64))
        began = time.process_time()
        got = at_prefixes(make(200_000))
        assert time.process_time() - began < 20
        assert got[-1] == count(make(200_000))
