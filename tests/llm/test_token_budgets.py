"""Where texts are cut to fit a budget of tokens, from the counts of their prefixes."""

import random

from tokenizers import Tokenizer

from quadrille.llm import tokens

PATH = tokens.vocabulary("word_bpe_49k.json")


def test_the_longest_prefix_within_the_limit(spark):
    rng = random.Random(8)
    words = ["hello", "Thtionly", "naïve", "don't", "x=1;", "\n\n", "日本語", "supercalifragilistic", "42"]
    texts = [None, "", "one", *(" ".join(rng.choice(words) for _ in range(n)) for n in (5, 9, 10, 14, 40, 90))]
    texts += [" ".join(rng.choice(["supercalifragilistic", "don't", "we'll", "x=1;", "  ", "naïve", "42"]) for _ in range(n)) for n in (6, 12, 30, 60)]  # plain ones
    library = Tokenizer.from_file(PATH)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    frame = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, fit_chars int")
    for limit in (10, 25):
        rows = {r.doc_id: r for r in tokens.count_tokens(frame, PATH, limit).collect()}
        for i, t in enumerate(texts):
            t = t or ""
            assert (rows[i].n_tokens, rows[i].over_limit) == (count(t), count(t) > limit)
            assert rows[i].fit_chars == max(k for k in range(len(t) + 1) if count(t[:k]) <= limit)
