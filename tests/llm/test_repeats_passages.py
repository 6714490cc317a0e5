"""Passages planted in two documents each: the contract's length in bytes decides, not their number of words."""

import random

from pairloom.llm.repeats import LENGTH, remove_repeats


def test_planted_passages_go_by_bytes(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    text = lambda n, size: " ".join(word(size) for _ in range(n))
    short, long = text(60, 5), text(60, 8)  # 359 and 539 bytes
    texts = [f"{text(40, 6)} {i}| {p} |{i} {text(30, 6)}" for i, p in enumerate((short, short, long, long, text(60, 8)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(short) < LENGTH < len(long)
    removed = lambda length: [r.n_removed for r in remove_repeats(df, length).orderBy("id").collect()]
    ends = len("| ") + len(" |")  # around the passage, up to the number that differs
    assert removed(LENGTH) == [0, 0, len(long) + ends, len(long) + ends, 0]
    assert removed(200) == [len(short) + ends] * 2 + [len(long) + ends] * 2 + [0]
