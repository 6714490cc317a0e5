import random
import re

import pytest
from pyspark.sql import functions as F

from pairloom.functions import tokens as tk
from pairloom.operators import tokenize as enc
from pairloom.sources.lines import read_vocab

VOCAB = tk.Vocabulary(("[PAD]", "[UNK]", "[CLS]", "[SEP]", "C", "c", "cc", "ccc1", "(", ")", "[", "]", "=", "O", "Cl", "+", "-", "é"))


def test_tree_matches_like_the_plain_alternatives(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("Ccl1()[]=O+-éxQ ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["ccc", "cccc1", "ccc1ccc1", "[CLS]C[SEP]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = re.compile(VOCAB.pattern)
    for row in df.select("t", tk.tokenize("t", VOCAB).alias("k")).collect():
        assert row.k == plain.findall("[CLS]" + row.t + "[SEP]")


def encode(spark, texts, max_len):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return enc.encode(df, "t", VOCAB, max_len).orderBy("id")


def test_encode_pads_and_cuts(spark):
    rows = encode(spark, ["Cc", "x", "C" * 10, ""], 6).collect()
    assert rows[0].ids == [2, 4, 5, 3, 0, 0] and rows[0].n_tokens == 4
    assert rows[1].ids == [2, 3, 0, 0, 0, 0]
    assert rows[2].ids == [2, 4, 4, 4, 4, 4] and rows[2].n_tokens == 12
    assert rows[3].n_tokens == 2


def test_every_token_has_its_id(spark):
    rows = encode(spark, list(VOCAB.tokens), 3).collect()
    assert [r.ids[1] for r in rows] == list(range(len(VOCAB.tokens)))


def test_decode_roundtrip(spark):
    texts = ["CCO", "c(=O)Cl", "é[C+]", ""]
    df = encode(spark, texts, 20).select("id", tk.decode("ids", VOCAB).alias("d"))
    assert [r.d for r in df.collect()] == texts
    cut = encode(spark, ["CCCCCC"], 4).select(tk.decode("ids", VOCAB)).first()[0]
    assert cut == "CCC"


def test_mask(spark):
    assert encode(spark, ["C"], 5).select(tk.attention_mask("ids")).first()[0] == [1, 1, 1, 0, 0]


def test_trim_batch(spark):
    df = encode(spark, ["C", "CCC", "CC", "CCCCCCCCC"], 8).withColumn("b", F.col("id") % 2)
    widths = {r.id: len(r.ids) for r in enc.trim_batch(df, ["b"], "longest").collect()}
    assert widths == {0: 4, 2: 4, 1: 8, 3: 8}
    assert enc.trim_batch(df, ["b"], "max_len") is df
    with pytest.raises(ValueError):
        enc.trim_batch(df, ["b"], "shortest")


def test_read_vocab(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_bytes(b"[PAD]\r\n[UNK]\r\n[CLS]\r\n[SEP]\r\nC\r\n##N\r\n###N)\r\n")
    assert read_vocab(spark, str(path)).tokens == ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "C", "N", "#N)")


def test_vocabulary_size_is_checked():
    with pytest.raises(ValueError):
        tk.Vocabulary(tuple(str(i) for i in range(tk.MAX_TOKENS + 1)))


@pytest.mark.parametrize(
    "text,ok", [("(a(b))", True), ("(", False), (")(", False), ("", True), ("())(", False), ("a", True)]
)
def test_balanced(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tk.balanced("t", "(", ")")).first()[0] is ok
