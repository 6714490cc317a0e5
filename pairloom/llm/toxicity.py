"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Text is folded first (case, look-alike letters, digits and signs that stand for letters), so the
lexicon holds plain forms only. An entry is a whole word or the start of a word. Phrases of the
exception list take the hits inside them back. The score is a logistic function of the weighted
hits, whole and per word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.fitting import held_out, logistic, sigmoid, training_labels

TRAIN_ROWS = 20_000  # labelled rows that the fit may see
THRESHOLD = 0.5
SHORTEST, LONGEST = 4, 8  # lengths of word starts
SUPPORT = 8  # distinct toxic texts that hold an entry

# Characters that look like Latin letters, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x",
    "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "pond scum", "class clown")


class _Folding(dict):
    """Code points to folded text, made as they occur. Letters keep their accents."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        out = ""
        for c in unicodedata.normalize("NFKC", char).lower():
            c = HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c))
            if unicodedata.category(c) != "Cf":  # invisible joiners vanish
                out += c if c.isalpha() or unicodedata.category(c) == "Mn" else " "
        self[code] = out
        return out


FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Folded words between single or more spaces, with a space at either end."""
    return f" {(text or '').translate(FOLDING)} "


def _terms(folded: str) -> set[str]:
    """Entries that a text supports: its words (' word ') and their starts (' wor')."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, exception phrases, and the logistic that turns hits into a score."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    weights: tuple[float, float] = (0.0, 0.0)
    bias: float = 0.0

    def automaton(self):
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(fold(phrase).rstrip() + " ", (len(fold(phrase).rstrip()) + 1, None))
        for entry, weight in self.entries:
            found.add_word(entry, (len(entry), weight))
        if len(found):
            found.make_automaton()
        return found

    def features(self, automaton, text: str | None) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Weighted hits (root), the same per word, and the hits (start, end, weight) in the folded text.

        Of several entries that start at one place, the heaviest counts.
        """
        folded = re.sub(" +", " ", fold(text))
        best: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in automaton.iter(folded) if len(automaton) else ():
            start = end + 1 - size
            if weight is None:
                excused.append((start, end + 1))
            elif start not in best or weight > best[start][1]:
                best[start] = (end + 1, weight)
        hits, reach = [], -1
        excused.sort(reverse=True)
        for start, (end, weight) in sorted(best.items()):
            while excused and excused[-1][0] <= start:
                reach = max(reach, excused.pop()[1])
            if reach < start + 2:  # no phrase holds the beginning of the entry
                hits.append((start, end, weight))
        total = sum(w for *_, w in hits)
        words = max(1, folded.count(" ") - 1)
        return float(np.sqrt(max(total, 0))), total / words, hits


def _counts(sample: DataFrame) -> DataFrame:
    """In how many distinct texts of either label each entry occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: Counter = Counter()
            other: Counter = Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                (toxic if y else other).update(_terms(fold(text)))
            for kind, counter in ((1, toxic), (0, other)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counter), pa.string()), pa.array([kind] * len(counter), pa.int32()),
                     pa.array(list(counter.values()), pa.int64())],
                    names=["term", "kind", "n"],
                )

    parts = sample.mapInArrow(count, "term string, kind int, n long")
    return parts.groupBy("term").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("other"),
    )


def _choose(rows: list, n_toxic: int, n_other: int) -> list[tuple[str, float]]:
    """Entries with their weights (log odds); a longer entry must beat the shorter one that holds it."""
    odds = {
        r["term"]: float(np.log((r["toxic"] + 0.5) / (n_toxic + 1)) - np.log((r["other"] + 0.5) / (n_other + 1))) for r in rows
    }
    kept: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t), t)):
        starts = [term[:n] for n in range(SHORTEST + 1, len(term))]
        if not any(kept.get(s, -1) >= odds[term] - 1 for s in starts):
            kept[term] = odds[term]
    return sorted(kept.items())


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    """Learn entries, weights and the logistic from at most ``rows`` labelled rows.

    Entries are counted by Spark over the distinct texts of the sample; what reaches the driver are the entries with enough
    toxic texts, all of them, and three numbers for each row. Of several rows of one id the smallest text counts. Without
    usable labels the lexicon is empty and the score a half; without toxic ones it is near 0.
    """
    wanted = F.broadcast(training_labels(labels, column, rows))  # at most ``rows`` ids
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(wanted, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = joined.groupBy(F.sha2("text", 256).alias("h")).agg(F.max("y").alias("y"), F.first("text").alias("text"))
    counts = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_other = counts.get(1.0, 0), counts.get(0.0, 0)
    precise = (F.col("toxic") / (n_toxic + 1)) > 20 * (F.col("other") + 0.1) / (n_other + 1)
    support = max(2, min(SUPPORT, n_toxic // 20))
    found = _counts(sample.select("text", "y")).filter((F.col("toxic") >= support) & precise)
    lexicon = Lexicon(tuple(_choose(found.collect(), n_toxic, n_other)))
    table = _with_hits(sample.select(F.lit(0).cast("long").alias("id"), "text", "y"), lexicon, ["id", "y"]).toArrow()
    if not table.num_rows:
        return lexicon
    x = np.column_stack([table["hits"].to_numpy(), table["rate"].to_numpy()])
    weights, bias = logistic(x, table["y"].to_numpy(), l2=1e-6, steps=3000)
    return Lexicon(lexicon.entries, lexicon.exceptions, (float(weights[0]), float(weights[1])), bias)


def _with_hits(df: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep``, ``hits``, ``rate`` and ``terms`` (the matched entries) for rows with a ``text``."""
    kept = [df.schema[c] for c in keep]
    types = {c: df.schema[c].dataType.simpleString() for c in keep}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [lexicon.features(automaton, t) for t in batch.column("text").to_pylist()]
            folded = [{"start": a, "stop": b, "weight": w} for *_, hits in rows for a, b, w in hits]
            sizes = np.cumsum([0, *(len(hits) for *_, hits in rows)])
            span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("weight", pa.float64())])
            spans = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(folded, span))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([r[0] for r in rows], pa.float64()),
                 pa.array([r[1] for r in rows], pa.float64()), spans],
                names=[*keep, "hits", "rate", "spans"],
            )

    schema = ", ".join(f"{f.name} {types[f.name]}" for f in kept)
    return df.select(*keep, "text").mapInArrow(
        match, f"{schema}, hits double, rate double, spans array<struct<start:int,stop:int,weight:double>>"
    )


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``held_out``, ``score``, ``predicted`` and ``spans`` (hits in the folded text) of every row.

    Only the text is looked at. A null or empty text has no hits; ids may be null or repeat.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")
    )
    a, b = lexicon.weights
    total = F.lit(lexicon.bias) + F.col("hits") * a + F.col("rate") * b
    scored = _with_hits(base, lexicon, ["id", "held_out"]).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
    return scored.select("id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def score_text(lexicon: Lexicon, text: str | None) -> float:
    """The score of one text, outside Spark (tests, spot checks)."""
    hits, rate, _ = lexicon.features(lexicon.automaton(), text)
    return float(sigmoid(np.array(lexicon.bias + hits * lexicon.weights[0] + rate * lexicon.weights[1])))
