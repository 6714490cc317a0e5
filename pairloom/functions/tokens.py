"""Token expressions over a small vocabulary."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.util import as_col, let

PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
# A vocabulary is a literal of every plan that uses it, so its size is checked.
MAX_TOKENS = 20000
_SPECIAL = set("\\.[]{}()*+-?^$|/#&~")


def escape(token: str) -> str:
    """Escape for a regular expression, in a spelling that Java and RE2 both read."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in token)


@dataclass(frozen=True)
class Vocabulary:
    """Token strings by id (the position in the list)."""

    tokens: tuple[str, ...]
    # Ids by hash slot, see `id_of`; filled on first use.
    _slots: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        if len(self.tokens) > MAX_TOKENS:
            raise ValueError(f"{len(self.tokens)} tokens; a vocabulary holds at most {MAX_TOKENS}")

    def index(self, token: str) -> int:
        return self.tokens.index(token)

    @property
    def pattern(self) -> str:
        """All tokens as alternatives, longest first; among equals, file order."""
        ordered = sorted((t for t in self.tokens if t), key=len, reverse=True)
        return "(" + "|".join(escape(t) for t in ordered) + ")"

    @property
    def automaton(self) -> str:
        """The same matches as `pattern`, from a tree of the tokens.

        Longest first means: at a place, the longest token that fits. Tokens with the same start
        share it, and single characters form one class, so a place is decided by a few
        comparisons instead of one per token.
        """
        tree: dict = {}
        for token in self.tokens:
            node = tree
            for ch in token:
                node = node.setdefault(ch, {})
            if token:
                node[""] = {}

        def branches(node: dict) -> str:
            leaves = [ch for ch, below in node.items() if ch and set(below) == {""}]
            parts = [escape(ch) + tail(below) for ch, below in node.items() if ch and set(below) != {""}]
            if leaves:
                parts.append("[" + "".join(escape(ch) for ch in leaves) + "]")
            return "|".join(parts)

        def tail(node: dict) -> str:
            return f"(?:{branches(node)})" + ("?" if "" in node else "")

        return branches(tree)

    def id_of(self, spark: SparkSession) -> tuple[Column, int]:
        """A two-level lookup: hash slot, then the one or two tokens of that slot.

        A map literal is searched from front to back, so one map of all tokens would cost hundreds
        of comparisons per token. The slot number is Spark's own hash, taken once per token here.
        """
        if "table" not in self._slots:
            slots = 1
            while slots < 2 * len(self.tokens):
                slots *= 2
            rows = (
                spark.createDataFrame(pa.table({"id": range(len(self.tokens)), "token": list(self.tokens)}))
                .select("id", "token", F.pmod(F.hash("token"), F.lit(slots)).alias("slot"))
                .collect()
            )
            groups: list[dict[str, int]] = [{} for _ in range(slots)]
            for row in rows:
                groups[row["slot"]].setdefault(row["token"], row["id"])
            self._slots["table"] = groups
        groups = self._slots["table"]
        empty = F.create_map().cast("map<string,int>")
        maps = [
            F.create_map(*[F.lit(v) for kv in g.items() for v in kv]) if g else empty for g in groups
        ]
        return F.array(*maps), len(groups)


def tokenize(text: Column | str, vocab: Vocabulary) -> Column:
    """Tokens of ``[CLS]text[SEP]``, longest match first; other characters are skipped."""
    framed = F.concat(F.lit(CLS), as_col(text), F.lit(SEP))
    return F.regexp_extract_all(framed, F.lit(vocab.automaton), F.lit(0))


def token_ids(spark: SparkSession, tokens: Column | str, vocab: Vocabulary) -> Column:
    table, slots = vocab.id_of(spark)
    return F.transform(
        as_col(tokens),
        lambda t: F.element_at(F.element_at(table, F.pmod(F.hash(t), F.lit(slots)) + 1), t),
    )


def fit(ids: Column | str, max_len: int, pad_id: int) -> Column:
    """Exactly ``max_len`` ids: padded, or cut (a cut row has no end token)."""
    ids = as_col(ids)
    short = F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), short)), 1, max_len)


def decode(ids: Column | str, vocab: Vocabulary) -> Column:
    """Text of the ids behind the first one and before the first end token."""
    table = F.array(*[F.lit(t) for t in vocab.tokens])
    ids = as_col(ids)
    return let(
        F.array_position(ids, vocab.index(SEP)).cast("int"),
        lambda end: F.array_join(
            F.transform(
                F.slice(ids, 2, F.greatest(F.when(end > 0, end - 2).otherwise(F.size(ids) - 1), F.lit(0))),
                lambda i: F.element_at(table, i + 1),
            ),
            "",
        ),
    )


def attention_mask(ids: Column | str, pad_id: int = 0) -> Column:
    return F.transform(as_col(ids), lambda i: (i != pad_id).cast("int"))


def covers(text: Column | str, vocab: Vocabulary) -> Column:
    """True where the tokens leave no character of the text out."""
    text = as_col(text)
    tokens = F.regexp_extract_all(text, F.lit(vocab.automaton), F.lit(0))
    return F.length(F.array_join(tokens, "")) == F.length(text)


def balanced(text: Column | str, opening: str, closing: str) -> Column:
    """True where every closing mark has an opening one before it and none stays open."""
    marks = F.regexp_replace(as_col(text), f"[^{escape(opening)}{escape(closing)}]", "")
    # A depth below zero sticks.
    depth = F.aggregate(
        F.split(marks, ""),
        F.lit(0),
        lambda acc, m: F.when(acc < 0, acc)
        .when(m == opening, acc + 1)
        .when(m == closing, acc - 1)
        .otherwise(acc),
    )
    return depth == 0
