"""Pieces of SQL (DuckDB dialect) that state the shared expressions for the checks."""

from __future__ import annotations

from pairloom.functions import text as tx
from pairloom.functions.rand import MIX_A, MIX_B, STRIDE
from pairloom.functions.tokens import CLS, SEP, Vocabulary


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _digest(seed: int, *keys: object) -> str:
    return f"md5(concat_ws(':', {', '.join(['%r' % str(seed), *map(str, keys)])}))"


def u(seed: int, *keys: object) -> str:
    return f"(('0x' || substr({_digest(seed, *keys)}, 1, 13))::BIGINT::DOUBLE / {float(2**52)!r})"


def u_int(seed: int, lo: int, hi: int, *keys: object) -> str:
    return f"({lo} + floor({u(seed, *keys)} * {hi - lo + 1}))::BIGINT"


def _let(expr: str, name: str, body: str) -> str:
    return f"list_transform([{expr}], lambda {name}: {body})[1]"


def _mixed(values: str) -> str:
    """The integer mixer over a list."""
    for shift, factor in ((16, MIX_A), (15, MIX_B)):
        values = f"list_transform({values}, lambda v: (xor(v, v >> {shift}) * {factor}) & 4294967295)"
    return f"list_transform({values}, lambda v: xor(v, v >> 15))"


def uniforms(seed: int, dims: int, *keys: object) -> str:
    digest = _digest(seed, *keys)
    first, second = (f"('0x' || substr({digest}, {at}, 8))::BIGINT" for at in (1, 9))
    steps = f"list_transform(range(0, {dims}), lambda d: (wa + d * {STRIDE}) & 4294967295)"
    crossed = _let(second, "wb", f"list_transform({_mixed(_let(first, 'wa', steps))}, lambda v: xor(v, wb))")
    return f"list_transform({_mixed(crossed)}, lambda v: v::DOUBLE / 4294967296.0::DOUBLE)"


def normals(seed: int, dims: int, *keys: object) -> str:
    radius = "sqrt(-2.0::DOUBLE * ln(greatest(us[d // 2 * 2 + 1], 1e-12)))"
    angle = "2 * pi() * us[d // 2 * 2 + 2]"
    wave = f"CASE WHEN d % 2 = 0 THEN cos({angle}) ELSE sin({angle}) END"
    return _let(
        uniforms(seed, dims + dims % 2, *keys),
        "us",
        f"list_transform(range(0, {dims}), lambda d: {radius} * {wave})",
    )


def r6(expr: str, digits: int = 6) -> str:
    """Rounded, and never minus zero."""
    return f"(CASE WHEN abs({expr}) < 0.5e-{digits} THEN 0.0::DOUBLE ELSE round(({expr})::DOUBLE, {digits}) END)"


WS_LIST = quote(tx.WHITESPACE)


def strip(expr: str) -> str:
    return f"trim({expr}, {WS_LIST})"


def one_line(expr: str) -> str:
    return f"translate({expr}, chr(9) || chr(10) || chr(13), '   ')"


def _sub(expr: str, pattern: str, replacement: str) -> str:
    for n in "321":
        replacement = replacement.replace("$" + n, "\\" + n)
    return f"regexp_replace({expr}, {quote(pattern)}, {quote(replacement)}, 'g')"


# The rules of sentence splitting, stated here on their own: a wrong rule on one side shows in the check.
_GAP = r"[ \t\n\r\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Words that may open a sentence.
# The rules of sentence splitting, as patterns and replacements.
_OPENERS = (
    r"Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever"
).replace(r"\s", _GAP)
_BEFORE_RUNS = [
    (r"(Mr|St|Mrs|Ms|Dr)\.", "$1<prd>"),
    (r"\.(com|net|org|io|gov|edu|me)", "<prd>$1"),
    (r"([0-9])\.([0-9])", "$1<prd>$2"),
]
_AFTER_RUNS = [
    (_GAP + r"([A-Za-z])\. ", " $1<prd> "),
    (r"([A-Z]\.[A-Z]\.(?:[A-Z]\.)?) (" + _OPENERS + ")", "$1<stop> $2"),
    (r"([A-Za-z])\.([A-Za-z])\.([A-Za-z])\.", "$1<prd>$2<prd>$3<prd>"),
    (r"([A-Za-z])\.([A-Za-z])\.", "$1<prd>$2<prd>"),
    (r" (Inc|Ltd|Jr|Sr|Co)\. (" + _OPENERS + ")", " $1<stop> $2"),
    (r" (Inc|Ltd|Jr|Sr|Co)\.", " $1<prd>"),
    (r" ([A-Za-z])\.", " $1<prd>"),
]


def sentences(expr: str) -> str:
    work = f"replace(' ' || {expr} || '  ', chr(10), ' ')"
    for pattern, replacement in _BEFORE_RUNS:
        work = _sub(work, pattern, replacement)
    # Without look-around a private mark stands for a dot of a run.
    work = _sub(work, r"(\.{2,})", "$1<stop>")
    work = f"replace({work}, '..', chr(1) || chr(1))"
    work = f"replace({work}, chr(1) || '.', chr(1) || chr(1))"
    work = f"replace({work}, chr(1), '<prd>')"
    work = f"replace({work}, 'Ph.D.', 'Ph<prd>D<prd>')"
    for pattern, replacement in _AFTER_RUNS:
        work = _sub(work, pattern, replacement)
    for found, swapped in ((".”", "”."), ('."', '".'), ('!"', '"!'), ('?"', '"?')):
        work = f"replace({work}, {quote(found)}, {quote(swapped)})"
    for mark in ".?!":
        work = f"replace({work}, '{mark}', '{mark}<stop>')"
    work = f"replace({work}, '<prd>', '.')"
    return f"list_transform(string_split({work}, '<stop>'), lambda s: {strip('s')})"


def sentences_cte(source: str, key: str, text: str) -> str:
    """CTEs ``split_raw`` and ``split(key, arr)`` with the last empty piece removed."""
    return (
        f"split_raw AS (SELECT {key}, {sentences(text)} AS a FROM {source}), "
        f"split AS (SELECT {key}, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS arr FROM split_raw)"
    )


def groups_cte(key: str) -> str:
    """CTE ``groups(key, g, grp)`` from ``split``: a group starts at place 0 or at a letter."""
    return (
        f"lines AS (SELECT {key}, unnest(arr) AS s, unnest(range(0, len(arr))) AS i FROM split), "
        rf"marked AS (SELECT *, sum(CASE WHEN i = 0 OR regexp_matches(s, '^\p{{L}}') THEN 1 ELSE 0 END) "
        f"OVER (PARTITION BY {key} ORDER BY i) - 1 AS g FROM lines), "
        f"groups AS (SELECT {key}, g, string_agg(s, ' ' ORDER BY i) AS grp FROM marked GROUP BY {key}, g)"
    )


def tokens(expr: str, vocab: Vocabulary) -> str:
    return f"regexp_extract_all({quote(CLS)} || {expr} || {quote(SEP)}, {quote(vocab.pattern)}, 0)"


def vocab_list(vocab: Vocabulary) -> str:
    return "[" + ", ".join(quote(t) for t in vocab.tokens) + "]"


def vocab_map(vocab: Vocabulary) -> str:
    return f"map({vocab_list(vocab)}, range(0, {len(vocab.tokens)}))"


def covers(expr: str, vocab: Vocabulary) -> str:
    return (
        f"(length(array_to_string(regexp_extract_all({expr}, {quote(vocab.pattern)}, 0), '')) = length({expr}))"
    )


def betas(name: str, steps: int, start: float = 0.0001, end: float = 0.02) -> str:
    """A query for ``t, beta``."""
    n = steps

    def line(a: float, b: float, k: int) -> str:
        return f"({a!r}::DOUBLE + t * ({b!r}::DOUBLE - {a!r}::DOUBLE) / {max(k - 1, 1)})"

    def level(at: str) -> str:
        return f"pow(cos((({at}) / {float(n)!r} + 0.008) / 1.008 * pi() / 2), 2)"

    scale = 1000.0 / n
    expr = {
        "linear": line(scale * start, scale * end, n),
        "squaredcos_cap_v2": f"least(1 - {level('t + 1')} / {level('t')}, 0.999)",
        "quad": f"pow({line(start**0.5, end**0.5, n)}, 2)",
        "warmup10": f"CASE WHEN t < {n // 10} THEN {line(start, end, n // 10)} ELSE {end!r} END",
        "warmup50": f"CASE WHEN t < {n // 2} THEN {line(start, end, n // 2)} ELSE {end!r} END",
        "const": f"{end!r}::DOUBLE",
        "jsd": f"1.0::DOUBLE / ({n} - t)",
    }[name]
    return f"SELECT t, ({expr})::DOUBLE AS beta FROM (SELECT unnest(range(0, {n})) AS t)"


def coefs_cte(name: str, betas_sql: str) -> str:
    """CTE ``name`` with all coefficients from a query for ``t, beta``."""
    return (
        f"{name}_b AS ({betas_sql}), "
        f"{name}_ab AS (SELECT t, beta, product(1 - beta) OVER (ORDER BY t) AS ab FROM {name}_b), "
        f"{name}_p AS (SELECT *, coalesce(lag(ab) OVER (ORDER BY t), 1.0) AS abp, "
        f"coalesce(lead(ab) OVER (ORDER BY t), 0.0) AS abn FROM {name}_ab), "
        f"{name}_v AS (SELECT *, beta * (1 - abp) / (1 - ab) AS pv FROM {name}_p), "
        f"{name}_c AS (SELECT *, CASE WHEN t = 0 THEN lead(pv) OVER (ORDER BY t) ELSE pv END AS pvc FROM {name}_v), "
        f"{name} AS (SELECT t, beta, ab, abp, abn, pv, ln(pvc) AS plv, "
        "sqrt(ab) AS sab, sqrt(1 - ab) AS somab, ln(1 - ab) AS lomab, sqrt(1 / ab) AS rab, "
        "sqrt(1 / ab - 1) AS rm1, beta * sqrt(abp) / (1 - ab) AS c1, "
        "(1 - abp) * sqrt(1 - beta) / (1 - ab) AS c2, "
        f"CASE WHEN t = 0 THEN pvc ELSE beta END AS flv FROM {name}_c)"
    )


def respaced_betas(base: str, kept: list[int]) -> str:
    """A query for ``t, beta`` (and ``old_t``) of a respaced schedule over CTE ``base``."""
    return (
        "SELECT row_number() OVER (ORDER BY t) - 1 AS t, t AS old_t, "
        f"1 - ab / coalesce(lag(ab) OVER (ORDER BY t), 1.0) AS beta FROM {base} "
        f"WHERE t IN ({', '.join(map(str, kept))})"
    )
