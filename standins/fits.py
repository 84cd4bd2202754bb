"""SQL for logistic fits: Newton steps in a recursive query, many models at a time, and tails by continued fractions."""

from __future__ import annotations

from collections.abc import Sequence

#: Shuffled order of a row inside its class: the first 60 bits of md5 of seed and id.
ORDER = "substr(md5('42:' || doc_id), 1, 15), doc_id"

ROWS = r"""rows AS (SELECT doc_id, quality, ln(n_chars + 1.0) AS length, ln(len(string_split(text, chr(10))) + 1.0) AS lines,
  ln(length(regexp_replace(text, '[^0-9]', '', 'g')) + 1.0) AS digits FROM documents JOIN labels USING (doc_id))"""


def newton(features: Sequence[str], steps: int = 30) -> str:
    """CTE ``beta(step, model, b0, ...)`` from ``design(model, y, w, <features>)`` and ``models(model, lam)``.

    Each step solves (Hessian) d = gradient by elimination written out column by column.
    """
    q = len(features) + 1
    x = ["1.0", *features]
    betas = [f"b{i}" for i in range(q)]
    margin = " + ".join(f"{b} * {v}" for b, v in zip(betas, x))
    upper = [(i, j) for i in range(q) for j in range(i, q)]
    ridge = lambda i: f" + any_value(lam) * any_value(b{i})" if i else ""
    sums = [f"sum(w * (p - y) * {x[i]}){ridge(i)} AS r{i}" for i in range(q)]
    sums += [f"sum(w * p * (1 - p) * {x[i]} * {x[j]}){' + any_value(lam)' if i == j and i else ''} AS a{i}{j}" for i, j in upper]
    sql = f"""SELECT step, model, {', '.join(f'any_value({b}) AS {b}' for b in betas)}, {', '.join(sums)} FROM (
        SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM beta JOIN design USING (model) JOIN models USING (model) WHERE step < {steps})
        GROUP BY step, model"""
    for k in range(q):
        cells = [f"a{i}{j}" if i <= k else f"a{i}{j} - a{k}{i} / a{k}{k} * a{k}{j} AS a{i}{j}" for i, j in upper]
        right = [f"r{i}" if i <= k else f"r{i} - a{k}{i} / a{k}{k} * r{k} AS r{i}" for i in range(q)]
        sql = f"SELECT step, model, {', '.join(betas + cells + right)} FROM ({sql})"
    for i in reversed(range(q)):
        rest = "".join(f" - a{i}{j} * d{j}" for j in range(i + 1, q))
        sql = f"SELECT *, (r{i}{rest}) / a{i}{i} AS d{i} FROM ({sql})"
    return f"""beta AS (SELECT 0 AS step, model, {', '.join(f'0.0::DOUBLE AS {b}' for b in betas)} FROM models
      UNION ALL SELECT step + 1, model, {', '.join(f'{b} - d{i}' for i, b in enumerate(betas))} FROM ({sql})),
    fitted AS (SELECT * FROM beta WHERE step = {steps})"""


def probability(features: Sequence[str]) -> str:
    return "1 / (1 + exp(-(b0" + "".join(f" + b{i + 1} * {f}" for i, f in enumerate(features)) + ")))"


def ranked(scored: str, by: str) -> str:
    """CTE ``areas``: ROC area and average precision of ``p`` against ``y`` in ``scored``."""
    return f"""cuts AS (SELECT {by}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {scored} GROUP BY ALL),
    run AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM cuts WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)),
    areas AS (SELECT {by}, sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc,
      sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision FROM run GROUP BY {by})"""


def chi2_tail(x: str) -> str:
    """erfc(sqrt(x / 2)): a continued fraction from its far end, or a series of positive terms."""
    z = f"sqrt(greatest({x}, 0.0) / 2)"
    far = f"list_reduce(list_concat([{z}], list_transform(range(400, 0, -1), lambda k: k::DOUBLE)), lambda t, k: {z} + k / 2 / t)"
    near = f"""list_sum(list_transform(range(0, 80), lambda n: exp((2 * n + 1) * ln(greatest({z}, 1e-300)) + n * ln(2.0)
        - (lgamma(2.0 * n + 2) - n * ln(2.0) - lgamma(n + 1.0)))))"""
    return f"CASE WHEN {z} < 2 THEN 1 - 2 * exp(-({z} * {z})) / sqrt(pi()) * {near} ELSE exp(-({z} * {z})) / sqrt(pi()) / {far} END"


def t_tail(t: str, df: str) -> str:
    """Two-sided p-value: the incomplete beta function at df / (df + t * t)."""
    a, x, rest = f"({df} / 2)", f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))"

    def fraction(a: str, b: str, x: str) -> str:
        odd = f"-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))"
        even = f"m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))"
        parts = f"""list_transform(range(800, 0, -1), lambda k: list_transform([(k // 2)::DOUBLE],
            lambda m: CASE WHEN k % 2 = 1 THEN {odd} ELSE {even} END)[1])"""
        return f"(1 / list_reduce(list_concat([1.0::DOUBLE], {parts}), lambda t, part: 1 + part / t))"
    front = f"exp(lgamma({a} + 0.5) - lgamma({a}) - lgamma(0.5) + {a} * ln({x}) + ln({rest}) / 2)"
    return f"""CASE WHEN {x} < ({a} + 1) / ({a} + 2.5) THEN {front} * {fraction(a, '0.5', x)} / {a}
        ELSE 1 - {front} * {fraction('0.5', a, rest)} / 0.5 END"""
