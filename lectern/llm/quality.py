"""Problem 8: per-document text statistics and the kind of a text.

The statistics are built-in column expressions, so a scan of the documents
computes them inside the JVM.  The kind comes from an ordered rule list that is
induced from labelled documents by incremental reduced-error pruning: rules of
the rarest class first, each grown on two thirds of the labels that are left and
pruned on the rest.  The learned thresholds become one SQL ``CASE`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of English, French and Spanish.
COMMON_WORDS = (
    "a", "about", "after", "all", "although", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "between", "but", "by", "can", "did",
    "do", "each", "for", "from", "had", "has", "have", "he", "how", "however", "i", "if", "in", "is", "it", "its", "no", "not", "of", "on", "one", "only", "or",
    "our", "over", "she", "so", "some", "than", "that", "the", "their", "them", "then", "there", "they", "this", "through", "to", "two", "under", "was", "we",
    "were", "what", "when", "where", "which", "while", "who", "will", "with", "would", "you",
    "au", "aux", "avec", "ce", "ces", "cette", "dans", "de", "des", "du", "elle", "en", "entre", "est", "et", "il", "la", "le", "les", "leur", "mais", "ne",
    "nous", "ont", "ou", "par", "pas", "pour", "que", "qui", "sans", "se", "ses", "son", "sont", "sur", "un", "une",
    "al", "como", "con", "del", "el", "ella", "entre", "es", "esta", "este", "fue", "fueron", "ha", "las", "lo", "los", "más", "no", "para", "pero", "por",
    "se", "sin", "sobre", "son", "su", "sus", "una", "y",
)

#: Fixed value: Unicode white space, spelled out so that ASCII is tested first.
WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: The statistics that rules may test, in the order in which they are tried.
STATISTICS = (
    "common_share", "punct_line_share", "words_per_line", "list_mark_share", "separator_rate", "digit_ratio", "symbol_ratio", "mean_word_length", "long_word_share",
    "distinct_share", "distinct_line_share", "other_script_share", "single_share", "sentence_rate", "consonant_run_rate", "mixed_share", "comma_rate",
)


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns word_count, mean_word_length, symbol_ratio,
    punct_line_share, common_share and the further :data:`STATISTICS`.

    Null, empty and white-space texts have no words and zero everywhere.  Whole
    texts are measured.  Columns of ``df`` with these names are replaced;
    repeated rows are measured each.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    low = F.lower(t)
    work = df.withColumns({
        "__flat": F.trim(F.regexp_replace(t, WHITE, " ")),
        "__words": F.filter(F.split(t, WHITE), lambda w: w != ""),
        "__lines": F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(" \t\f\u00a0"))), lambda x: x != ""),
    })
    words, lines = F.col("__words"), F.col("__lines")
    # sizes come from the flat text; the arrays are made only if a rule asks for them
    flat, n_lines = F.col("__flat"), F.size(lines)
    dense = F.length(F.replace(flat, F.lit(" "), F.lit("")))
    count = F.when(flat == "", 0).otherwise(F.length(flat) - dense + 1)
    kept = lambda pattern: F.length(F.regexp_replace(flat, pattern, ""))
    digits = F.length(flat) - F.length(F.regexp_replace(flat, "[0-9]+", ""))
    separators = F.length(t) - F.length(F.regexp_replace(t, r"[\t|;]+", ""))
    values = {
        "word_count": count.cast("long"),
        "mean_word_length": _rate(dense, count),
        "symbol_ratio": _rate(kept(r"[a-zA-Z0-9 \p{L}\p{N}]+"), dense),
        "punct_line_share": _rate(F.size(F.filter(lines, lambda x: F.substring(x, -1, 1).isin(*".!?…:\"”»)"))), n_lines),
        "common_share": _rate(F.size(F.filter(F.split(low, r"[^a-z\p{L}\p{N}]+"), lambda w: w.isin(*sorted(set(COMMON_WORDS))))), count),
        "words_per_line": _rate(count, n_lines),
        "list_mark_share": _rate(F.size(F.filter(lines, lambda x: x.rlike(r"^(?:[-*•·–—+]|[\[(]?\d{1,3}[.)\]]|[a-z][.)])\s"))), n_lines),
        "separator_rate": _rate(separators, n_lines),
        "digit_ratio": _rate(digits, dense),
        "long_word_share": _rate(F.regexp_count(flat, F.lit("[^ ]{25,}+")), count),
        "distinct_share": _rate(F.size(F.array_distinct(words)), count),
        "distinct_line_share": _rate(F.size(F.array_distinct(lines)), n_lines),
        "other_script_share": _rate(kept(r"[\x00-\x7f]+"), dense),
        "single_share": _rate(F.size(F.filter(words, lambda w: F.length(w) == 1)), count),
        "sentence_rate": _rate(F.regexp_count(t, F.lit(r"[.!?](?=\s|$)")), count),
        "consonant_run_rate": _rate(F.regexp_count(low, F.lit(r"[bcdfghjklmnpqrstvwxz]{5,}")), count),
        "mixed_share": _rate(F.regexp_count(t, F.lit(r"[A-Za-z]\d|\d[A-Za-z]")), count),
        "comma_rate": _rate(F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))), n_lines),
    }
    return work.withColumns(values).drop("__flat", "__words", "__lines")


# --- rule induction ---------------------------------------------------------


@dataclass(frozen=True)
class Test:
    column: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def sql(self) -> str:
        return f"`{self.column}` {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    kind: str
    tests: tuple[Test, ...]

    def covers(self, table: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(table.values())))
        out = np.ones(n, dtype=bool)
        for t in self.tests:
            out &= t.holds(table[t.column])
        return out


def _cuts(values: np.ndarray, positive: np.ndarray):
    """Midpoints between neighbouring values of different classes, with the
    width of the gap as a share of the spread."""
    order = np.argsort(values, kind="stable")
    v, p = values[order], positive[order]
    spread = v[-1] - v[0] if len(v) else 0
    for i in np.nonzero(v[1:] > v[:-1])[0]:
        yield (v[i] + v[i + 1]) / 2, (v[i + 1] - v[i]) / spread


def _grow(table, positive, columns, kind) -> Rule:
    tests: list[Test] = []
    inside = np.ones(len(positive), dtype=bool)
    while (inside & ~positive).any() and len(tests) < 4:
        p0, n0 = (inside & positive).sum(), (inside & ~positive).sum()
        base = np.log2(p0 / (p0 + n0)) if p0 else 0
        best = None
        for c in columns:
            values = table[c]
            for threshold, gap in _cuts(values[inside], positive[inside]):
                for above in (True, False):
                    test = Test(c, above, float(threshold))
                    hit = inside & test.holds(values)
                    p, n = (hit & positive).sum(), (hit & ~positive).sum()
                    if not p or (p == p0 and n == n0):
                        continue
                    gain = p * (np.log2(p / (p + n)) - base)
                    # of equal gains the widest gap generalises best
                    rank = (round(float(gain), 6), gap)
                    if best is None or rank > best[0]:
                        best = (rank, test, hit)
        if best is None or best[0][0] <= 0:
            break
        tests.append(best[1])
        inside = best[2]
    return Rule(kind, tuple(tests))


def _prune(rule: Rule, table, positive) -> Rule:
    best, best_value = rule, -2.0
    for keep in range(len(rule.tests), 0, -1):
        short = Rule(rule.kind, rule.tests[:keep])
        hit = short.covers(table)
        p, n = (hit & positive).sum(), (hit & ~positive).sum()
        value = (p - n) / (p + n) if p + n else -1.0
        if value > best_value or (value == best_value and keep < len(best.tests)):
            best, best_value = short, value
    return best


def induce(table: dict[str, np.ndarray], labels: np.ndarray, columns=STATISTICS, default: str = "prose", seed: int = 0) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning.

    Classes other than ``default`` are learned from the rarest to the most
    frequent; the list ends where a pruned rule errs on more than half of the
    prune set or no example of the class is left.
    """
    random = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=object)
    left = np.ones(len(labels), dtype=bool)
    kinds = sorted({k for k in labels if k != default}, key=lambda k: ((labels == k).sum(), k))
    rules: list[Rule] = []
    for kind in kinds:
        while (left & (labels == kind)).any():
            at = np.nonzero(left)[0]
            part = np.zeros(len(at), dtype=bool)
            for cls in (True, False):
                of = np.nonzero((labels[at] == kind) == cls)[0]
                random.shuffle(of)
                part[of[: max(1, round(len(of) * 2 / 3))]] = True
            pick = lambda rows: {c: table[c][rows] for c in columns}
            grow, prune = at[part], at[~part]
            rule = _grow(pick(grow), labels[grow] == kind, columns, kind)
            if not rule.tests:
                break
            if len(prune):
                rule = _prune(rule, pick(prune), labels[prune] == kind)
            hit = rule.covers(table) & left
            judged = hit[prune] if (hit[prune].any()) else hit[at]
            truth = (labels[prune] if hit[prune].any() else labels[at])[judged] == kind
            if not (hit & (labels == kind)).any() or truth.mean() <= 0.5:
                break
            rules.append(rule)
            left &= ~hit
    return rules


def apply_rules(rules: list[Rule], table: dict[str, np.ndarray], default: str = "prose") -> np.ndarray:
    out = np.full(len(next(iter(table.values()))), default, dtype=object)
    free = np.ones(len(out), dtype=bool)
    for rule in rules:
        hit = rule.covers(table) & free
        out[hit] = rule.kind
        free &= ~hit
    return out


def best_rules(table: dict[str, np.ndarray], labels: np.ndarray, seeds: int = 25, columns=STATISTICS, default: str = "prose") -> list[Rule]:
    """The list of the random grow and prune divisions with the fewest errors on
    all labels, of those the one with the fewest tests."""
    found = []
    for seed in range(seeds):
        rules = induce(table, labels, columns, default, seed)
        wrong = int((apply_rules(rules, table, default) != labels).sum())
        found.append((wrong, sum(len(r.tests) for r in rules), seed, rules))
    return min(found, key=lambda x: x[:3])[3]


def case_expression(rules: list[Rule], default: str = "prose") -> str:
    """The rule list as one SQL expression over the statistics."""
    if not rules:
        return f"'{default}'"
    arms = " ".join(f"WHEN {' AND '.join(t.sql() for t in r.tests)} THEN '{r.kind}'" for r in rules)
    return f"CASE {arms} ELSE '{default}' END"


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "kind", bound: int = 1000) -> list[Rule]:
    """Rules from labelled documents, at most ``bound`` of them (those with the
    smallest keys); labels without a document or a kind teach nothing."""
    some = labels.where(F.col(kind).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(kind).alias("__kind")).orderBy(key).limit(bound)
    rows = statistics(documents.select(key, text).join(F.broadcast(some), key), text).select("__kind", *STATISTICS).toPandas()
    if rows.empty:
        return []
    return best_rules({c: rows[c].to_numpy(float) for c in STATISTICS}, rows["__kind"].to_numpy(object))


def classify(documents: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The statistics of each document and ``kind``; null, empty and white-space
    texts have a null kind."""
    blank = F.col("word_count") == 0
    return statistics(documents, text).withColumn("kind", F.when(~blank, F.expr(case_expression(rules))))
