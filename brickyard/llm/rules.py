"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document: the ledger keeps the
measurements and one integer whose bits say which rules failed. Policies are
versioned masks over those bits, so a new policy, or the effect of leaving a
rule out, needs the ledger alone and never the texts again. All of it is
built-in SQL functions; nothing is shuffled to make the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh

WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: SQL over the measurements; True fails. A rule's bit is its place and never changes; new rules are added at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
}


@dataclass(frozen=True)
class Policy:
    """A document passes version ``version`` if none of ``rules`` failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("2", tuple(RULES)))}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of three words which the text has at least twice.

    Windows are sorted by a 64-bit hash and their place; a text in which two
    windows of one hash differ is counted again by the windows themselves.
    """

    def window(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p")))

    def spelt(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(window(w, i).alias("g"), i.alias("p")))

    def places(s: Column) -> Column:
        same = lambda x, k: F.get(s, k)["g"] == x["g"]
        twice = F.filter(s, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def differ(w: Column, s: Column) -> Column:
        clash = lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) & (window(w, F.get(s, k - 1)["p"]) != window(w, x["p"]))
        return F.exists(F.transform(s, lambda x, k: F.coalesce(clash(x, k), F.lit(False))), lambda x: x)

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3)))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        exact = _let(F.sort_array(spelt(w)), lambda s: _let(places(s), covered))
        return _let(F.sort_array(hashed(w)), lambda s: F.when(differ(w, s), exact).otherwise(_let(places(s), covered)))

    return F.when(F.size(words) >= 4, count(words)).otherwise(F.lit(0).cast("long"))


def _measured(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(text, WHITE + "+"), "")
    by_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    by_lines = _let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return F.struct(by_words.alias("w"), by_lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))


def ledger(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds the measurements and ``failed_bits`` (bit k: the k-th of RULES failed).

    A null or empty text has zero of everything, and so fails ``few_words``
    alone. Columns of ``docs`` that bear a measurement's name are replaced;
    all others, and repeated rows, stay.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    kept = [c for c in docs.columns if c.lower() not in {*names, "failed_bits"}]
    (m,) = fresh(docs.columns, "_m")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    measured = docs.withColumn(m, _measured(text)).select(
        *(F.col(f"`{c}`") for c in kept), f"{m}.w.n_words", f"{m}.w.word_chars", f"{m}.n_symbols", f"{m}.l.n_lines", f"{m}.l.n_dup_lines", f"{m}.w.n_repeat_words"
    )
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_bits", total)


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes ``policy``."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy, bits: str = "failed_bits") -> DataFrame:
    """For each rule of ``policy``: documents it fails, those it alone fails, and those kept without it.

    Rows are first counted by their bits, of which there are at most
    2 ** len(RULES), so the ledger is read once and shuffles a few rows.
    Columns: version, rule, n_failed, n_only, n_kept_without (long). An empty
    ledger gives zeros.
    """
    counts = rows.groupBy(F.col(bits).bitwiseAND(F.lit(policy.mask)).alias("b")).count()
    sums = []
    for k, rule in enumerate(RULES):
        if rule in policy.rules:
            bit = F.lit(1 << k)
            rest = F.lit(policy.mask & ~(1 << k))
            of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
            own = F.struct(F.lit(rule).alias("rule"), of(F.col("b").bitwiseAND(bit) != 0).alias("n_failed"), of(F.col("b") == bit).alias("n_only"), of(F.col("b").bitwiseAND(rest) == 0).alias("n_kept_without"))
            sums.append(own)
    return counts.agg(F.array(*sums).alias("r")).select(F.lit(policy.version).alias("version"), F.inline("r"))
