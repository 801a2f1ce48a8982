"""Weakly supervised quality filtering, on DataFrame functions only.

Each rule votes (for good or for bad, as it looks for sound prose or for a defect) or abstains. Expectation-maximisation
estimates from the vote patterns alone how often every rule votes on good and on bad documents, and the share of good
ones; a document is kept if its posterior probability of being good is at least one half. The patterns are counted over
all documents, and the estimate works on those counts, of which there are at most two to the number of rules.
Abstaining is evidence too: a rule for defects finds only its own kind, so a lone vote must be able to decide.

Defined edge results: a null text counts as empty, has no words and fails the base; words of repeated 3-word windows are
compared by a 64-bit hash of the three words; a text of any length is counted whole; a posterior of exactly one half is
kept; null ids keep their rows; repeated rows are judged alike and counted each; extra columns are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\f\r"
#: The characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"


def _runs(col: Column) -> Column:
    """The words: maximal runs of characters other than ASCII white space."""
    plain = F.translate(col, SPACE[1:], " " * 5)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and counts. One scan, no shuffle."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    words = base.select("id", "t", _runs(F.col("t")).alias("w"))
    n = F.size("w").cast("long")
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    hashed = words.select(
        "id",
        "t",
        n.alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    tri = F.zip_with(
        F.zip_with("h", F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))),
        F.slice("h", 3, F.greatest(F.size("h"), F.lit(1))),
        lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)),
    )
    windows = hashed.select(
        "id",
        "n_words",
        "word_chars",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("t", F.lit("[.!?]")).cast("long").alias("n_stops"),
        F.slice(tri, F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))).alias("tri"),
    )
    return windows.withColumn("n_repeat_words", _covered(F.col("tri"))).drop("tri")


def _covered(tri: Column) -> Column:
    """Words in windows of three whose hash occurs at least twice.

    Window hashes are sorted with their places; equal neighbours mark places; sorted places p cover
    min(3, next p - p) words each and the last one covers 3.
    """
    ordered = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    size = F.size("tri")

    def marks(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, size - 1))
        after = F.slice(s, 2, size)
        pairs = F.zip_with(before, s, lambda b, x: F.struct(x["i"].alias("i"), F.coalesce(b["h"] == x["h"], F.lit(False)).alias("b"), x["h"].alias("h")))
        both = F.zip_with(pairs, after, lambda x, a: F.when(x["b"] | F.coalesce(a["h"] == x["h"], F.lit(False)), x["i"]))
        return F.sort_array(F.array_compact(both))

    def span(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    heavy = F.element_at(F.transform(F.array(ordered), lambda s: F.element_at(F.transform(F.array(marks(s)), span), 1)), 1)
    return F.when(F.size(F.array_distinct("tri")) == size, F.lit(0).cast("long")).otherwise(heavy)


#: What a rule's vote starts from: the chances of voting, on good and on bad documents, for a rule that looks for a
#: defect and for one that looks for sound prose. Both are smoothed towards this by SMOOTH documents of each class.
DEFECT, SOUND = (0.02, 0.3), (0.9, 0.5)
SMOOTH = 20.0


def default_rules() -> dict[str, tuple[int, Column]]:
    """Rule name -> (its vote: 1 good or -1 bad, when it votes); otherwise it abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.col("word_chars"), F.lit(1))
    symbols, repeat = F.col("n_symbols") / n, F.col("n_repeat_words") / n
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    mean, upper = F.col("word_chars") / n, F.col("n_upper") / letters
    digits, stops = F.col("n_digits") / letters, F.col("n_stops") / n
    return {
        "symbols_per_word": (-1, symbols > 0.25),
        "symbols_per_char": (-1, F.col("n_symbols") / letters > 0.04),
        "repeats": (-1, repeat > 0.4),
        "dup_lines": (-1, dup > 0.5),
        "case": (-1, upper > 0.4),
        "shouting": (-1, (stops > 0.7) & (upper > 0.2)),
        "digits": (-1, digits > 0.25),
        "word_length": (-1, (mean < 2.2) | (mean > 12.0)),
        "prose": (1, (symbols < 0.05) & (upper < 0.15) & (stops <= 0.4)),
        "varied": (1, repeat < 0.3),
        "distinct_lines": (1, dup < 0.3),
    }


def vote(rules: dict[str, tuple[int, Column]]) -> dict[str, Column]:
    return {f"v_{k}": F.when(when, F.lit(way)).otherwise(F.lit(0)) for k, (way, when) in rules.items()}


def estimate(patterns: list[tuple[tuple[int, ...], int]], ways: list[int], rounds: int = 100) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over counted vote patterns.

    Returns the share of good documents, and per rule the chances that it votes on a good and on a bad document. A
    rule can't vote against the sense of its vote: one for defects votes at least as often on bad documents, one for
    sound prose at least as often on good ones, so the meaning of the classes can't turn over.
    """
    begin = [SOUND if w > 0 else DEFECT for w in ways]
    prior, chance = 0.9, list(begin)
    for _ in range(rounds):
        good_n = total = 0.0
        hits = [[0.0, 0.0] for _ in ways]
        for votes, n in patterns:
            p = posterior(votes, prior, chance)
            good_n, total = good_n + p * n, total + n
            for h, v in zip(hits, votes, strict=True):
                if v:
                    h[0] += p * n
                    h[1] += (1 - p) * n
        if not total:
            break
        prior = min(0.99, max(0.01, good_n / total))
        chance = []
        for w, h, s in zip(ways, hits, begin, strict=True):
            good = (h[0] + SMOOTH * s[0]) / (good_n + SMOOTH)
            bad = (h[1] + SMOOTH * s[1]) / (total - good_n + SMOOTH)
            chance.append((max(good, bad), bad) if w > 0 else (good, max(good, bad)))
    return prior, chance


def posterior(votes: tuple[int, ...], prior: float, chance: list[tuple[float, float]]) -> float:
    """Probability of being good."""
    logit = math.log(prior / (1 - prior)) + sum(weight(v, c) for v, c in zip(votes, chance, strict=True))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, logit))))


def weight(v: int, chance: tuple[float, float]) -> float:
    """Log-likelihood ratio of good to bad, of a vote (v not 0) or of abstaining."""
    good, bad = (min(1 - 1e-9, max(1e-9, c)) for c in chance)
    return math.log(good / bad) if v else math.log((1 - good) / (1 - bad))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict | None = None, keep_at: float = 0.5) -> DataFrame:
    """One row per document: id, counts, votes and ``quality`` (posterior probability of being good), ``kept``."""
    rules = rules or default_rules()
    votes = vote(rules)
    table = materialize(features(docs, id_col, text_col).select("*", *[v.cast("byte").alias(k) for k, v in votes.items()]))
    counted = table.groupBy(*votes).count().collect()  # at most 2 ** rules rows
    prior, chance = estimate(sorted((tuple(int(x) for x in r[:-1]), r[-1]) for r in counted), [w for w, _ in rules.values()])
    logit = F.lit(math.log(prior / (1 - prior)))
    for name, c in zip(votes, chance, strict=True):
        logit = logit + F.when(F.col(name) != 0, F.lit(weight(1, c))).otherwise(F.lit(weight(0, c)))
    quality = 1 / (1 + F.exp(-logit))
    return table.withColumn("quality", quality).withColumn("kept", F.col("quality") >= keep_at)


def op9_query(spark, sf_dir: str) -> DataFrame:
    got = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (F.col("kept") & ~failed).alias("kept"),
        "quality",
    )
