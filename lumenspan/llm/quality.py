"""Quality of texts by weak supervision, in DataFrame expressions only.

Rules look at counts of a text and vote that it is good, vote that it is bad, or
abstain. How far each rule can be trusted isn't given: expectation-maximisation
estimates how many texts are good and, for every rule, how often it votes good, votes
bad and abstains on good texts and on bad ones, from how the rules agree and differ.
Abstaining is an outcome like the votes, so that a rule that only ever votes bad or
abstains tells something by either. A text's posterior probability of being good then
replaces the demand that it pass all rules.

The texts are read once, into a table of counts and votes. EM sees only how often each
pattern of votes occurs, at most 3 ** rules rows however many texts there are, and
each of its steps is one aggregation of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, materialise, words

#: Words in a window, and how often it must be found, to count as repeated.
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Most steps of EM, and the change of its numbers below which it has settled.
STEPS, SETTLED = 60, 1e-3
#: What EM starts from: the share of good texts, and how often a rule votes good and bad on good texts and on bad ones.
SHARE_GOOD, ON_GOOD, ON_BAD = 0.8, (0.6, 0.05), (0.2, 0.5)
#: Texts of each class and outcome that are imagined besides those seen, so that no estimate is 0.
IMAGINED = 0.5


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` holds, and else abstains; both are SQL over the counts."""

    name: str
    good: str
    bad: str


NEVER = "false"
# That a text lacks one defect says little for it: most rules vote bad or abstain.
RULES = (
    Rule("symbols", "n_symbols * 100 < n_words", "n_symbols * 10 > n_words"),
    Rule("plain_words", "n_plain * 10 >= 9 * n_words", "n_plain * 10 < 6 * n_words"),
    Rule("marks", "n_marks * 4 < n_words AND n_marks * 60 > n_words", "n_marks * 10 > 6 * n_words"),
    Rule("doubled_signs", NEVER, "n_doubled * 20 > n_words"),
    Rule("capitals", NEVER, "n_capitals * 10 > 3 * word_chars"),
    Rule("word_length", NEVER, "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("lines", NEVER, "n_dup_lines * 10 > 3 * n_lines"),
    Rule("repeats", NEVER, "n_repeat_words * 10 > n_words"),
    Rule("stutter", NEVER, "n_again * 5 > n_words"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(hashes: Column) -> Column:
    """How many words stand in windows that are found twice or more, the first included.

    Windows are known by a 64-bit hash of their words' hashes, sorted next to equal ones.
    """
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(hashes[i + k] for k in range(WINDOW))))
    return F.when(n > WINDOW, windows)


def _covered(windows: Column) -> Column:
    sorted_ = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), sorted_)


def counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, counts) for docs(doc_id, text): the numbers that rules look at, one row per row. A null text is an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(key).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        words(F.col("text")).alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[.,;:!?]")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit(r"([#*$%&|<>!?])\1")).cast("long").alias("n_doubled"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:!?]?(?![^\x20\x09-\x0D])")).cast("long").alias("n_plain"),
    )
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("windows", repeat_words(F.col("hashes")))
    rows = rows.withColumn("sorted", _covered(F.col("windows")))
    h = lambda k: F.get(F.col("sorted"), k)["h"]
    again = lambda k: F.coalesce(h(k) == h(k - 1), F.lit(False)) | F.coalesce(h(k) == h(k + 1), F.lit(False))
    places = F.transform(F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), again), lambda k: F.get(F.col("sorted"), k)["i"])
    rows = rows.withColumn("places", F.when(F.col("sorted").isNotNull(), F.sort_array(places)))
    following = lambda p, k: F.least(F.coalesce(F.get(F.col("places"), k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
    covered = F.aggregate(F.transform("places", following), F.lit(0), lambda s, x: s + x)
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter(F.transform("hashes", lambda h, i: F.coalesce(h == F.get(F.col("hashes"), i - 1), F.lit(False))), lambda x: x)).cast("long").alias("n_again"),
        "n_capitals",
        "n_marks",
        "n_doubled",
        "n_plain",
    )


def vote(rule: Rule) -> Column:
    """1 for good, 0 for bad, null where the rule abstains."""
    return F.when(F.expr(rule.good), 1).when(F.expr(rule.bad), 0).cast("tinyint")


@dataclass
class Trust:
    """Share of good texts, and for each rule how often it votes good and votes bad (abstaining is the rest) on good texts and on bad ones."""

    share: float
    good: list[tuple[float, float]]
    bad: list[tuple[float, float]]

    def numbers(self) -> list[float]:
        return [self.share, *(x for pair in self.good + self.bad for x in pair)]

    def posterior(self) -> Column:
        """Probability that a text with the votes v0, v1, ... is good."""
        odds = F.lit(log(self.share) - log(1 - self.share))
        for i, (g, b) in enumerate(zip(self.good, self.bad, strict=True)):
            up, down, none = (F.lit(log(x) - log(y)) for x, y in zip((*g, 1 - sum(g)), (*b, 1 - sum(b)), strict=True))
            odds = odds + F.when(F.col(f"v{i}") == 1, up).when(F.col(f"v{i}") == 0, down).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def _rates(up: float, down: float, of: float) -> tuple[float, float]:
    """How often a rule votes good and bad, given how many of so many texts it did so on."""
    return (up + IMAGINED) / (of + 3 * IMAGINED), (down + IMAGINED) / (of + 3 * IMAGINED)


def _no_worse_than_chance(seen: list[float], n_good: float, n_bad: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """A rule's rates on good texts and on bad ones, from (good, bad) votes on good texts and (good, bad) votes on bad ones.

    A rule is taken to vote good no less often on good texts than on bad ones, and bad no
    less often on bad ones. The likeliest rates under that are the plain ones where they
    keep it, and where they don't, one rate for both, which makes the vote tell nothing.
    """
    (up, down), (up_bad, down_bad) = _rates(*seen[:2], n_good), _rates(*seen[2:], n_bad)
    both = _rates(seen[0] + seen[2], seen[1] + seen[3], n_good + n_bad)
    if up < up_bad:
        up = up_bad = both[0]
    if down_bad < down:
        down = down_bad = both[1]
    return (up, down), (up_bad, down_bad)


def estimate(votes: DataFrame, rules: tuple[Rule, ...] = RULES, steps: int = STEPS) -> Trust:
    """EM over the votes v0, v1, ... of all texts. Without texts it is what EM starts from."""
    names = [f"v{i}" for i in range(len(rules))]
    patterns = materialise(votes.groupBy(*names).agg(F.count("*").alias("n")), "patterns").coalesce(1)
    start = lambda up, down, rule: (up if rule.good != NEVER else 1e-3, down)
    trust = Trust(SHARE_GOOD, [start(*ON_GOOD, r) for r in rules], [start(*ON_BAD, r) for r in rules])
    for _ in range(steps):
        good, bad = F.col("good"), F.col("n") - F.col("good")
        sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
        for i, name in enumerate(names):
            for side, of in (("g", good), ("b", bad)):
                sums += [F.sum(F.when(F.col(name) == k, of).otherwise(0.0)).alias(f"{side}{i}_{k}") for k in (1, 0)]
        found = patterns.withColumn("good", F.col("n") * trust.posterior()).agg(*sums).first()
        if not found["n"]:
            break
        n, g = float(found["n"]), found["good"]
        pairs = [_no_worse_than_chance([found[f"{side}{i}_{k}"] for side in "gb" for k in (1, 0)], g, n - g) for i in range(len(rules))]
        last, trust = trust, Trust((g + IMAGINED) / (n + 2 * IMAGINED), [x for x, _ in pairs], [x for _, x in pairs])
        if max(abs(x - y) for x, y in zip(last.numbers(), trust.numbers(), strict=True)) < SETTLED:
            break
    return trust


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, counts, base_failed, posterior, kept) for every row of docs(doc_id, text).

    base_failed: under 10 words, or more than a fifth of them in repeated windows. kept:
    not failed, and more likely good than bad. A null or blank text has no words and
    fails. Null ids and repeated rows are judged like others; further columns are not read.
    """
    table = materialise(counts(docs).select("*", *(vote(r).alias(f"v{i}") for i, r in enumerate(rules))), "votes")
    posterior = estimate(table, rules).posterior()
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return table.select("doc_id", *COUNTS, failed.alias("base_failed"), posterior.alias("posterior"), (~failed & (posterior >= 0.5)).alias("kept"))
