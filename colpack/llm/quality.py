"""Quality rules as weak supervision (operator 2), in DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0).  Expectation-maximisation over the counts of vote
patterns, at most three to the number of rules whatever the corpus, estimates how accurate each
rule's good and bad votes are, and the share of good documents; a document is kept if the posterior
probability that it is good is at least one half, so one weak bad vote does not condemn it.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colpack.llm.common import materialize

SPACE = " \t\n\r\x0b\x0c"
MIN_WORDS = 50
ROUNDS = 100
#: Share of either class at least: nothing is certain.
LEAST = 0.05
#: Accuracy that a vote is believed to have before votes are compared, and how many documents that belief counts for.
BEFOREHAND, STRENGTH = 0.8, 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper")


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """name -> vote, over the measures of a document."""
    word, symbols, dup = _ratio("word_chars", "n_words"), _ratio("n_symbols", "n_words"), _ratio("n_dup_lines", "n_lines")
    repeat, upper, ended = _ratio("n_repeat_words", "n_words"), _ratio("n_upper", "word_chars"), _ratio("n_ended_lines", "n_lines")
    marks = _ratio("n_symbols", "word_chars")
    return {
        "length": _vote(F.col("n_words") >= 2 * MIN_WORDS, F.col("n_words") < 10),
        "word_length": _vote(word.between(3, 10), (word < 3) | (word > 10)),
        "symbols": _vote(symbols <= 0.01, symbols > 0.1),
        "marks": _vote(marks <= 0.01, marks > 0.05),
        "dup_lines": _vote(dup <= 0.05, dup > 0.3),
        "repeats": _vote(repeat <= 0.1, repeat > 0.3),
        "upper_case": _vote(upper <= 0.1, upper > 0.3),
        "open_lines": _vote(ended >= 0.95, ended < 0.9),
    }


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the columns of MEASURES, of which a null text has none.

    Equal three-word windows are found by sorting their hashes with the position in the low bits,
    so that neighbours with equal high bits are compared in full: no explosion and no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    df = df.withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)))
    df = df.withColumn("__n", F.size("__words"))
    window = lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))
    df = df.withColumn("__hashes", F.when(F.col("__n") > 2, F.transform(F.sequence(F.lit(0), F.col("__n") - 3), window)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__bits", F.length(F.bin(F.col("__n").cast("bigint"))))
    df = df.withColumn("__high", F.expr("shiftleft(-1L, __bits)"))
    df = df.withColumn("__sorted", F.sort_array(F.transform("__hashes", lambda h, i: h.bitwiseAND(F.col("__high")).bitwiseOR(i.cast("bigint")))))

    def same(x: Column, y: Column) -> Column:
        place = lambda z: z.bitwiseAND(F.bitwise_not(F.col("__high"))).cast("int")
        return (x.bitwiseAND(F.col("__high")) == y.bitwiseAND(F.col("__high"))) & (F.get("__hashes", place(x)) == F.get("__hashes", place(y)))

    again = F.filter("__sorted", lambda x, i: F.coalesce(same(x, F.get("__sorted", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("__sorted", i + 1)), F.lit(False)))
    places = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.bitwise_not(F.col("__high")))))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    cover = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    size = lambda c: F.size(c).cast("bigint")
    return df.select(
        *[c for c in df.columns if not c.startswith("__")],
        F.col("__n").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "__words")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (size("__lines") - size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        F.aggregate(places, start, cover, lambda acc: acc["n"]).alias("n_repeat_words"),
        size("__lines").alias("n_lines"),
        size(F.filter("__lines", lambda line: line.rlike(r"[.!?:\"'][\x20\x09-\x0D]*$"))).alias("n_ended_lines"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("bigint").alias("n_upper"),
    )


def fit(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """(share of good, for each rule the evidence of a good and of a bad vote) by expectation-maximisation.

    A vote's accuracy is the share of its documents that are of the class it names, with STRENGTH documents
    added beforehand of which BEFOREHAND are, so a rule that others contradict loses its weight and may
    even count the other way.  Evidence is the log odds of the accuracy against those of the class as
    such.  The start is each document's majority; should the votes all in all end as evidence of the
    other class, the classes have changed names and are changed back.  Without rows the evidence is zero.
    """
    total = sum(patterns.values())
    if not total:
        return 0.5, [(0.0, 0.0)] * len(rules())
    rows = sorted(patterns.items())
    good = {votes: (1 + votes.count(1)) / (2 + votes.count(1) + votes.count(-1)) for votes in patterns}
    odds = lambda p: math.log(p / (1 - p))
    share, evidence = 0.5, []
    for _ in range(rounds):
        share = min(1 - LEAST, max(LEAST, sum(n * good[v] for v, n in rows) / total))
        was, evidence = evidence, []
        for j in range(len(rows[0][0])):
            told = []
            for vote, base in ((1, share), (-1, 1 - share)):
                cast = sum(n for v, n in rows if v[j] == vote)
                right = sum(n * (good[v] if vote > 0 else 1 - good[v]) for v, n in rows if v[j] == vote)
                told.append(vote * (odds((right + BEFOREHAND * STRENGTH) / (cast + STRENGTH)) - odds(base)))
            evidence.append(tuple(told))
        good = {votes: posterior(votes, share, evidence) for votes in patterns}
        if was and max(abs(x - y) for a, b in zip(was, evidence) for x, y in zip(a, b)) < 1e-9:
            break
    if sum(x - y for x, y in evidence) < 0:
        return 1 - share, [(-x, -y) for x, y in evidence]
    return share, evidence


def posterior(votes: tuple[int, ...], share: float, evidence: list[tuple[float, float]]) -> float:
    """Probability that a document with these votes is good."""
    z = math.log(share / (1 - share)) + sum(e[0] if v > 0 else e[1] for v, e in zip(votes, evidence) if v)
    return 1 / (1 + math.exp(-z))


def judged(df: DataFrame) -> DataFrame:
    """df, which has the measures and is cheap to read twice, with posterior, base_failed and kept."""
    votes = rules()
    counted = df.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).agg(F.count("*").alias("n"))
    # at most 3 ** rules rows, whatever the corpus
    patterns = {tuple(row)[:-1]: row["n"] for row in counted.collect()}
    share, evidence = fit(patterns)
    z = F.lit(math.log(share / (1 - share)))
    for vote, (good, bad) in zip(votes.values(), evidence):
        z = z + F.when(vote > 0, good).when(vote < 0, bad).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("posterior", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the measures, base_failed, kept, posterior) of every row of df.

    A null or empty text has no words, so it fails.  Repeated rows and null ids stay rows of their own;
    an empty table gives no row; other columns are not read.  The measures are computed once and written
    without the texts; the fit sees them all.
    """
    rows = materialize(measured(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))).drop("text"), "measures")
    return judged(rows).select(F.col("id").alias(id_col), *MEASURES[:5], "base_failed", "kept", "posterior")


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that are kept, with df's own columns, which may have any names."""
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(measured(packed).drop("text"), "measured")
    return judged(rows).where("kept").select("own.*")
