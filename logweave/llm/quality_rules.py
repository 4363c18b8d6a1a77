"""Quality rules by weak supervision: rules vote or abstain, and the posterior of all votes decides.

Base limits come first (too few words, too much repetition). What passes is voted on by rules; their
accuracies come from expectation maximisation over the whole corpus's vote patterns (`weak_labels`), and a text stays if its
posterior chance of being good is at least `keep_at`. No rule alone rejects a text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import durable, map_rows, texts
from logweave.llm.text_stats import Stats, measure
from logweave.llm.weak_labels import VoterModel, fit, pattern_counts, posteriors

#: Fixed values of the base limits.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
KEEP_AT = 0.5


def vote(good: bool, bad: bool) -> str:
    return "-" if bad else "+" if good else "0"


def rule_votes(s: Stats) -> str:
    """One character a rule: '+', '-' or '0'. Rules on repetition abstain on short texts."""
    n, chars = max(s.n_words, 1), max(s.n_chars, 1)
    return "".join(
        (
            vote(s.n_symbols * 20 < n, s.n_symbols * 4 > n),
            vote(s.n_symbols * 200 < chars, s.n_symbols * 30 > chars),
            vote(s.n_symbol_words * 20 < n, s.n_symbol_words * 4 > n),
            vote(s.n_shouted * 50 < n, s.n_shouted * 8 > n),
            vote(s.n_upper * 10 < n, s.n_upper * 3 > n),
            vote(n >= 30 and s.n_repeat_words * 10 < n, n >= 30 and s.n_repeat_words * 100 > 30 * n),
            vote(s.n_same_next * 20 < n, n >= 10 and s.n_same_next * 4 > n),
            vote(n >= 30 and s.n_distinct * 3 > n, n >= 60 and s.n_distinct * 5 < n),
            vote(s.n_lines > 2 and s.n_dup_lines == 0, s.n_lines > 3 and s.n_dup_lines * 10 > 3 * s.n_lines),
        )
    )


VOTERS = 9


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def rows(source):
        for doc_id, text in source:
            s = measure(text)
            failed = s.n_words < LEAST_WORDS or 100 * s.n_repeat_words > MOST_REPEATED_PERCENT * s.n_words
            yield doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, rule_votes(s)

    return map_rows(texts(docs, id_col, text_col), rows, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, votes string")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> tuple[DataFrame, VoterModel]:
    """One row for each row of docs: the measures, votes, posterior and `kept`; and the fitted model.

    A null or empty text has no words and fails the base limits; repeated rows are judged each; other columns are not
    read. The measures are written once to the shared folder: texts are read a single time.
    """
    rows = durable(measured(docs, id_col, text_col))
    counts = pattern_counts(rows.where(~F.col("base_failed")))
    model = fit(counts, VOTERS)
    chance = posteriors(counts, model)
    if chance:  # at most 3 ** VOTERS rows
        table = rows.sparkSession.createDataFrame(sorted(chance.items()), "votes string, posterior double")
        rows = rows.join(F.broadcast(table), "votes", "left")
    else:
        rows = rows.withColumn("posterior", F.lit(None).cast("double"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= keep_at)), model
