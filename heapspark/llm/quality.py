"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, materialize, slices, text_hash

_SYMBOLS = "#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words", "n_mark_words"]
_COUNT_TYPES = ", ".join(f"{c} long" for c in _COUNTS)
_MARKS = string.punctuation.encode()


def _repeated(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a width-word window found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for i in range(width):  # 64-bit hash of each window; a chance collision in one text has odds below 1e-9
        w = (w ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        w ^= w >> np.uint64(29)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """_COUNTS of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line and line.encode("utf-8", "surrogatepass").split():
            dup += line in seen
            seen.add(line)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, _SYMBOLS))
    upper = sum(map(bytes.isupper, words))
    marks = len(words) - len(raw.translate(None, _MARKS).split())  # words of punctuation alone
    return len(words), len(text) - spaces, symbols, dup, _repeated(words), len(lines), upper, len(set(words)), marks


def _measures(text: pa.Array) -> pa.Array:
    rows = [measure(t or "") for part in slices([pa.RecordBatch.from_arrays([text], names=["text"])]) for t in part.column(0).to_pylist()]
    cols = list(zip(*rows)) or [[]] * len(_COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_COUNTS)


def counts_of(text: Column) -> Column:
    """A struct of _COUNTS of the whole text; null text has no words."""

    @F.arrow_udf(f"struct<{_COUNT_TYPES.replace(' long', ': long')}>")
    def count(text: pa.Array) -> pa.Array:
        return _measures(text)

    return count.asNondeterministic()(text)  # keeps the optimiser from measuring once for each use


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, *_COUNTS) of whole texts.  No shuffle."""
    return docs.select("doc_id", text_hash().alias("text_hash"), counts_of(F.col("text")).alias("counts")).select("doc_id", "text_hash", "counts.*")


@dataclass(frozen=True)
class Rule:
    """bad and good are SQL conditions over _COUNTS; where neither holds, the rule abstains."""

    name: str
    bad: str = "false"
    good: str = "false"


#: Signs of junk, each silent about anything else, and signs of prose.
RULES = (
    Rule("length", bad="n_words < 10"),
    Rule("repetition", bad="100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", bad="n_words > 0 and 100 * n_symbols > 4 * word_chars"),
    Rule("duplicate_lines", bad="n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", bad="n_words > 0 and 100 * n_upper_words > 40 * n_words"),
    Rule("word_length", bad="n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    Rule("variety", bad="n_words >= 40 and 100 * n_distinct_words < 15 * n_words"),
    Rule("marks", bad="n_words > 0 and 100 * n_mark_words > 10 * n_words"),
    Rule("prose", good="n_words >= 30 and 100 * n_symbols <= word_chars and 100 * n_upper_words <= 15 * n_words and 100 * n_mark_words <= 3 * n_words"),
    Rule("fresh", good="n_words >= 10 and 100 * n_repeat_words <= 5 * n_words and 100 * n_dup_lines <= 10 * n_lines"),
)


def vote(rule: Rule) -> Column:
    """1 good, 0 bad, -1 abstains."""
    return F.when(F.expr(rule.bad), 0).when(F.expr(rule.good), 1).otherwise(-1)


def start(patterns: np.ndarray) -> np.ndarray:
    """First accuracies [rule, class, vote], votes bad, good, abstain: a rule is right more often than wrong.

    A rule that never casts one of the votes has no share for it.
    """
    likely = np.array([[0.3, 0.1, 0.6], [0.02, 0.7, 0.28]])
    tables = []
    for votes in patterns.T:
        cast = np.array([(votes == v).any() for v in (0, 1, -1)], float)
        table = np.array([[0.3, 0.0, 0.7], [0.02, 0.0, 0.98]]) if not cast[1] else np.array([[0.0, 0.3, 0.7], [0.0, 0.8, 0.2]]) if not cast[0] else likely
        tables.append(table + 1e-6)
    out = np.stack(tables)
    return out / out.sum(axis=2, keepdims=True)


def expectation_maximisation(patterns: np.ndarray, weight: np.ndarray, rounds: int = 200, prior: float = 0.85) -> tuple[np.ndarray, float]:
    """(accuracy[rule, class, vote], share of good documents) of a two-class naive Bayes model.

    patterns: [pattern, rule] votes -1, 0, 1; weight: documents of each pattern.  A pseudo-count of
    the first accuracies keeps the classes' meaning.
    """
    onehot = np.stack([patterns == v for v in (0, 1, -1)], axis=2).astype(float)
    n = max(weight.sum(), 1.0)
    first = table = start(patterns)
    good = prior
    for _ in range(rounds):
        score = np.einsum("prv,rcv->pc", onehot, np.log(table)) + np.log([1 - good, good])
        post = np.exp(score - score.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * weight[:, None]
        counts = np.einsum("pc,prv->rcv", mass, onehot) + 0.02 * n * first
        new = counts / counts.sum(axis=2, keepdims=True)
        done = np.abs(new - table).max() < 1e-9
        table, good = new, float((mass[:, 1].sum() + 0.02 * n * prior) / (1.02 * n))
        if done:
            break
    return table, good


def posterior(table: np.ndarray, good: float, patterns: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good."""
    onehot = np.stack([patterns == v for v in (0, 1, -1)], axis=2).astype(float)
    score = np.einsum("prv,rcv->pc", onehot, np.log(table)) + np.log([1 - good, good])
    return 1 / (1 + np.exp(score[:, 0] - score[:, 1]))


_BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def learn(votes: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(votes, quality): the posterior of each pattern of votes.  votes: a column of that name, an array in the order of rules.

    Votes of all rows are counted by pattern, at most 3^rules rows whatever the corpus; EM runs on
    those counts.
    """
    seen = votes.groupBy("votes").count().collect()  # bounded by the number of patterns
    patterns = np.array([r["votes"] for r in seen], dtype=int).reshape(-1, len(rules))
    table, good = expectation_maximisation(patterns, np.array([r["count"] for r in seen], dtype=float))
    chance = posterior(table, good, patterns) if len(seen) else []
    return votes.sparkSession.createDataFrame([(p.tolist(), float(q)) for p, q in zip(patterns, chance)], "votes array<int>, quality double")


def _votes(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[vote(r) for r in rules])


def judge(docs: DataFrame, threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_hash, counts, base_failed, quality, kept) of every document.

    Each document gets the posterior of its pattern of votes (see learn()).  base_failed rejects
    outright.  Null or empty texts have no words and fail.  Repeated rows get equal results.
    An empty table gives no rows.  Other columns are ignored.
    """
    voted = materialize(measured(docs).withColumn("votes", _votes(rules)), "votes")
    joined = voted.join(F.broadcast(learn(voted, rules)), "votes", "left")  # at most 3^rules rows
    return joined.withColumn("base_failed", F.expr(_BASE)).withColumn("kept", ~F.expr(_BASE) & (F.col("quality") >= threshold)).drop("votes")


def keep_good(docs: DataFrame, threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of docs that judge() keeps, with their columns unchanged.

    One pass counts votes, a second one measures again and filters, so that no text is shuffled.
    """
    found = learn(docs.select(counts_of(F.col("text")).alias("counts")).select("counts.*").select(_votes(rules).alias("votes")), rules)
    verdict, counts = free_name(docs, "verdict"), free_name(docs, "counts")
    inside = lambda sql: re.sub(r"\bn_\w+|\bword_chars", lambda m: f"{counts}.{m[0]}", sql)
    voted = F.array(*[vote(Rule(r.name, inside(r.bad), inside(r.good))) for r in rules])
    good = found.where(F.col("quality") >= threshold).select(F.col("votes").alias(verdict))  # at most 3^rules rows
    counted = docs.withColumn(counts, counts_of(F.col("text"))).where(~F.expr(inside(_BASE))).withColumn(verdict, voted)
    return counted.join(F.broadcast(good), verdict, "left_semi").select(*docs.columns)
