"""Quality rules whose cutoffs carry a guarantee.

A rule rejects a text whose statistic passes a cutoff, and a text goes when any rule
rejects it. What is tested is this combined verdict: in every stratum the exact
(Clopper-Pearson) upper bound on the share of good texts it rejects must stay under
the whole limit. The bad texts and a third of the good ones, drawn by a hash of the
id, propose a path of ever stricter verdicts, the rule that catches most bad texts for
the good ones it costs first. The path does not depend on the other good texts, so
they test it verdict by verdict from the mildest on, each at the stratum's whole level,
up to the first that does not hold. Of those that hold, the one that catches most bad
texts is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.blocks import SPACE, Block, Hasher, blocks, bound_batches, mix, shingles, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW_WORDS = 8
CUTOFFS = 40  # equal steps of each statistic's range

# Rules: a statistic in [0, 1], the larger the worse; Spark may compute it for texts without words too.
RULES = {
    "symbols": "least(1.0, n_symbols / greatest(1, word_chars))",
    "dup_lines": "least(1.0, n_dup_lines / (1.0 + n_lines))",
    "repeats": "n_repeat_words / greatest(1, n_words)",
    "long_words": "least(1.0, greatest(0.0, word_chars / greatest(1, n_words) - 5) / 20)",
    "short_words": "least(1.0, greatest(0.0, 5 - word_chars / greatest(1, n_words)) / 5)",
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False


def block_counts(block: Block) -> dict[str, np.ndarray]:
    """The counts of every text of a block, and the number of its lines with a word."""
    data, count = block.bytes, len(block)
    starts, ends = word_spans(data)
    owner = block.owner(starts)
    hasher = Hasher(data)
    inside = ~SPACE[data]
    # code points are the bytes that do not continue one
    chars = block.count(inside & ((data & 0xC0) != 0x80))

    # lines with a word: every word falls into the line of the line feeds before it
    line_of_word = np.cumsum(~_NEWLINE[data])[starts] if len(starts) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(line_of_word, prepend=-1)) if len(starts) else np.zeros(0, np.int64)
    feeds = np.flatnonzero(~_NEWLINE[data])
    line = line_of_word[first]
    line_start = np.where(line > 0, feeds[line - 1] + 1, 0)
    line_owner = owner[first]
    line_key = mix(hasher.spans(line_start, feeds[line]) + line_owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at = np.unique(line_key, return_index=True)
    lines = np.bincount(line_owner, minlength=count)
    distinct = np.bincount(line_owner[at], minlength=count)

    repeated = np.zeros(count, np.int64)
    runs = shingles(hasher.spans(starts, ends), WINDOW_WORDS)
    if len(runs):
        whole = owner[: len(runs)] == owner[WINDOW_WORDS - 1 :]
        at = np.flatnonzero(whole)
        key = mix(runs[at] + owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        marks = np.zeros(len(starts) + 1, np.int64)
        np.add.at(marks, at[again], 1)
        np.add.at(marks, at[again] + WINDOW_WORDS, -1)
        repeated = np.bincount(owner[np.cumsum(marks[:-1]) > 0], minlength=count)
    return {
        "n_words": np.bincount(owner, minlength=count),
        "word_chars": chars,
        "n_symbols": block.count(_SYMBOL[data]),
        "n_dup_lines": lines - distinct,
        "n_repeat_words": repeated,
        "n_lines": lines,
    }


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and the counts of every whole text."""
    bound_batches(docs.sparkSession)
    rest = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.select(*keep).schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                found = block_counts(block)
                rows = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*(rows[c] for c in keep), *map(pa.array, found.values())], [*keep, *found]
                )

    return rest.mapInArrow(apply, f"{schema}, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_lines")))


def upper_bound(failures: int, trials: int, level: float) -> float:
    """Exact binomial upper bound: the largest rate not rejected at ``level``."""
    if failures >= trials:
        return 1.0
    low, high = failures / trials, 1.0
    choose = [math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) for k in range(failures + 1)]
    for _ in range(50):
        rate = (low + high) / 2
        logs = [c + k * math.log(rate) + (trials - k) * math.log1p(-rate) for k, c in enumerate(choose)]
        top = max(logs)
        tail = top + math.log(sum(math.exp(x - top) for x in logs))
        low, high = (rate, high) if tail > math.log(level) else (low, rate)
    return high


def choose_cutoff(good: np.ndarray, bad: np.ndarray, limit: float, level: float, price: float) -> float | None:
    """The cutoff step that catches most at least cost among those that hold, or None.

    ``good`` and ``bad`` count labelled texts by step of the statistic. Cutoff k
    rejects steps k and above. Cutoffs are tried from the mildest on and the bound
    only grows, so the search stops at the first that does not hold.
    """
    best, gain, trials = None, 0.0, int(good.sum())
    good_above, bad_above = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    for k in range(len(good) - 1, 0, -1):
        if trials == 0 or good_above[k] > limit * trials or upper_bound(int(good_above[k]), trials, level) > limit:
            break
        if bad_above[k] - price * good_above[k] > gain:
            best, gain = k, bad_above[k] - price * good_above[k]
    return best


def propose(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """A path of ever stricter verdicts: the rule and its next cutoff, one step at a time.

    ``steps`` holds a row of steps, one per rule, for each kind of text, ``good`` and
    ``bad`` the labelled texts of that kind. The next move takes one rule to the cutoff
    with most new bad texts per new good one; of equal moves the strictest, so the
    path goes on up to the next good text. It ends where no move catches a bad text
    or the verdict rejects more than the limit here.
    """
    cutoffs, path = [CUTOFFS + 1] * steps.shape[1], []
    left, allowed, spent = np.ones(len(steps), bool), limit * good.sum(), 0
    while spent <= allowed:
        best = (0.0, 0, 0)
        for rule, cutoff in enumerate(cutoffs):
            at = steps[left, rule]
            new_good = np.cumsum(np.bincount(at, good[left], CUTOFFS + 1)[::-1])[::-1]
            new_bad = np.cumsum(np.bincount(at, bad[left], CUTOFFS + 1)[::-1])[::-1]
            worth = (new_bad / (new_good + 0.5))[1:cutoff]
            if len(worth) and worth.max() > best[0]:
                best = (float(worth.max()), rule, 1 + int(worth.argmax()))
        if not best[0]:
            break
        _, rule, cutoff = best
        path += [(rule, k) for k in range(cutoffs[rule] - 1, cutoff - 1, -1)]
        cutoffs[rule] = cutoff
        gone = left & (steps[:, rule] >= cutoff)
        spent, left = spent + good[gone].sum(), left & ~gone
    return path


def certify(
    path: list[tuple[int, int]], steps: np.ndarray, good: np.ndarray, bad: np.ndarray, limit: float, level: float
) -> dict[int, int]:
    """The cutoff of every rule used by the best verdict of the path that holds on these texts."""
    size = len(path)
    first = np.full(len(steps), size)  # place of the first verdict that rejects the text
    for place in range(size - 1, -1, -1):
        rule, cutoff = path[place]
        first[steps[:, rule] >= cutoff] = place
    # the mildest verdict is the last step, what no verdict rejects is step 0
    by_step = [np.bincount(size - first, x, size + 1).astype(np.int64) for x in (good, bad)]
    taken = choose_cutoff(*by_step, limit, level, 0.0)
    return {} if taken is None else dict(path[: size - taken + 1])


def thresholds(
    counts: DataFrame,
    labels: DataFrame,
    *,
    stratum: str = "lang",
    limit: float = 0.05,
    level: float = 0.05,
) -> DataFrame:
    """``stratum, rule, cutoff`` for every rule used in a stratum.

    The rules of a stratum share one test of the whole limit and the level is divided
    by strata, so in all strata at once good texts are rejected at most at rate
    ``limit``, except with chance ``level``. Labels without a document, null labels
    and null keys are left out; a key with several labels takes the smallest. A
    stratum is one group of counts by distinct row of steps, not of texts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # texts the base rules reject anyway are no evidence on these
    held = counts.where("not base_failed").join(known, "doc_id")
    steps = [F.least(F.floor(F.expr(e) * CUTOFFS), F.lit(CUTOFFS)).cast("int").alias(r) for r, e in RULES.items()]
    kind_of = F.when(F.col("quality") <= 0, "bad").when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, "proposing").otherwise("testing")
    table = held.select(F.col(stratum).alias("stratum"), kind_of.alias("kind"), *steps)
    kinds = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in ("proposing", "testing", "bad")]
    table = table.groupBy("stratum", *RULES).agg(*kinds)
    strata = max(1, held.select(stratum).distinct().count())

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        at, bad = group[[*RULES]].to_numpy(np.int64), group["bad"].to_numpy()
        path = propose(at, group["proposing"].to_numpy(), bad, limit)
        chosen = certify(path, at, group["testing"].to_numpy(), bad, limit, level / strata)
        names = list(RULES)
        rows = {"stratum": [group["stratum"].iloc[0]] * len(chosen), "rule": [names[r] for r in chosen], "cutoff": list(chosen.values())}
        return pd.DataFrame(rows, dtype=object)

    kind = dict(counts.dtypes)[stratum]
    return table.groupBy("stratum").applyInPandas(decide, f"stratum {kind}, rule string, cutoff int")


def judge(counts: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """Add ``kept`` to rows that have ``base_failed``; a stratum without rules keeps the rest."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES]
    )
    passed = [
        F.coalesce(F.least(F.floor(F.expr(e) * CUTOFFS), F.lit(CUTOFFS)) < F.col(f"_{r}"), F.lit(True))
        for r, e in RULES.items()
    ]
    every = ~F.col("base_failed")
    for rule in passed:
        every = every & rule
    joined = counts.join(wide, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", every).drop("_stratum", *[f"_{r}" for r in RULES])


def base_rules(counts: DataFrame) -> DataFrame:
    """Add ``base_failed``: under 20 words, or over 30 % of them in repeated windows."""
    return counts.withColumn(
        "base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    )
