"""Registered queries: titles and n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import text as fx
from kinfold.functions.stopwords import default_stop_words
from kinfold.operators import ngrams
from kinfold.registry.fragments import table
from kinfold.session import spread

# The default phrases and some that occur in the test texts, accents included.
PHRASES = (*fx.SLANG_PHRASES, "of the", "the", "und der", "der", "de la", "la", "ción", "é")
STOP_WORDS = ("of", "the", "and", "de", "la", "der", "die", "und", "los", "que")
_MIN_FREQUENCY = 20
_N_TOP = 50

_EMOJI_SQL = fx.emoji_class() + "+"


def _slang_sql(phrases=PHRASES) -> str:
    """Words wrapped in markers turn whole-word matching into plain matching."""
    wrapped = ["\x03 \x02".join(p.split(" ")) for p in fx.longest_first(phrases)]
    return "(?i)\x02(?:" + "|".join(wrapped) + ")\x03" + fx.SPACE + "*"


def clean_sql(column: str, phrases=PHRASES) -> dict[str, str]:
    emoji = f"regexp_replace({column}, '{_EMOJI_SQL}', '', 'g')"
    noise = f"regexp_replace({emoji}, '{fx.NOISE}', '', 'g')"
    marked = f"regexp_replace({noise}, '({fx.WORD}+)', '\x02\\1\x03', 'g')"
    cut = f"regexp_replace({marked}, '{_slang_sql(phrases)}', '', 'g')"
    slang = f"regexp_replace({cut}, '[\x02\x03]', '', 'g')"
    cleaned = f"trim(regexp_replace({slang}, '{fx.SPACE}+', ' ', 'g'), ' ')"
    return {"emoji": emoji, "noise": noise, "slang": slang, "clean": cleaned}


def _texts(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def clean_text(spark, folder):
    docs = _texts(spark, folder)
    return docs.select("doc_id", fx.clean_text(fx.as_text(F.col("text")), PHRASES).alias("cleaned"))


def clean_text_steps(spark, folder):
    """What each cleaning step leaves, as md5 and length."""
    text = fx.as_text(F.col("text"))
    emoji = fx.remove_emoji(text)
    noise = fx.remove_noise(emoji)
    slang = fx.remove_slang(noise, PHRASES)
    steps = {"emoji": emoji, "noise": noise, "slang": slang}
    return _texts(spark, folder).select(
        "doc_id",
        *[F.md5(c).alias(f"{name}_md5") for name, c in steps.items()],
        *[F.char_length(c).cast("long").alias(f"{name}_chars") for name, c in steps.items()],
    )


def word_tokens(spark, folder):
    tokens = fx.without_stop_words(fx.word_tokens(fx.as_text(F.col("text"))), STOP_WORDS)
    docs = _texts(spark, folder).select("doc_id", tokens.alias("tokens"))
    return docs.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.array_join("tokens", " ").alias("tokens"),
    )


def common_ngrams(spark, folder):
    return ngrams.common_ngrams(
        table(spark, folder, "documents"),
        "text",
        min_frequency=_MIN_FREQUENCY,
        n_top=_N_TOP,
        stop_words=STOP_WORDS,
    )


def ngram_report(spark, folder):
    report = ngrams.ngram_report(
        table(spark, folder, "documents"),
        "text",
        min_frequency=_MIN_FREQUENCY,
        n_top=_N_TOP,
        stop_words=STOP_WORDS,
    )
    return report.withColumn("ngrams", F.to_json("ngrams"))


def ngram_report_default(spark, folder):
    """The n-gram job as it is called without arguments: floor 100, top 200, both default stop word lists."""
    report = ngrams.ngram_report(table(spark, folder, "documents"), "text")
    return report.withColumn("ngrams", F.to_json("ngrams"))


_STEPS = clean_sql("coalesce(text, 'nan')")
_TOKENS = f"regexp_extract_all(lower(coalesce(text, 'nan')), '{fx.WORD}+')"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_KEPT = f"list_filter({_TOKENS}, lambda x: x NOT IN ({_quoted(STOP_WORDS)}))"


def _grams_sql(stop_words, min_frequency: int, n_top: int) -> str:
    return f"""kept AS (
  SELECT doc_id, list_filter({_TOKENS}, lambda x: x NOT IN ({_quoted(stop_words)})) AS t FROM documents),
grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(t) - n + 2),
                        lambda i: array_to_string(list_slice(t, i, i + n - 1), ' '))) AS ngram
  FROM kept CROSS JOIN (SELECT unnest([2, 3, 4]) AS n) WHERE len(t) >= n),
per_doc AS (SELECT ngram, doc_id, count(*) AS c FROM grams GROUP BY ngram, doc_id),
top AS (
  SELECT ngram, count(*) AS doc_freq, CAST(sum(c) AS BIGINT) AS term_freq FROM per_doc
  GROUP BY ngram HAVING count(*) >= {min_frequency}),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY term_freq DESC, ngram) AS rank FROM top
  QUALIFY rank <= {n_top})"""


def _report_sql(stop_words, min_frequency: int, n_top: int) -> str:
    return f"""WITH {_grams_sql(stop_words, min_frequency, n_top)}
SELECT coalesce(CAST(to_json(list(ngram ORDER BY rank)) AS VARCHAR), '[]') AS ngrams, {min_frequency} AS min_frequency,
       (SELECT count(*) FROM documents) AS total_titles FROM ranked"""


_GRAMS = _grams_sql(STOP_WORDS, _MIN_FREQUENCY, _N_TOP)

QUERIES = {
    "clean_text": clean_text,
    "clean_text_steps": clean_text_steps,
    "word_tokens": word_tokens,
    "common_ngrams": common_ngrams,
    "ngram_report": ngram_report,
    "ngram_report_default": ngram_report_default,
}

SQL = {
    "clean_text": f"SELECT doc_id, {_STEPS['clean']} AS cleaned FROM documents",
    "clean_text_steps": "SELECT doc_id, "
    + ", ".join(
        f"md5({_STEPS[s]}) AS {s}_md5, length({_STEPS[s]}) AS {s}_chars"
        for s in ("emoji", "noise", "slang")
    )
    + " FROM documents",
    "word_tokens": f"""SELECT doc_id, len({_KEPT}) AS n_tokens, array_to_string({_KEPT}, ' ') AS tokens
FROM documents""",
    "common_ngrams": f"WITH {_GRAMS} SELECT ngram, doc_freq, term_freq, CAST(rank AS INTEGER) AS rank FROM ranked",
    "ngram_report": _report_sql(STOP_WORDS, _MIN_FREQUENCY, _N_TOP),
    "ngram_report_default": _report_sql(default_stop_words(), 100, 200),
}
