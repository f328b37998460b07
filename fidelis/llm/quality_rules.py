"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios.

Everything is a built-in expression of one narrow plan: no user function, no shuffle, no state. Results for special
input: a null or empty text has no words and so fails the base rule; a null ``doc_id`` is carried through; repeated
rows are judged each by itself; an empty table gives an empty result; other columns are passed on by ``keep_good``
and not looked at otherwise. Ratios are compared as products of whole numbers, so ties at a threshold are exact:
a value at its bound passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.store import fresh

# The white space between words and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with by on are this be at from or an have not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des du et un une en est que pour dans au ne il sur "
    "el los las y que un una por con para no se su al lo es mi"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low * base <= 1000 * value <= high * base``; a bound of None doesn't count."""

    name: str
    value: str
    base: str
    low: int | None = None
    high: int | None = None


#: Bounds are in thousandths of the base.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1_500, 15_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 15, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("capitals", "n_capitals", "n_chars", None, 400),
    Rule("exclamation", "n_exclamation", "n_words", None, 300),
)
#: The base rule: words at least, and hundredths of the words that may lie in a repeated window.
MIN_WORDS, MAX_REPEAT, WINDOW = 50, 50, 3


def measured(df: DataFrame, text: str = "text", name: str = "_m") -> DataFrame:
    """``df`` with a struct column ``name`` of all counts; a column of that name is replaced."""
    df = df.drop(name)
    made = fresh(df, "t", "w", "l", "h", "s")
    t_, w_, l_, h_, s_ = made
    stops = sorted({*STOP_WORDS, *(w[:1].upper() + w[1:] for w in STOP_WORDS)})
    df = df.withColumn(t_, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(w_, F.array_remove(F.split(t_, SPACE), "")).withColumn(l_, F.filter(F.split(t_, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    w = F.col(w_)
    df = df.withColumn(h_, F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")))
    h = F.col(h_)
    # Windows in the order of their hash, with their places; only where any hash repeats.
    df = df.withColumn(s_, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(s_)
    twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*(x["i"] + k for k in range(WINDOW)))))))
    counts = {
        "n_words": F.size(w_),
        "word_chars": F.length(F.array_join(w_, "")),
        "n_symbols": F.regexp_count(t_, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(l_) - F.size(F.array_distinct(l_)),
        "n_repeat_words": F.when(s.isNull(), F.lit(0)).otherwise(covered),
        "n_lines": F.size(l_),
        "n_chars": F.length(t_),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stops))),
        "n_capitals": F.regexp_count(t_, F.lit("[A-Z]")),
        "n_exclamation": F.regexp_count(t_, F.lit("!")),
    }
    # Made by a generator of one row, not by a projection: filters on the counts then stay above, where each is computed
    # once. Pushed down, they would hold every expression as often as they name it, also inside the loops over words.
    m = F.explode(F.array(F.struct(*(v.cast("long").alias(k) for k, v in counts.items()))))
    return df.withColumn(name, m).drop(*made)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])


def passes(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules of the table as one boolean expression."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (1000 * m[r.value] >= r.low * m[r.base])
        if r.high is not None:
            ok = ok & (1000 * m[r.value] <= r.high * m[r.base])
    return ok


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``_m`` (counts), ``base_failed``, ``kept`` and ``failed_rules`` (names, in the table's order); columns of these names are replaced."""
    m = F.col("_m")
    failed = F.array_compact(F.array(*(F.when(~passes(m, (r,)), F.lit(r.name)) for r in rules)))
    out = measured(df, text).withColumn("base_failed", base_failed(m)).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` whose text passes, with the columns of ``df`` alone."""
    names = df.columns
    (name,) = fresh(df, "m")
    m = F.col(name)
    return measured(df, text, name).where(~base_failed(m) & passes(m, rules)).select(*(F.col(f"`{n}`") for n in names))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(d).select("doc_id", *(F.col("_m")[k].alias(k) for k in base), "base_failed", "kept")


def _sql_rules() -> str:
    parts = []
    for r in RULES:
        if r.low is not None:
            parts.append(f"1000 * {r.value} >= {r.low} * {r.base}")
        if r.high is not None:
            parts.append(f"1000 * {r.value} <= {r.high} * {r.base}")
    return " AND ".join(parts)


def measure_sql(table: str, keep: str = "") -> str:
    """DuckDB: the counts of each row of ``table``, which has doc_id and text; ``keep`` names more columns."""
    stops = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w[:1].upper() + w[1:] for w in STOP_WORDS)}))
    count = lambda cls, s="t": f"(length({s}) - length(regexp_replace({s}, '{cls}', '', 'g')))"
    return f"""
    SELECT * EXCLUDE (t, ws, ls), len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
      {count("[#*$%&|<>]")} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, length(t) AS n_chars,
      len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop_words, {count("[A-Z]")} AS n_capitals, {count("!")} AS n_exclamation,
      (SELECT count(DISTINCT p) FROM (SELECT unnest([i, i + 1, i + 2]) AS p FROM (SELECT i, count(*) OVER (PARTITION BY a, b, c) AS n FROM
        (SELECT i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT unnest(range(1, len(ws) - 1)) AS i))) WHERE n > 1)) AS n_repeat_words
    FROM (SELECT doc_id, {keep} t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM (SELECT *, coalesce(text, '') AS t FROM {table}))"""


def verdict_sql(table: str, keep: str = "") -> str:
    bad = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words)"
    return f"SELECT *, {bad} AS base_failed, NOT {bad} AND {_sql_rules()} AS kept FROM ({measure_sql(table, keep)})"


def op1_sql() -> str:
    return f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({verdict_sql('documents')})"
