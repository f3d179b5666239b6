"""Operator 7 (native): line-first cleaning.

Each line of a text is judged by itself: runs of words without a sentence mark, shouting, symbol noise, navigation
bars and boilerplate phrases fail. Failed lines are removed, and a document that loses too large a part of its
words with them is rejected. Counts of the whole text (words, symbols, repeated lines and 5-word windows) reject
documents that are short or repeat themselves. All of it is one projection: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.llm.registry import query, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Phrases of page furniture, in lower case.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
               "uses cookies", "enable javascript", "lorem ipsum", "subscribe to our newsletter", "click here to",
               "sign up for", "share this article")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; ``max_lost`` is the share of words that a kept document may lose."""

    unpunctuated_words: int = 12     # so many words want a sentence mark
    shouting_words: int = 5          # so many words all in capitals fail
    exclamations_per_word: float = 0.3
    symbols_per_word: float = 0.25
    bars_per_word: float = 0.2
    least_symbols: int = 3
    max_lost: float = 0.5
    boilerplate: tuple[str, ...] = field(default=BOILERPLATE)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def failed_rule(line: Column, n: Column, rules: LineRules) -> Column:
    """Name of the first rule that a line of ``n`` words fails, or null."""
    lower = F.lower(line)
    phrase = F.lit(False)
    for p in rules.boilerplate:
        phrase = phrase | F.contains(lower, F.lit(p))
    symbols, bars = _count(line, SYMBOLS), _count(line, "|»›•")
    return (F.when((n >= rules.unpunctuated_words) & (_count(line, ".!?…") == 0), "punctuation")
            .when((n >= rules.shouting_words) & (F.upper(line) == line) & (lower != line), "shouting")
            .when((n >= rules.shouting_words) & (_count(line, "!") > n * rules.exclamations_per_word), "shouting")
            .when((bars >= rules.least_symbols) & (bars >= n * rules.bars_per_word), "navigation")
            .when((symbols >= rules.least_symbols) & (symbols >= n * rules.symbols_per_word), "symbols")
            .when(phrase, "boilerplate"))


def repeated_words(text_words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the text, the first included.

    Windows are told apart by a 64-bit hash. Sorted by (hash, place), equal windows are neighbours; their places,
    sorted again, cover min(5, distance to the next) words each.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(text_words) - 5),
                         lambda i: F.xxhash64(*[F.get(text_words, i + k) for k in range(5)]))
    return F.when(F.size(text_words) < 5, F.lit(0)).otherwise(_covered(hashes))


def _covered(hashes: Column) -> Column:
    def of_places(places: Column) -> Column:
        last = F.size(places) - 1
        gaps = F.transform(places, lambda p, i: F.when(i == last, F.lit(5)).otherwise(F.least(F.lit(5), F.get(places, i + 1) - p)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def of_sorted(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]))
        return _let(F.sort_array(F.transform(again, lambda p: p["p"])), of_places)

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, of_sorted))

    return _let(hashes, of_hashes)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(),
          least_words: int = 10, max_repeated: int = 20) -> DataFrame:
    """One row a document: the counts, ``base_failed``, ``kept``, the share of words lost and the cleaned text.

    Null texts count as empty: no words, ``base_failed``, not kept. Null ids and repeated rows stay; other columns
    are not read. ``clean_text`` has the lines that passed, in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = F.transform(F.split(text, "\n", -1), lambda l: F.struct(l.alias("line"), F.size(words(l)).alias("n")))
    counted = source.select(
        "doc_id", text.alias("text"), words(text).alias("words"), lines.alias("lines"))
    judged = F.transform("lines", lambda l: F.struct(
        l["line"].alias("line"), l["n"].alias("n"), failed_rule(l["line"], l["n"], rules).alias("rule")))
    filled = F.transform(F.filter("lines", lambda l: l["n"] > 0), lambda l: l["line"])
    rows = counted.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _let(filled, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        judged.alias("lines"))
    good = F.filter("lines", lambda l: l["rule"].isNull())
    kept_words = F.aggregate(good, F.lit(0), lambda a, l: a + l["n"])
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    lost = F.col("n_words") - kept_words
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        lost.cast("long").alias("n_lost_words"),
        F.array_join(F.transform(good, lambda l: l["line"]), "\n").alias("clean_text"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= F.col("n_words") * rules.max_lost))


_R = LineRules()


def _sql_count(column: str, signs: str) -> str:
    return f"(length({column}) - length(translate({column}, '{signs}', '')))"


ORACLE = rf"""
with t as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from t),
windows as (select rid, unnest(range(1, len(words) - 3)) as p, words from w where len(words) >= 5),
named as (select rid, p, words[p : p + 4] as win from windows),
twice as (select rid, p from (select rid, p, count(*) over (partition by rid, win) as n from named) where n > 1),
covered as (select rid, sum(least(5, coalesce(nxt - p, 5))) as n from
            (select rid, p, lead(p) over (partition by rid order by p) as nxt from twice) group by rid),
l as (select rid, unnest(string_split(text, chr(10))) as line from t),
ln as (select rid, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l),
per as (select rid, sum(n) filter (where not coalesce(
            (n >= {_R.unpunctuated_words} and {_sql_count('line', '.!?…')} = 0)
            or (n >= {_R.shouting_words} and upper(line) = line and lower(line) <> line)
            or (n >= {_R.shouting_words} and {_sql_count('line', '!')} > n * {_R.exclamations_per_word}::double)
            or ({_sql_count('line', '|»›•')} >= {_R.least_symbols} and {_sql_count('line', '|»›•')} >= n * {_R.bars_per_word}::double)
            or ({_sql_count('line', SYMBOLS)} >= {_R.least_symbols} and {_sql_count('line', SYMBOLS)} >= n * {_R.symbols_per_word}::double)
            or {' or '.join(f"contains(lower(line), '{p}')" for p in _R.boilerplate)}, false)) as kept_words,
        count(*) filter (where n > 0) - count(distinct line) filter (where n > 0) as dup from ln group by rid),
base as (select t.doc_id, len(words) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         {_sql_count('text', SYMBOLS)} as n_symbols, dup as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
         coalesce(kept_words, 0) as kept_words
         from t join w using (rid) join per using (rid) left join covered using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - kept_words <= n_words * 0.5::double as kept
from base
"""


@query("op7_line_quality", ORACLE)
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("n_lost_words", "clean_text")
