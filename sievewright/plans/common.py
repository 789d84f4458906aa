"""Reading tables, and SQL pieces that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.functions import rules as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_fold(c: str) -> str:
    return f"strip_accents(lower({c}))"


def sql_raw_words(c: str) -> str:
    return f"regexp_extract_all({sql_fold(c)}, '[a-z0-9]+')"


def sql_tokens(c: str) -> str:
    return f"list_filter({sql_raw_words(c)}, lambda w: length(w) >= 2 AND w NOT IN ({quoted(R.QUESTION_STOP)}))"


def sql_split_words(c: str, stop) -> str:
    return f"list_filter(string_split_regex(regexp_replace({sql_fold(c)}, '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(stop)}))"


def sql_significant(c: str) -> str:
    return f"list_transform({sql_split_words(c, R.TITLE_STOP)}, lambda w: CASE WHEN length(w) > 6 AND w LIKE '%en' THEN w[:-3] WHEN length(w) > 5 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)"


def sql_detail(c: str) -> str:
    stem = "CASE WHEN length(w) > 6 AND w LIKE '%en' THEN w[:-3] WHEN length(w) > 5 AND w LIKE '%s' THEN w[:-2] ELSE w END"
    for v in "aeou":  # a doubled vowel becomes one, pair by pair
        stem = f"replace({stem}, '{v}{v}', '{v}')"
    return f"list_transform({sql_split_words(sql_normal(c), R.DETAIL_STOP)}, lambda w: {stem})"


def sql_normal(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace({c}, '&nbsp;', ' ', 'g'), '[\\s\\x{{00A0}}\\x{{202F}}\\x{{2007}}\\x{{FEFF}}]+', ' ', 'g'))"


def sql_title_words(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(regexp_replace({sql_fold(sql_normal(c))}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2))"


def sql_title(c: str, n: int = 8) -> str:
    """The first words of a text."""
    return f"array_to_string(string_split({c}, ' ')[1:{n}], ' ')"


def title(c, n: int = 8):
    from pyspark.sql import functions as F

    return F.array_join(F.slice(F.split(c, " ", n + 1), 1, n), " ")
