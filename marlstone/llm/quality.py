"""Line-first cleaning with built-in functions only.

Each line of a text is judged alone: punctuation (too many symbols for its words, or a long run of
words without any mark, whatever their script), navigation (menus: parts set apart by bars or arrows, or nothing but menu
words) and boilerplate (stock phrases of web pages). Failing lines go; a document that loses more
than ``most_lost`` of its word characters goes as a whole. No step leaves the row it works on, so
there is no shuffle.

Arrays are only ever passed as arguments of higher-order functions, never captured inside a lambda:
a captured expression would be computed once for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import BLANKS, few_files, space_words, table

SYMBOLS = "#*$%&|<>"
#: Stock phrases of web pages, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "use of cookies",
    "uses cookies",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "subscribe to our newsletter",
    "click here to",
)
#: Marks that set the parts of a menu apart.
BARS = ("|", "»", ">", "›", "•", "·")
#: Words of menus, in lower case.
MENU_WORDS = ("home", "menu", "login", "logout", "sign in", "sign up", "register", "search", "next", "previous", "back", "share", "print", "contact", "about us", "sitemap", "skip to content", "read more")


#: A mark: anything but letters, digits and blanks of any script.
MARK = r"[^\p{L}\p{M}\p{N}\p{Z}_\x09-\x0D]"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _any_of(text: Column, parts) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def _has_words(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def with_text_flags(df: DataFrame, text: str) -> DataFrame:
    """Facts about a whole text that spare its lines a rule: without a symbol in the text, no line
    has one."""
    low = F.lower(F.col(text))
    return (
        df.withColumn("__sym", F.col(text).rlike(f"[{SYMBOLS}{{}}!]"))
        .withColumn("__bar", _any_of(F.col(text), BARS))
        .withColumn("__stock", _any_of(low, {p.split(" ")[-1 if p != "click here to" else 0] for p in BOILERPLATE}))
    )


def line_fails(line: Column) -> Column:
    """Whether a line breaks one of the three rules, given the flags of its text. A line without
    words breaks none. Cheap conditions come first: the rest is then not computed."""
    bare = F.length(_without(line, BLANKS))
    symbols = _count_of(line, SYMBOLS + "{}") + (F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))) / 2
    noisy = F.col("__sym") & (symbols * 10 > bare)
    unmarked = ~line.rlike(MARK) & (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= 12)
    # a bar between blanks
    bars = F.regexp_count(line, F.lit(r"(?:^|[ \t])(?:\||»|>|›|•|·)(?=$|[ \t])"))
    menu = F.col("__bar") & (bars >= 2) & (bars * 40 > bare)
    only_menu = (F.octet_length(line) < 30) & F.trim(F.regexp_replace(F.lower(line), "[^a-z ]+", " ")).isin(*MENU_WORDS)
    stock = F.col("__stock") & _any_of(F.lower(line), BOILERPLATE)
    return _has_words(line) & (unmarked | only_menu | noisy | menu | stock)


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add the number of words that lie in a 3-word window found twice or more in the same row.

    Windows are compared by a 64-bit hash. They are sorted within the row with their positions;
    neighbours with equal hashes repeat, and each repeated window adds the words by which it goes
    past the repeated window before it, three at most. Time n log n, memory one row.
    """
    n = F.size(words)
    df = df.withColumn("__p", F.zip_with(F.col(words), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("__p", F.zip_with(F.col("__p"), F.slice(words, F.lit(3), n), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("__p", F.slice("__p", F.lit(1), F.greatest(n - 2, F.lit(0))))
    # most texts repeat no window: nothing to sort
    df = df.withColumn("__p", F.when(F.size(F.array_distinct("__p")) < F.size("__p"), F.col("__p")).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__p", F.sort_array(F.transform("__p", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("__e", F.zip_with("__p", F.slice("__p", F.lit(2), F.size("__p")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    df = df.withColumn("__d", F.zip_with("__e", F.concat(F.array(F.lit(False)), F.col("__e")), lambda a, b: F.coalesce(a, F.lit(False)) | b))
    df = df.withColumn("__p", F.sort_array(F.array_compact(F.zip_with("__p", F.slice("__d", F.lit(1), F.size("__p")), lambda p, d: F.when(d, p["i"])))))
    gaps = F.zip_with("__p", F.slice("__p", F.lit(2), F.size("__p")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return df.withColumn(out, F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)).drop("__p", "__e", "__d")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null texts count as empty: no words, all figures 0, base_failed true. Existing columns with the
    names of the figures are replaced; other columns stay.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("__t", value).withColumn("__w", space_words(value))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.when(F.col("__t").rlike(f"[{SYMBOLS}]"), _count_of(F.col("__t"), SYMBOLS)).otherwise(0).cast("long"))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), _has_words))
    df = df.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    df = with_repeated_words(df, "__w", "n_repeat_words")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.withColumn("base_failed", failed).drop("__t", "__w", "__l")


def clean_lines(df: DataFrame, text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """Add ``clean_text`` (lines that pass, in order), ``n_bad_lines`` and ``lost_too_much``.

    Null texts become empty texts that lose nothing. A text without line ends is one line.
    """
    df = with_text_flags(df.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit(""))), "__t")
    df = df.withColumn("__l", F.split("__t", "\n"))
    df = df.withColumn("__g", F.filter("__l", lambda x: ~line_fails(x)))
    df = df.withColumn("n_bad_lines", (F.size("__l") - F.size("__g")).cast("long"))
    df = df.withColumn("clean_text", F.when(F.col("n_bad_lines") > 0, F.array_join("__g", "\n")).otherwise(F.col("__t")))
    left, had = (F.length(_without(F.col(c), BLANKS)) for c in ("clean_text", "__t"))
    lost = (F.col("n_bad_lines") > 0) & ((had - left) > had * F.lit(most_lost))
    return df.withColumn("lost_too_much", lost).drop("__t", "__l", "__g", "__sym", "__bar", "__stock")


def clean_documents(df: DataFrame, text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """Figures, cleaned lines and ``kept``: false for base failures and for texts that lost too much."""
    out = clean_lines(measure(df, text), text, most_lost)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("lost_too_much"))


def op2_line_quality(spark, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = clean_documents(docs)
    return few_files(found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines"))


def _sql() -> str:
    white = "[\\x20\\x09-\\x0D]"
    word = "[^\\x20\\x09-\\x0D]+"
    stock = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
    menu = ", ".join(f"'{p}'" for p in MENU_WORDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM t),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM t),
judged AS (
  SELECT doc_id, l, length(regexp_replace(l, '{white}+', '', 'g')) AS bare,
    (length(l) - length(regexp_replace(l, '[#*$%&|<>{{}}]', '', 'g'))) + (length(l) - length(replace(l, '!', ''))) / 2.0 AS sym,
    len(regexp_extract_all(' ' || replace(replace(l, chr(9), ' '), ' ', '  ') || ' ', ' (?:\\||»|>|›|•|·) ')) AS bars
  FROM lines),
marked AS (
  SELECT doc_id, l, bare, bare > 0 AND (sym * 10 > bare OR (bars >= 2 AND bars * 40 > bare) OR {stock}
    OR (octet_length(encode(l)) < 30 AND trim(regexp_replace(lower(l), '[^a-z ]+', ' ', 'g')) IN ({menu}))
    OR (NOT regexp_matches(l, '{MARK}') AND len(regexp_extract_all(l, '{word}')) >= 12)) AS bad
  FROM judged),
sums AS (
  SELECT doc_id, count(*) FILTER (bare > 0) - count(DISTINCT l) FILTER (bare > 0) AS n_dup_lines,
    count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(bare) FILTER (bad), 0) AS lost, sum(bare) AS had
  FROM marked GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '{white}+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, n_bad_lines, lost, had
  FROM w JOIN sums USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (lost > had * 0.5) AS kept, n_bad_lines
FROM f
"""


SQL = _sql()
