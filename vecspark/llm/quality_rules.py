"""Line-first quality rules: clean line by line, then judge what is left of the document.

Each line is held against five rules: it ends like a sentence, it is no navigation bar, it isn't made of symbols,
it doesn't shout, and it has no boilerplate phrase. Lines that fail one go, and so do repetitions of an earlier
line. A document that keeps less than `min_kept` percent of its word characters is rejected. All of it is column
expressions within the scan: no shuffle, and a document's cost is n log n in its own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm import native
from vecspark.llm.shared import load

#: Word characters in kept lines, in percent, from which a document stays.
MIN_KEPT = 50
#: What a line of running text ends with.
SENTENCE_ENDS = tuple(""".!?:;,-…。！？"'”’»)]""")
#: Separators of menus and breadcrumbs, of which a line holds fewer than one for 30 characters.
NAVIGATION = "|»›•→"
#: Symbols, of which a line holds fewer than one for 5 characters.
SYMBOLS = "#*$%&<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Phrases of page furniture, held against lower-cased lines.
BOILERPLATE = (
    r"\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|enable javascript|"
    "click here|sign up|log in|subscribe to|newsletter|read more|share this|skip to content|back to top|lorem ipsum)"
)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(native.SPACE))


def held(text: Column, characters: str) -> Column:
    """How many of these characters a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_passes(line: Column) -> Column:
    """Whether a line without outer white space passes the five rules. It shouts if 2 in 5 characters are A-Z."""
    size = F.length(line)
    return (
        F.right(line, F.lit(1)).isin(*SENTENCE_ENDS)
        & (30 * held(line, NAVIGATION) < size)
        & (5 * held(line, SYMBOLS) < size)
        & ((size < 20) | (5 * held(line, CAPITALS) < 2 * size))
        & ~F.lower(line).rlike(BOILERPLATE)
    )


def repeated_windows(hashes: str, packed: str) -> Column:
    """Positions of the windows of a text whose hash another one has, of window hashes and these sorted with positions.

    What is sorted has 34 bits of a hash. Neighbours of equal bits are compared by the whole hash; where these differ,
    so that equal windows may stand apart, every window of those bits is held against all others of them.
    """
    h, s = F.col(hashes), F.col(packed)

    def bits(x: Column) -> Column:
        return F.shiftright(x, native.POSITION_BITS)

    def whole(x: Column) -> Column:
        return F.get(h, native.position(x))

    def with_next(x: Column, i: Column) -> Column:
        after = F.get(s, i + 1)
        return F.when(bits(x) == bits(after), F.when(whole(x) == whole(after), F.lit(1)).otherwise(F.lit(2))).otherwise(F.lit(0))

    codes = F.transform(s, with_next)
    return F.transform(
        F.array(F.struct(codes.alias("codes"))),
        lambda t: F.transform(
            F.array(F.struct(
                F.filter(s, lambda x, i: (F.get(t.codes, i) == 1) | (F.coalesce(F.get(t.codes, i - 1), F.lit(0)) == 1)).alias("near"),
                F.transform(F.filter(s, lambda x, i: F.get(t.codes, i) == 2), bits).alias("mixed"),
            )),
            lambda u: F.when(F.size(u.mixed) == 0, u.near).otherwise(F.array_union(u.near, _equal_among(F.filter(s, lambda x: F.array_contains(u.mixed, bits(x))), whole))),
        )[0],
    )[0]


def _equal_among(some: Column, whole) -> Column:
    return F.filter(some, lambda x: F.exists(some, lambda y: (x != y) & (whole(x) == whole(y))))


def measured(docs: DataFrame) -> DataFrame:
    """docs(text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the kept lines (_lines),
    without white space around them. A null text counts as empty."""
    text = native.text_or_empty()
    squeezed = F.regexp_replace(text, r"[\x20\x09-\x0D]", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(bare(x)) > 0)
    one = (
        docs.withColumn("_words", native.word_array(text))
        .withColumn("word_chars", F.length(squeezed).cast("long"))
        .withColumn("n_symbols", held(text, SYMBOLS + "|").cast("long"))
        .withColumn("_lines", lines)
    )
    two = one.withColumn("n_words", F.size("_words").cast("long")).withColumn("_hashes", native.window_hashes("_words", 3))
    three = two.withColumn("_distinct", F.array_distinct("_lines")).withColumn("_sorted", native.sorted_with_positions("_hashes")).drop("_words")
    four = three.withColumn("_repeated", repeated_windows("_hashes", "_sorted")).drop("_sorted", "_hashes")
    five = four.withColumn("_at", F.sort_array(F.transform("_repeated", native.position))).drop("_repeated")
    at = F.col("_at")
    spans = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    return (
        five.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size("_distinct")).cast("long"))
        .withColumn("_lines", F.filter(F.transform("_distinct", bare), line_passes))
        .drop("_at", "_distinct")
    )


def judged(docs: DataFrame, min_kept: int = MIN_KEPT) -> DataFrame:
    """docs with the measures, kept_chars, base_failed, kept and cleaned (the kept lines).

    base_failed: under 50 words, or over half of them in repeated 3-word windows. A text that is null, empty or
    without words has all counts 0, is base_failed and not kept. A very long text is judged whole. Repeated rows are
    judged alike, each on its own, and an empty table has none. Columns of docs that have the names of results are
    replaced; any others, whatever their names, stay.

    The results hang on a row number, which is not deterministic, so that the optimizer leaves a filter on them above
    the measures instead of copying these, each array once for each of its elements.
    """
    kept_chars = F.aggregate(
        F.transform("_lines", lambda x: F.length(F.translate(x, native.SPACE, ""))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    results = (*MEASURES, "cleaned")
    renamed, own = native.aside(docs)
    found = (
        measured(renamed.withColumn("text", own["text"]))
        .withColumn("kept_chars", kept_chars)
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (100 * F.col("kept_chars") >= min_kept * F.col("word_chars")))
        .withColumn("cleaned", F.array_join("_lines", "\n"))
    )
    others = [column.alias(c) for c, column in own.items() if c not in results]
    return found.select(*others, *[F.when(F.monotonically_increasing_id() >= 0, F.col(c)).alias(c) for c in results])


def apply_rules(docs: DataFrame, min_kept: int = MIN_KEPT) -> DataFrame:
    """The documents that are not rejected, cleaned: text has the kept lines alone, and n_chars, if there, follows it.

    The columns are those of docs, and the others of them, whatever their names, are as they were.
    """
    renamed, own = native.aside(docs, "_doc")
    found = judged(renamed.withColumn("text", own["text"]), min_kept).where("kept")
    out = own | {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    return found.select(*[column.alias(c) for c, column in out.items()])


def op4(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", *MEASURES)


OP4_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT r, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM base
), kinds AS (
  SELECT r, line, count(*) AS c,
         regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS l FROM lines GROUP BY r, line
), by_line AS (
  SELECT r, sum(c - 1) AS dup, sum(CASE WHEN right(l, 1) IN ({", ".join("'" + x.replace("'", "''") + "'" for x in SENTENCE_ENDS)})
      AND 30 * (length(l) - length(translate(l, '{NAVIGATION}', ''))) < length(l)
      AND 5 * (length(l) - length(translate(l, '{SYMBOLS}', ''))) < length(l)
      AND (length(l) < 20 OR 5 * (length(l) - length(translate(l, '{CAPITALS}', ''))) < 2 * length(l))
      AND NOT regexp_matches(lower(l), '{BOILERPLATE}')
      THEN length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) ELSE 0 END) AS kept_chars
  FROM kinds GROUP BY r
), windows AS (
  SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), often AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM windows) WHERE c > 1
), spans AS (
  SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM often) GROUP BY r
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM base LEFT JOIN by_line USING (r) LEFT JOIN spans USING (r)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * kept_chars >= {MIN_KEPT} * word_chars AS kept, kept_chars FROM failed
"""
