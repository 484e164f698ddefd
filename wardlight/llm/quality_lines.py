"""Line-first cleaning: rules drop lines, and a text that loses too much of itself is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlight.llm.common import BLANK_CHARS, BLANKS, let, present, words

#: Marks that end a sentence (closing quotes and brackets may follow),
#: separators of menus, and phrases of page furniture.
SENTENCE_END = r"[.!?\x{2026}:;][\"'\x{201D}\x{2019}\x{00BB})\]]*[\x20\x09-\x0D]*\z"
LOUD_WORD = r"(?:[#*$%&|<>]|!!|\?\?)[.,]?(?:[\x20\x09-\x0D]|\z)"
MENU_MARKS = "|›»•·>"
FURNITURE = (r"(?i)javascript|cookie|all rights reserved|terms of (use|service)|privacy policy|sign (in|up)|log ?in"
             r"|click here|read more|subscribe|share (this|on)|skip to (main )?content|lorem ipsum|powered by")
SYMBOLS = "#*$%&|<>"

#: Production parameters.
MENU_WORDS = 12          # a line without an end mark and of so few words is navigation
WRAP_CHARS = 40          # unless it has so many characters and text follows: prose wrapped in short lines
LOUD_SHARE = 0.30        # of a line's words may end in a symbol, "!!" or "??"
MAX_LOST = 0.50          # share of word characters that may go before the text is rejected
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _chars_of(text: Column, chars: str) -> Column:
    """How many characters of `text` are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANK_CHARS, ""))


def _blank(text: Column) -> Column:
    """Whether `text` has no word character; looks no further than the first one."""
    return F.ltrim(text, F.lit(BLANK_CHARS)) == ""


def _wrapped(line: Column, following: Column) -> Column:
    """Whether the next line carries this one on: a long line, then directly a long or a closing one."""
    goes_on = (F.length(following) >= WRAP_CHARS) | following.rlike(SENTENCE_END)
    return (F.length(line) >= WRAP_CHARS) & F.coalesce(goes_on & ~_blank(following), F.lit(False))


def line_passes(line: Column, following: Column) -> Column:
    """Whether a line with words survives the punctuation, navigation and furniture rules.

    `following` is the next line, null for the last one.

    * punctuation: it ends in a sentence mark, has more than MENU_WORDS words or is wrapped (of
      WRAP_CHARS characters, the next line as long or ending in a mark), and at most
      LOUD_SHARE of its words end in a symbol or a doubled "!" or "?";
    * navigation: fewer menu marks than a third of its words;
    * furniture: none of the stock phrases.
    """
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    loud = F.regexp_count(line, F.lit(LOUD_WORD))
    ends = line.rlike(SENTENCE_END) | (n > MENU_WORDS) | _wrapped(line, following)
    few_marks = F.when(line.rlike(f"[{MENU_MARKS}]"), _chars_of(line, MENU_MARKS) * 3 < n).otherwise(n > 0)
    return ends & (loud <= n * F.lit(LOUD_SHARE)) & few_marks & ~line.rlike(FURNITURE)


def clean_text(text: Column) -> Column:
    """`text` without the lines that fail; blank lines stay where they are."""
    def kept(lines: Column) -> Column:
        return F.filter(lines, lambda x, i: _blank(x) | line_passes(x, F.get(lines, i + 1)))

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def repeated_words(tokens: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window found twice or more (the first one included).

    Window hashes are sorted as plain longs; only where two are equal are they sorted
    again with their positions, and the gaps between repeated windows are summed. All
    steps are n log n in the words of one text.
    """
    count = F.size(tokens)
    starts = F.sequence(F.lit(0), count - n)

    def covered(spots: Column) -> Column:
        gaps = F.transform(spots, lambda p, i: F.least(
            F.coalesce(F.get(spots, i + 1) - p, F.lit(n)), F.lit(n)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def spots(pairs: Column) -> Column:
        same = lambda x, i, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, i: F.when(i > 0, same(x, i, i - 1)).otherwise(False) | same(x, i, i + 1))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def search(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(let(pairs, spots), covered)

    def hashed(ws: Column) -> Column:
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)]))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(search(h)))

    return F.when(count < n, F.lit(0)).otherwise(let(tokens, hashed))


def line_quality(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Add the base statistics, `cleaned` and `kept` to every row of `docs`.

    Columns added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, cleaned, lost (share of word characters removed) and kept. Columns of
    `docs` with these names are replaced. A null or empty text has no words, fails the base
    rule and is not kept; its `cleaned` is empty and `lost` 0. Repeated rows are judged
    alike; very long lines are evaluated whole. The plan is narrow: no shuffle.
    """
    whole = present(text)
    base = docs.withColumn("__words", words(whole))
    lines = F.filter(F.split(whole, "\n"), lambda x: ~_blank(x))
    base = base.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": _word_chars(whole).cast("long"),
        "n_symbols": _chars_of(whole, SYMBOLS).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")).cast("long"),
        "cleaned": clean_text(whole),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.when(F.col("cleaned") != whole, 1 - F.try_divide(_word_chars(F.col("cleaned")), F.col("word_chars")))
    base = base.withColumns({"base_failed": failed, "lost": F.coalesce(lost, F.lit(0.0))})
    return base.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost)).drop("__words")


__all__ = ["BLANKS", "clean_text", "line_passes", "line_quality", "repeated_words"]
