"""Recognised text: clean-up, similarity, parsing, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def post_process(text: Column) -> Column:
    """Normalises line ends and blanks, keeps tokens with a letter or digit, drops empty lines, capitalises lines."""
    t = F.regexp_replace(F.trim(text), "\r\n", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, " *\n *", "\n")
    lines = F.transform(F.split(t, "\n"), lambda line: F.array_join(F.filter(F.split(F.trim(line), " +"), lambda w: w.rlike(r"[\p{L}\d]")), " "))
    kept = F.filter(lines, lambda line: F.length(line) > 0)
    return F.array_join(F.transform(kept, lambda line: F.concat(F.upper(F.substring(line, 1, 1)), line.substr(F.lit(2), F.length(line)))), "\n")


def clamp_confidence(c: Column) -> Column:
    """0..100 to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / 100))


def clue_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, after lower-casing and without dots, commas and semicolons; equal: 1, empty: 0."""
    clean = lambda c: F.regexp_replace(F.trim(F.lower(c)), "[.,;]", "")
    x, y = clean(a), clean(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longer)


def sequence_string(labels: Column) -> Column:
    """An array of labels (null is a symbol) as a string of one character each, so that levenshtein() compares sequences."""
    return F.array_join(F.transform(labels, lambda n: F.char(F.lit(64) + F.coalesce(n, F.lit(0)))), "")


def hocr_words(html: Column) -> Column:
    """Array of structs (y0, y1, confidence, text) of the recognised words in hOCR mark-up."""
    word = r"<span class='ocrx_word'[^>]*title='bbox \d+ (\d+) \d+ (\d+); x_wconf (\d+)'[^>]*>([^<]*)</span>"
    part = lambda i: F.regexp_extract_all(html, F.lit(word), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("y0"), part(2).alias("y1"), part(3).alias("c"), part(4).alias("t")), lambda z: F.struct(z["y0"].cast("int").alias("y0"), z["y1"].cast("int").alias("y1"), z["c"].cast("double").alias("confidence"), z["t"].alias("text")))


def log_line(line: Column) -> Column:
    """(number, text, confidence) of a run's log line for a clue."""
    pattern = 'pista (\\d+): "([^"]*)" conf=(\\d+)%'
    return F.struct(*[F.nullif(F.regexp_extract(line, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(("number", "text", "confidence"))])


def elapsed(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def byte_size(n: Column) -> Column:
    """Bytes in the largest unit below them."""
    units = ("Bytes", "KB", "MB", "GB")
    power = F.least(F.lit(len(units) - 1), F.floor(F.log(1024.0, F.greatest(n, F.lit(1)))))
    value = F.regexp_replace(F.format_string("%.2f", n / F.pow(F.lit(1024.0), power)), r"\.?0+$", "")
    return F.when(n == 0, F.lit("0 Bytes")).otherwise(F.concat(value, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), (power + 1).cast("int"))))


def letter_input(x: Column) -> Column:
    """The last letter typed, upper-case."""
    return F.right(F.regexp_replace(F.upper(x), "[^A-ZÀ-Ü]", ""), F.lit(1))


def reason_prefix(reason: Column) -> Column:
    return F.substring_index(reason, "(", 1)


def file_stamp(t: Column) -> Column:
    return F.replace(t, F.lit(":"), F.lit("-"))


def label_line(line: Column) -> Column:
    """(file, label) of ``file,label``; null unless there are exactly two fields and the label is a number."""
    parts = F.split(line, ",", -1)
    label = F.trim(F.get(parts, F.lit(1))).try_cast("int")
    return F.when((F.size(parts) == 2) & label.isNotNull(), F.struct(F.trim(parts[0]).alias("file"), label.alias("label")))


def ctc_encode(s: Column, alphabet: str = "0123456789", width: int = 4) -> Column:
    """Place of each character in the alphabet, from 1, filled with zeros to ``width``."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c))
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), width)), 1, width)
