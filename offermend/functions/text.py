"""Text keys and clean-ups as Column expressions.

Everything here stays in the JVM. Unicode decomposition and case folding come from the ICU
classes Spark ships; strings that are plain ASCII skip them.
"""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# A character the reference's \w accepts, and the white space its \s and strip() accept.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f"
STRIP_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once, for expressions that mention their input many times."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _code_point_class(keep) -> str:
    """Java character class of all code points for which ``keep`` holds, as ranges."""
    parts, start, last = [], None, None
    for cp in range(sys.maxunicode + 1):
        if keep(chr(cp)):
            if start is None:
                start = cp
            last = cp
        elif start is not None:
            parts.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}" if last > start else f"\\x{{{start:X}}}")
            start = None
    return "[" + "".join(parts) + "]"


# Code points with a non-zero combining class: what "drop combining marks" means here. The quick
# category test comes first, so other characters never walk the long class.
COMBINING = r"\p{M}(?<=" + _code_point_class(lambda ch: unicodedata.combining(ch) != 0) + ")"


def is_ascii(c: Column | str) -> Column:
    c = _col(c)
    return F.length(c) == F.octet_length(c)


def _decompose(c: Column, compat: bool) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(compat))


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(STRIP_CHARS))


def collapse_spaces(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), f"(?U)[{SPACE}]+", " "))


def null_if_blank(c: Column | str) -> Column:
    """Null for the spellings of a missing cell: blank, ``nan`` and ``None``."""
    c = _col(c)
    return F.when(strip(c).isin("", "nan", "None"), None).otherwise(c)


def truthy(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string").isin("1", "True", "true", "yes", "1.0"), F.lit(False))


def drop_marks(c: Column | str) -> Column:
    """Compatibility-decomposed text without combining marks."""
    c = _col(c)
    return F.when(is_ascii(c), c).when(c.isNotNull(), F.regexp_replace(_decompose(c, True), COMBINING, ""))


def norm_text(c: Column | str) -> Column:
    """Compatibility-decompose, drop combining marks, lower, strip."""
    return strip(F.lower(drop_marks(c)))


def casefold(c: Column | str) -> Column:
    c = _col(c)
    return F.when(is_ascii(c), F.lower(c)).when(
        c.isNotNull(), F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    )


def norm_char_name(c: Column | str, keep_accents: bool = False) -> Column:
    """Key of an attribute name: spaces collapsed, trailing colons dropped, case folded."""
    folded = casefold(strip(F.rtrim(collapse_spaces(c), F.lit(":"))))
    return folded if keep_accents else norm_text(folded)


def norm_color(c: Column | str) -> Column:
    """Colour key: accents dropped, separators to spaces, other punctuation removed."""
    spaced = F.regexp_replace(drop_marks(F.lower(strip(_col(c)))), r"[-/_.,;:]+", " ")
    return collapse_spaces(F.regexp_replace(spaced, f"(?U)[^{WORD}{SPACE}]", ""))


def norm_title(c: Column | str) -> Column:
    """Title key: accents dropped, punctuation to spaces."""
    c = F.lower(strip(_col(c)))
    bare = F.when(is_ascii(c), c).when(c.isNotNull(), F.regexp_replace(_decompose(c, False), r"\p{Mn}", ""))
    return collapse_spaces(F.regexp_replace(bare, f"(?U)[^{WORD}{SPACE}]", " "))


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: Column | str) -> Column:
    """Double for a plain decimal text, else null (no type suffixes, no infinities)."""
    return bound(strip(_col(c)), lambda s: F.when(s.rlike(NUMBER), s.try_cast("double")))


def norm_id(c: Column | str) -> Column:
    """Identifier text: blank to null, numbers to their integer part, the rest stripped."""
    c = null_if_blank(_col(c).cast("string"))
    number = to_number(c)
    return F.when(number.isNotNull(), number.cast("long").cast("string")).otherwise(strip(c))


def slug(c: Column | str, default: str = "marketplace") -> Column:
    s = F.btrim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", F.lit(default)).otherwise(s)


def strip_tags(c: Column | str) -> Column:
    """Markup removed by pattern only: every tag becomes one space."""
    return collapse_spaces(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "<[^>]+>", " "))


def error_code(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(strip(_col(c)), "^([0-9]+)", 1), F.lit(""))


def size_from_title(c: Column | str) -> Column:
    """Text after the last ' - ' of a title."""
    c = _col(c)
    tail = strip(F.substring_index(c, " - ", -1))
    return F.when(F.instr(c, " - ") > 0, F.nullif(tail, F.lit("")))


def _drop_zeros(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def compact_number(x: Column) -> Column:
    """Six significant digits without trailing zeros; exponent form outside 1e-4 .. 1e6."""
    return bound(x, _compact_number)


def _compact_number(x: Column) -> Column:
    size = F.abs(x)
    out = F.when(size == 0, F.lit("0"))
    for limit, digits in ((1e-3, 9), (1e-2, 8), (1e-1, 7), (1.0, 6), (1e1, 5), (1e2, 4), (1e3, 3), (1e4, 2), (1e5, 1)):
        rounds_up = limit - 0.5 * 10.0**-digits
        out = out.when((size >= 1e-4) & (size < rounds_up), _drop_zeros(F.format_string(f"%.{digits}f", x)))
    out = out.when((size >= 1e-4) & (size < 999999.5), F.format_string("%.0f", x))
    exponent = F.format_string("%.5e", x)
    return out.otherwise(
        F.concat(_drop_zeros(F.substring_index(exponent, "e", 1)), F.lit("e"), F.substring_index(exponent, "e", -1))
    )


def size_format(c: Column | str) -> Column:
    """``42,5`` to ``42.5 EU`` for a size between 1 and 200, else null."""
    number = to_number(F.replace(_col(c), F.lit(","), F.lit(".")))
    return bound(number, lambda n: F.when(n.between(1, 200), F.concat(_compact_number(n), F.lit(" EU"))))


def word_pattern(*words: str) -> str:
    """Pattern that finds any of the words as a whole word."""

    def bounded(word: str) -> str:
        before = "(?<![%s])" if re.match(r"\w", word[0]) else "(?<=[%s])"
        after = "(?![%s])" if re.match(r"\w", word[-1]) else "(?=[%s])"
        return before % WORD + "\\Q" + word + "\\E" + after % WORD

    return "|".join(bounded(w) for w in words)


def word_match(c: Column | str, *words: str) -> Column:
    """True if the lower-cased text holds one of the words."""
    return F.lower(_col(c)).rlike(word_pattern(*words))


def title_key(title: Column | str, marketplace: Column) -> Column:
    return F.md5(F.concat(marketplace, F.lit("|"), F.lower(strip(_col(title)))))


def char_request_key(title, category, marketplace, missing: Column) -> Column:
    """Key of a request for attributes: the missing names count as a set."""
    return F.md5(
        F.concat(marketplace, F.lit("|"), F.lower(strip(_col(title))), F.lit("|"), _col(category), F.lit("|"),
                 F.array_join(F.sort_array(missing), ","))
    )


def done_key(title, category, marketplace) -> Column:
    return F.md5(F.concat(F.lit("done|"), marketplace, F.lit("|"), F.lower(strip(_col(title))), F.lit("|"), _col(category)))


def url_key(url) -> Column:
    return F.md5(strip(_col(url)))


def checkpoint_key(marketplace, filename) -> Column:
    text = F.concat(F.lower(strip(_col(marketplace))), F.lit("|"), F.lower(strip(_col(filename))))
    return F.substring(F.md5(text), 1, 12)


def sanitize(c: Column | str, max_len: int | None = None) -> Column:
    """Text safe inside a quoted request: one line, quotes escaped, cut at ``max_len`` if one is given."""
    one_line = F.translate(F.coalesce(_col(c), F.lit("")), "\n\r", "  ")
    safe = F.replace(one_line, F.lit('"'), F.lit('\\"'))
    return safe if max_len is None else F.substring(safe, 1, max_len)


LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}).*?\[(\w+)\]\s+(.*)"


def log_line_parse(c: Column | str) -> Column:
    """Struct (ts, level, message) of an application log line, null if it is not one."""
    c = _col(c)
    return F.when(
        c.rlike(LOG_LINE),
        F.struct(*[F.regexp_extract(c, LOG_LINE, i + 1).alias(n) for i, n in enumerate(("ts", "level", "message"))]),
    )


def url_guard(c: Column | str) -> Column:
    """Reason why the first url of a comma list must not be fetched, null if it may.

    Only literal IPv4 hosts are judged; names are not resolved.
    """
    url = strip(F.element_at(F.split(F.coalesce(_col(c), F.lit("")), ","), 1))
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    private = host.rlike(
        r"^(localhost|0\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|127\.\d+\.\d+\.\d+|169\.254\.\d+\.\d+|192\.168\.\d+\.\d+"
        r"|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|192\.0\.0\.\d+|192\.0\.2\.\d+|198\.1[89]\.\d+\.\d+|198\.51\.100\.\d+"
        r"|203\.0\.113\.\d+|2[4-5]\d\.\d+\.\d+\.\d+)$"
    )
    return (
        F.when(~scheme.isin("http", "https"), F.lit("scheme"))
        .when(host == "", F.lit("host"))
        .when(private, F.lit("private"))
    )


def display_name(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(":"))
