"""Text scalars as native Column expressions (no Python on the row path).

X1 ``clean_html``  HTML -> lower-case ASCII text
X2 ``lower``       (pyspark.sql.functions.lower)
X3 literal replace, one left-to-right non-overlapping pass
X4 drop all but ASCII letters, digits and (Unicode) whitespace
X5 ``tokens``      runs of two or more word characters, lower-cased
M1 ``phrase_tokens`` words of skill phrases and of the texts tagged with them
X6 ``ngrams``      contiguous word n-grams inside one text
X12 ``join_terms`` array -> text with a separator
X13 ``or_empty``   NULL -> ""
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written; results depend on them)
# ---------------------------------------------------------------------------
# Word characters of the tokenizer: letters, numbers, underscore; a token is a
# run of two or more of them (one-letter words are dropped).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"

# Whitespace as Python's str.isspace() defines it (the cleaning step keeps it):
# U+0009-U+000D, U+001C-U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE_CLASS = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Everything that is not an ASCII letter, digit or whitespace is deleted.
ALNUM_OR_SPACE_RUN = "[a-zA-Z0-9" + PY_WHITESPACE_CLASS + "]+"

# HTML pieces removed before text extraction: script / style / template
# bodies, comments, then any tag or declaration (`<` + letter, `/`, `!`, `?`).
SCRIPT_BODY = r"(?is)<script(\s[^>]*)?>.*?</script\s*>"
STYLE_BODY = r"(?is)<style(\s[^>]*)?>.*?</style\s*>"
TEMPLATE_BODY = r"(?is)<template(\s[^>]*)?>.*?</template\s*>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[a-zA-Z/!?][^>]*>"
# A character reference right after its `&`: decimal, hexadecimal, named.
DECIMAL_REF = r"^#([0-9]{1,7});?"
HEX_REF = r"^#[xX]([0-9a-fA-F]{1,6});?"
NAMED_REF = r"^([a-zA-Z][a-zA-Z0-9]*);"
# Named references that decode to whitespace or to `&`; every other named reference decodes to
# punctuation or a non-ASCII character, which X4 deletes anyway.
NAMED_CHARS = {
    "amp": "&", "AMP": "&", "Tab": "\t", "NewLine": "\n", "nbsp": "\u00a0", "NonBreakingSpace": "\u00a0",
    "ensp": "\u2002", "emsp": "\u2003", "emsp13": "\u2004", "emsp14": "\u2005", "numsp": "\u2007",
    "puncsp": "\u2008", "thinsp": "\u2009", "ThinSpace": "\u2009", "hairsp": "\u200a",
    "VeryThinSpace": "\u200a", "MediumSpace": "\u205f",
}
# Code points a numeric reference may decode to that survive X4 or become `and`: tab, line feed, form
# feed, carriage return, printable ASCII, and the whitespace above U+009F. Other controls are not
# characters of HTML, U+0080-U+009F stand for Windows-1252 punctuation, the rest is deleted by X4.
NUMERIC_WHITESPACE = (0x9, 0xA, 0xC, 0xD, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Words of the skill dictionary: runs of one or more word characters with any closing + or # (C, R, C++, C#) and
# a dot, number or at sign before them that opens a text or follows white space (.NET).
LEAD = r"(?:(?<![^ \t\n\f\r])[.#@])?"
PHRASE_TOKEN = LEAD + r"[\p{L}\p{N}_]+[+#]*"
# Words with &, dot or hyphen inside, kept whole; and what tells a phrase that must be met in that form: & or a dot
# between words (R&D, Node.js), or a hyphen beside a one-letter word (e-learning).
COMPOUND_TOKEN = LEAD + r"[\p{L}\p{N}_]+(?:[&.-][\p{L}\p{N}_]+)*[+#]*"
W = r"[\p{L}\p{N}_]"
COMPOUND = f"{W}[&.]{W}|(?<!{W}){W}-{W}|{W}-{W}(?!{W})"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_replace(c, search: str, repl: str) -> Column:
    """Replace every non-overlapping occurrence, left to right, once."""
    return F.replace(_c(c), F.lit(search), F.lit(repl))


def strip_non_alnum(c) -> Column:
    """Keep ASCII letters, digits and whitespace (Python's notion of it).

    The runs that stay are joined: a third of the time of replacing what goes, character by character."""
    return F.array_join(F.regexp_extract_all(_c(c), F.lit(ALNUM_OR_SPACE_RUN), F.lit(0)), "")


def _decoded(part: Column) -> Column:
    """One piece of text that followed a `&`: its leading character reference decoded, once."""
    number = F.coalesce(F.when(part.rlike(DECIMAL_REF), F.regexp_extract(part, DECIMAL_REF, 1).cast("bigint")),
                        F.when(part.rlike(HEX_REF), F.conv(F.regexp_extract(part, HEX_REF, 1), 16, 10).cast("bigint")))
    space = F.element_at(F.create_map(*[F.lit(v) for n in NUMERIC_WHITESPACE for v in (n, chr(n))]), number.cast("int"))
    char = F.when(number.between(0x20, 0x7E), F.chr(number)).otherwise(F.coalesce(space, F.lit("")))
    after_number = F.regexp_replace(F.regexp_replace(part, DECIMAL_REF, ""), HEX_REF, "")
    named = F.element_at(F.create_map(*[F.lit(v) for kv in NAMED_CHARS.items() for v in kv]),
                         F.regexp_extract(part, NAMED_REF, 1))
    return (F.when(number.isNotNull(), F.concat(char, after_number))
             .when(part.rlike(NAMED_REF), F.concat(F.coalesce(named, F.lit("")), F.regexp_replace(part, NAMED_REF, "")))
             .otherwise(F.concat(F.lit("&"), part)))


def html_text(c) -> Column:
    """Visible text of an HTML fragment, character references decoded.

    Script, style and template bodies and comments are not text. Numeric references decode to ASCII and
    whitespace characters, named ones to whitespace or `&`; all others decode to characters X4 deletes
    and are dropped here. What a reference decodes to is not read again (`&amp;lt;` is `&lt;`).
    """
    x = _c(c)
    for pat in (SCRIPT_BODY, STYLE_BODY, TEMPLATE_BODY, COMMENT, TAG):
        x = F.regexp_replace(x, pat, "")
    return F.array_join(F.transform(F.split(x, "&"), lambda part, i: F.when(i == 0, part).otherwise(_decoded(part))), "")


def clean_html(c) -> Column:
    """HTML -> lower-case ASCII text, in the reference's step order.

    1. text of the document (html_text); 2. `&` -> `and`; 3. X4;
    4. two newlines -> space; 5. newline -> space; 6. two spaces -> one space,
    a single pass (three spaces leave two); 7. lower case.

    Known differences from a full HTML parser: named references without `;`, a `<`
    followed by a letter in plain text, `>` inside attribute values.
    """
    x = html_text(c)
    x = literal_replace(x, "&", "and")
    x = strip_non_alnum(x)
    x = literal_replace(x, "\n\n", " ")
    x = literal_replace(x, "\n", " ")
    x = literal_replace(x, "  ", " ")
    return F.lower(x)


def tokens(c) -> Column:
    """Array of lower-cased tokens (runs of >= 2 word characters), in text order.

    Computed as: split on runs of non-word characters, keep pieces of length
    >= 2 -- the same maximal runs TOKEN_PATTERN extracts, about a third cheaper.
    """
    return F.filter(F.split(F.lower(_c(c)), NON_WORD_RUN), lambda x: F.length(x) >= 2)


def phrase_tokens(c) -> Column:
    """M1: array of lower-cased dictionary words, in text order: one-letter words, closing + and #, and a
    leading dot, # or @ after white space included."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(PHRASE_TOKEN), F.lit(0))


def compound_tokens(c) -> Column:
    """M1: the same with words joined by &, dot or hyphen as one word."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(COMPOUND_TOKEN), F.lit(0))


def is_compound(c) -> Column:
    """M1: is the phrase to be met in its joined form (``COMPOUND``)?"""
    return _c(c).rlike(COMPOUND)


def ngrams(tok, n: int) -> Column:
    """Contiguous n-grams of a token array, joined by one space.

    Built by zipping n shifted slices, so the cost is linear in the number of
    tokens and no lambda re-evaluates the token expression. Fewer than ``n``
    tokens gives an empty array; n = 1 returns the tokens.
    """
    t = _c(tok)
    if n == 1:
        return t
    m = F.greatest(F.size(t) - F.lit(n - 1), F.lit(0))
    acc = F.slice(t, F.lit(1), m)
    for j in range(2, n + 1):
        acc = F.zip_with(acc, F.slice(t, F.lit(j), m), lambda x, y: F.concat(x, F.lit(" "), y))
    return acc


def join_terms(arr, sep: str = ", ") -> Column:
    """Join an array of strings (NULL elements skipped)."""
    return F.array_join(_c(arr), sep)


def or_empty(c) -> Column:
    """NULL -> empty text."""
    return F.coalesce(_c(c), F.lit(""))
