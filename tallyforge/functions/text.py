"""Text expressions: tokens, code lines, display of names, durations and shortened strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that are tokens of their own, and the white space between tokens.
DELIMITERS = "(){}[]<>;:,.=+-*/&|!?@#"
WHITE_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CLASS = "".join("\\" + c for c in DELIMITERS)
TOKEN_PATTERN = f"[{_CLASS}]|[^{_CLASS}{WHITE_SPACE}]+"


def tokens(text: Column) -> Column:
    """Words between white space, with each delimiter as a token of its own."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their ends; an end of line at the very end opens no further line."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(text == "", F.slice(parts, 1, 0)).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def code_lines(text: Column) -> Column:
    """Lines that hold code: not blank, not a ``//`` comment, not inside a block comment that starts a line.

    A block comment that opens in mid-line opens nothing; text after its end on the same line counts.
    """

    def step(acc: Column, raw: Column) -> Column:
        line = F.trim(F.regexp_replace(raw, "[\t\r\x0b\x0c]", " "))
        opens = line.startswith("/*")
        inside = acc["inside"] | opens
        close = F.instr(F.when(acc["inside"], line).otherwise(F.substr(line, F.lit(3))), "*/")
        rest = F.when(acc["inside"], F.substr(line, close + 2)).otherwise(F.substr(line, close + 4))
        rest = F.trim(rest)
        code = lambda s: (s != "") & ~s.startswith("//")
        counts = F.when(inside, (close > 0) & code(rest)).otherwise(code(line))
        return F.struct((inside & (close == 0)).alias("inside"), (acc["n"] + counts.cast("bigint")).alias("n"))

    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(lines(text), zero, step, lambda acc: acc["n"])


def scope_names(path: Column, kind: str | None = None) -> Column:
    return F.transform(F.filter(path, lambda s: s["kind"] == kind) if kind else path, lambda s: s["name"])


def module_path(path: Column) -> Column:
    return F.array_join(scope_names(path, "module"), "::")


def scope_label(segment: Column) -> Column:
    short = F.when(segment["kind"] == "module", "mod ").when(segment["kind"] == "type", "type ").otherwise("fn ")
    return F.concat(short, segment["name"])


def clip(text: Column, width: int) -> Column:
    return F.left(text, F.lit(width))


def ellipsize(text: Column, width: int) -> Column:
    if width <= 0:
        return F.lit("")
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.left(text, F.lit(width - 1)), F.lit("…")))


def fit(prefix: Column, body: Column, suffix: Column, width: int) -> Column:
    """Prefix and body from the left, suffix at the right edge; the body gives way first."""
    room = F.greatest(F.lit(width) - F.length(prefix) - F.length(suffix), F.lit(0))
    shown = F.when(F.length(body) <= room, body).when(room > 0, F.concat(F.left(body, room - 1), F.lit("…"))).otherwise("")
    return F.concat(prefix, F.rpad(shown, room, " "), suffix)


def clock(seconds: Column) -> Column:
    """``~H:MM:SS`` from an hour on, else ``~M:SS``."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    return F.when(s >= 3600, F.concat(F.lit("~"), h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(F.lit("~"), F.floor(s / 60).cast("string"), F.lit(":"), two(r)))


def compact_duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def hint(pairs: Column) -> Column:
    """``key:action`` pairs joined by two blanks."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(":"), p["action"])), "  ")


#: Names under which a language of snippets is also known.
LANGUAGES = {
    "csharp": "c#",
    "golang": "go",
    "js": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "jsx": "javascript",
    "py": "python",
    "rb": "ruby",
    "rs": "rust",
    "sh": "bourne again shell (bash)",
    "bash": "bourne again shell (bash)",
    "zsh": "bourne again shell (bash)",
    "yml": "yaml",
    "md": "markdown",
    "dockerfile": "docker",
    "tf": "terraform",
    "proto": "protobuf",
    "el": "lisp",
    "elisp": "lisp",
}


def language(name: Column) -> Column:
    """The language a name stands for, in lower case; an unknown name stands for itself."""
    low = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), low), low)


#: Characters that take two columns: East Asian wide and full-width blocks, and pictographs.
_WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}\x{20000}-\x{3FFFD}]"


def display_width(text: Column) -> Column:
    """Columns that a text takes on a screen."""
    return F.length(text) + F.regexp_count(text, F.lit(_WIDE))


def clip_width(text: Column, width: int) -> Column:
    """As much of the text as fits into ``width`` columns; a wide character that would stick out is left out."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    grown = F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(0).alias("w")), lambda a, c: F.when(a["w"] + display_width(c) <= width, F.struct(F.concat(a["t"], c).alias("t"), (a["w"] + display_width(c)).alias("w"))).otherwise(F.struct(a["t"].alias("t"), F.lit(width + 1).alias("w"))))
    return grown["t"]
