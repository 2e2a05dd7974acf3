"""Cleaning, cutting and chunking of whole texts, one row at a time, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import reference_data as ref


# Fixed value: the characters of Unicode's White_Space, which `(?U)\s` is.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: other characters that an ASCII letter meets when case does not count.
OTHER_CASES = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def trim_space(text: Column) -> Column:
    """Trim every kind of white space, as text tools do; SQL trim only knows the blank."""
    return F.btrim(text, F.lit(WHITE_SPACE))  # looks at the ends only


def _alternatives(pattern: str) -> tuple[list[str], int]:
    """What stands between the bars of a pattern, or of the group it is the rest of, and where that ends."""
    parts, start, i, depth, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        sign = pattern[i]
        if sign == "\\":
            i += 1
        elif in_class:
            in_class = sign != "]"
        elif sign == "[":
            in_class = True
        elif sign == "(":
            depth += 1
        elif sign == ")" and depth == 0:
            break
        elif sign == ")":
            depth -= 1
        elif sign == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:i]], i


def first_letters(pattern: str) -> str | None:
    """The ASCII letters one of which a match begins with; None where a match may begin otherwise."""
    found = ""
    for part in _alternatives(pattern)[0]:
        part = part.removeprefix(r"\b")
        if part.startswith("("):
            inner = part[3:] if part.startswith("(?:") else part[1:]
            end = _alternatives(inner)[1]
            letters = None if inner.startswith("?") else first_letters(inner[:end])
            following = inner[end + 1 : end + 2]
        else:
            letters, following = part[:1] if part[:1].isascii() and part[:1].isalpha() else None, part[1:2]
        if not letters or following in ("*", "?", "{"):
            return None
        found += letters
    return found


def started(pattern: str, flags: str = "iuU") -> str:
    """The pattern with its flags, behind a look at the next character, a cheap test that nearly every place of a text fails."""
    letters = first_letters(pattern)
    if letters is None:
        return f"(?{flags}){pattern}"
    cases = "".join(dict.fromkeys(c for a in letters.lower() for c in a + a.upper() + OTHER_CASES.get(a, "")))
    return f"(?=[{cases}])(?{flags}){pattern}"


def _plain(text: Column, removed: str) -> Column:
    """One blank for each run of white space; without the ASCII signs `removed` and without what is no word character beyond ASCII.

    Single blanks and characters that stay are not matched, so a text that is plain already is only read.
    """
    blanks = F.regexp_replace(trim_space(text), r"(?U)[\s&&[^ ]]\s*| \s+", " ")
    return F.regexp_replace(blanks, rf"(?U)[{removed}[^\x20-\x7e\w\s]]", "")


def clean_wide(text: Column) -> Column:
    """Collapse blanks, drop unusual signs, lower-case, normalise fiscal terms."""
    cleaned = F.lower(_plain(text, r"""!"#&'?\\^`{|}~"""))
    for pattern, replacement in ref.CLEAN_TERMS:
        cleaned = F.regexp_replace(cleaned, started(pattern), replacement)
    return trim_space(cleaned)


def clean_narrow(text: Column) -> Column:
    """As `clean_wide` with fewer signs kept, case left alone and plain replacements."""
    cleaned = _plain(text, r"""!"#&'*+<=>?@\[\\\]^`{|}~""")
    for old, new in ref.CLEAN_REPLACEMENTS:
        cleaned = F.replace(cleaned, F.lit(old), F.lit(new))
    return trim_space(cleaned)


def cut_at_sentence(text: Column, max_length: int) -> Column:
    """Whole sentences while the result so far plus the next one still fits."""
    sentences = F.split(text, r"[.!?]+", -1)
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, sentence: Column) -> Column:
        full = acc["full"] | (F.length(acc["kept"]) + F.length(sentence) > max_length)
        kept = F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], sentence, F.lit(".")))
        return F.struct(kept.alias("kept"), full.alias("full"))

    cut = F.aggregate(sentences, start, step, lambda acc: trim_space(acc["kept"]))
    return F.when(F.length(text) <= max_length, text).otherwise(cut)


def prefixed_query(text: Column) -> Column:
    """Search phrases about documents get a context prefix."""
    lowered = F.lower(text)
    about_documents = F.lit(False)
    for word in ref.QUERY_PREFIX_WORDS:
        about_documents = about_documents | lowered.contains(word)
    return F.when(about_documents, F.concat(F.lit(ref.QUERY_PREFIX), text)).otherwise(text)


def split_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of chunks: split long pieces by paragraph, sentence, word; merge greedily; repeat the last words.

    The overlap is counted in words (a fifth of `overlap`), so a chunk can be longer than `size`.
    """
    def cut(separator: str):
        # A lambda with a second parameter would be handed the element's index.
        return lambda p: F.when(F.length(p) > size, F.split(p, separator, -1)).otherwise(F.array(p))

    pieces = F.array(text)
    for separator in ["\n\n", r"\. ", " "]:
        pieces = F.flatten(F.transform(pieces, cut(separator)))
    words = int(overlap / 5)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

    def step(acc: Column, piece: Column) -> Column:
        current, done = acc["current"], acc["done"]
        empty = F.length(current) == 0
        fits = F.length(current) + F.length(piece) + 1 <= size
        tail_words = F.split(current, " ", -1)
        tail = F.array_join(F.slice(tail_words, F.greatest(F.size(tail_words) - (words - 1), F.lit(1)), words), " ")
        return F.struct(
            F.when(empty | fits, done).otherwise(F.array_append(done, current)).alias("done"),
            F.when(empty, piece)
            .when(fits, F.concat(current, F.lit(" "), piece))
            .otherwise(F.concat(tail, F.lit(" "), piece))
            .alias("current"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.length(acc["current"]) == 0, acc["done"]).otherwise(F.array_append(acc["done"], acc["current"]))

    chunks = F.aggregate(pieces, start, step, finish)
    return F.filter(chunks, lambda c: F.length(trim_space(c)) > 0)


def sentence_chunks(text: Column, size: int = 1000, overlap: int = 200, look_back: int = 100) -> Column:
    """Sliding window that ends at the first sentence end within its last `look_back` characters."""
    length = F.length(text)
    advance = size - overlap - look_back
    start = F.struct(
        F.array().cast("array<struct<from:int,until:int>>").alias("bounds"), F.lit(0).alias("at")
    )

    def step(acc: Column, _i: Column) -> Column:
        at = acc["at"]
        hard_end = F.least(at + size, length)
        window = F.substr(text, at + (size - look_back) + 1, F.lit(look_back + 1))
        offset = F.regexp_instr(window, F.lit(r"[.!?][ \n]"))
        snapped = F.when((hard_end < length) & (offset > 0), at + (size - look_back) + offset).otherwise(hard_end)
        bound = F.struct(at.alias("from"), snapped.alias("until"))
        following = F.when(snapped < length, snapped - overlap).otherwise(snapped)
        over = at >= length
        return F.struct(
            F.when(over, acc["bounds"]).otherwise(F.array_append(acc["bounds"], bound)).alias("bounds"),
            F.when(over, at).otherwise(following).alias("at"),
        )

    turns = F.sequence(F.lit(0), (F.ceil(length / advance) + 1).cast("int"))
    bounds = F.aggregate(turns, start, step, lambda acc: acc["bounds"])
    cut = F.transform(bounds, lambda b: trim_space(F.substr(text, b["from"] + 1, b["until"] - b["from"])))
    whole = F.when(length == 0, F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(length <= size, whole).otherwise(F.filter(cut, lambda c: F.length(c) > 0))


def fixed_chunks(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Windows of `size` characters that share `overlap` with their neighbour; blank ones are dropped."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last), lambda i: trim_space(F.substr(text, i * step + 1, F.lit(size)))
    )
    return F.filter(windows, lambda c: F.length(c) > 0)
