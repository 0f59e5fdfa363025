"""Text columns: UTF-8, lines, reproducible random text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaygauge.functions.numbers import int_div

def utf8_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def utf8_text(value: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD instead of failing the job."""
    return F.make_valid_utf8(value.cast("string"))


def faithful_text(value: Column) -> Column:
    """Bytes as text that differs where they do: U+FFFD and the bytes in hexadecimal where they are
    no UTF-8, or begin as such a text would."""
    text = value.cast("string")
    plain = F.is_valid_utf8(text) & ~F.startswith(text, F.lit("\ufffd"))
    return F.when(value.isNotNull(), F.when(plain, text).otherwise(F.concat(F.lit("\ufffd"), F.hex(value))))


def _with_newlines(text: Column) -> Column:
    """Every kind of line break as a newline, so that lines split on one character."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    """Lines of a text as a line reader yields them: inner empty lines stay, the empty
    rest after a final line break does not."""
    broken = _with_newlines(text)
    body = F.when(broken.endswith("\n"), F.left(broken, F.char_length(broken) - 1)).otherwise(broken)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def count_lines(text: Column) -> Column:
    """The number of lines, without making them."""
    broken = _with_newlines(text)
    breaks = F.octet_length(broken) - F.octet_length(F.replace(broken, F.lit("\n"), F.lit("")))
    rest = ((text != "") & ~broken.endswith("\n")).cast("int")
    return breaks + rest


def hashed_length(seed: str, row_id: Column, shortest: int, longest: int) -> Column:
    """A length in [shortest, longest], uniform over row ids and the same on every run."""
    if not 0 <= shortest <= longest:
        raise ValueError("lengths must satisfy 0 <= shortest <= longest")
    word = F.substring(F.md5(F.concat_ws(":", F.lit(seed), row_id.cast("string"))), 1, 8)
    return F.lit(shortest) + F.conv(word, 16, 10).cast("bigint") % (longest - shortest + 1)


def hashed_text(seed: str, row_id: Column, length: Column) -> Column:
    """Printable text of a given length, made of one digest per 32 characters."""
    blocks = F.transform(
        F.sequence(F.lit(0).cast("bigint"), int_div(F.greatest(length, F.lit(1)) - 1, 32)),
        lambda block: F.md5(F.concat_ws(":", F.lit(seed), row_id.cast("string"), block.cast("string"))),
    )
    return F.substr(F.array_join(blocks, ""), F.lit(1), length.cast("int"))
