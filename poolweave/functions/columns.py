"""Scalar helpers as Column expressions; everything here stays inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def uniform(seed: int, salt: str, *keys: Column | str) -> Column:
    """Reproducible uniform draw in (0, 1) from the first 52 bits of an md5."""
    parts = [F.lit(str(seed)), F.lit(salt)] + [
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys
    ]
    digest = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    a = F.col(later) if isinstance(later, str) else later
    b = F.col(earlier) if isinstance(earlier, str) else earlier
    return (
        F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    ) / F.lit(3.6e9)


def age_years(intime: Column | str, born: Column | str) -> Column:
    """Years of 365 days; a birth date shifted past admission reads as 90."""
    years = hours_between(intime, born) / F.lit(24.0) / F.lit(365.0)
    return F.when(years < 0, F.lit(90.0)).otherwise(years)


def bin_count(hours: Column, step: float = 1.0) -> Column:
    return (hours / F.lit(step) + F.lit(1.0) - F.lit(EPS)).cast("int")


def bin_id(hours: Column, step: float = 1.0) -> Column:
    return (hours / F.lit(step) - F.lit(EPS)).cast("int")


def number(text: Column) -> Column:
    """Text to double, NULL on anything that is not a plain number."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def contains_any_case(text: Column, needle: str) -> Column:
    return F.coalesce(F.lower(text), F.lit("")).contains(needle)


def clean_note(text: Column) -> Column:
    """Lower-case a note and delete bracketed spans, list numbers and fixed headings."""
    body = F.regexp_replace(F.regexp_replace(text, "\n", " "), "\r", " ")
    body = F.lower(F.regexp_replace(body, r"(?U)^\s+|\s+$", ""))
    # Patterns and their replacements, applied in this order.
    steps = [
        (r"(?s)\[(.*?)]", ""),
        (r"[0-9]+\.", ""),
        (r"dr\.", "doctor"),
        (r"m\.d\.", "md"),
        (r"admission date:", ""),
        (r"discharge date:", ""),
        (r"--|__|==", ""),
    ]
    return reduce(lambda acc, s: F.regexp_replace(acc, s[0], s[1]), steps, body)


def diagnosis_group3(code: Column) -> Column:
    """Three-character diagnosis group, NULL where the code is too short."""
    tidy = F.upper(F.trim(code))
    head = F.substring(tidy, 1, 1)
    digits = F.regexp_replace(tidy, "[^0-9]", "")
    size = F.length(digits)
    return (
        F.when((head == "V") & (size >= 2), F.concat(head, F.substring(digits, 1, 2)))
        .when((head == "E") & (size >= 2), F.concat(head, F.substring(digits, 1, 3)))
        .when(head.isin("V", "E"), F.lit(None))
        .when(size >= 3, F.substring(digits, 1, 3))
    )


def variable_name(category: Column, description: Column) -> Column:
    """``category/description`` where a missing part prints as ``nan``."""
    return F.concat_ws(
        "/", F.coalesce(category, F.lit("nan")), F.coalesce(description, F.lit("nan"))
    )


def binary_entropy(p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))
    return -(q * F.log(q) + (F.lit(1.0) - q) * F.log(F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector scaled to length one; a zero vector stays zero."""
    size = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def blend(a: Column, b: Column, weight: Column | float) -> Column:
    """``weight * a + (1 - weight) * b`` element by element."""
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    return F.zip_with(
        a, b, lambda x, y: w * x.cast("double") + (F.lit(1.0) - w) * y.cast("double")
    )


def with_bias(a: Column) -> Column:
    """Append the constant 1 that carries a linear head's intercept."""
    return F.concat(F.transform(a, lambda x: x.cast("double")), F.array(F.lit(1.0)))


def coalition_members(mask: Column, modalities: int) -> Column:
    """Boolean array: is modality m part of the coalition bit mask?"""
    return F.array(
        *[F.shiftright(mask, m).bitwiseAND(F.lit(1)) == 1 for m in range(modalities)]
    )


def locale_number(text: Column) -> Column:
    """Number typed with accents, comma decimals or ``nao``; other text is an error."""
    # Accented letters and their plain forms.
    accented = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
    plain = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"
    tidy = F.regexp_replace(F.translate(F.trim(text), accented, plain), r"[^\x00-\x7F]", "")
    missing = tidy.isNull() | (tidy == "") | (F.lower(tidy) == "nao")
    tidy = F.when(F.upper(tidy) == "1O", F.lit("10")).otherwise(tidy)
    value = number(F.replace(tidy, F.lit(","), F.lit(".")))
    bad = F.raise_error(F.concat(F.lit("unsupported numeric value: "), text)).cast("double")
    return F.when(missing, F.lit(None).cast("double")).otherwise(F.coalesce(value, bad))


def category_text(text: Column, fold_case: bool = False) -> Column:
    tidy = F.trim(text)
    return F.lower(tidy) if fold_case else tidy


def token_list(text: Column) -> Column:
    """Comma list to sorted distinct lower-case tokens; empty and ``0`` are dropped."""
    parts = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), lambda t: F.trim(t))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: (t != "") & (t != "0"))))


def whole_number(text: Column) -> Column:
    """Strict integer parse: NULL unless the text is a finite whole number."""
    value = number(text.cast("string"))
    return F.when(value == F.floor(value), value.cast("bigint"))


def binary_flag(text: Column) -> Column:
    """1 or 0 for the four accepted spellings, NULL otherwise."""
    return F.when(text.isin("1", "1.0"), F.lit(1)).when(text.isin("0", "0.0"), F.lit(0))


# Token ids of the padding, start and separator tokens.
PAD_TOKEN, START_TOKEN, SEPARATOR_TOKEN = 0, 101, 102


def blank_tokens(length: int) -> dict[str, Column]:
    """Token arrays of a note that carries no content but keeps a two-token mask."""
    if length < 2:
        raise ValueError("a note needs room for its start and separator tokens")
    pad = F.array_repeat(F.lit(PAD_TOKEN), length - 2)
    zeros = F.array_repeat(F.lit(0), length)
    return {
        "input_ids": F.concat(F.array(F.lit(START_TOKEN), F.lit(SEPARATOR_TOKEN)), pad),
        "token_type_ids": zeros,
        "attention_mask": F.concat(F.array(F.lit(1), F.lit(1)), F.array_repeat(F.lit(0), length - 2)),
    }


def hot_index(flags: Column) -> Column:
    """Zero-based index of the largest flag, the first one on ties; NULL counts as 0."""
    filled = F.transform(flags, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return (F.array_position(filled, F.array_max(filled)) - 1).cast("int")


def code_of(value: Column, categories: list[float], column: str) -> Column:
    """Position of ``value`` in the fitted categories; an unseen value is an error."""
    known = F.array(*[F.lit(float(c)) for c in categories])
    position = F.array_position(known, value.cast("double"))
    failure = F.raise_error(
        F.concat(F.lit(f"unseen categorical value in {column}: "), value.cast("string"))
    ).cast("int")
    return F.when(position > 0, (position - 1).cast("int")).otherwise(failure)
