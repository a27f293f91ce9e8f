"""Column functions on candidate scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASS_LIMIT = 1 + 1e-6


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def fault(answer: Column, top_prob: Column, p_yes: Column, mass_yes: Column, mass_no: Column) -> Column:
    """First reason for which a score can't be used, in the order of the checks; null if there is none."""
    finite = is_finite(mass_yes) & is_finite(mass_no) & is_finite(p_yes) & is_finite(top_prob)
    mass = mass_yes + mass_no
    return (
        F.when(~finite, "non-finite value").when((mass_yes < 0) | (mass_no < 0), "negative mass")
        .when((mass <= 0) | (mass > MASS_LIMIT), "mass out of range").when((top_prob < 0) | (top_prob > 1), "probability out of range")
        .when(~F.coalesce(answer.isin("yes", "no"), F.lit(False)), "neither yes nor no")
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null, never 0, where whole is 0."""
    return part / F.when(whole != 0, whole)


def yes_share(mass_yes: Column, mass_no: Column) -> Column:
    return ratio(mass_yes, mass_yes + mass_no)


def file_in(path: Column, folder: str) -> Column:
    """The path with another folder and the same file name."""
    return F.concat(F.lit(folder + "/"), F.substring_index(path, "/", -1))


def shown(x: Column, digits: int = 3) -> Column:
    return F.when(x.isNull(), "undefined").when(~is_finite(x), "nan").otherwise(F.format_string(f"%.{digits}f", x))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text of string fields with sorted keys and blanks after separators, byte for byte."""
    parts = [F.concat(F.lit(f'"{k}": '), F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


#: Spellings of the two answers.
ANSWERS = {"yes": ("Yes", "yes", "YES", " Yes", " yes", " YES"), "no": ("No", "no", "NO", " No", " no", " NO")}


def single_tokens(encode, answers: dict[str, tuple[str, ...]] = ANSWERS) -> dict[str, list[int]]:
    """Ids of the spellings that encode() makes one token of, for each answer; no id may stand for two answers."""
    found = {name: sorted({ids[0] for x in spelt if len(ids := list(encode(x))) == 1}) for name, spelt in answers.items()}
    every = [i for ids in found.values() for i in ids]
    if len(every) != len(set(every)):
        raise ValueError("a token stands for two answers")
    return found


def token_class(top: Column, tokens: dict[str, list[int]]) -> Column:
    """The answer that a token id stands for, or other."""
    out = F
    for name, ids in tokens.items():
        out = out.when(top.isin(*ids), name)
    return out.otherwise("other")


def without_suffix(text: Column, suffix: str) -> Column:
    return F.when(F.endswith(text, F.lit(suffix)), F.left(text, F.length(text) - len(suffix))).otherwise(text)


def list_literal(text: Column) -> Column:
    """Strings of a list in Python's notation, in single or double quotes with backslash escapes; null if it is none."""
    one = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
    found = F.regexp_extract_all(text, F.lit(one), F.lit(0))
    plain = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
    return F.when(F.rlike(text, F.lit(rf"^\[\s*(?:(?:{one})(?:\s*,\s*(?:{one}))*)?\s*\]$")), F.transform(found, plain))
