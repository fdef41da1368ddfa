"""Name normalization, anchors and signatures."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes and characters that normalizing removes.
_SUFFIX = re.compile(r"\b(?:jr|sr)\.?$")
_OTHER = re.compile(r"[^a-z0-9]+")
#: Entries a worker keeps before it forgets them all.
_MEMORY = 200_000


def normalized(value: str | None) -> str:
    """Accents, case, a trailing jr or sr and everything but letters and digits removed; null becomes empty."""
    text = unicodedata.normalize("NFKD", value or "")
    text = "".join(ch for ch in text if not unicodedata.combining(ch)).casefold()
    return _OTHER.sub(" ", _SUFFIX.sub("", text.replace("’", "'")).strip()).strip()


def normalize_name(c: str | Column) -> Column:
    """Column form of ``normalized``: Arrow batches, each distinct name worked once a worker."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        known: dict[str | None, str] = {}
        out = []
        for x in names:
            y = known.get(x)
            if y is None:
                if len(known) > _MEMORY:
                    known.clear()
                y = known[x] = normalized(x)
            out.append(y)
        return pd.Series(out, dtype=object)

    return run(F.col(c) if isinstance(c, str) else c)


def pair_key(a: str | Column, b: str | Column) -> Column:
    """Unordered key of two texts."""
    a, b = [F.col(x) if isinstance(x, str) else x for x in (a, b)]
    return F.concat_ws("||", F.array_sort(F.array(a, b)))


def name_tokens(norm: Column) -> Column:
    """The words of a normalized name."""
    return F.filter(F.split(norm, " "), lambda w: w != "")


def full_anchor(norm: Column) -> Column:
    """The last word of a full name; empty if there is none."""
    return F.coalesce(F.try_element_at(name_tokens(norm), F.lit(-1)), F.lit(""))


def short_surnames(norm: Column) -> Column:
    """The surname words of a short name: all but its trailing words of one or two letters, or all but the last."""
    words = name_tokens(norm)
    # Words up to the last one longer than two letters.
    keep = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), F.lit(0), lambda a, i: F.when(F.length(F.try_element_at(words, i)) > 2, i).otherwise(a))
    short = F.when(keep > 0, F.slice(words, F.lit(1), keep)).otherwise(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    return F.when(F.size(short) > 0, short).otherwise(F.slice(words, 1, 1))


def short_anchor(norm: Column) -> Column:
    """The last surname word of a short name; empty if there is none."""
    return F.coalesce(F.try_element_at(short_surnames(norm), F.lit(-1)), F.lit(""))


def short_signature(norm: Column) -> Column:
    """``surname words::initial`` of a short name: all but the last word, and that word's first letter."""
    words = name_tokens(norm)
    n = F.size(words)
    return F.when(n < 2, F.concat(norm, F.lit("::"))).otherwise(
        F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))), " "), F.lit("::"), F.substring(F.try_element_at(words, F.lit(-1)), 1, 1))
    )


def full_signatures(norm: Column, longest: int = 4) -> Column:
    """The signatures a full name may have in short form: each ending of up to ``longest`` words with the first initial."""
    words = name_tokens(norm)
    n = F.size(words)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(longest)), F.lit(1))), lambda k: F.array_join(F.slice(words, F.greatest(n - k + 1, F.lit(1)), k), " "))
    return F.when(n > 0, F.array_distinct(F.transform(ends, lambda e: F.concat(e, F.lit("::"), F.substring(words[0], 1, 1))))).otherwise(F.array().cast("array<string>"))
