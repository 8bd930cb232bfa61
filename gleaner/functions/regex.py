"""Keyword patterns of the .NET dialect as patterns of Java or of the `regex` module."""

from __future__ import annotations

import logging
import re

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..spec import SpecError
from .patterns import quick, tokens

TIMEOUT_S = 5.0
log = logging.getLogger("gleaner.regex")


def java_pattern(pattern: str, case_sensitive: bool) -> str:
    """The pattern for rlike: Unicode classes, only line feed ends a line, and Unicode case folding if case is ignored.

    Names of groups, and references to them, lose the underscores, which Java does not allow; classes and escapes stay as they are.
    """

    def java(token: str) -> str:
        name = re.fullmatch(r"(\(\?|\\k)<([A-Za-z_]\w*)>", token)
        return f"{name[1]}<{plain_name(name[2])}>" if name else token

    return f"(?{'' if case_sensitive else 'iu'}dU)" + "".join(map(java, tokens(pattern)))


def plain_name(name: str) -> str:
    return "g" + "".join(c if c.isascii() and c.isalnum() and c != "Z" else f"Z{ord(c):x}Z" for c in name)


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether Java accepts the pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError):  # PatternSyntaxException is an illegal argument
        return False
    return True


def _module_pattern(pattern: str, case_sensitive: bool):
    """The pattern for the `regex` module, which spells references to named groups in its own way."""
    import regex

    pattern = "".join(re.sub(r"^\\k[<'](\w+)[>']$", r"(?P=\1)", x) for x in tokens(pattern))
    return regex.compile(pattern, regex.VERSION0 | regex.UNICODE | (0 if case_sensitive else regex.IGNORECASE))


def search_within(compiled, text: str, timeout_s: float) -> bool:
    """Whether the pattern is found in time."""
    try:
        return compiled.search(text, timeout=timeout_s) is not None
    except TimeoutError:
        log.warning("the pattern %r took more than %s s on a text of %d characters, which counts as no match", compiled.pattern, timeout_s, len(text))
        return False


def timed_match(content: Column, pattern: str, case_sensitive: bool, timeout_s: float = TIMEOUT_S) -> Column:
    """Match by the `regex` module in Arrow batches; a call of more than timeout_s counts as no match and is logged."""

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        compiled = _module_pattern(pattern, case_sensitive)

        return values.map(lambda v: None if v is None else search_within(compiled, v, timeout_s)).astype("boolean")

    return found(content)


def regex_match(spark: SparkSession, content: Column, pattern: str, case_sensitive: bool, timeout_s: float | None = None) -> Column:
    """Predicate for a pattern anywhere in the content, with a limit of time for each call where it could take long.

    Java's engine, which knows no limit, where it accepts the pattern, the pattern is quick and no limit is asked for.
    """
    java = java_pattern(pattern, case_sensitive)
    if timeout_s is None and quick(pattern, case_sensitive) and compiles(spark, java):
        return content.rlike(java)
    return timed_match(content, pattern, case_sensitive, timeout_s or TIMEOUT_S)


def validate(spark: SparkSession, keywords: list[str], case_sensitive: bool) -> None:
    """Refuse patterns that no engine here accepts, before any file is read."""
    import regex

    for k in keywords:
        if quick(k, case_sensitive) and compiles(spark, java_pattern(k, case_sensitive)):
            continue
        try:
            _module_pattern(k, case_sensitive)
        except regex.error as e:
            raise SpecError(f"the keyword {k!r} is not a valid pattern: {e}") from None
