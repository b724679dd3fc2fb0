"""Text expressions: all JVM-side columns, save for Unicode normal forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values.
BODY_MARK = "正文："
EMBEDDING_SKIPPED = ("车型：", "手册版本：")
CONTENT_TAGS = (
    ("safety", "安全|警告|危险|碰撞|气囊|儿童"),
    ("operation", "开启|关闭|使用|操作|设置|调节|解锁|锁止"),
    ("driving", "驾驶|行驶|制动|泊车|方向盘|辅助驾驶"),
    ("energy", "充电|电池|电量|续航|能耗"),
    ("maintenance", "保养|维护|检查|轮胎|清洁|故障"),
    ("comfort", "座椅|空调|后视镜|车窗|娱乐|音响"),
)
SENTENCE_ENDS = "(?<=[。！？；])"
QUERY_MARKS = "[，。！？；：、,.!?;:]+"


def squeeze(text: Column) -> Column:
    """Unicode white space (line separators too) to single spaces, trimmed."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """CJK characters, bigrams of all CJK characters in a row, and [a-z0-9]+ words, lower-cased.

    Null gives no tokens. Bigrams bridge whatever stands between two CJK characters.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    chars = F.regexp_extract_all(low, F.lit("([一-鿿])"), F.lit(1))
    pairs = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    words = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))
    # texts without CJK characters are read twice and not four times
    return F.when(low.rlike("[一-鿿]"), F.concat(chars, F.filter(pairs, lambda x: x.isNotNull()), words)).otherwise(words)


def body(text: Column) -> Column:
    """What follows the body mark; the whole text without one; stripped."""
    at = F.instr(text, BODY_MARK)
    return strip(F.when(at > 0, F.substring(text, at + len(BODY_MARK), F.length(text))).otherwise(text))


def embedding_text(text: Column) -> Column:
    """The text without vehicle and version lines."""
    kept = F.filter(F.split(text, r"\R"), lambda x: ~F.startswith(x, F.lit(EMBEDDING_SKIPPED[0])) & ~F.startswith(x, F.lit(EMBEDDING_SKIPPED[1])))
    return F.array_join(kept, "\n")


def reference_body(text: Column, limit: int = 700) -> Column:
    """The body, cut at the last sentence end in the limit if that keeps half of it."""
    whole, head = body(text), F.substring(body(text), 1, limit)
    last = F.greatest(*(F.when(F.instr(head, c) > 0, F.length(head) - F.instr(F.reverse(head), c) + 1).otherwise(0) for c in ("。", "；", "\n")))
    cut = F.when(last - 1 >= limit // 2, strip(F.substring(head, F.lit(1), last))).otherwise(F.concat(F.regexp_replace(head, r"(?U)\s+$", ""), F.lit("…")))
    return F.when(F.length(whole) <= limit, whole).otherwise(cut)


def content_tag(text: Column, tags=CONTENT_TAGS) -> Column:
    """The first of the ordered tags whose pattern is found, else general."""
    out = F.lit("general")
    for name, pattern in reversed(tags):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC: the JVM functions have none."""
    return text.str.normalize("NFKC")


def normalized(text: Column, unicode_form: bool = True) -> Column:
    """NFKC, lower case, punctuation to spaces, white space squeezed."""
    text = nfkc(text) if unicode_form else text
    return squeeze(F.regexp_replace(F.lower(text), QUERY_MARKS, " "))


def aliased(text: Column, aliases: dict[str, str]) -> Column:
    """Ordered, cascading, case-insensitive literal replacements; targets are regex templates."""
    for source, target in aliases.items():
        text = F.regexp_replace(text, r"(?iu)\Q" + source.replace(r"\E", r"\E\\E\Q") + r"\E", target)
    return text


def expanded(text: Column, terms: dict[str, list[str]]) -> Column:
    """Synonyms of the terms found case-insensitively are appended; order-preserving dedupe."""
    parts = F.array(text)
    for term, more in terms.items():
        found = F.contains(F.lower(text), F.lower(F.lit(term)))
        parts = F.when(found, F.concat(parts, F.array(*map(F.lit, more)))).otherwise(parts)
    return F.array_join(F.array_distinct(parts), " ")
